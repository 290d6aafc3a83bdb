"""Whitening of embeddings from exact whole-number statistics: bit-sliced scatter, centred before eigh.

Every entry c becomes the whole number x = floor(64 c) + 1000000. One pass gets n and each
dimension's sum, minimum and maximum. The second one shifts each dimension by its minimum
and packs every bit of it across the rows of a chunk into 64-bit words, a plane a bit. The
sum of the products of two dimensions is then the sum over pairs of their planes of
2^(b + b') * popcount(plane AND plane'), exact. Only those sums leave a task: dims * (dims + 1) / 2
decimals, added up by Spark. The driver gets one row per pair of dimensions, whatever the
number of vectors, centres them as whole numbers (n * sum of products - product of sums) and
calls eigh on the quotients, so that no double has rounded before the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .vectors import scaled, usable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
PLANE_BYTES = 32 << 20  # of the planes of one chunk of rows


@dataclass(frozen=True)
class Whitening:
    """n vectors with per-dimension sums of x and the range of x, eigenvalues in falling order, unit eigenvectors as columns, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def rank(self) -> int:
        """Components whose variance is not lost in rounding."""
        return int((self.values > max(self.values.max(initial=0), 0) * len(self.sums) * np.finfo(float).eps).sum())

    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0) / self.trace if self.trace > 0 else np.zeros(len(self.values))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, n, sum, low, high) of a task; dim -1 counts the vectors. The entries that shorter vectors lack are added on the driver."""
    n, found = 0, {}
    for batch in batches:
        x, lengths = scaled(batch.column(0), SCALE)
        n += len(x)
        for d in range(x.shape[1]):
            own = x[lengths > d, d] + SHIFT
            halves = (int((own >> 26).sum()) << 26) + int((own & ((1 << 26) - 1)).sum())
            k, s, low, high = found.get(d, (0, 0, 2**62, -(2**62)))
            found[d] = (k + len(own), s + halves, min(low, int(own.min())), max(high, int(own.max())))
    rows = [(-1, n, 0, 0, 0), *((d, *v) for d, v in found.items())]
    dim, k, s, low, high = zip(*rows)
    yield pa.RecordBatch.from_arrays([pa.array(dim, pa.int32()), pa.array(k, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0)), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["dim", "n", "sum", "low", "high"])


def planes(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """A row of 64-bit words for each bit of each dimension: bit r of the plane is that of row r."""
    n, words = len(shifted), -(-len(shifted) // 64)
    out = np.zeros((sum(bits), words * 8), dtype=np.uint8)
    at = 0
    for d, width in enumerate(bits):
        for b in range(width):
            packed = np.packbits(((shifted[:, d] >> b) & 1).astype(np.uint8), bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    assert n <= words * 64
    return out.view(np.uint64)


def scatter(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sums of products of each two dimensions (upper triangle), by popcounts of the ANDs of their planes."""
    packed, dims = planes(shifted, bits), len(bits)
    starts = np.concatenate([[0], np.cumsum(bits)])
    weights = np.array([1 << b for width in bits for b in range(width)], dtype=object if max(bits, default=0) > 30 else np.int64)
    out = np.zeros((dims, dims), dtype=object if 2 * max(bits, default=0) + 20 > 62 else np.int64)
    for i in range(dims):
        for b in range(bits[i]):
            counts = np.bitwise_count(packed[starts[i] :] & packed[starts[i] + b]).sum(axis=1, dtype=np.int64)
            weighted = np.concatenate([[0], np.cumsum(counts * weights[starts[i] :])])
            ends = starts[i:] - starts[i]
            out[i, i:] += (weighted[ends[1:]] - weighted[ends[:-1]]) * (1 << b)
    return out


def _scatters(low: list[int], bits: list[int]):
    dims = len(low)
    most = max(4096, min(65536, PLANE_BYTES * 8 // max(1, sum(bits)) // 64 * 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = None, [], 0

        def flush():
            nonlocal total, held, n
            if n:
                part = scatter(np.concatenate(held), bits).astype(object)  # whole numbers of any size from here on
                total = part if total is None else total + part
            held, n = [], 0

        for batch in batches:
            x, _ = scaled(batch.column(0), SCALE)
            y = np.zeros((len(x), dims), dtype=np.int64)
            y[:, : x.shape[1]] = x
            y += SHIFT - np.array(low, dtype=np.int64)
            for k in range(0, len(y), most):
                piece = y[k : k + most]
                if n + len(piece) > most:
                    flush()
                held.append(piece)
                n += len(piece)
        flush()
        if total is not None:
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "products"])

    return run


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening:
    """The whitening of all usable vectors, from three passes' worth of sums that do not grow with the rows."""
    ship(vectors.sparkSession)
    own = vectors.where(usable(column)).select(F.col(column).cast("array<double>").alias("v"))
    totals = own.mapInArrow(_totals, "dim int, n long, sum decimal(38,0), low long, high long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = {r.dim: r for r in totals.collect()}  # a row per dimension
    n, dims = (rows[-1].n if rows else 0), len(rows) - 1
    if n == 0 or dims <= 0:
        return Whitening(n, (), (), (), np.zeros(0), np.zeros((0, 0)), 0.0)
    lacking = lambda d: n - rows[d].n  # noqa: E731  vectors without this entry: c = 0
    sums = [int(rows[d].sum) + lacking(d) * SHIFT for d in range(dims)]
    low = [min(rows[d].low, SHIFT) if lacking(d) else rows[d].low for d in range(dims)]
    high = [max(rows[d].high, SHIFT) if lacking(d) else rows[d].high for d in range(dims)]
    bits = [(b - a).bit_length() for a, b in zip(low, high)]
    sent = own.mapInArrow(_scatters(low, bits), "i int, j int, products decimal(38,0)").groupBy("i", "j").agg(F.sum("products").alias("products"))
    centred = np.zeros((dims, dims), dtype=object)
    shifted = [s - n * a for s, a in zip(sums, low)]
    for r in sent.collect():  # a row per pair of dimensions
        centred[r.i, r.j] = centred[r.j, r.i] = n * int(r.products) - shifted[r.i] * shifted[r.j]
    covariance = np.array([[c / (n * n) for c in row] for row in centred], dtype=float)  # whole numbers divide with one rounding
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1], found[:, ::-1]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(dims)])
    return Whitening(n, tuple(sums), tuple(low), tuple(high), values, found * signs, sum(centred[d, d] for d in range(dims)) / (n * n))


def _projected(model: Whitening, components: int):
    """A function from a batch of vectors to (n * x - sums, whitened)."""
    dims, rank = len(model.sums), min(components, model.rank())
    small = max((model.n * (b - a) for a, b in zip(model.low, model.high)), default=0) < 2**62
    base = np.array(model.sums, dtype=object) - model.n * SHIFT
    matrix = model.vectors[:, :rank] / np.sqrt(model.values[:rank])
    n, squares_fit = model.n, sum((model.n * (b - a)) ** 2 for a, b in zip(model.low, model.high)) < 2**63

    def run(lists: pa.Array):
        x, _ = scaled(lists, SCALE)
        y = np.zeros((len(x), dims), dtype=np.int64 if small else object)
        y[:, : x.shape[1]] = x
        apart = y * n - (base.astype(np.int64) if small and all(abs(b) < 2**63 for b in base) else base)
        wide = apart if squares_fit else apart.astype(object)
        deviation = (wide * wide).sum(axis=1)
        if not squares_fit and any(v >= 2**63 for v in deviation):
            raise ValueError("a deviation does not fit into a long")
        return deviation.astype(np.int64), (apart.astype(float) / n) @ matrix

    return run


def transform(vectors: DataFrame, model: Whitening, column: str = "embedding", components: int = COMPONENTS, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """`keep` columns of usable vectors with deviation (long) and whitened (array of doubles, null where a component has no variance)."""
    ship(vectors.sparkSession)
    wide = min(components, len(model.sums))
    project = _projected(model, components)
    own = vectors.where(usable(column)).select(*keep, F.col(column).cast("array<double>").alias("__v"))
    fields = ", ".join(f"`{c}` {t}" for c, t in own.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, w = project(batch.column(len(keep)))
            padded = np.full((len(w), wide), np.nan)
            padded[:, : w.shape[1]] = w
            flat = pa.array(padded.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * wide, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(deviation, pa.int64()), lists], [*keep, "deviation", "whitened"])

    return own.mapInArrow(run, f"{fields + ', ' if keep else ''}deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding", components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over the components with variance: measured on all vectors."""
    ship(vectors.sparkSession)
    rank = min(components, model.rank())
    if not rank:
        return None
    project = _projected(model, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moment = 0, np.zeros(rank), np.zeros((rank, rank))
        for batch in batches:
            w = project(batch.column(0))[1]
            if len(w):
                own = w.mean(axis=0)
                moment += (w - own).T @ (w - own) + np.outer(own - mean, own - mean) * (n * len(w) / (n + len(w)))
                mean += (own - mean) * len(w) / (n + len(w))
                n += len(w)
        i, j = np.triu_indices(rank)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array((moment + n * np.outer(mean, mean))[i, j])], ["i", "j", "moment"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank), pa.int32()), pa.array(np.full(rank, -1), pa.int32()), pa.array(n * mean)], ["i", "j", "moment"])

    own = vectors.where(usable(column)).select(F.col(column).cast("array<double>").alias("v"))
    rows = {(r.i, r.j): r.moment for r in own.mapInArrow(run, "i int, j int, moment double").groupBy("i", "j").agg(F.sum("moment").alias("moment")).collect()}  # a row per pair of components
    mean = [rows[i, -1] / model.n for i in range(rank)]
    return max(abs(rows[i, j] / model.n - mean[i] * mean[j] - (i == j)) for i in range(rank) for j in range(i, rank))


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out. Entries that a
    vector lacks beside longer ones count as c = 0 (an empty vector lacks all). Repeated
    rows, and rows without a vec_id, are vectors of their own. A component without variance
    has whitened null and explained 0; with no component that has any, identity_error is
    null. No usable vector, or only empty ones: no rows. Other columns are ignored. An entry
    of 2^47 or more, and a deviation beyond a long, are refused. Signs are fixed: the largest entry of each eigenvector is
    positive, the first of equal ones decides.
    """
    model = fit(vectors, column)
    explained = model.explained()[:components]
    out = transform(vectors.select("vec_id", column), model, column, components)
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e)) for e in explained]) if len(explained) else F.array(F.lit(0.0))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(identity_error(vectors, model, column, components)).cast("double").alias("identity_error"),
    )
