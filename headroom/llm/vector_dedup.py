"""Embedding near-dedup: every pair within the cosine asked for, between cells that a bound cannot rule out.

1. Cluster centres are fitted on a bounded sample. Each vector has a home cell, that of
   its nearest centre. Cells above BLOCK_BYTES are cut into blocks.
2. A vector is dealt to every block of every cell that may hold a partner of it. Two
   bounds rule a cell out: the angle to its centre exceeds the cell's radius by more than
   the angle asked for, or the vector lies farther than that angle from the half space in
   which the cell's centre is nearer than the vector's own. Neither loses a pair.
3. Two blocks meet in one task, where all pairs are compared, in double precision. A pair
   of vectors meets in just one task and counts there for both, so that counts are
   symmetric and no pair leaves the task; what does is a spanning forest of the links.
4. Recall is audited against brute force for a bounded set of query vectors.

Copies are merged first: only distinct directions take part, with the number of vectors
they stand for. No approximate graph is searched: any such search can lose links. Where
vectors lie in clusters the bounds leave few cells; where they fill the sphere evenly the
work is that of all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, partitions, written
from .near_dup import whole_groups

BLOCK_BYTES = 1 << 24  # of the vectors of a block; a cell has half of it on average, up to CENTRES cells
SAMPLE = 32_768
CENTRES = 8192  # one for each half block of vectors, and for four of the sample at most
SLICE = 256  # rows compared with a block at once
ROUNDING = 1e-9  # far above the error of a product of unit vectors
AUDIT = 200


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        step = max(64, (1 << 22) // k)
        near = np.concatenate([(sample[i : i + step] @ centres.T).argmax(1) for i in range(0, len(sample), step)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        empty = norm < 1e-9
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = unit_rows(total)
    return centres


def _homes(centres: np.ndarray):
    """Each vector's cell and its cosine with the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo in range(0, batch.num_rows, 1024):
                rows = batch.slice(lo, 1024)
                sim = _matrix(rows.column("unit")) @ centres.T
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sim.argmax(1)), pa.array(sim.max(1))], names=[*rows.schema.names, "cell", "inner"])

    return run


def possible(x: np.ndarray, home: np.ndarray, centres: np.ndarray, least: np.ndarray, cosine: float) -> np.ndarray:
    """Which cells (columns) may hold a vector within `cosine` of each row of `x`; `least` is each cell's smallest cosine with its centre."""
    sim = x @ centres.T
    if cosine <= 0:
        return np.ones(sim.shape, bool)
    angle = np.arccos(min(cosine, 1.0))
    radius = np.arccos(np.clip(least - ROUNDING, -1, 1))
    near = sim >= np.cos(np.minimum(radius + angle, np.pi)) - 1e-6
    # a cell's vectors lie on its side of the plane midway between its centre and the row's own
    apart = np.sqrt(np.maximum(2 - 2 * (centres[home] @ centres.T), 0))
    beyond = sim[np.arange(len(x)), home][:, None] - sim
    near &= beyond <= (np.sin(angle) + 1e-6) * apart + 1e-6
    near[np.arange(len(x)), home] = True
    return near


def _deal(centres: np.ndarray, least: np.ndarray, first: np.ndarray, cosine: float):
    """A row for each block that a vector has to meet: part names the two blocks, side which of them is its own (0: both)."""
    total = int(first[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                rows = batch.slice(lo, 1024)
                home, own = rows.column("cell").to_numpy(), rows.column("block").to_numpy()
                own = own + first[home]
                cells = possible(_matrix(rows.column("unit")), home, centres, least, cosine)
                at, other = np.nonzero(np.repeat(cells, np.diff(first), axis=1))
                mine = own[at]
                part = np.maximum(mine, other) * total + np.minimum(mine, other)
                side = np.where(mine == other, 0, np.where(mine > other, 1, 2)).astype(np.int32)
                for i in range(0, len(at), 8192):
                    picked = rows.select(["node", "unit", "copies"]).take(pa.array(at[i : i + 8192]))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(part[i : i + 8192]), pa.array(side[i : i + 8192])], names=["node", "unit", "copies", "part", "side"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unit vector of each usable row as bytes, null for the others."""
    for batch in batches:
        column = batch.column(1)
        out = []
        for i in range(len(column)):
            v = column[i]
            got = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                a = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(a).max()
                if np.isfinite(top) and top > 0:
                    a = a / top
                    got = (a / np.linalg.norm(a) + 0.0).tobytes()
            out.append(got)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _compare(cosine: float):
    """Per part: counts of the links of its vectors (other is the node itself), and a spanning forest of these links (links is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["part"], 1):
            part, node, copies, side = (table.column(c).to_numpy() for c in ("part", "node", "copies", "side"))
            x = _matrix(table.column("unit"))
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(x)], strict=True):
                left = np.flatnonzero(side[lo:hi] != 2) + lo
                right = np.flatnonzero(side[lo:hi] != 1) + lo
                if not len(left) or not len(right):
                    continue
                within = side[lo] == 0  # a block with itself: both orders of a pair are met
                g, weight = x[right], copies[right]
                links, forest = np.zeros(len(x), np.int64), _Forest(len(x))
                for i in range(0, len(left), SLICE):
                    ask = left[i : i + SLICE]
                    sim = x[ask] @ g.T
                    a, b = np.nonzero(sim >= cosine - ROUNDING)
                    ok = _verdict(sim, x[ask], g, a, b, cosine)
                    ok &= node[ask[a]] != node[right[b]]
                    a, b = a[ok], b[ok]
                    np.add.at(links, ask[a], weight[b])
                    if not within:
                        np.add.at(links, right[b], copies[ask[a]])
                    a, b = forest.grow(ask[a], right[b])
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(np.zeros(len(a), np.int64)), pa.array(node[b])], names=["node", "links", "other"])
                got = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(links[got]), pa.array(node[got])], names=["node", "links", "other"])

    return run


def _verdict(sim: np.ndarray, x: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs reach the cosine: those within rounding of it are summed anew, in one fixed order."""
    ok = sim[a, b] >= cosine + ROUNDING
    for i in np.array_split(np.flatnonzero(~ok), max(1, int((~ok).sum()) >> 14)):
        ok[i] = np.einsum("id,id->i", x[a[i]], g[b[i]]) >= cosine
    return ok


class _Forest:
    """Which links of a part join what no earlier one has joined."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def grow(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = self.parent[a] != self.parent[b]
        a, b = a[new], b[new]
        if not len(a):
            return a, b
        # each b with its first a, then each a once with every such first one: these join all that the links join
        _, one, back = np.unique(b, return_index=True, return_inverse=True)
        _, two = np.unique(a * len(self.parent) + a[one][back], return_index=True)
        some = np.union1d(one, two)
        a, b = a[some], b[some]
        parent = dict(zip((labels := np.unique(self.parent[np.concatenate([a, b])])).tolist(), labels.tolist(), strict=True))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        keep = []
        for k, (i, j) in enumerate(zip(self.parent[a].tolist(), self.parent[b].tolist(), strict=True)):
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
                keep.append(k)
        root = np.arange(len(self.parent))
        root[labels] = [find(i) for i in labels.tolist()]
        self.parent = root[self.parent]
        return a[keep], b[keep]


def links_found(nodes: DataFrame, cosine: float, block: int | None = None) -> DataFrame:
    """(node, links, other): how many vectors of other nodes are linked (0 in rows that only carry a link), and a link.

    `block` is the number of vectors of a block, set by BLOCK_BYTES if not given.
    """
    total = nodes.count()
    width = nodes.select(F.length("unit")).first()[0]
    block = block or max(256, BLOCK_BYTES // width)
    share = min(1.0, SAMPLE / total)
    place = F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) / float(1 << 30)
    sample = _matrix(nodes.where(place < share).select("unit").toArrow()["unit"])  # about SAMPLE vectors, whatever the table's size
    if not len(sample):
        sample = _matrix(nodes.select("unit").limit(1).toArrow()["unit"])
    sample = sample[np.lexsort(sample.T[:3])]
    centres = fit_centres(sample, int(min(CENTRES, max(1, len(sample) // 4), max(1, 2 * total // block))))
    schema = T.StructType([*nodes.schema.fields, T.StructField("cell", T.LongType()), T.StructField("inner", T.DoubleType())])
    homes = written(nodes.mapInArrow(_homes(centres), schema), "homes")
    size, least = np.zeros(len(centres), np.int64), np.ones(len(centres))
    for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("inner").alias("least")).collect():  # at most CENTRES rows
        size[r["cell"]], least[r["cell"]] = r["n"], r["least"]
    blocks = -(-size // block)  # an empty cell has none
    first = np.concatenate([[0], np.cumsum(blocks)])
    per_cell = F.get(F.array(*[F.lit(int(v)) for v in blocks]), F.col("cell").cast("int"))
    homes = homes.select("node", "unit", "copies", "cell", F.pmod(F.xxhash64("unit"), per_cell).cast("long").alias("block"))
    rows = homes.mapInArrow(_deal(centres, least, first, cosine), "node long, unit binary, copies long, part long, side int")
    rows = rows.repartition(partitions(nodes), "part").sortWithinPartitions("part", "side", "node")
    return rows.mapInArrow(_compare(cosine), "node long, links long, other long")


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9, **options) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding): n_links, component_id and kept.

    Vectors that are null, empty, zero, or hold null or non-finite components, link with
    nothing. Vectors of unlike length are compared only with their own kind. Rows with a
    null vec_id, or a repeated one, are separate vectors that share that id; a null id is
    the largest. Other columns are ignored, and an empty table gives no rows.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = written(base.mapInArrow(_normalised, "vec_id long, unit binary"), "vectors")
    # equal directions are one node: its smallest id stands for it
    key = F.coalesce("vec_id", F.lit(2**63 - 1))
    nodes = rows.where("unit is not null").groupBy("unit").agg(F.min(key).alias("node"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("width", F.length("unit")), "nodes")
    found = None
    for r in nodes.groupBy("width").count().collect():  # one row per vector length
        part = links_found(nodes.where(F.col("width") == r["width"]).drop("width"), cosine, **options)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "member")
    nodes = nodes.join(counts, "node", "left").join(labels, F.col("node") == F.col("member"), "left")
    nodes = nodes.select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(nodes, "unit", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("component"), key).alias("component"))
    last = F.col("component") == 2**63 - 1
    return out.select("vec_id", "n_links", F.when(~last, F.col("component")).alias("component_id"), (F.col("component") == key).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, cosine: float = 0.9, queries: int = AUDIT) -> tuple[int, int]:
    """(links found, links there) of about `queries` vectors, by brute force of these against all rows."""
    total = max(vectors.count(), 1)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_normalised, "vec_id long, unit binary").where("unit is not null")
    asked = rows.where(part < min(1.0, queries / total)).toArrow()
    ids, q = asked["vec_id"].to_numpy(), _matrix(asked["unit"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(q):
                hit = (q @ _matrix(batch.column(1)).T >= cosine).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit)], names=["vec_id", "n"])

    there = rows.mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    r = result.join(F.broadcast(there), "vec_id").agg(F.sum(F.least("n_links", "n")), F.sum("n")).first()
    return int(r[0] or 0), int(r[1] or 0)
