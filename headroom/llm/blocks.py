"""Windows that start in several places, found through minimizer blocks.

A window is `window` consecutive symbols (words or bytes) of one document. Its minimizer
is its `anchor`-gram with the smallest hash, the leftmost of equals: equal windows have
equal minimizers at equal distances. The windows of a document that share a minimizer
occurrence are consecutive and form a block; a document of n symbols has about
2 n / (window - anchor + 2) blocks instead of n windows, and only these leave the scan.

1. Blocks are dealt by their minimizer. Equal blocks meet there: all but the first are
   repeats, window by window. A minimizer with one distinct block is done.
2. Where a minimizer has several distinct blocks, their windows are compared one by one,
   with the documents' own symbols.

A minimizer that would fill a partition (known from a bounded sample of documents) is
not dealt as such: its windows are dealt one by one by their own content, and a task
sends each content once, so that no group is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .common import partitions, written

SHIFT = 128  # a block's place is first window * SHIFT + number of windows
SAMPLE_DOCUMENTS = 8192
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Shape:
    window: int
    anchor: int
    symbols: Symbols  # texts -> (first hash value of each symbol, an independent second one, offsets)

    def __post_init__(self):
        if self.width >= SHIFT:
            raise ValueError(f"a block of up to {self.width} windows does not fit its place, which counts to {SHIFT - 1}")

    @property
    def width(self) -> int:
        return self.window - self.anchor + 1


def byte_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = K.utf8(texts)
    return K.BYTE[raw], K.BYTE2[raw], offsets


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = K.utf8(texts)
    starts, ends, words = K.word_spans(raw, offsets)
    hashes = K.word_hashes(raw, starts, ends)
    return hashes, K.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), words


def _plain_ids(docs: DataFrame) -> bool:
    """Whether doc_id is whole, unique and not null, so that it can serve as a key."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    return not ids.where("n > 1 or doc_id is null or doc_id < 0").limit(1).count()


def row_keys(docs: DataFrame, name: str) -> DataFrame:
    """`docs` (doc_id, text and others) with a unique long column `name` in document order.

    The key is doc_id itself where ids are whole, unique and not null. Else rows are
    numbered in the order of doc_id (null last) and text, so that a repeated row is a
    later document.
    """
    if _plain_ids(docs):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = docs.repartitionByRange(partitions(docs), *order[:2]).sortWithinPartitions(*order)
    return written(ranged.withColumn(name, F.monotonically_increasing_id()), "ordered")


def ordered_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(key, doc_id, text) of `docs`, see `row_keys`; whether the key is doc_id."""
    docs = docs.select("doc_id", "text")
    if _plain_ids(docs):
        return docs.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text"), True
    return row_keys(docs, "key").select("key", "doc_id", "text"), False


def _blocks(values, second, offsets, shape: Shape):
    """For each block: text, first window, number of windows, place of its minimizer, and hashes (minimizer, block)."""
    first, other = K.prefix_hash(values), K.prefix_hash(second)
    grams = K.ngram_hashes(first, shape.anchor)
    least = K.window_argmin(grams, shape.width)
    count = np.maximum(np.diff(offsets) - shape.window + 1, 0)
    total = int(count.sum())
    if not total:
        return None
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    low = least[at]
    cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(cut, total))
    start, low = at[cut], low[cut]
    whole = K.span_hash(other, start, start + n + shape.window - 1) + (low - start).astype(np.uint64) * np.uint64(K.BASE)
    return doc[cut], start, n, grams[low], whole, first, other


ROW = "gram long, block long, key long, pos long"
SOURCE_ROW = f"{ROW}, src_key long, src_pos long"
NODE_ROW = f"{SOURCE_ROW}, u long, v long"


def emit(shape: Shape, hot: np.ndarray, same_document: bool, nodes: bool = False):
    """The blocks of (key, text) rows as SOURCE_ROW, where src is the earlier place that a block repeats if that is known at once; with `nodes` as NODE_ROW, which adds the hashes of its first and last window - 1 symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.text_slices(batch, 1):
                keys = rows.column(0).to_numpy(zero_copy_only=False)
                values, second, offsets = shape.symbols(rows.column(1))
                both = np.stack([values, second], 1)
                for part, at, text, base in K.segments(both, offsets, shape.window):
                    found = _blocks(np.ascontiguousarray(part[:, 0]), np.ascontiguousarray(part[:, 1]), at, shape)
                    if found is None:
                        continue
                    doc, start, n, gram, whole, first, other = found
                    key, place = keys[text[doc]], start - at[doc] + base[doc]
                    src_key, src_place = np.full(len(n), -1), np.full(len(n), -1)
                    big = np.isin(gram, hot) if len(hot) else np.zeros(len(gram), bool)
                    if big.any():
                        start, gram, whole, key, place, n, src_key, src_place = _split(shape, same_document, big, start, n, gram, whole, key, place, first, other)
                    cols = [gram.view(np.int64), whole.view(np.int64), key, place * SHIFT + n]
                    cols += [pa.array(src_key, mask=src_key < 0), pa.array(src_place * SHIFT + 1, mask=src_key < 0)]
                    if nodes:
                        most, wide = np.maximum(n, 1), shape.window - 1
                        cols += [K.span_hash(first, start, start + wide).view(np.int64), K.span_hash(first, start + most, start + most + wide).view(np.int64)]
                    names = [c.split()[0] for c in (NODE_ROW if nodes else SOURCE_ROW).split(", ")]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def _split(shape, same_document, big, start, n, gram, whole, key, place, first, other):
    """Blocks of hot minimizers become windows dealt by content; of equal ones in this batch the first is dealt, the others are repeats of it (n = 0)."""
    m = n[big]
    inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    s = np.repeat(start[big], m) + inner
    k, p = np.repeat(key[big], m), np.repeat(place[big], m) + inner
    h1, h2 = K.span_hash(first, s, s + shape.window), K.span_hash(other, s, s + shape.window)
    order = np.lexsort((p, k, h2, h1))
    s, h1, h2, k, p = s[order], h1[order], h2[order], k[order], p[order]
    again = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
    src = np.maximum.accumulate(np.where(again, 0, np.arange(len(k))))
    again &= same_document | (k > k[src])
    # a repeat goes to a group of its own, spread by its place
    h1 = np.where(again, K.mix(k.astype(np.uint64) * np.uint64(K.BASE) + p.astype(np.uint64)), h1)
    ones = np.where(again, 0, 1)
    rest = ~big
    join = lambda a, b: np.concatenate([a[rest], b])
    none = np.full(len(n), -1)
    return join(start, s), join(gram, h1), join(whole, h2), join(key, k), join(place, p), join(n, ones), join(none, np.where(again, k[src], -1)), join(none, np.where(again, p[src], -1))


def _sampled_grams(shape: Shape):
    def run(batches):
        for batch in batches:
            for rows in K.text_slices(batch, 1):
                values, second, offsets = shape.symbols(rows.column(1))
                for part, at, _, _ in K.segments(np.stack([values, second], 1), offsets, shape.window):
                    found = _blocks(np.ascontiguousarray(part[:, 0]), np.ascontiguousarray(part[:, 1]), at, shape)
                    if found is not None:
                        grams, counts = np.unique(found[3], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], names=["gram", "n"])

    return run


def hot_grams(docs: DataFrame, shape: Shape, n_partitions: int) -> np.ndarray:
    """Minimizers that would hold more than a quarter of a mean partition's rows, from about SAMPLE_DOCUMENTS documents.

    This only decides how rows are dealt, never the result. At most 4 * n_partitions
    minimizers can be that frequent, so that what the driver gathers is bounded.
    """
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    share = min(1.0, SAMPLE_DOCUMENTS / total)
    picked = docs.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    grams = picked.select("key", "text").mapInArrow(_sampled_grams(shape), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = written(grams.where("n >= 8"), "grams")
    rows = grams.agg(F.sum("n")).first()[0] or 0
    least = max(64, rows / (4 * n_partitions))
    return np.array([r[0] for r in grams.where(F.col("n") > least).select("gram").collect()], np.int64).view(np.uint64)


def compared_blocks(docs: DataFrame, shape: Shape, same_document: bool) -> DataFrame:
    """(key, pos, gram, src_key, src_pos): blocks that repeat an earlier one, with its place; and blocks still to be compared, with their minimizer.

    same_document: whether an earlier place in the same document makes a repeat too.
    """
    n = partitions(docs)
    hot = hot_grams(docs, shape, n)
    rows = docs.select("key", "text").mapInArrow(emit(shape, hot, same_document), SOURCE_ROW)
    rows = rows.repartition(n, "gram").sortWithinPartitions("gram", "block", "key", "pos")  # serves all windows below
    by_gram, by_block = W.partitionBy("gram"), W.partitionBy("gram", "block")
    first = F.min(F.struct("key", "pos")).over(by_block)
    several = F.min("block").over(by_gram) != F.max("block").over(by_gram)
    rows = rows.select("key", "pos", "gram", "src_key", "src_pos", first.alias("first"), several.alias("several"))
    known = F.col("src_key").isNotNull()
    repeat = known | (F.col("key") > F.col("first.key"))
    if same_document:
        repeat = repeat | (F.col("pos") > F.col("first.pos"))
    pos = F.when(known, F.col("pos") + 1).otherwise(F.col("pos"))  # its number of windows was 0
    source = lambda c: F.when(known, F.col(f"src_{c}")).when(repeat, F.col(f"first.{c}")).alias(f"src_{c}")
    rows = rows.where(repeat | F.col("several"))
    return rows.select("key", pos.alias("pos"), F.when(~repeat, F.col("gram")).alias("gram"), source("key"), source("pos"))


def place_of(pos: str):
    return F.floor(F.col(pos) / SHIFT).cast("long")


def joined_spans(runs: DataFrame, *by: str) -> DataFrame:
    """(key, place, n, src_key, src_place): runs of n windows (key, place, n, src_key, src_place) that follow each other in document and source, as one."""
    runs = runs.select("key", "place", "n", "src_key", (F.col("place") - F.col("src_place")).alias("shift"), *by).repartition(partitions(runs), "key")
    line = W.partitionBy("key", "src_key", "shift", *by).orderBy("place")
    ahead = F.max(F.col("place") + F.col("n")).over(line.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("fresh", (ahead.isNull() | (F.col("place") > ahead)).cast("int"))
    runs = runs.withColumn("span", F.sum("fresh").over(line.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("key", "src_key", "shift", *by, "span").agg(F.min("place").alias("place"), F.max(F.col("place") + F.col("n")).alias("end"))
    return out.select("key", "place", (F.col("end") - F.col("place")).alias("n"), "src_key", (F.col("place") - F.col("shift")).alias("src_place"))


CUT_ROW = "key long, doc_id long, size long, n_removed long, n_spans long, kept_sha256 string, digests array<struct<place:long,n:long,digest:binary>>"


def cut_spans(keyed: DataFrame, spans: DataFrame, window: int, symbols_of: Callable[[str | None], list], joined: Callable[[list], bytes]) -> DataFrame:
    """CUT_ROW of each document without its spans, after the symbols of each span have been compared with those at its source.

    What is compared are 160-bit digests of the symbols themselves, so that texts need
    not travel. Hashes that found unequal symbols raise.
    """
    own = spans.groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("spans"))
    ranges = spans.select("key", "place", "n").union(spans.select("src_key", "src_place", "n")).distinct()
    asked = ranges.groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("asked"))
    rows = keyed.join(asked.join(own, "key", "left"), "key", "left").select("key", "doc_id", "text", "spans", "asked")
    cut = written(rows.mapInArrow(_cut(window, symbols_of, joined), CUT_ROW), "cut")
    seen = cut.select("key", F.explode("digests").alias("d")).select("key", "d.place", "d.n", "d.digest")
    there = seen.select(F.col("key").alias("src_key"), F.col("place").alias("src_place"), "n", F.col("digest").alias("src_digest"))
    agree = spans.join(seen, ["key", "place", "n"]).join(there, ["src_key", "src_place", "n"]).where("digest = src_digest")
    if agree.count() != spans.count():
        raise RuntimeError("equal hashes of unequal text: choose other hash values")
    return cut.drop("key", "digests")


def _pairs(column: pa.Array, r: int) -> tuple[np.ndarray, np.ndarray]:
    if not column[r].is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = column[r].values
    return values.field("place").to_numpy(), values.field("n").to_numpy()


def _cut(window: int, symbols_of, joined):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"size": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "digests": []}
            for r in range(batch.num_rows):
                symbols = symbols_of(batch.column(2)[r].as_py())
                places, counts = _pairs(batch.column(4), r)
                out["digests"].append([{"place": p, "n": n, "digest": hashlib.blake2b(joined(symbols[p : p + n + window - 1]), digest_size=20).digest()} for p, n in zip(places.tolist(), counts.tolist(), strict=True)])
                places, counts = _pairs(batch.column(3), r)
                gone = np.zeros(0, bool)
                out["size"].append(len(symbols))
                if len(places):
                    step = np.zeros(len(symbols) + 1, np.int64)
                    np.add.at(step, places, 1)
                    np.add.at(step, places + counts + window - 1, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))  # kept stretches start and end here
                    symbols = [s for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) for s in symbols[a:b]] if isinstance(symbols, list) else b"".join(symbols[a:b] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                out["kept_sha256"].append(hashlib.sha256(joined(symbols)).hexdigest())
            types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("place", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))]
            cols = [batch.column(0), batch.column(1), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", *out])

    return run
