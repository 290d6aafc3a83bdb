"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every kind of window of an item's length around a shared shingle gets a 64-bit SimHash of its
shingles, each weighted by how often it occurs. Fingerprints within RADIUS of an item's
are found without comparing all pairs: the 64 bits are cut into BLOCKS blocks, and of
RADIUS = BLOCKS * (FLIPS + 1) - 1 differing bits some block holds at most FLIPS. Items
stand in the index under all variants of each block with up to ITEM_FLIPS bits changed,
windows look up all variants of theirs with up to WINDOW_FLIPS, so that blocks that differ
in FLIPS bits meet; the join key also holds the block and the length. What lies within
the radius is verified on the weighted shingles themselves.

Only DataFrame functions. The index is a written table that grows with the benchmark, the
lookups grow with the windows; both meet in a join that shuffles or broadcasts as their
true sizes ask for. All sums are aggregations, so that long items cost in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .text_scan import KIND, at_places, item_shingles, item_windows

SHINGLE = 5
BLOCKS = (13, 13, 13, 13, 12)
ITEM_FLIPS, WINDOW_FLIPS = 2, 1
FLIPS = ITEM_FLIPS + WINDOW_FLIPS
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
SIMILARITY = 0.8


def simhash(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, print, size): 64-bit SimHash of the shingles of each group of `rows` (by, shingle); one that occurs twice counts twice."""
    sums = [F.sum(F.when(F.getbit("shingle", F.lit(b)) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(64)]
    summed = rows.groupBy(*by).agg(F.count("*").alias("size"), *sums)
    bits = F.lit(0).cast("long")
    for b in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return summed.select(*by, bits.alias("print"), "size")


def blocks_of(print_: Column) -> list[Column]:
    out, at = [], 0
    for width in BLOCKS:
        out.append(F.shiftrightunsigned(print_, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return out


def variants(print_: Column, flips: int) -> Column:
    """(block, value): all values that differ from a block in at most `flips` bits."""
    def entry(block: int, value: Column):
        return lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value"))

    out = []
    for block, (value, width) in enumerate(zip(blocks_of(print_), BLOCKS, strict=True)):
        masks = grown = {0}
        for _ in range(flips):
            grown = {m | 1 << i for m in grown for i in range(width)}
            masks = masks | grown
        step = F.array(*[F.lit(m).cast("long") for m in sorted(masks)])
        out.append(F.transform(step, entry(block, value)))
    return F.explode(F.concat(*out))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, doc_id, item_id, start, n_words, distance, similarity) of all windows that match; key is the doc_id and a hash of the text."""
    items = benchmark.select(F.struct("item_id").alias("item"), "text").distinct()
    # items that share an id keep apart by their text
    items = items.select(F.struct("item.item_id", F.xxhash64("text").alias("t")).alias("item"), "text")
    index = written(item_shingles(items, SHINGLE), "items")
    keyed = docs.select(row_key(docs).alias("key"), "doc_id", "text")
    places, windows = item_windows(keyed, index, SHINGLE)
    prints = simhash(windows, KIND)
    asks = prints.select(*KIND, "print", "size", variants(F.col("print"), WINDOW_FLIPS).alias("e")).select(*KIND, "print", "size", "e.block", "e.value")
    table = simhash(index, ["item", "n_words"]).withColumnsRenamed({"print": "item_print", "size": "item_size"})
    table = table.select("item", "n_words", "item_print", "item_size", variants(F.col("item_print"), ITEM_FLIPS).alias("e"))
    table = written(table.select("item", "n_words", "item_print", "item_size", "e.block", "e.value"), "index")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = asks.join(table, ["n_words", "block", "value"]).where(distance <= RADIUS)
    near = near.select(*KIND, "item", "size", "item_size", distance.alias("distance")).distinct()
    # weighted Jaccard similarity, from the counts of the shingles that both have
    mine = windows.groupBy(*KIND, "shingle").agg(F.count("*").alias("n"))
    theirs = index.groupBy("item", "shingle").agg(F.count("*").alias("m"))
    both = near.join(mine, KIND).join(theirs, ["item", "shingle"]).groupBy(*KIND, "item", "size", "item_size", "distance").agg(F.sum(F.least("n", "m")).alias("both"))
    share = F.col("both") / (F.col("size") + F.col("item_size") - F.col("both"))
    similar = both.withColumn("similarity", share).where(F.col("similarity") >= similarity)
    return at_places(places, similar).select("key", "doc_id", "item.item_id", "start", "n_words", "distance", "similarity")


def row_key(docs: DataFrame) -> Column:
    return F.struct("doc_id", F.xxhash64("text").alias("t"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): passages of `docs` (doc_id, text) that match an item of `benchmark` (item_id, text).

    similarity is the weighted Jaccard similarity of the 5-word shingles of item and
    passage, on lower-cased words; start counts words. Each matching document and item
    gives one row, its best passage, the first of equals. Items of fewer than five words
    are matched as one shingle, also inside longer texts. Null and empty texts match nothing; rows with a null
    doc_id or item_id are matched like others and show null; repeated rows give one result.
    Other columns are ignored.
    """
    best = matches(docs, benchmark, similarity).groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start"), "n_words")).alias("m")
    )
    return best.select("doc_id", "item_id", "m.start", "m.n_words", "m.distance", "m.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` without a contaminated passage, all columns kept.

    Rows are judged by their own text: of rows that share a doc_id, or have none, only
    the contaminated ones leave; repeated rows stay or leave together.
    """
    key = free_name(docs, "key")
    found = matches(docs, benchmark, similarity).select("key.*").distinct().select(F.col("doc_id").alias(f"{key}_id"), F.col("t").alias(f"{key}_t"))
    same = docs["doc_id"].eqNullSafe(F.col(f"{key}_id")) & (F.xxhash64(docs["text"]) == F.col(f"{key}_t"))
    return docs.join(found, same, "left_anti")
