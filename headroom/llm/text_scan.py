"""Native search for short texts inside long ones: shared by the license scan and benchmark decontamination.

Only DataFrame functions. A window of a document can be similar to an item only if it
shares a word shingle with it, so the work has two passes:

1. One scan hashes the shingles of all documents and joins them with the items' shingles.
   Every hit names the window of the item's own length in which the shingle would stand
   at its place in the item. Nothing else leaves the scan.
2. Only the documents that were hit are read again, and the named windows are cut.
   Windows of equal words are one kind: a passage that stands in any number of documents is
   retrieved and verified once, and its places meet the result by the kind alone.

A word is hashed once, and a shingle's hash is that of its words' hashes. The items'
shingles, which do not grow with the documents, are sent to all tasks where their checked
size is below BROADCAST_BYTES; else that join shuffles. The keys of the documents hit are a
written table whose size Spark knows when it plans the join with the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BROADCAST_BYTES = 48 << 20
SALTS = 64
ROW_BYTES = 64  # of a row of numbers in a broadcast table
KIND = ["n_words", "kind1", "kind2"]  # length and 128 bits of hash of a window's words
_BLANKS = "\t\n\x0b\x0c\r"


def words(text: Column, without: str = "") -> Column:
    """Lower-cased words of a text, cut at ASCII white space; the characters of `without` vanish first; null has none."""
    lower = F.translate(F.lower(F.coalesce(text, F.lit(""))), _BLANKS + without, " " * len(_BLANKS))
    return F.filter(F.split(lower, " "), lambda w: w != "")


def hashed_words(text: Column, without: str = "") -> Column:
    return F.transform(words(text, without), lambda w: F.xxhash64(w))


def shingles(hashes: Column, m: int) -> Column:
    """Hashes of the m-word shingles of a column of word hashes, in order; fewer words have none."""
    at = F.sequence(F.lit(0), F.size(hashes) - m)
    return F.when(F.size(hashes) >= m, F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(m)])))


def with_words(rows: DataFrame, *columns: str, without: str = "") -> DataFrame:
    """`columns` and w, the word hashes of `text`. They are generated, so that they are made once and not for each shingle."""
    return rows.select(*columns, F.explode_outer(F.array(hashed_words(F.col("text"), without))).alias("w"))


def item_shingles(items: DataFrame, k: int, without: str = "") -> DataFrame:
    """(item, n_words, at, shingle) of all items that have words; an item of fewer than k words is one shingle."""
    worded = with_words(items, "item", without=without).where(F.size("w") > 0)
    s = F.when(F.size("w") >= k, shingles(F.col("w"), k)).otherwise(F.array(F.lit(None).cast("bigint")))
    for m in range(1, k):
        s = F.when(F.size("w") == m, shingles(F.col("w"), m)).otherwise(s)
    return worded.select("item", F.size("w").alias("n_words"), F.posexplode(s).alias("at", "shingle"))


def small_enough(table: DataFrame) -> bool:
    most = BROADCAST_BYTES // ROW_BYTES
    return table.limit(most + 1).count() <= most


def item_windows(docs: DataFrame, index: DataFrame, k: int, without: str = "") -> tuple[DataFrame, DataFrame]:
    """The item-sized windows of `docs` (key, doc_id, text) around shared shingles: (key, doc_id, start, kind) of each, and (kind, shingle), a row per shingle of each kind.

    Windows that hang over an end of the document are moved inside; a document shorter
    than the item is one window. An item of m words, fewer than k, is one m-word shingle:
    for the lengths m that occur, the documents' m-word shingles are hashed too.
    """
    places = written(index.select("shingle", "n_words", "at").distinct(), "places")
    lengths = [r["m"] for r in places.select(F.least("n_words", F.lit(k)).alias("m")).distinct().orderBy("m").collect()] or [k]  # k rows at most
    some = lambda m: F.coalesce(shingles(F.col("w"), m), F.array().cast("array<bigint>"))
    found = F.concat(*[F.transform(some(m), lambda h, i: F.struct(i.alias("pos"), h.alias("shingle"))) for m in lengths])
    # the outer form: no filter on the shingles is inferred, which would be pushed below the words
    rows = with_words(docs, "key", without=without).withColumn("length", F.size("w")).select("key", "length", F.explode_outer(found).alias("s"))
    rows = rows.select("key", "length", "s.pos", "s.shingle")
    hits = rows.join(F.broadcast(places) if small_enough(places) else places, "shingle")
    last = F.greatest(F.col("length") - F.col("n_words"), F.lit(0))
    asked = hits.select("key", "n_words", F.greatest(F.least(F.col("pos") - F.col("at"), last), F.lit(0)).alias("start")).distinct()
    asked = written(asked, "asked")
    # documents that were hit are told apart by key before their words are made, whatever their number
    docs = docs.join(written(asked.select("key").distinct(), "hit"), "key", "left_semi")
    cut = with_words(docs, "key", "doc_id", without=without).join(asked, "key")
    cut = cut.select("key", "doc_id", "n_words", "start", F.slice("w", F.col("start") + 1, F.col("n_words")).alias("w"))
    cut = cut.select("*", F.xxhash64("w").alias("kind1"), F.xxhash64(F.lit(1), "w").alias("kind2"))
    cut = written(cut, "windows")
    kinds = cut.groupBy(*KIND).agg(F.any_value("w").alias("w")).withColumn("m", F.least("n_words", F.lit(k)))
    s = F.array().cast("array<bigint>")
    for m in lengths:
        s = F.when(F.col("m") == m, some(m)).otherwise(s)
    kinds = written(kinds.select(*KIND, F.explode(s).alias("shingle")), "kinds")
    return cut.select("key", "doc_id", "start", *KIND), kinds


def at_places(places: DataFrame, found: DataFrame) -> DataFrame:
    """What was `found` of each kind at all of its places. A kind may have any number of places: each is dealt to SALTS parts, of which those that occur get what was found."""
    dealt = places.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)))
    parts = dealt.select(*KIND, "salt").distinct()
    return dealt.join(found.join(parts, KIND), [*KIND, "salt"]).drop("salt").distinct()  # repeated rows have the same places
