"""License scan: MinHash bands over text windows retrieve templates, exact containment verifies.

Around every word shingle that a document shares with a template, windows of template
length overlap the text. MinHash bands of one row each, BANDS of them, retrieve the
templates of a window. A window of a template's length that contains a share c of its
shingles has Jaccard similarity c / (2 - c) at least, where the bands collide with
probability 1 - (1 - c / (2 - c)) ** BANDS: above 1 - 1e-9 at c = 0.8. A retrieved
template counts if the window contains enough of its shingles, exactly compared.

Only DataFrame functions. The templates are a parameter table of any size; TEMPLATES are
those of `template_table`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written
from .license_texts import TEMPLATES
from .text_scan import KIND, at_places, item_shingles, item_windows

SHINGLE = 5
BANDS = 20
CONTAINMENT = 0.8
MARKS = ".,;:!?\"'`()[]{}<>*#/|_=~-"  # vanish from words, so that comment signs and punctuation do not hide a notice


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id int, license string, text string")


def minhashes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, band, value): in each band the least of the group's shingle hashes under the band's own seed."""
    least = rows.groupBy(*by).agg(*[F.min(F.xxhash64("shingle", F.lit(b))).alias(f"m{b}") for b in range(BANDS)])
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"m{b}").alias("value")) for b in range(BANDS)]))
    return least.select(*by, bands.alias("e")).select(*by, "e.band", "e.value")


def license_scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, n_places, start, containment): the licenses that `docs` (doc_id, text) state.

    `templates` has template_id, license and text. containment is the share of the
    template's distinct 5-word shingles (lower-cased words without punctuation; a template
    of fewer words is one shingle, also inside longer texts) in a window of its length;
    of templates of one length, a window counts for those that it contains best. n_places
    counts the windows, start is the word where the best, then first, of them begins
    (marks that stand alone are no words). Null and empty texts and
    templates match nothing; rows with a null doc_id show null; repeated rows give one
    result. Other columns are ignored.
    """
    if not 0.5 <= containment <= 1:
        raise ValueError("the bands are set for a containment from 0.5 to 1")
    items = templates.select(F.struct("template_id", "license", F.xxhash64("text").alias("t")).alias("item"), "text").distinct()
    index = written(item_shingles(items, SHINGLE, MARKS), "items")
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("key"), "doc_id", "text")
    where, windows = item_windows(keyed, index, SHINGLE, MARKS)
    table = minhashes(index, ["item", "n_words"])
    found = minhashes(windows, KIND).join(table, ["n_words", "band", "value"]).select(*KIND, "item").distinct()
    kinds = index.select("item", "shingle").distinct()
    shared = found.join(windows.distinct(), KIND).join(kinds, ["item", "shingle"])
    shared = shared.groupBy(*KIND, "item").agg(F.count("*").alias("both"))
    shared = shared.join(kinds.groupBy("item").agg(F.count("*").alias("all")), "item")
    shared = shared.withColumn("containment", F.col("both") / F.col("all")).where(F.col("containment") >= containment)
    # versions of a license differ in a word or two: a window states those that it contains best
    shared = shared.withColumn("best", F.max("containment").over(W.partitionBy(*KIND))).where("containment = best")
    places = at_places(where, shared).groupBy("doc_id", F.col("item.license").alias("license"))
    out = places.agg(F.count_distinct("key", "start").alias("n_places"), F.max_by(F.struct("start", "containment"), F.struct("containment", -F.col("start"))).alias("m"))
    return out.select("doc_id", "license", "n_places", "m.start", "m.containment")
