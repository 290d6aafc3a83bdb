"""Mixing sources to target weights along a time-varying curriculum.

Each source has a piecewise-linear weight schedule over training time 0..1. Its area is
the source's weight; the normalised running area F(t) says which part of the source's
target has been asked for by time t. Documents of a source stand in a fixed hash order;
the words before a document give q, the part of the target already delivered, and
t = F^-1(q) is the document's training position. Sorting all copies by position yields
the training order.

Only (doc_id, source, size) leave the scan, as a written table. Running sums need no task that sees a whole
source: every source is cut into hash buckets, the bucket totals (sources x buckets
rows) get their running sums, and each bucket adds its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, free_name, written


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Schedule:
    """Relative weight at each knot; the area is scaled to `weight`, so the shape only moves demand in time."""

    weight: float
    knots: tuple[float, ...] = (0.0, 1.0)
    shape: tuple[float, ...] = (1.0, 1.0)

    def __post_init__(self) -> None:
        k = self.knots
        if len(k) < 2 or len(k) != len(self.shape) or k[0] != 0 or k[-1] != 1 or any(a >= b for a, b in zip(k, k[1:])):
            raise ValueError("knots must rise from 0 to 1, with one shape value each")
        if self.weight <= 0 or min(self.shape) < 0 or max(self.shape) <= 0:
            raise ValueError("weights must be positive")

    def areas(self) -> list[float]:
        out = [0.0]
        for i in range(len(self.knots) - 1):
            out.append(out[-1] + (self.knots[i + 1] - self.knots[i]) * (self.shape[i] + self.shape[i + 1]) / 2)
        return out

    def position(self, q: Column) -> Column:
        """F^-1(q) for 0 <= q <= 1: in the segment that holds the area, the root of its quadratic."""
        areas, found = self.areas(), None
        asked = q * areas[-1]
        for i in reversed(range(len(self.knots) - 1)):
            t0, width = self.knots[i], self.knots[i + 1] - self.knots[i]
            w0, slope = self.shape[i], (self.shape[i + 1] - self.shape[i]) / width
            rest = F.greatest(asked - F.lit(areas[i]), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            step = F.try_divide(2 * rest, F.lit(w0) + root)  # the stable form of the root
            here = F.lit(t0) + F.least(F.coalesce(step, F.lit(0.0)), F.lit(width))
            found = here if found is None else F.when(asked < areas[i + 1], here).otherwise(found)
        return found


DEFAULT_SCHEDULES = (
    Schedule(3.0, (0.0, 1.0), (1.5, 0.5)),
    Schedule(1.0, (0.0, 0.6, 1.0), (0.4, 0.8, 2.2)),
    Schedule(2.0, (0.0, 0.5, 1.0), (0.8, 1.2, 0.8)),
)


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, class): water-filling over the source dimension, one row per source.

    target = min(cap * size, level * weight), where the level spends share * all words.
    With sources in rising order of cap * size / weight, the first source that its share
    does not fill fixes the level for itself and all later ones.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # windows over one row per source, after the aggregation
    ranked = per.withColumn("class", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("class") + 1))
    by_ratio = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    spend = F.lit(share) * F.sum("source_size").over(whole) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    filled = ranked.withColumn("level", spend / F.sum("weight").over(rest))
    free = F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size")
    filled = filled.withColumn("free", free).withColumn(
        "final", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(whole)["level"]
    )
    target = F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("final") * F.col("weight"), F.lit(cap) * F.col("source_size")))
    return filled.select("source", "source_size", target.cast("double").alias("target"), "class")


def curriculum_assign(
    docs: DataFrame,
    schedules: tuple[Schedule, ...] = DEFAULT_SCHEDULES,
    share: float = 1.5,
    cap: float = 2.0,
    buckets: int = 4096,
) -> DataFrame:
    """One row per document: size, source_size, target, taken, passes (pass, taken, position).

    `docs` needs doc_id, text and source; other columns are ignored. A null text has size
    0, a null source is a source of its own, after all others; repeated rows are taken as
    separate documents, in a stable order. Documents of size 0 are taken 0 times. An empty
    table gives no rows. The order inside a source is md5(doc_id), without an id that of the
    text's own md5, so reruns agree and rows without ids are not one group.
    """
    if buckets & (buckets - 1) or not 16 <= buckets <= 1 << 16:
        raise ValueError("buckets must be a power of two from 16 to 65536")
    sized = docs.select(
        "doc_id",
        "source",
        word_count("text").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("place"),
    )
    sized = sized.withColumn("bucket", F.shiftright(F.conv(F.substring("place", 1, 4), 16, 10).cast("int"), 16 - (buckets.bit_length() - 1)))
    sized = written(sized, "sizes")  # texts are read and counted once
    targets = source_targets(sized, tuple(s.weight for s in schedules), share, cap)
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    plan = totals.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.source_size", "t.target", "t.class")
    inside = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))
    )
    at = joined.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", "p.class", (F.col("p.ahead") + F.col("d.inside")).alias("at"))
    quota = F.floor("target")
    passes = []
    for k in range(int(-(-cap // 1))):
        took = F.greatest(F.lit(0), F.least(F.col("size"), quota - F.lit(k) * F.col("source_size") - F.col("at")))
        q = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(k) * F.col("source_size") + F.col("at"), F.col("target")), F.lit(0.0)))
        position = F.coalesce(*[F.when(F.col("class") == i, s.position(q)) for i, s in enumerate(schedules)])
        passes.append(F.struct(F.lit(k).alias("pass"), took.cast("long").alias("taken"), position.alias("position")))
    at = at.withColumn("passes", F.filter(F.array(*passes), lambda p: p["taken"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["taken"])
    return at.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes")


def curriculum_mix(docs: DataFrame, **options) -> DataFrame:
    """The training order: a row per taken copy, range-sorted by position, with all columns of `docs` and pass, taken, position.

    Columns of `docs` that have these three names are replaced, all others stay. Rows that
    share a doc_id, or have none, are told apart by their source and size, equal ones are
    interchangeable; a row of size 0 is not taken.
    """
    docs = docs.drop("pass", "taken", "position")
    there, nth, ident = (free_name(docs, n) for n in ("size", "nth", "ident"))
    sized = docs.withColumn(there, word_count("text"))
    numbered = sized.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", "source", there).orderBy(F.xxhash64("text"))))
    again = W.partitionBy("doc_id", "source", "size").orderBy(F.get("passes", F.lit(0))["position"], "taken")
    picked = curriculum_assign(docs, **options).withColumn(nth, F.row_number().over(again)).select(F.col("doc_id").alias(ident), F.col("source").alias(f"{nth}_source"), F.col("size").alias(f"{nth}_size"), F.col(nth).alias(f"{nth}_"), F.explode("passes").alias("p"))
    picked = picked.select(ident, f"{nth}_", f"{nth}_source", f"{nth}_size", F.col("p.pass").alias("pass"), F.col("p.taken").alias("taken"), F.col("p.position").alias("position"))
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(f"{nth}_source")) & (F.col(there) == F.col(f"{nth}_size"))
    joined = numbered.join(picked, same & (F.col(nth) == F.col(f"{nth}_")))
    return joined.drop(ident, nth, f"{nth}_", f"{nth}_source", f"{nth}_size", there).orderBy("position", "doc_id", "pass")
