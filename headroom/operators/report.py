"""Report sink, and the arguments of a report: period and providers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relations import Settings, query

SCHEMA_VERSION = "0.2.0"
KEEP = 1.0
_NAMED = {"week": 7, "month": 30, "year": 365}


def parse_period(period: str, now: int) -> tuple[int, int]:
    """(start, now) of `week`, `month`, `year`, `<n>d` or `all` (start 0), whatever the case and blanks around."""
    period = period.strip().lower()
    if period == "all":
        return 0, now
    days = _NAMED.get(period) or (int(m[1]) if (m := re.fullmatch(r"0*([1-9]\d*)d", period)) else None)
    if not days:
        raise ValueError(f"unknown period {period!r}: week, month, year, all or a number of days such as 30d")
    return now - days * 86400, now


def parse_providers(asked: str | None, known: tuple[str, ...] = ("alpha", "beta")) -> tuple[str, ...]:
    """The providers asked for: one of the known names, `both` or `all` (also if none is named)."""
    if asked is None or asked.strip().lower() in ("both", "all"):
        return ()
    name = asked.strip().lower()
    if name not in known:
        raise ValueError(f"unknown provider {asked!r}: {', '.join(known)}, both or all")
    return (name,)


def settings(period: str, now: int, provider: str | None = None, known: tuple[str, ...] = ("alpha", "beta")) -> Settings:
    """What a report is asked for, from its words."""
    t0, t1 = parse_period(period, now)
    return Settings(t0, t1, period.strip().lower(), parse_providers(provider, known))


def _dollars(prefix: str, approx):
    """A tagged amount: a band, a floor, or null where unknown."""
    lo, med, hi = (F.col(f"{prefix}_{x}") for x in ("lo", "med", "hi"))
    none = F.lit(None).cast("double")
    amount = lambda kind, low, mid, high: F.struct(F.lit(kind).alias("kind"), low.alias("lo"), mid.alias("med"), high.alias("hi"), approx.alias("approx"))
    return F.when(med.isNotNull(), amount("band", lo, med, hi)).when(lo.isNotNull(), amount("floor", lo, none, none))


def to_json(report: DataFrame, basis: DataFrame, windows: DataFrame, asked: Settings) -> DataFrame:
    """(account_id, json): one document per account with its providers; nulls are written, each unknown amount with its reason."""
    key = ["account_id", "provider"]
    parts = basis.groupBy(*key).agg(F.first(F.struct(*[c for c in basis.columns if c not in key])).alias("basis"))
    shown = F.struct(
        F.col("operative").cast("int").alias("first"), *[c for c in windows.columns if c not in (*key, "gap_lo", "gap_med", "gap_hi", "kind")],
        _dollars("gap", F.lit(None).cast("boolean")).alias("gap_usd"),
    )
    opened = windows.groupBy(*key).agg(F.sort_array(F.collect_list(shown), asc=False).alias("open_windows"))
    rows = report.join(parts, key, "left").join(opened, key, "left")
    notes = F.filter(F.array(*[F.col(c) for c in report.columns if c.startswith("note_")]), lambda n: n.isNotNull())
    one = F.struct(
        "provider", F.struct("plan_type", "monthly_usd", F.col("plan_approx").alias("approx"), "window_cost").alias("plan"),
        F.struct(F.col("hull_t0").alias("t0"), F.col("hull_t1").alias("t1"), F.col("measured_secs").alias("union_secs"), "coverage_frac").alias("measured"),
        "extracted_usd", _dollars("left", F.col("left_approx")).alias("left_on_table_usd"), "left_reason", "basis", F.coalesce("open_windows", F.array()).alias("open_windows"),
        F.struct("verdict", "return_multiple", "extracted_usd", "plan_cost_usd", F.lit(KEEP).alias("threshold_keep"), F.col("decision_approx").alias("approx"), F.col("decision_reason").alias("reason")).alias("decision"),
        notes.alias("notes"), F.filter(F.array("error"), lambda e: e.isNotNull()).alias("errors"),
    )
    per = rows.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("provider", one.alias("one")))).alias("providers"))
    head = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(asked.now).alias("generated_at")]
    head.append(F.struct(F.lit(asked.requested).alias("requested"), F.lit(asked.t0).alias("t0"), F.lit(asked.now).alias("t1")).alias("period"))
    document = F.struct(*head, F.transform("providers", lambda p: p["one"]).alias("providers"))
    return per.select("account_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def report_json(spark: SparkSession, sf_dir: str, asked: Settings = Settings()) -> DataFrame:
    got = lambda name: query(name, asked)(spark, sf_dir)
    return to_json(got("provider_report"), got("basis"), got("open_windows"), asked)
