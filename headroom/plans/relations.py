"""Named relations: every operator as one SELECT over other relations.

A relation's text is a function of the dialect `d`; its inputs are the names that follow
FROM and JOIN. `text(name, d)` puts a relation and all it needs into one statement, so
that the optimizer sees the whole plan. Any input can be bound to a table of the user's
own with `apply`. Every relation is keyed by account and provider, so that one account
gives the single-account answer and many are partitions of the same work.

Times are epoch seconds. What a user may set is in `Settings`: the report period [t0, now)
and the providers. Tables that users have of their own - events, snapshots, prices, plans,
configured plan prices, provider rules, operands of the decision - are bound by name.

Where the second dialect states a relation otherwise than Spark does, it states its
definition plainly (a recursive walk, an inequality join), so that equal results mean more
than equal words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written
from .dialect import DUCK, SPARK

T0, NOW = 1704067200, 1706659200
MONTH = 2629746
WEEK = 604800
K = "account_id, provider"
MOST_INSTANCES = 8
#: Names of the tables that come from outside.
SOURCES = ("events",)
RELATIONS: dict[str, Callable] = {}
ORDER: list[str] = []


def relation(f: Callable) -> Callable:
    RELATIONS[f.__name__] = f
    ORDER.append(f.__name__)
    return f


def dollars(x: str) -> str:
    """An exact, order-independent sum of dollars: events cost whole billionths."""
    return f"cast(coalesce(sum(cast({x} as decimal(28, 9))), 0) as double)"


@dataclass(frozen=True)
class Settings:
    """The period [t0, now) with the name it was asked for by, and the providers (none named: all)."""

    t0: int = T0
    now: int = NOW
    requested: str = "30d"
    providers: tuple[str, ...] = ()


class _D:
    """A dialect's words, and the settings that relations are written for."""

    def __init__(self, name: str, settings: Settings):
        self.__dict__.update(SPARK if name == "spark" else DUCK)
        self.json_ = self.json
        self.spark = name == "spark"
        self.t0, self.now, self.requested = settings.t0, settings.now, settings.requested


#: The logs that a choice of providers narrows.
LOGS = ("usage_events", "snapshots")
#: Relations that need no more of a log than the period.
RANGES = {"usage_between": "usage_events", "snapshots_between": "snapshots"}


def _sql(name: str, dialect: str, settings: Settings) -> str:
    sql = RELATIONS[name](_D(dialect, settings))
    if name in LOGS and settings.providers:
        sql = f"select * from ({sql}) chosen where provider in ({_listed(settings)})"
    return sql


def _listed(settings: Settings) -> str:
    for p in settings.providers:
        if not re.fullmatch(r"[\w.-]+", p):
            raise ValueError(f"not a provider's name: {p!r}")
    return ", ".join(f"'{p}'" for p in settings.providers)


def _needs(sql: str) -> list[str]:
    names = re.findall(r"\b(?:from|join)\s+([a-z_0-9]+)", sql)
    return [n for n in dict.fromkeys(names) if n in RELATIONS]


def text(name: str, dialect: str, bound: frozenset[str] = frozenset(), settings: Settings = Settings()) -> str:
    """One statement for a relation; `bound` names are left free."""
    done, parts = {}, []

    def add(n: str) -> None:
        if n in done or n in bound:
            return
        sql = _sql(n, dialect, settings)
        done[n] = sql
        for m in _needs(sql):
            if m != n:
                add(m)
        parts.append(f"{n} as ({sql})")

    add(name)
    return "with " + ",\n".join(parts) + f"\nselect * from {name}"


#: Relations that many others read: they are written once and read back, so that plans stay small and work is shared.
CUTS = (
    "priced", "snapshots", "coalesced", "cuts", "folded", "instanced", "summary", "op_instances", "attributed", "prepared", "qualified",
    "weekly", "spans", "plan_costs", "certified", "tiered", "left_over", "gaps", "ingest_lines", "counter_source", "rollout_parsed", "spool_points", "poll_points",
    "union_sources", "scan_summary",
)


def _run(spark: SparkSession, name: str, tables: dict[str, DataFrame], settings: Settings) -> DataFrame:
    sql = text(name, "spark", frozenset(tables), settings)
    used = {t: df for t, df in tables.items() if re.search(rf"\b(?:from|join)\s+{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(_braces(sql, used), **used)


def apply(spark: SparkSession, name: str, kept: dict[str, DataFrame] | None = None, settings: Settings = Settings(), **tables: DataFrame) -> DataFrame:
    """The relation over the given tables in place of the relations or sources of those names.

    Shared relations on the way are written to the shared folder; `kept` holds those of an
    earlier call on the same tables and settings.
    """
    ready = {} if kept is None else kept
    if settings.providers:
        _listed(settings)
        tables = {n: t.where(t["provider"].isin(*settings.providers)) if n in LOGS else t for n, t in tables.items()}

    if name in RANGES:  # of a table in partitions by day only those of the period are opened
        tables = {n: t.where(f"day between {settings.t0} div 86400 and {settings.now} div 86400") if n == RANGES[name] and "day" in t.columns else t for n, t in tables.items()}

    def below(n: str) -> list[str]:
        found = []
        for m in _needs(_sql(n, "spark", settings)):
            if m != n and m not in tables:
                found += below(m) + [m]
        return list(dict.fromkeys(found))

    for cut in below(name):
        if cut in CUTS and cut not in ready:
            ready[cut] = written(_run(spark, cut, {**ready, **tables}, settings), cut)
    return _run(spark, name, {**{c: t for c, t in ready.items() if c != name}, **tables}, settings)


def _braces(sql: str, tables) -> str:
    """Escapes braces that are not a table's."""
    keep = {"{" + t + "}" for t in tables}
    return re.sub(r"\{[a-z_0-9]*\}|[{}]", lambda m: m[0] if m[0] in keep else m[0].replace("{", "{{").replace("}", "}}"), sql)


_kept: dict[tuple, dict[str, DataFrame]] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Number, bytes and a hash of names, sizes and times of the files: a file that is written over is another state."""
    files = spark.read.format("binaryFile").load(path)  # only the listing is read: no content is asked for
    return tuple(files.agg(F.count("*"), F.sum("length"), F.expr("bit_xor(xxhash64(path, length, modificationTime))")).first())


def query(name: str, settings: Settings = Settings()) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query; queries of one session over the same files share their written tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir}/events.parquet"
        key = (spark.sparkContext.applicationId, path, settings, *_state(spark, path))
        return apply(spark, name, _kept.setdefault(key, {}), settings, events=spark.read.parquet(path))

    return run
