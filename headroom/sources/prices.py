"""Price books: a TOML or JSON file with [[price]] and [[plan]] entries, checked before anything is priced by it."""

from __future__ import annotations

import json
import tomllib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..plans.relations import apply

PRICE = (
    "provider string, prefix string, from_ts long, until_ts long, p_input double, p_cached double, p_5m double, p_1h double, "
    "p_write double, p_output double, price_approx boolean, split_family boolean"
)
PLAN = "provider string, plan_id string, monthly_usd double, plan_approx boolean"
_RATES = ("input", "cached", "cache_5m", "cache_1h", "cache_write", "output")
OPEN_END = 2**62


def day(text: str | None) -> int:
    """Midnight UTC of `YYYY-MM-DD`; no day is an open end."""
    return OPEN_END if text is None else int(datetime.strptime(str(text), "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp())


def book(spark: SparkSession, entries: dict) -> dict[str, DataFrame]:
    """{"prices": ..., "plans": ...} of a parsed book, to be passed to `relations.apply`; a book with a problem raises.

    A price has provider, prefix, from, until (open if missing), USD per million tokens
    (input, cached, output; cache_5m, cache_1h or cache_write), approx, and split_family
    where cache writes are told apart by lifetime. A plan has provider, id, monthly_usd,
    approx. The book stands in place of the built-in one as a whole.
    """
    number = lambda v: None if v is None else float(v)
    prices = [
        (p["provider"], p["prefix"], day(p["from"]), day(p.get("until")), *[number(p.get(r)) for r in _RATES], bool(p.get("approx", False)), bool(p.get("split_family", False)))
        for p in entries.get("price", [])
    ]
    plans = [(p["provider"], p["id"], number(p.get("monthly_usd")), bool(p.get("approx", False))) for p in entries.get("plan", [])]
    return checked(spark, spark.createDataFrame(prices, PRICE), spark.createDataFrame(plans, PLAN))


def checked(spark: SparkSession, prices: DataFrame, plans: DataFrame) -> dict[str, DataFrame]:
    """The tables as they are, or a ValueError that names every problem."""
    found = apply(spark, "price_problems", prices=prices, plans=plans).orderBy("kind", "provider", "id").limit(20).collect()
    if found:
        raise ValueError("price book refused: " + "; ".join(f"{r.kind} {r.provider}/{r.id}: {r.problem}" for r in found))
    return {"prices": prices, "plans": plans}


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A book from a file that Spark can read."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # a small table by its nature
    return book(spark, json.loads(text) if path.endswith(".json") else tomllib.loads(text))
