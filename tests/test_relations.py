"""Each relation against DuckDB on the smallest table, and literal cases of the windows."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headroom.operators.report import parse_period, parse_providers, settings
from headroom.plans import registry
from headroom.plans.relations import Settings, apply

SF = "/root/testdata/sf0.001"
SNAP = "account_id string, provider string, window_id string, window_minutes long, used_percent double, resets_at long, ts long, source string, plan_type string"


def rows_of(frame):
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "item") else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    want = con.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert rows_of(got) == rows_of(want)


def series(spark, rows):
    return spark.createDataFrame([("a", "p", "w", m, float(p), r, t, "s", plan) for t, p, r, m, plan in rows], SNAP)


@pytest.mark.parametrize(
    ("rows", "instances"),
    [
        ([(100, 10, 10000, 10080, None), (200, 20, 10000, 10080, None), (300, 1, 700000, 10080, None), (400, 3, 700000, 10080, None)], 2),
        ([(100, 40, None, 300, None), (200, 41, None, 300, None), (300, 2, None, 300, None)], 2),
        ([(100, 40, None, 300, None), (200, 38, None, 300, None), (300, 36, None, 300, None)], 1),
        ([(100, 1, 10000, 10080, None), (200, 1, 10500, 10080, None), (300, 1, 11000, 10080, None), (400, 1, 11500, 10080, None)], 2),
        ([(100, 1, None, 300, None), (100 + 6 * 3600, 2, None, 300, None)], 2),
        ([(100, 1, None, 300, "a"), (200, 2, None, 300, "a"), (300, 3, None, 300, "b")], 2),
        ([(100, 1, None, 300, None), (200, 2, None, 300, None), (300, 3, None, 10080, None)], 2),
        # what an instance carries outlasts rows that do not state it
        ([(100, 1, None, 300, "a"), (200, 2, None, 300, None), (300, 3, None, 300, "b")], 2),
        ([(100, 1, None, 300, None), (200, 2, None, None, None), (200 + 6 * 3600, 3, None, None, None)], 2),
        ([(100, 1, 10000, 300, None), (200, 2, None, 300, None), (300, 3, 10700, 300, None)], 2),
        ([(100, 1, None, None, None), (200, 2, None, 300, None), (300, 3, None, 600, None)], 2),
        ([(100, 1, 10000, 300, None), (200, 2, 10600, 300, None), (300, 3, 9400, 300, None)], 1),
    ],
)
def test_instances(spark, rows, instances):
    got = apply(spark, "instances", snapshots=series(spark, rows)).agg(F.max("instance_id")).first()[0]
    assert got == instances


def test_same_second(spark):
    rows = [(100, 39, None, None, None), (200, 40, None, 300, None), (200, 30, 9000, None, "x"), (300, 41, None, None, None)]
    got = {r.ts: r for r in apply(spark, "coalesce_snapshots", snapshots=series(spark, rows)).collect()}
    assert len(got) == 3
    assert (got[200].used_percent, got[200].resets_at, got[200].window_minutes, got[200].plan_type) == (40, 9000, 300, "x")


COUNTERS = "account_id string, file string, line_no long, ts long, model string, c_input long, c_cached long, c_write long, c_output long"


@pytest.mark.parametrize(
    ("counters", "want"),
    [
        ([(900_000, 0, 0, 0), (902_000, 0, 0, 100)], [(2000, 0, 0, 100)]),
        ([(1000, 0, 0, 100), (1500, 0, 0, 80)], [(1000, 0, 0, 100), (500, 0, 0, 0)]),
        ([(1000, 200, 0, 10), (400, 100, 0, 5)], [(800, 200, 0, 10), (300, 100, 0, 5)]),
        ([(100, 0, 0, 1), (100, 0, 0, 1)], [(100, 0, 0, 1)]),
    ],
)
def test_counter_diff(spark, counters, want):
    df = spark.createDataFrame([("a", "f", i, i, "m", *c) for i, c in enumerate(counters)], COUNTERS)
    got = apply(spark, "counter_diff", counter_rows=df).orderBy("line_no")
    assert [tuple(r) for r in got.select("input_tokens", "cached_input_tokens", "cache_w_unsplit", "output_tokens").collect()] == want


def test_counters_give_back_the_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = apply(spark, "counter_diff", events=events).agg(F.sum("input_tokens"), F.sum("output_tokens")).first()
    want = apply(spark, "usage_events", events=events).where("provider = 'alpha'").agg(F.sum("cents")).first()[0]
    assert (got[0], got[1]) == (want, want)


def test_period():
    assert parse_period("7d", 10**9) == (10**9 - 604800, 10**9)
    assert parse_period("month", 10**9)[0] == 10**9 - 30 * 86400
    with pytest.raises(ValueError):
        parse_period("fortnight", 0)


def test_report_json(spark):
    import json

    rows = registry.QUERIES["report_json"](spark, SF).collect()
    flat = {(r.account_id, r.provider): r for r in registry.QUERIES["provider_report"](spark, SF).collect()}
    for r in rows:
        for p in json.loads(r.json)["providers"]:
            assert p["extracted_usd"] == flat[r.account_id, p["provider"]].extracted_usd


@pytest.mark.parametrize("slot", [900, 40_000, 30 * 86400])
def test_series_cut_by_time_equal_the_fold(spark, monkeypatch, slot):
    """Whatever the parts that a series is cut into, its instances are those of one walk over all rows."""
    import random

    from headroom.plans import windows
    from headroom.streaming.pipelines import fold, merged_second

    monkeypatch.setattr(windows, "SLOT", slot)
    g, rows, want = random.Random(slot), [], {}
    for w in "xyz":
        ts, percent, resets = 1000, 0.0, 20_000
        for _ in range(250):
            ts += g.choice([0, 1, 60, 300, 3000, 20_000])
            percent = g.choice([percent, percent + 1, percent + 7, max(0.0, percent - 4), 1.0])
            resets += g.choice([0, 0, 0, 400, -300, 18_000])
            rows.append(("a", "p", w, g.choice([300, 300, None, 10_080]), percent, g.choice([resets, None]), ts, f"s{len(rows)}", g.choice([None, None, "b", "b", "c"])))
        now, at, n = None, {}, 0
        for r in rows:
            if r[2] == w:
                at.setdefault(r[6], []).append((r[6], r[4], r[7], r[3], r[5], r[8]))
        for t in sorted(at):
            started = now is None
            now, closed = fold(now, merged_second(at[t]))
            n += started or closed is not None
            want[w, t] = n
    got = apply(spark, "instances", snapshots=spark.createDataFrame(rows, SNAP).repartition(3)).collect()
    assert {(r.window_id, r.ts): r.instance_id for r in got} == want and max(want.values()) > 50
