"""Work that grows with the tables: shared once, cut by hours, and lines that are opened at one call."""

import random
import re

import pytest
from pyspark.sql import functions as F

from headroom.plans import relations
from headroom.plans.relations import Settings, apply

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "most"), [("ingest_lines", 1), ("rollout_parsed", 1), ("spool_parsed", 1), ("spool_points", 0), ("poll_parsed", 1), ("poll_points", 4)])
def test_lines_are_opened_at_one_call(name, most):
    """A call a field made a method that the JVM does not compile; a poll's resets are of two types."""
    assert relations.RELATIONS[name](relations._D("spark", Settings())).count("try_variant_get(") == most


def test_priced_events_are_not_moved_by_model(spark, events):
    tables = {"events": events, "provider_rules": apply(spark, "provider_rules")}
    assert "rightHint=(strategy=broadcast)" in relations._run(spark, "priced", tables, Settings())._jdf.queryExecution().optimizedPlan().toString()


def test_counters_are_laid_out_once(spark, events):
    kept = {}
    apply(spark, "union_events", kept, events=events)
    assert {"counter_source", "rollout_parsed", "ingest_lines"} <= set(kept)


def test_no_window_over_an_account(spark, events):
    """Running sums and line numbers are made by hours."""
    points = apply(spark, "snapshots", events=events)
    for df in (points, relations._run(spark, "spool_lines", {"events": events, "snapshots": points}, Settings())):
        keyed = [line for line in plan(df).splitlines() if "Window [" in line and ("event_id" in line or "row_number" in line)]
        assert keyed and all(re.search(r"\], \[account_id#\d+, \w+#\d+L?\]", line) for line in keyed)


def test_series_by_hours_equal_running_sums(spark):
    """Hours at the borders of weeks and five hours, seconds that several events share, and negative amounts."""
    g, rows = random.Random(5), []
    for i in range(600):
        at = 1704067200 + g.choice([0, 17_999, 18_000, 604_799, 604_800, 604_800 * 2 - 3600, g.randrange(2_500_000)]) + g.choice([0, 0, 1, 3599])
        rows.append((i, at, g.randrange(12), "click", float(g.choice([5, 20, 75, -3])), '{"k": 3}'))
    df = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(timestamp_seconds(at) as timestamp) ts", "user_id", "event_type", "value", "props")
    want = {}
    totals = {}
    for _, _, u, _, v, _ in rows:
        totals[u % 10] = totals.get(u % 10, 0) + round(v * 100)
    for seconds, window, times in ((604_800, "weekly", 1), (18_000, "short", 20)):
        run = {}
        for i, at, u, _, v, _ in sorted(rows, key=lambda r: (r[1], r[0])):
            n = u % 10
            if n == 7:
                continue
            k = (n, (at - 1704067200) // seconds)
            run[k] = run.get(k, 0) + round(v * 100)
            scale = totals[n] * (60 if n == 1 else 100 + 20 * n)
            x = int(run[k] * 400 * 100 * times / scale) if abs(run[k]) < 1e9 else None
            key = (f"a{n}", window, at)
            want[key] = max(want.get(key, -(10**9)), x)
    want = {k: float(min(100, v)) for k, v in want.items()}
    got = apply(spark, "snapshots", events=df).where(F.col("window_id") != "weekly_scoped").collect()
    assert {(r.account_id, r.window_id, r.ts): r.used_percent for r in got} == want


def test_spool_numbers_run_on_over_hours(spark):
    rows = [("a", "beta", w, 300, float(i % 50), None, 1704067200 + 700 * i, "log", None) for i in range(60) for w in ("short", "weekly")]
    points = spark.createDataFrame(rows, "account_id string, provider string, window_id string, window_minutes long, used_percent double, resets_at long, ts long, source string, plan_type string")
    lines = apply(spark, "spool_lines", snapshots=points).orderBy("line_no").collect()
    assert [r.line_no // 2 for r in lines] == list(range(1, len(lines) + 1)) and [r.ts for r in lines] == sorted(r.ts for r in lines)
    assert len(lines) == sum(2 if r[6] % 13 == 0 else 1 for r in rows)


def test_lines_of_counters_are_laid_out_once(spark, events):
    """The tests of a line stand on its text, not on the expression that lays it out."""
    kept = {}
    apply(spark, "rollout_parsed", kept, events=events)
    df = relations._run(spark, "rollout_parsed", {"events": events, **{n: kept[n] for n in ("counter_source", "snapshots")}}, Settings())
    assert "Contains(" in plan(df) and "Contains(concat" not in plan(df)


def test_new_snapshots_are_found_without_a_join(spark):
    """Both tables are grouped at once; keys with a null are new whatever the store holds, and a key held twice is held."""
    columns = "account_id string, source string, window_id string, ts long, used_percent double"
    rows = [("a", "poll", "w", 1, 5.0), ("a", "poll", "w", 1, 3.0), ("a", "poll", "w", 2, 7.0), (None, "poll", "w", 3, 1.0), (None, "poll", "w", 3, 2.0), ("a", "poll", "w", 4, None)]
    held = [("a", "poll", "w", 2), ("a", "poll", "w", 2), (None, "poll", "w", 3), ("a", "poll", "w", 9)]
    new, old = spark.createDataFrame(rows, columns), spark.createDataFrame(held, columns.rsplit(",", 1)[0])
    df = apply(spark, "insert_ignore_snapshots", union_sources=new, existing_snapshots=old)
    assert "Join" not in plan(df)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("a", "poll", "w", 1, 3.0), (None, "poll", "w", 3, 1.0), ("a", "poll", "w", 4, None)], key=str)


def test_short_spans_meet_events_by_hour(spark):
    """Events at both ends of a span, at a border of hours, in two spans, in none, and without a price."""
    at = 1704067200
    spans = [("a", "p", 1, "short", at, at + 7200), ("a", "p", 1, "other", at + 3599, at + 3600), ("a", "p", 2, "short", at, at + 10)]
    contained = spark.createDataFrame(spans, "account_id string, provider string, instance_id long, window_id string, first_ts long, peak_ts long")
    paid = [(1, at, 1.0), (1, at + 1, 2.0), (1, at + 3600, 4.0), (1, at + 7200, 8.0), (1, at + 7201, 16.0), (1, at + 5, None), (3, at + 5, 32.0)]
    events = spark.createDataFrame([("a", "p", i, t, usd) for i, t, usd in paid], "account_id string, provider string, instance_id long, ts long, usd double")
    totals = spark.createDataFrame([("a", "p", 1, 31.0)], "account_id string, provider string, instance_id long, attributed_usd double")
    df = apply(spark, "dq_attribution", contained=contained, attributed=events, attribution=totals)
    assert re.search(r"Join Inner.*hour_no#\d+L? = hour_no#\d+L?", plan(df))
    assert {r.instance_id: (r.long_usd, r.short_usd, r.status) for r in df.collect()} == {1: (31.0, 18.0, "ok"), 2: (0.0, 0.0, "ok")}


def test_series_are_cut_by_days_and_coalesced_once(spark, events):
    from headroom.plans.windows import SLOT

    kept = {}
    apply(spark, "instances", kept, events=events)
    assert "coalesced" in kept and SLOT <= 86400
