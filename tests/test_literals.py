"""Worked cases by hand on the registered relations: prices, rates, bands, decisions, plan costs, measured time, formats."""

import pytest

from headroom.functions import text as T
from headroom.operators.checks import require_ok
from headroom.plans.relations import Settings, _D, apply
from headroom.sources.refresh import EMPTY_LOGS
from headroom.sources.prices import OPEN_END, book, day, load

DAY, MONTH, WEEK = 86400, 2629746, 604800
SNAP = "account_id string, provider string, window_id string, window_minutes long, used_percent double, resets_at long, ts long, source string, plan_type string"
USAGE = (
    "account_id string, provider string, ts long, model string, input_tokens long, cached_input_tokens long, cache_w_5m long, cache_w_1h long, "
    "cache_w_unsplit long, output_tokens long, dedup_key string, event_id long"
)
QUALIFIED = "account_id string, provider string, instance_id long, first_ts long, rate double, rate_lo double, rate_hi double, approx boolean, dpct double"


def usage(spark, *rows, provider="alpha"):
    return spark.createDataFrame([("a", provider, ts, model, *counts, f"k{i}", i) for i, (ts, model, *counts) in enumerate(rows)], USAGE)


def snaps(spark, *rows, provider="alpha"):
    return spark.createDataFrame([("a", provider, w, m, float(p), r, t, "s", plan) for w, m, t, p, r, plan in rows], SNAP)


def qualified(spark, rates, low=0.5, high=0.5):
    return spark.createDataFrame([("a", "p", i, 1000 - i, float(r), r - low, r + high, False, 20.0) for i, r in enumerate(rates)], QUALIFIED)


@pytest.mark.parametrize(("n", "lo", "med", "hi", "coverage"), [(2, 0.5, 1.5, 2.5, 0.5), (4, 0.5, 2.5, 4.5, 0.875), (7, 0.5, 4, 7.5, 0.984375), (8, 1.5, 4.5, 7.5, 0.929688)])
def test_band_by_number(spark, n, lo, med, hi, coverage):
    r = apply(spark, "band", qualified=qualified(spark, range(1, n + 1))).first()
    assert (r.lo, r.med, r.hi, r.coverage) == (lo, med, hi, coverage)


def test_ends_are_sorted_on_their_own(spark):
    rows = [("a", "p", i, i, c / d * 100, c / (d + 1) * 100, c / (d - 1) * 100, False, float(d)) for i, (c, d) in enumerate([(2.88, 12), (25.0, 100)])]
    r = apply(spark, "band", qualified=spark.createDataFrame(rows, QUALIFIED)).first()
    assert r.hi == round(2.88 / 11 * 100, 6) and r.min_dpct == 12 and r.widening == round(1 / 11, 6)


def test_one_left_out(spark):
    r = apply(spark, "loo_shift", qualified=qualified(spark, [21, 24, 25, 27, 49])).first()
    assert r.shift == 0.04
    assert apply(spark, "band", qualified=qualified(spark, [21])).count() == 0


def test_rates(spark):
    scanned = spark.createDataFrame([("a", "p", 1, 5.88, 12.0, None, True), ("a", "p", 2, 1.0, 10.0, None, True), ("a", "p", 3, 1.0, 10.0, "unpriced", True), ("a", "p", 4, 1.0, 10.0, None, False)], "account_id string, provider string, instance_id long, attributed_usd double, dpct double, reason string, is_scanned boolean")
    got = {r.instance_id: (r.rate_lo, r.rate, r.rate_hi) for r in apply(spark, "instance_rates", scanned=scanned).collect()}
    assert got == {1: (round(588 / 13, 6), 49.0, round(588 / 11, 6)), 2: (round(100 / 11, 6), 10.0, round(100 / 9, 6))}


def test_newest_eight(spark):
    rows = [("a", "p", i, i, "usage_gap" if i in (11, 3, 1) else None) for i in range(12)]
    admitted = spark.createDataFrame(rows, "account_id string, provider string, instance_id long, first_ts long, reason string")
    got = {r.instance_id for r in apply(spark, "scanned", admitted=admitted).where("is_scanned").collect()}
    assert got == {11, 10, 9, 8, 7, 6, 5, 4, 3, 2}
    assert apply(spark, "exclusions", admitted=admitted).first().n == 2  # what lies past the eighth is not counted


@pytest.mark.parametrize(
    ("lo", "hi", "cost", "verdict", "multiple", "extracted", "reason"),
    [
        (200.0, 200.0, 100.0, "KEEP", 2.0, 200.0, None),
        (100.0, 100.0, 100.0, "KEEP", 1.0, 100.0, None),
        (99.0, 99.0, 100.0, "DOWNGRADE", 0.99, 99.0, "less than"),
        (110.0, 150.0, 100.0, "KEEP", 1.1, 110.0, None),
        (50.0, 80.0, 100.0, "DOWNGRADE", 0.8, 80.0, "less than"),
        (80.0, 120.0, 100.0, "UNKNOWN", None, None, "both sides"),
        (80.0, 80.0, None, "UNKNOWN", None, 80.0, "plan cost"),
        (80.0, 80.0, 0.0, "UNKNOWN", None, 80.0, "plan cost"),
        (80.0, 80.0, float("inf"), "UNKNOWN", None, 80.0, "plan cost"),
        (None, None, 100.0, "UNKNOWN", None, None, "extracted"),
        (float("nan"), float("nan"), 100.0, "UNKNOWN", None, None, "extracted"),
        (9.0, 8.0, 100.0, "UNKNOWN", None, None, "extracted"),
    ],
)
def test_decision(spark, lo, hi, cost, verdict, multiple, extracted, reason):
    given = spark.createDataFrame([("a", "p", lo, hi, 0.0, cost, False)], "account_id string, provider string, lo double, hi double, approx_usd double, cost double, approx boolean")
    r = apply(spark, "decision", operands=given).first()
    assert (r.verdict, r.return_multiple, r.extracted_usd) == (verdict, multiple, extracted)
    assert (reason in r.reason) if reason else r.reason is None


BOOK = {
    "price": [
        {"provider": "alpha", "prefix": "m", "from": "2024-01-01", "input": 5.0, "cached": 0.5, "output": 30.0},
        {"provider": "alpha", "prefix": "m-mini", "from": "2024-01-01", "until": "2024-02-01", "input": 2.5, "cached": 0.25, "output": 15.0, "cache_write": 3.0, "approx": True},
        {"provider": "alpha", "prefix": "m-mini", "from": "2024-02-01", "input": 2.0, "cached": 0.2, "output": 12.0},
        {"provider": "beta", "prefix": "s", "from": "2024-01-01", "input": 3.0, "cached": 0.3, "cache_5m": 3.75, "cache_1h": 6.0, "output": 15.0, "split_family": True},
    ],
    "plan": [{"provider": "alpha", "id": "large", "monthly_usd": 100.0}, {"provider": "alpha", "id": "small", "monthly_usd": 20.0}],
}


def test_prices_by_era_and_longest_prefix(spark):
    jan, feb = day("2024-01-15"), day("2024-02-01")
    M = 10**6
    events = usage(spark, (jan, "m-mini-x", M, 0, 0, 0, 0, 0), (feb, "m-mini-x", M, 0, 0, 0, 0, 0), (feb - 1, "m-mini", 0, M, 0, 0, M, M), (jan, "m-max", M, 0, 0, 0, M, 0), (jan, "org/m", M, 0, 0, 0, 0, 0), (day("2023-12-31"), "m", M, 0, 0, 0, 0, 0), (jan, "n", M, 0, 0, 0, 0, 0))
    got = [(r.usd, r.is_approx, r.is_external, r.is_unpriced) for r in apply(spark, "priced", usage_events=events, **book(spark, BOOK)).orderBy("event_id").collect()]
    want = [(2.5, True, False, False), (2.0, False, False, False), (18.25, True, False, False), (10.0, True, False, False), (None, False, True, False), (None, False, False, True), (None, False, False, True)]
    assert [(None if a is None else round(a, 9), *b) for a, *b in got] == want
    events = usage(spark, (jan, "s/x", M, M, M, M, 0, M), (jan, "s", 0, 0, 0, 0, M, 0), provider="beta")
    got = [(round(r.usd, 9), r.is_approx) for r in apply(spark, "priced", usage_events=events, **book(spark, BOOK)).orderBy("event_id").collect()]
    assert got == [(28.05, False), (3.75, True)]


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"input": float("nan")}, "bad rate"), ({"output": float("inf")}, "bad rate"), ({"cached": -1.0}, "bad rate"), ({"input": None}, "bad rate"),
        ({"prefix": ""}, "empty prefix"), ({"until": "2023-01-01"}, "empty era"), ({"prefix": "m-mini"}, "overlapping eras"),
    ],
)
def test_bad_books_are_refused(spark, change, problem):
    with pytest.raises(ValueError, match=problem):
        book(spark, {**BOOK, "price": [{**BOOK["price"][0], **change}, *BOOK["price"][1:]]})


def test_bad_plans_and_files(spark, tmp_path):
    for plans, problem in (([*BOOK["plan"], BOOK["plan"][0]], "repeated plan"), ([{"provider": "alpha", "id": "x", "monthly_usd": float("nan")}], "bad price")):
        with pytest.raises(ValueError, match=problem):
            book(spark, {**BOOK, "plan": plans})
    (tmp_path / "book.toml").write_text('[[price]]\nprovider="alpha"\nprefix="m"\nfrom="2024-01-01"\ninput=1\ncached=0\noutput=2\n[[plan]]\nprovider="alpha"\nid="p"\nmonthly_usd=9\n')
    got = load(spark, str(tmp_path / "book.toml"))
    assert got["prices"].first().until_ts == OPEN_END and got["plans"].first().monthly_usd == 9.0


def test_plan_history_is_priced_by_its_time(spark):
    t = 1_780_000_000
    series = snaps(spark, ("w", 10080, t, 10, t + 7 * DAY, "large"), ("w", 10080, t + 2 * DAY, 60, t + 7 * DAY, "large"), ("w", 10080, t + 10 * DAY, 4, t + 17 * DAY, "small"), ("w", 10080, t + 12 * DAY, 40, t + 17 * DAY, "small"))
    given = {"snapshots": series, "usage_events": usage(spark, (t - 900 * DAY, "m", 1, 0, 0, 0, 0, 0)).limit(0), **book(spark, BOOK)}
    asked = Settings(t - DAY, t + 14 * DAY)
    got = apply(spark, "plan_cost", settings=asked, **given).first()
    assert got.cost == round((100 * 10 * DAY + 20 * (2 * DAY + 1)) / MONTH, 6)
    assert apply(spark, "measured_span", settings=asked, **given).first().measured_secs == 12 * DAY + 1
    far = apply(spark, "measured_span", settings=Settings(t - 90 * DAY, t + 90 * DAY), **given).first()
    assert (far.hull_t0, far.hull_t1) == (t, t + 12 * DAY + 1)
    fixed = spark.createDataFrame([("a", "alpha", 30.0), ("a", "beta", 99.0)], "account_id string, provider string, override_usd double")
    got = apply(spark, "plan_cost", settings=asked, plan_overrides=fixed, **given).first()
    assert got.cost == round(30 * (12 * DAY + 1) / MONTH, 6) and got.monthly_usd == 30


def test_separate_stretches_and_unknown_plans(spark):
    t = 1_780_000_000
    events = usage(spark, (t, "m", 1000, 0, 0, 0, 0, 100), (t + 2 * DAY, "m", 1000, 0, 0, 0, 0, 100))
    series = snaps(spark, ("w", 10080, t + 100 * DAY, 10, t + 107 * DAY, "gone"), ("w", 10080, t + 101 * DAY, 30, t + 107 * DAY, "gone"))
    given = {"usage_events": events, "snapshots": series, **book(spark, BOOK)}
    asked = Settings(0, t + 200 * DAY, "all")
    r = apply(spark, "provider_report", settings=asked, **given).first()
    assert r.measured_secs == 3 * DAY + 2 and "2 separate stretches of 3d 0h" in r.note_disjoint
    assert r.verdict == "UNKNOWN" and r.plan_cost_usd is None and r.monthly_usd is None and "gone" in r.error and "gone" in r.note_unknown_plans
    assert r.kind is None and r.left_reason and r.gap_reason
    # an account without any snapshot is in the report, with nothing made up
    r = apply(spark, "provider_report", settings=asked, **{**given, "snapshots": series.limit(0)}).first()
    assert r.tier is None and r.left_lo is None and "no limit window" in r.left_reason and r.extracted_usd == round(2 * (0.005 + 0.003), 6)
    assert apply(spark, "phrases", settings=asked, **given).first().measured == "3.0d measured"


def test_operative_window(spark):
    now = 1_780_000_000
    asked = Settings(0, now)
    pick = lambda *rows: apply(spark, "operative_window", settings=asked, snapshots=snaps(spark, *rows)).first()
    week, short = ("week", 10080, now - DAY, 10, None, None), ("short", 300, now - 60, 10, None, None)
    assert pick(week, short).window_id == "week"
    assert pick(("week", 10080, now - 8 * DAY, 10, None, None), short).window_id == "short"  # the longer one is not live
    old = pick(("week", 10080, now - 9 * DAY, 10, None, None), ("short", 300, now - 8 * DAY, 10, None, None))
    assert old.window_id == "short" and not old.live
    assert pick(week, ("week_of_model", 43200, now - 60, 10, None, None)).window_id == "week"  # scoped ids do not count


def test_unlock(spark):
    now, first = 1_780_000_000, 1_779_000_000
    tiered = lambda n, complete: spark.createDataFrame([("a", "p", "INSUFFICIENT", n, complete, WEEK)], "account_id string, provider string, tier string, n long, complete long, regime_secs long")
    summary = spark.createDataFrame([("a", "p", "w", first)], "account_id string, provider string, window_id string, first_ts long")
    operative = spark.createDataFrame([("a", "p", "w")], "account_id string, provider string, window_id string")
    got = lambda n, complete: tuple(apply(spark, "unlock", settings=Settings(0, now), tiered=tiered(n, complete), summary=summary, operative=operative).select("needed", "path", "unlocks_at").first())
    assert got(2, 4) == (2, "rate", now + 4 * WEEK)
    assert got(1, 0) == (3, "structural", max(first + 4 * WEEK, now + WEEK))
    assert got(0, 3) == (4, "rate", None)


def test_formats(spark):
    d = _D("spark", Settings())
    one = lambda sql: spark.sql(f"select {sql} x").first().x
    usd = lambda v: one(T.usd(d, f"cast('{v}' as double)"))
    assert [usd(v) for v in ("187.29", "1846.2", "0", "-3.5", "NaN")] == ["$187.29", "$1,846.20", "$0.00", "-$3.50", "$?"]
    whole = lambda v: one(T.usd_whole(d, f"cast('{v}' as double)"))
    assert [whole(v) for v in ("15.09", "39.02", "17.5", "-2", "NaN")] == ["$15", "$39", "$18", "$0", "$?"]
    assert [one(T.count(d, f"cast({n} as bigint)")) for n in (41218, 999, 10**6, 0)] == ["41,218", "999", "1,000,000", "0"]
    assert [one(T.percent(d, f"cast({x} as double)")) for x in (0.9375, 0.875, 0.9921875, 0.5)] == ["93.75%", "87.5%", "99.2188%", "50%"]
    assert [one(T.duration(d, f"cast({s} as bigint)")) for s in (4 * DAY + 11 * 3600, 7800, 300, 59)] == ["4d 11h", "2h 10m", "5m", "0m"]
    assert [one(T.window_word(d, f"cast({m} as bigint)")) for m in (10080, 2880, 300, 45)] == ["weekly", "2d", "5h", "45m"]


def test_rollout_lines(spark):
    count = lambda at, total, limits="": f'{{"timestamp":"{at}","type":"event_msg","payload":{{"type":"token_count","info":{{"total_token_usage":{total}}}{limits}}}}}'
    total = lambda i, c, w, o: f'{{"input_tokens":{i},"cached_input_tokens":{c},"cache_write_input_tokens":{w},"output_tokens":{o}}}'
    limits = ',"rate_limits":{"plan_type":"pro","primary":{"used_percent":12.5,"window_minutes":0,"resets_at":99},"secondary":{"used_percent":-1,"window_minutes":300}}'
    lines = [
        '{"type":"session_meta","payload":{"model":"first"}}', count("2024-01-01T00:00:00Z", total(100, 40, 0, 5), limits), '{"type":"turn_context","model":"second"}',
        count("2024-01-01T00:01:00Z", total(300, 40, 0, 5)), '{"type":"session_meta","payload":{"model":"late"}}', count("2024-01-01T00:02:00Z", total(50, 10, 2, 1)), count("bad", total(900, 0, 0, 0)),
        '{"type":"event_msg","payload":{"type":"token_count","info":null,"rate_limits":null}}', '{"token_count', count("2024-01-01T00:03:00Z", total(50, 10, 2, 1)), "{}", count("2024-01-01T00:04:00.5Z", total(60, 10, 1, 1)),
    ]
    given = {"rollout_lines": spark.createDataFrame([("a", "f", i + 1, line) for i, line in enumerate(lines)], "account_id string, file string, line_no long, line string")}
    got = [(r.line_no, r.model, r.input_tokens, r.cached_input_tokens, r.cache_w_unsplit, r.output_tokens) for r in apply(spark, "scan_rollout_usage", **given).orderBy("line_no").collect()]
    assert got == [(2, "first", 60, 40, 0, 5), (4, "second", 200, 0, 0, 0), (6, "second", 40, 10, 2, 1), (12, "second", 10, 0, 0, 0)]
    points = apply(spark, "scan_rollout_snapshots", **given).collect()
    assert [(r.window_id, r.window_minutes, r.used_percent, r.resets_at, r.plan_type) for r in points] == [("primary", None, 12.5, 99, "pro")]
    assert [(r.line_no, r.step) for r in apply(spark, "counter_warnings", **given).collect()] == [(12, "partial")]


def test_polls_are_refused_whole(spark):
    bodies = [
        '{"plan_type":"pro","rate_limit":{"primary_window":{"used_percent":5,"limit_window_seconds":18000,"reset_at":7},"secondary_window":{"used_percent":6,"limit_window_seconds":0}}}',
        '{"rate_limit":{"primary_window":{"used_percent":5,"limit_window_seconds":18000},"secondary_window":{"used_percent":-6,"limit_window_seconds":18000}}}',
        '{"weekly":{"utilization":30.5,"resets_at":"2024-01-01T00:00:10Z"},"short":{"utilization":1,"resets_at":44}}', '{"weekly":{"utilization":-1},"short":{"utilization":1}}', "not json", "{}",
    ]
    bodies += ['{"weekly":{"utilization":-1}}', '{"short":{"utilization":9}}']  # of the second of a valid one: the one that is refused takes nothing along, the later one adds nothing
    times = [*range(6), 2, 2]
    given = spark.createDataFrame([("a", f"p{i}", t, b) for i, (t, b) in enumerate(zip(times, bodies))], "account_id string, payload_id string, ts long, body string")
    got = sorted((r.ts, r.window_id, r.used_percent, r.window_minutes or 0, r.resets_at or 0) for r in apply(spark, "scan_polls", poll_payloads=given).collect())
    assert got == [(0, "primary", 5.0, 300, 7), (0, "secondary", 6.0, 0, 0), (2, "short", 1.0, 300, 44), (2, "weekly", 30.5, 10080, 1704067210)]
    none = {n: spark.createDataFrame([], s) for n, s in EMPTY_LOGS.items() if n != "poll_payloads"}
    summary = {r.source: r for r in apply(spark, "scan_summary", poll_payloads=given, **none).collect()}
    assert (summary["polls"].n_lines, summary["polls"].parse_errors, summary["polls"].snapshots) == (8, 5, 4)


def test_spool_lines_count_once(spark):
    """A line that is written again is no error and no second snapshot; of two percents of one second the first line's stays."""
    line = lambda t, p: '{"ts":%d,"rate_limits":{"weekly":{"used_percentage":%d}}}' % (t, p)
    rows = [("a", "s", i, 0, x) for i, x in enumerate([line(5, 10), line(5, 10), line(5, 10), line(5, 11), "broken", line(6, -1), line(7, 12)])]
    given = spark.createDataFrame(rows, "account_id string, file string, line_no long, ts long, line string")
    assert sorted((r.ts, r.used_percent) for r in apply(spark, "scan_spool", spool_lines=given).collect()) == [(5, 10.0), (7, 12.0)]
    none = {n: spark.createDataFrame([], s) for n, s in EMPTY_LOGS.items() if n != "spool_lines"}
    summary = {r.source: r for r in apply(spark, "scan_summary", spool_lines=given, **none).collect()}
    assert (summary["spool"].n_lines, summary["spool"].parse_errors, summary["spool"].snapshots) == (7, 2, 2)


@pytest.mark.parametrize("swapped", [False, True])
def test_equal_percents_of_one_second(spark, swapped):
    """Where percents are equal the source that comes last decides, in whatever order rows come."""
    rows = [("a", "p", "w", 300, 5.0, 900, 100, "rollout", "x"), ("a", "p", "w", 10080, 5.0, 800, 100, "poll", "y"), ("a", "p", "w", 60, 4.0, 700, 100, "spool", "z")]
    given = spark.createDataFrame(rows[::-1] if swapped else rows, SNAP).coalesce(1)
    got = apply(spark, "coalesced", snapshots=given).first()
    assert (got.used_percent, got.window_minutes, got.resets_at, got.plan_type) == (5.0, 300, 900, "x")


def test_failed_checks_stop(spark):
    rows = lambda s: spark.createDataFrame([("one", "ok"), ("two", s)], "name string, status string")
    assert require_ok(rows("warn")).count() == 2
    with pytest.raises(RuntimeError, match="two"):
        require_ok(rows("fail"))


def keyed(spark, schema, *rows):
    return spark.createDataFrame([("a", "p", *r) for r in rows], f"account_id string, provider string, {schema}")


TIERED = "tier string, lo double, med double, hi double, bound double, n long, regime_secs long"
OPENED = "first_ts long, last_ts long, last_pct double, resets_at long, usd double"


def test_gap_of_a_calibrated_window(spark):
    """A band of 20.67, 25 and 53.45 at 27 percent; what is proven lifts the lower end."""
    tiered = keyed(spark, TIERED, ("CALIBRATED", 20.67, 25.0, 53.45, 10.0, 4, WEEK))
    gap = lambda usd, bound=None: apply(spark, "live_gap", tiered=tiered if bound is None else keyed(spark, TIERED, ("CALIBRATED", 20.67, 25.0, 53.45, bound, 4, WEEK)), opened=keyed(spark, OPENED, (1, 2, 27.0, 99, usd))).first()
    r = gap(6.0)
    assert (r.kind, round(r.lo, 2), r.med, round(r.hi, 2), r.gap_reason) == ("band", 15.09, 18.25, 39.02, None)
    assert gap(6.0, 24.0).lo == 18.0  # 24 proven less 6 used
    full = apply(spark, "live_gap", tiered=tiered, opened=keyed(spark, OPENED, (1, 2, 104.0, 99, 30.0))).first()
    assert (full.lo, full.med, full.hi) == (0, 0, 0)


@pytest.mark.parametrize(
    ("bound", "usd", "kind", "lo", "reason"),
    [(20.0, 1.7, "floor", 18.3, None), (20.0, 20.0, None, None, "usage in this window covers all that is proven"), (0.0, 1.0, None, None, "not calibrated, and no bound is proven yet")],
)
def test_gap_of_a_window_with_a_bound_only(spark, bound, usd, kind, lo, reason):
    r = apply(spark, "live_gap", tiered=keyed(spark, TIERED, ("MEASURED", 1.0, 2.0, 3.0, bound, 2, WEEK)), opened=keyed(spark, OPENED, (1, 2, 50.0, 99, usd))).first()
    assert (r.kind, r.lo, r.med, r.hi, r.gap_reason) == (kind, lo, None, None, reason)


@pytest.mark.parametrize(("age", "n", "pace", "at", "checkpoint"), [(0.2, 9, "too_young", None, None), (0.25, 3, "uncalibrated", None, 0.25), (0.363, 4, "calibrated", 20.0, 0.25), (0.5, 4, "calibrated", 40.0, 0.5), (0.99, 4, "calibrated", 60.0, 0.75)])
def test_capture_pace(spark, age, n, pace, at, checkpoint):
    now = 1_000_000
    gaps = keyed(spark, "tier string, resets_at long, open_first long, regime_secs long, gap_lo double, gap_med double, gap_hi double", ("CALIBRATED", now + 107 * 3600, now - int(round(age * WEEK)), WEEK, 15.09, 18.25, 39.02))
    curve = keyed(spark, "checkpoint double, med double, n long, skipped long", (0.25, 20.0, n, 0), (0.5, 40.0, n, 0), (0.75, 60.0, n, 0))
    r = apply(spark, "capture_pace", settings=Settings(0, now), gaps=gaps, capture_curve=curve).first()
    assert (r.pace, r.checkpoint_pct, r.checkpoint) == (pace, at, checkpoint)
    assert (round(r.per_day_lo, 2), round(r.per_day_hi, 2)) == (3.38, 8.75)  # 4 days and 11 hours are left


def test_dollars_since_a_start(spark):
    """Certified: from the last plan change on, the end left out; open: after the first snapshot, now counted. Days and single events add up to the definition."""
    now, events = 900_000, [(86_399, 1.0), (200_000, 2.0), (200_001, 4.0), (258_000, 8.0), (300_000, 16.0), (899_999, 32.0), (900_000, 64.0), (900_001, 128.0)]
    priced = keyed(spark, "ts long, usd double", *events, (250_000, None))
    given = {
        "priced": priced, "regime": keyed(spark, "regime_start long, regime_secs long, complete long", (1000, WEEK, 1)), "plan_points": keyed(spark, "ts long, plan_type string", (500, "x"), (200_000, "y")),
        "spans": keyed(spark, "a long, b long", (100_000, 150_000), (190_000, 260_000), (300_000, 300_010)),
    }
    certified = lambda t0: apply(spark, "certified_extraction", settings=Settings(t0, now), **given).first()
    assert (certified(0).start_ts, certified(0).usd) == (200_000, 62.0)
    assert certified(258_001).usd == 48.0 and certified(950_000).usd == 0
    assert apply(spark, "certified_epoch", settings=Settings(0, now), **given).first().secs == 60_000 + 10
    instances = keyed(spark, "first_ts long, last_ts long, last_pct double, resets_at long, regime_secs long, is_open boolean", (200_000, now - 5, 30.0, None, WEEK, True), (1, 2, 3.0, None, WEEK, False))
    opened = apply(spark, "open_extraction", settings=Settings(0, now), priced=priced, op_instances=instances).collect()
    assert [(r.first_ts, r.usd) for r in opened] == [(200_000, 124.0)]
    stale = apply(spark, "open_extraction", settings=Settings(0, now + WEEK), priced=priced, op_instances=instances).count()
    assert stale == 0


PREPARED = "instance_id long, first_ts long, last_ts long, peak_ts long, peak_pct double, first_pct double, covered_secs long, regime_secs long, is_open boolean, dpct double, attributed_usd double, unpriced boolean, approx boolean, usage_gap long, snapshot_gap long"


@pytest.mark.parametrize(
    ("dpct", "unpriced", "span", "usage_gap", "snapshot_gap", "reason"),
    [
        (10.0, False, 8000, 2000, 60480, None), (9.0, True, 8000, 9999, 99999, "low_growth"), (10.0, True, 8000, 9999, 99999, "unpriced"), (10.0, False, 8000, 2001, 99999, "usage_gap"),
        (10.0, False, 100, 1800, 0, None), (10.0, False, 100, 1801, 0, "usage_gap"), (10.0, False, 8000, 2000, 60481, "snapshot_gap"),
    ],
)
def test_gates_in_order_and_at_equality(spark, dpct, unpriced, span, usage_gap, snapshot_gap, reason):
    row = (1, 0, span, span, 50.0, 0.0, span, WEEK, False, dpct, 5.0, unpriced, False, usage_gap, snapshot_gap)
    assert apply(spark, "admission", prepared=keyed(spark, PREPARED, row)).first().reason == reason


def test_polls_against_logs(spark):
    polled = spark.createDataFrame([("a", "w", 40.0, 100_000), ("a", "w", 10.0, 90_000), ("a", "x", 50.0, 100_000), ("a", "y", 7.0, 100_000)], "account_id string, window_id string, used_percent double, ts long")
    logged = spark.createDataFrame([("a", "w", 35.0, 99_000), ("a", "w", 1.0, 98_000), ("a", "w", 99.0, 100_001), ("a", "x", 44.0, 100_000), ("a", "y", 7.0, 13_600)], "account_id string, window_id string, used_percent double, ts long")
    got = apply(spark, "source_crosscheck", scan_polls=polled, scan_rollout_snapshots=logged).collect()
    assert sorted((r.window_id, r.polled, r.logged, r.agrees) for r in got) == [("w", 40.0, 35.0, True), ("x", 50.0, 44.0, False)]  # y: a day old


def test_short_windows_inside_long_ones(spark):
    contained = keyed(spark, "instance_id long, window_id string, first_ts long, peak_ts long", (1, "s", 100, 200), (1, "s", 300, 400), (2, "s", 1000, 1100))
    attributed = keyed(spark, "instance_id long, ts long, usd double", (1, 100, 1.0), (1, 101, 2.0), (1, 200, 4.0), (1, 250, 8.0), (1, 400, 16.0), (2, 1050, 5.0))
    long = lambda one, two: keyed(spark, "instance_id long, attributed_usd double", (1, one), (2, two))
    rows = lambda t: {(r.instance_id, r.short_usd, r.status) for r in apply(spark, "dq_attribution", contained=contained, attributed=attributed, attribution=t).collect()}
    assert rows(long(31.0, 5.0)) == {(1, 22.0, "ok"), (2, 5.0, "ok")} and rows(long(21.99, 4.98)) == {(1, 22.0, "ok"), (2, 5.0, "fail")}


def test_an_entry_for_each_open_window(spark):
    schema = "window_id string, operative boolean, used_pct double, resets_at long, kind string, gap_lo double, gap_med double, gap_hi double"
    now = 1_000_000
    windows = keyed(spark, schema, ("long", True, 27.4, now + 385_200, "band", 15.09, 18.25, 39.02), ("short", False, 50.0, now + 600, None, None, None, None), ("old", True, 10.0, None, "floor", 18.3, None, None), ("none", True, 3.0, now - 5, None, None, None, None))
    got = {r.window_id: r.entry for r in apply(spark, "status_line", settings=Settings(0, now), open_windows=windows).collect()}
    assert got == {
        "long": "p long 27% - $15 to $39 left - resets in 4d 11h", "short": "p short 50% - resets in 10m",
        "old": "p old 10% - at least $18 left", "none": "p none 3% - gap not measured - resets in 0m",
    }
