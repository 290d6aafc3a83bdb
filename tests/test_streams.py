"""Streams against the batch relations on the same input."""

import datetime
import json
import random

import pyspark.sql.functions as F
import pytest

from headroom.plans.relations import apply
from headroom.streaming.pipelines import add_late, dedup_stream, instance_stream, into_table, late_rows, line_stream, rollout_state, rollout_stream, table, usage_stream, use_rocksdb, weekly_stream

SF = "/root/testdata/sf0.001"


def drained(stream, name, folder, mode="append"):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / f"c_{name}")).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def test_usage_stream_equals_scan(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    lines = apply(spark, "transcript_lines", events=events).where("file not like 'copy-%'")
    lines.select("line").write.text(str(tmp_path / "landed"))
    # every key once in these files, and no line without ids: the file's name does not matter
    want = apply(spark, "scan_transcripts", transcript_lines=lines).select("dedup_key", "model", "input_tokens", "output_tokens", "cached_input_tokens", "cache_w_5m", "cache_w_1h", "cache_w_unsplit")
    got = drained(dedup_stream(usage_stream(line_stream(spark, str(tmp_path / "landed"))), "60 days"), "usage", tmp_path).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_usage_stream_keys(spark, tmp_path):
    line = lambda i, r, n, extra: json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "requestId": r, "message": {"id": i, "usage": {"input_tokens": n, **extra}}})
    split = {"cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}, "cache_creation_input_tokens": 7}
    rows = [line("a", "1", 5, split), line("a", "1", 5, split), line(None, None, 6, {"cache_creation_input_tokens": 2}), line(None, None, 7, {}), line(None, None, 7, {})]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(str(tmp_path / "landed"))
    got = drained(dedup_stream(usage_stream(line_stream(spark, str(tmp_path / "landed"))), "1 day"), "keys", tmp_path).collect()
    assert sorted((r.input_tokens, r.cache_w_5m, r.cache_w_1h, r.cache_w_unsplit, r.model) for r in got) == [(5, 3, 4, 0, "UNKNOWN"), (6, 0, 0, 2, "UNKNOWN"), (7, 0, 0, 0, "UNKNOWN")]


def test_weekly_stream_equals_weekly_usd(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    priced = apply(spark, "priced", events=events).where("usd is not null").select("account_id", "provider", F.timestamp_seconds("ts").alias("at"), "usd")
    priced.coalesce(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "priced"))
    source = spark.readStream.schema(priced.schema).parquet(str(tmp_path / "priced"))
    got = drained(weekly_stream(source), "weekly_dollars", tmp_path, "complete")
    got = {(r.account_id, r.week): r.usd for r in got.select("account_id", F.unix_timestamp("window.start").alias("week"), "usd").collect()}
    want = {(r.account_id, r.week_start): r.usd for r in apply(spark, "weekly_usd", events=events).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_instances_close_at_their_reset(spark, tmp_path):
    schema = "account_id string, provider string, window_id string, window_minutes long, used_percent double, resets_at long, ts long, plan_type string, at timestamp"
    row = lambda w, t, p, resets: ("a", "p", w, 300, float(p), resets, t, None, None)
    use_rocksdb(spark)
    batches = [[row("x", 1000, 5, 1500), row("x", 1100, 9, 1500)], [row("y", 9000, 1, 99000)], [row("y", 9100, 2, 99000)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
        stream = instance_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "landed")), "10 seconds", close_at_reset=True)
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "closed")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "closed")).select("account_id", "provider", "window_id", "first_ts", "last_ts", "peak_pct", "peak_ts").collect()]
    assert got == [("a", "p", "x", 1000, 1100, 9.0, 1100)]


def test_late_rows_are_found_by_the_batch(spark, tmp_path):
    schema = "account_id string, dedup_key string, at timestamp"
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    batches = [[("a", "k1", day(20))], [("a", "k2", day(21))], [("a", "late", day(2)), ("a", "k3", day(22))]]
    for rows in batches:
        df = spark.createDataFrame(rows, "account_id string, dedup_key string, at string").selectExpr("account_id", "dedup_key", "to_timestamp(at) at")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
        stream = dedup_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "landed")), "1 hour")
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    batch, streamed = spark.read.schema(schema).parquet(str(tmp_path / "landed")), spark.read.parquet(str(tmp_path / "out"))
    assert {r.dedup_key for r in streamed.collect()} == {"k1", "k2", "k3"}
    assert [r.dedup_key for r in late_rows(batch, streamed).collect()] == ["late"]


def fed(spark, rows, schema, folder, name, stream, cuts, mode="append"):
    """All rows that a stream gives when its input lands in `cuts` parts, a run each."""
    use_rocksdb(spark)
    landed, out = str(folder / f"{name}_in"), str(folder / f"{name}_out")
    for part in cuts:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(landed)
        run = stream(spark.readStream.schema(schema).parquet(landed)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / f"{name}_c")).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out)


def test_rollout_stream_equals_scan(spark, tmp_path):
    """Lines cut anywhere into micro-batches, counters and models carried on; with a state from the batch for the first half."""
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id % 10 < 2")
    lines = apply(spark, "rollout_lines", events=events).select("account_id", "file", "line_no", "line").orderBy("line_no").checkpoint()
    rows = [tuple(r) for r in lines.collect()]
    want = apply(spark, "scan_rollout_usage", rollout_lines=lines)
    columns = ["account_id", "file", "line_no", "dedup_key", "ts", "model", "input_tokens", "cached_input_tokens", "cache_w_unsplit", "output_tokens"]
    want = sorted(tuple(r) for r in want.select(columns).collect())
    third = len(rows) // 3
    cuts = [range(third), range(third - 3, 2 * third + 1), range(2 * third + 1, len(rows))]  # three lines come twice
    got = fed(spark, rows, lines.schema, tmp_path, "rollouts", rollout_stream, cuts)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == want and len({r[5] for r in want}) > 2
    half = [range(third, len(rows))]
    before = rollout_state(spark.createDataFrame(rows[:third], lines.schema)).checkpoint()
    got = fed(spark, rows, lines.schema, tmp_path, "later", lambda x: rollout_stream(x, before), half)
    known = {(r.account_id, r.file): r.line_no for r in before.collect()}
    assert sorted(tuple(r) for r in got.select(columns).collect()) == [w for w in want if w[2] > known.get(w[:2], 0)]


SNAPS = "account_id string, provider string, window_id string, window_minutes long, used_percent double, resets_at long, ts long, source string, plan_type string, at timestamp"


def some_snapshots():
    g, rows, ts, percent, resets = random.Random(12), [], 1000, 0, 20_000
    for _ in range(160):
        ts += g.choice([0, 0, 60, 300, 900, 20_000])
        percent = g.choice([percent, percent + 2, percent + 7, max(0, percent - 4), 1])
        resets = g.choice([resets, resets, resets + 300, resets + 18_000, None]) or 20_000
        rows.append(("a", "p", g.choice("xy"), g.choice([300, 300, None]), float(percent), g.choice([resets, None]), ts, g.choice(["poll", "rollout", "spool"]), g.choice([None, "basic", "basic", "pro"]), None))
    rows += [("a", "p", w, 300, 1.0, None, ts + 10**6 + i * 10**6, "poll", None, None) for w in "xy" for i in range(3)]
    rows = list({(r[2], r[6], r[7]): r for r in rows}.values())  # a source has one row of a window and second
    return [(*r[:9], datetime.datetime.fromtimestamp(r[6], datetime.timezone.utc)) for r in sorted(rows, key=lambda r: r[6])]


@pytest.mark.parametrize("delay", [None, "1000 seconds"])
def test_instance_stream_equals_summary(spark, tmp_path, delay):
    """Seconds cut by micro-batches and, with a watermark, rows out of order: the closed instances are the batch's."""
    rows = some_snapshots()
    assert len({(r[2], r[6]) for r in rows}) < len(rows) - 10  # many rows share a second
    if delay:
        g = random.Random(3)
        rows = [r for _, r in sorted((r[6] + g.random() * 900, r) for r in rows)]
    columns = ["window_id", "first_ts", "last_ts", "covered_secs", "peak_pct", "peak_ts", "first_pct", "last_pct", "resets_at", "window_minutes", "plan_type", "n_points"]
    batch = sorted((tuple(r) for r in apply(spark, "summary", snapshots=spark.createDataFrame(rows, SNAPS).drop("at")).select(columns).collect()), key=repr)
    end = max(r[6] for r in rows)
    n = len(rows)
    got = fed(spark, rows, SNAPS, tmp_path, f"instances_{bool(delay)}", lambda x: instance_stream(x, delay), [range(n // 2), range(n // 2, 3 * n // 4), range(3 * n // 4, n)])
    got = sorted((tuple(r) for r in got.select(columns).collect()), key=repr)
    assert got == [b for b in batch if b[2] < end - 10**6 - 1 or b in got] and len(got) >= len(batch) - 4 > 20


def test_a_replayed_batch_and_late_rows(spark, tmp_path):
    """A micro-batch that is run again changes nothing, and late rows enter once: the table is the batch's."""
    schema = "account_id string, dedup_key string, n long"
    rows = lambda *keys: spark.createDataFrame([("a", k, i) for i, k in enumerate(keys)], schema)
    path = str(tmp_path / "table")
    rows("k1", "k2", "k2").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for again in range(2):  # another checkpoint: the same input comes as batch 0 once more
        into_table(stream, path, str(tmp_path / f"c{again}")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.dedup_key for r in table(spark, path, stream.schema).collect()) == ["k1", "k2"]
    batch = rows("k0", "k1", "k2", "k3")
    for _ in range(2):
        add_late(late_rows(batch, table(spark, path, stream.schema)), path, "today")
        add_late(batch, path, "today")
        assert sorted(r.dedup_key for r in table(spark, path, stream.schema).collect()) == ["k0", "k1", "k2", "k3"]
