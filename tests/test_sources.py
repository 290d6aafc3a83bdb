"""Log files: what is new in them, lines in order, the store and its incremental scans."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from headroom.plans.relations import Settings, apply
from headroom.sources import logs
from headroom.sources.logs import SEEN, changed, listing, new_lines, read_lines
from headroom.sources.refresh import by_folder, refresh
from headroom.sources.store import Store


def marks(found):
    return {r.file.rsplit("/", 1)[1]: (r.rewritten, r.done, r.lines, r.stop) for r in found.collect()}


def test_what_changed(spark, tmp_path):
    at = tmp_path / "logs"
    at.mkdir()
    (at / "a.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(100)))
    (at / "b.jsonl").write_text('{"n":0}\n' * 50)
    (at / "s.jsonl").write_text('{"n":5}\n')
    (at / "open.jsonl").write_text('{"n":1}\n{"n":')
    (at / "c.txt").write_text("x\n")
    first = changed(listing(spark, str(at)), spark.createDataFrame([], SEEN)).checkpoint()
    assert marks(first) == {"a.jsonl": (False, 0, 0, 890), "b.jsonl": (False, 0, 0, 400), "s.jsonl": (False, 0, 0, 8), "open.jsonl": (False, 0, 0, 8)}
    lines = new_lines(first).checkpoint()
    assert lines.count() == 152 and [r.line for r in lines.where(F.col("file").endswith("a.jsonl")).orderBy("line_no").collect()] == [f'{{"n":{i}}}' for i in range(100)]
    counts = lines.groupBy("file").agg(F.max("line_no").alias("lines"))
    seen = first.drop("lines").join(counts, "file").select("file", "size", "mtime", "head", F.col("stop").alias("done"), "lines").checkpoint()
    assert changed(listing(spark, str(at)), seen).count() == 0
    (at / "a.jsonl").write_text('{"n":7}\n')  # shrank
    (at / "s.jsonl").write_text('{"n":6}\n{"n":6')  # other bytes, larger
    (at / "b.jsonl").write_text('{"n":0}\n' * 51)  # grew
    (at / "open.jsonl").write_text('{"n":1}\n{"n":2}\n')  # its last line was finished
    (at / "d.jsonl").write_text('{"n":1}\n')
    found = changed(listing(spark, str(at)), seen).checkpoint()
    assert marks(found) == {"a.jsonl": (True, 0, 0, 8), "s.jsonl": (True, 0, 0, 8), "b.jsonl": (False, 400, 50, 408), "open.jsonl": (False, 8, 1, 16), "d.jsonl": (False, 0, 0, 8)}
    assert sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in new_lines(found).collect()) == [("a.jsonl", 1, '{"n":7}'), ("b.jsonl", 51, '{"n":0}'), ("d.jsonl", 1, '{"n":1}'), ("open.jsonl", 2, '{"n":2}'), ("s.jsonl", 1, '{"n":6}')]


def test_pieces_of_a_file_are_numbered(monkeypatch):
    g = random.Random(3)
    for _ in range(60):
        text = b"".join(bytes(g.choice(b"ab\r") for _ in range(g.choice([0, 1, 3, 30]))) + b"\n" for _ in range(g.randint(1, 60)))
        first, piece = g.choice([0, text.index(b"\n") + 1]), g.randint(1, 50)
        monkeypatch.setattr(logs, "STEP", g.randint(1, 40))
        read = lambda at, n: text[at : at + n]  # noqa: E731, B023
        got = [x for a in range(first, len(text), piece) for x in logs._lines_in(read, a, min(len(text), a + piece), first, len(text))]
        assert got == text[first:].split(b"\n")[:-1]


def test_lines_of_long_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "PIECE", 4096)
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i}\n" for i in range(5000)))
    rows = read_lines(spark, str(tmp_path), F.regexp_extract("file", r"(\w)\.jsonl$", 1)).collect()
    assert len(rows) == 10_000 and all(r.line == f"{r.account_id}{r.line_no - 1}" for r in rows)


def test_few_bytes_of_a_file_of_many(spark, tmp_path):
    """A file above 2 GB: its first bytes, its end and what was appended are read, not its middle."""
    path = tmp_path / "large.jsonl"
    with open(path, "wb") as f:
        f.write(b'{"n":0}\n')
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(b'\n{"n":1}\n{"n":2}\n')
    size = os.path.getsize(path)
    head = next(r.head for r in changed(listing(spark, str(tmp_path)), spark.createDataFrame([], SEEN)).collect())
    asked = []
    found, read = logs.opened(str(path))
    counted = lambda at, n: asked.append(n) or read(at, n)
    assert found == size and logs._last_line_end(counted, size) == size and sum(asked) == 1
    seen = spark.createDataFrame([(str(path), size - 16, None, head, size - 16, 1)], SEEN)
    assert [(r.line_no, r.line) for r in new_lines(changed(listing(spark, str(tmp_path)), seen)).orderBy("line_no").collect()] == [(2, '{"n":1}'), (3, '{"n":2}')]


def said(i, model="m", request="r", n=10, day=1):
    usage = {"input_tokens": n, "output_tokens": 1}
    return json.dumps({"type": "assistant", "timestamp": f"2024-01-{day:02d}T00:00:00Z", "requestId": request, "message": {"id": f"m{i}", "model": model, "usage": usage}}) + "\n"


def counted(n, percent):
    payload = {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n}}, "rate_limits": {"primary": {"used_percent": percent, "window_minutes": 300}}}
    return json.dumps({"type": "event_msg", "timestamp": f"2024-01-01T00:00:{n:02d}Z", "payload": payload}) + "\n"


def spooled(ts, percent):
    return json.dumps({"ts": ts, "rate_limits": {"weekly": {"used_percentage": percent}}}) + "\n"


BROKEN = "{broken \"assistant\" \"usage\"\n"
POLL = "account_id string, payload_id string, ts long, body string, provider string"


def keys(store):
    return sorted((r.dedup_key.rsplit("/", 1)[-1], r.input_tokens) for r in store.events().collect())


def percents(store):
    return sorted((r.source.split(":")[0], r.used_percent) for r in store.snapshots().collect())


def table_files(store, *names):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for n in names for d, _, fs in os.walk(f"{store.path}/{n}") for f in fs if f.startswith("part-")}


def test_refresh(spark, tmp_path):
    at, store = tmp_path / "logs", Store(spark, str(tmp_path / "store"), accounts=2, keys=4)
    (at / "archive").mkdir(parents=True)
    (at / "a.jsonl").write_text(said(1) + said(2) + BROKEN + said(3)[:-1])  # the last line is not finished
    (at / "b.jsonl").write_text(said(2, n=99) + said(4, day=5))
    (at / "rollout-1.jsonl").write_text(counted(5, 10) + counted(9, 11))
    (at / "archive" / "rollout-1.jsonl").write_text(counted(50, 90))
    (at / "archive" / "rollout-2.jsonl").write_text(counted(30, 20))
    (at / "spool.jsonl").write_text(spooled(7, 30) + spooled(7, 30) + spooled(8, -1))
    polls = spark.createDataFrame([("acc", "p1", 1, "{}", "beta"), ("acc", "p2", 2, '{"weekly":{"utilization":3}}', "beta")], POLL)
    one = refresh(store, [str(at)], "acc", "/archive/", polls)
    rollouts = [("rollout-1.jsonl:1", 5), ("rollout-1.jsonl:2", 4), ("rollout-2.jsonl:1", 30)]
    assert keys(store) == sorted([("m1:r", 10), ("m2:r", 10), ("m4:r", 10), *rollouts])
    assert percents(store) == [("poll", 3.0), ("rollout", 10.0), ("rollout", 11.0), ("rollout", 20.0), ("spool", 30.0)]
    assert {(r.source, r.parse_errors) for r in one.summary.collect()} == {("transcripts", 1), ("rollouts", 0), ("spool", 1), ("polls", 1)}
    assert one.files == 5 and store.lifetime_parse_errors() == 3
    # nothing changed, and payloads that are known: nothing is read, written or counted
    there = table_files(store, "files", "raw_events", "events", "snapshots", "scans", "polls")
    two = refresh(store, [str(at)], "acc", "/archive/", polls)
    assert (two.generation, two.files, two.partitions, two.summary.count()) == (1, 0, 0, 0)
    assert table_files(store, "files", "raw_events", "events", "snapshots", "scans", "polls") == there and store.lifetime_parse_errors() == 3
    # the file that held the first copy of m2 is written anew without it: the other copy takes its place
    (at / "a.jsonl").write_text(said(7))
    (at / "rollout-1.jsonl").write_text(counted(5, 10) + counted(9, 11) + counted(20, 12))
    three = refresh(store, [str(at)], "acc", "/archive/")
    assert three.files == 2 and keys(store) == sorted([("m7:r", 10), ("m2:r", 99), ("m4:r", 10), *rollouts, ("rollout-1.jsonl:3", 11)])
    # moved to the archive unchanged: known by its name
    os.rename(at / "rollout-1.jsonl", at / "archive" / "rollout-1.jsonl")
    assert refresh(store, [str(at)], "acc", "/archive/").files == 0
    # a line is appended: only its own day's partition is written
    before = table_files(store, "events")
    with open(at / "b.jsonl", "a") as f:
        f.write(said(9, day=9))
    four = refresh(store, [str(at)], "acc", "/archive/")
    assert four.partitions == 1 and four.summary.where("source = 'transcripts'").first().n_lines == 1
    after = table_files(store, "events")
    assert {f: t for f, t in after.items() if f in before} == before and len(after) == len(before) + 1
    store.compact()
    assert ("m9:r", 10) in keys(store) and store.raw_events().where("dedup_key = 'm1:r'").count() == 0
    (at / "b.jsonl").write_text(said(4, day=5))  # the only m2 and m9 leave, and with them the last row of a day
    refresh(store, [str(at)], "acc", "/archive/")
    assert keys(store) == sorted([("m7:r", 10), ("m4:r", 10), *rollouts, ("rollout-1.jsonl:3", 11)])
    # another session's view of the same folder
    assert keys(Store(spark, store.path, 2, 4)) == keys(store)


def test_a_scan_that_broke_off(spark, tmp_path, monkeypatch):
    at, store = tmp_path / "logs", Store(spark, str(tmp_path / "store"), accounts=2, keys=4)
    at.mkdir()
    (at / "a.jsonl").write_text(said(1) + BROKEN)
    refresh(store, [str(at)], "acc")
    (at / "a.jsonl").write_text(said(1) + BROKEN + said(2) + BROKEN)
    plain = Store.append
    monkeypatch.setattr(Store, "append", lambda self, name, df, g: plain(self, name, df, g) if name != "files" else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        refresh(store, [str(at)], "acc")
    monkeypatch.setattr(Store, "append", plain)
    assert store.lifetime_parse_errors() == 1
    (at / "a.jsonl").write_text(said(1) + BROKEN + said(3) + BROKEN)  # what the broken scan wrote is no more
    refresh(store, [str(at)], "acc")
    assert keys(store) == [("m1:r", 10), ("m3:r", 10)] and store.lifetime_parse_errors() == 2


def test_a_fleet_in_one_scan(spark, tmp_path):
    for account in ("x", "y"):
        (tmp_path / "logs" / account / "deep").mkdir(parents=True)
        (tmp_path / "logs" / account / "deep" / "t.jsonl").write_text(said(1) + said(2, n=3 if account == "x" else 4))
        (tmp_path / "logs" / account / "rollout-1.jsonl").write_text(counted(5, 10))
    by_name = F.regexp_extract("file", r"/logs/([^/]+)/", 1)
    store = Store(spark, str(tmp_path / "store"), accounts=4, keys=4)
    refresh(store, [str(tmp_path / "logs")], by_name)
    got = {(r.account_id, r.dedup_key.rsplit("/", 1)[-1], r.input_tokens) for r in store.events().collect()}
    assert got == {("x", "m1:r", 10), ("x", "m2:r", 3), ("x", "rollout-1.jsonl:1", 5), ("y", "m1:r", 10), ("y", "m2:r", 4), ("y", "rollout-1.jsonl:1", 5)}
    table = spark.createDataFrame([(f"{tmp_path}/logs", "all"), (f"{tmp_path}/logs/y", "why")], "folder string, account_id string")
    other = Store(spark, str(tmp_path / "other"), accounts=4, keys=4)
    refresh(other, [str(tmp_path / "logs")], by_folder(table))
    assert {(r.account_id, r.input_tokens) for r in other.events().where("dedup_key like 'm2%'").collect()} == {("all", 3), ("why", 4)}


def test_any_history_equals_a_full_scan(spark, tmp_path):
    """Files that grow, shrink, are written anew, appear and are copied: after every scan the tables are those of a scan from nothing."""
    g, at = random.Random(1), tmp_path / "logs"
    (at / "x").mkdir(parents=True)
    (at / "y").mkdir()
    name = lambda: at / g.choice("xy") / g.choice(["a.jsonl", "b.jsonl", "rollout-1.jsonl"])
    line = lambda f: counted(g.randint(0, 59), g.randint(-1, 90)) if f.name.startswith("rollout") else g.choice([said(g.randint(0, 5), n=g.randint(1, 9), day=g.randint(1, 4)), BROKEN, '{"type":"user"}\n'])
    store, account = Store(spark, str(tmp_path / "store"), accounts=2, keys=2), F.regexp_extract("file", r"/logs/(\w)/", 1)
    errors = 0
    for step in range(4):
        for _ in range(3):
            f = name()
            text = f.read_text() if f.exists() else ""
            kind = g.random()
            f.write_text(text + "".join(line(f) for _ in range(g.randint(1, 4))) if kind < 0.6 else "".join(line(f) for _ in range(g.randint(0, 4))))
            os.utime(f, (step * 100 + 1000, step * 100 + 1000))
        scan = refresh(store, [str(at)], account)
        errors += int(scan.summary.agg(F.sum("parse_errors")).first()[0] or 0)
        full = Store(spark, str(tmp_path / f"full{step}"), accounts=2, keys=2)
        refresh(full, [str(at)], account)
        rows = lambda df: sorted(map(repr, df.drop("epoch").collect()))
        assert rows(store.events()) == rows(full.events()) and rows(store.snapshots()) == rows(full.snapshots())
    assert store.lifetime_parse_errors() == errors


def test_the_raw_table_stays_in_its_buckets(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("".join(said(i) for i in range(200)))
    store = Store(spark, str(tmp_path / "store"), accounts=2, keys=4)
    refresh(store, [str(tmp_path / "logs")], "acc")
    new = spark.createDataFrame([("acc", f"m{i * 50}:r") for i in range(5)], "account_id string, dedup_key string").repartition(3)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = store.raw_events().join(new, ["account_id", "dedup_key"], "left_semi")
        assert met.count() == 4
        first = spark.sparkContext._jvm.PythonSQLUtils.explainString(met._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    # one exchange by key, that of the new keys: the table is read in its buckets
    assert "Bucketed: true" in first and first.count("Arguments: hashpartitioning(") == 1


def test_a_range_opens_its_partitions_only(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("".join(said(i, day=1 + i % 20) for i in range(100)))
    store = Store(spark, str(tmp_path / "store"), accounts=4, keys=2)
    refresh(store, [str(tmp_path / "logs")], "acc")
    day = 86400
    t0 = 1704067200 + 3 * day
    week = Settings(t0, t0 + 2 * day)
    got = apply(spark, "usage_between", settings=week, usage_events=store.events())
    assert got.count() == 10 and "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()
    assert len(store.events().inputFiles()) == 20
    ranged = store.events(t0, t0 + 2 * day, ["acc"])
    assert len(ranged.collect()) == 10 and store.events(t0, t0 + 2 * day, ["other"]).count() == 0
    read = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(ranged._jdf.queryExecution().executedPlan().collectLeaves())
    files = {leaf.metrics().apply("numFiles").value() for leaf in read if "FileScan" in leaf.toString()}
    assert files == {2}
