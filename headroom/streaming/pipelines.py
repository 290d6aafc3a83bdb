"""Structured Streaming forms of ingestion and tracking.

`rollout_stream` and `instance_stream` keep typed state (`transformWithStateInPandas`), which
needs the RocksDB state store (`use_rocksdb`). Their rows equal those of the batch relations
on the same input, however it is cut into micro-batches; what that takes of the input is in
each docstring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.ingest import BASELINE
from ..plans.relations import apply
from ..plans.windows import DROP, RESET_SLACK
from ..sources.tables import exists, ship


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that typed state needs, for queries that start from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def line_stream(spark: SparkSession, root: str, account_id: str | Column = "a") -> DataFrame:
    """Lines of immutable part files as they land; `account_id` is a name, or an expression over `file` for a folder of many accounts."""
    lines = spark.readStream.option("recursiveFileLookup", True).text(root)
    lines = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.withColumn("account_id", F.lit(account_id) if isinstance(account_id, str) else account_id).select("account_id", "line", "file")


def usage_stream(lines: DataFrame) -> DataFrame:
    """Usage events of transcript lines (account_id, file, line); what does not parse, is synthetic, empty or negative falls out (the batch job counts it).

    The key is the message and request id; without both it is the file and the line's
    own content, as a stream has no line numbers.
    """
    v = lines.where(F.col("line").contains('"assistant"') & F.col("line").contains('"usage"')).withColumn("v", F.expr("try_parse_json(line)"))
    get = lambda p, t: F.expr(f"try_variant_get(v, '$.{p}', '{t}')")
    n = lambda p: F.coalesce(get(f"message.usage.{p}", "bigint"), F.lit(0))
    split = F.expr("coalesce(schema_of_variant(try_variant_get(v, '$.message.usage.cache_creation', 'variant')) like 'OBJECT%', false)")
    events = v.select(
        "account_id", F.to_timestamp(get("timestamp", "string")).alias("at"), F.coalesce(get("message.model", "string"), F.lit("UNKNOWN")).alias("model"),
        n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), n("cache_read_input_tokens").alias("cached_input_tokens"),
        n("cache_creation.ephemeral_5m_input_tokens").alias("cache_w_5m"), n("cache_creation.ephemeral_1h_input_tokens").alias("cache_w_1h"),
        F.when(split, 0).otherwise(n("cache_creation_input_tokens")).alias("cache_w_unsplit"),
        F.coalesce(F.concat(get("message.id", "string"), F.lit(":"), get("requestId", "string")), F.concat("file", F.lit(":"), F.sha2("line", 256))).alias("dedup_key"),
        get("type", "string").alias("kind"),
    )
    counts = [F.col(c) for c in ("input_tokens", "output_tokens", "cached_input_tokens", "cache_w_5m", "cache_w_1h", "cache_w_unsplit")]
    good = F.col("at").isNotNull() & (F.col("kind") == "assistant") & (F.col("model") != "<synthetic>") & (F.least(*counts) >= 0) & (F.greatest(*counts) > 0)
    return events.where(good).drop("kind")


def dedup_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One event per account and key within the watermark; later copies are left to the batch recomputation."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["account_id", "dedup_key"])


def late_rows(batch: DataFrame, streamed: DataFrame, keys: tuple[str, ...] = ("account_id", "dedup_key")) -> DataFrame:
    """What a batch recomputation has and a stream's table lacks: rows that came after the watermark. The batch is the authority; these are to be added."""
    return batch.join(streamed.select(*keys).distinct(), list(keys), "left_anti")


def weekly_stream(priced: DataFrame, delay: str = "1 day") -> DataFrame:
    """Dollars per Monday week; `priced` has account_id, provider, at, usd."""
    week = F.window("at", "7 days", startTime="4 days")
    return priced.withWatermark("at", delay).groupBy("account_id", "provider", week).agg(F.sum("usd").alias("usd"))


_COUNTERS = ["c_input", "c_cached", "c_write", "c_output"]
_LAST = "line_no long, c_input long, c_cached long, c_write long, c_output long, turn string, session string"
_USAGE = "account_id string, file string, line_no long, dedup_key string, ts long, model string, input_tokens long, cached_input_tokens long, cache_w_unsplit long, output_tokens long"


def counter_steps(counters: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """What each row of counters (input, cached, write, output) adds to the row before it; `before` is the one ahead of the first, None for a file's start."""
    if not len(counters):
        return counters
    prev = np.vstack([counters[:1] if before is None else before[None, :], counters[:-1]])
    step = np.where((counters[:, 0] < prev[:, 0])[:, None], counters, np.maximum(counters - prev, 0))
    if before is None:
        step[0] = 0 if counters[0, [0, 2, 3]].sum() > BASELINE else counters[0]
    return step


class _Rollout(StatefulProcessor):
    """The last line, its counters, the last turn's model and the first session's: all that the next lines of a file depend on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LAST)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.sort_values("line_no").iloc[-1]
        self.last.update(tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in (row[c.split()[0]] for c in _LAST.split(", "))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else None
        line_no, counters, turn, session = (None, None, None, None) if old is None else (old[0], None if old[1] is None else np.array(old[1:5], dtype=np.int64), old[5], old[6])
        new = pd.concat(list(rows)).drop_duplicates("line_no").sort_values("line_no")
        if line_no is not None:
            new = new[new["line_no"] > line_no]  # lines that came before are known
        if not len(new):
            return
        named = new["named"].astype(object).where(new["named"].notna(), None)
        turns = named.where(new["v_type"] == "turn_context").ffill()
        turns = turns.where(turns.notna(), turn)
        met = named.where(new["v_type"] == "session_meta").ffill()
        first = session if session is not None else next((v for v in met if isinstance(v, str)), None)
        sessions = met.where(met.isna(), first) if session is None else pd.Series(session, index=new.index)
        models = turns.where(turns.notna(), sessions)
        models = models.where(models.notna(), "UNKNOWN")
        counts = (new["v_type"] == "event_msg") & (new["p_type"] == "token_count") & new["ts"].notna() & new["has_total"].fillna(False).astype(bool)
        at, values = new[counts], new.loc[counts, _COUNTERS].to_numpy(dtype=np.int64)
        d = counter_steps(values, counters)
        some = d.any(axis=1) if len(d) else np.zeros(0, bool)
        out = pd.DataFrame({
            "account_id": key[0], "file": key[1], "line_no": at["line_no"].to_numpy(np.int64), "dedup_key": key[1] + ":" + at["line_no"].astype("int64").astype(str).to_numpy(object), "ts": at["ts"].to_numpy(np.int64), "model": models[counts].to_numpy(object),
            "input_tokens": np.maximum(0, d[:, 0] - d[:, 1]), "cached_input_tokens": np.maximum(0, d[:, 1]), "cache_w_unsplit": np.maximum(0, d[:, 2]), "output_tokens": np.maximum(0, d[:, 3]),
        })[some]
        kept = values[-1] if len(values) else counters
        text = lambda v: v if isinstance(v, str) else None
        self.last.update((int(new["line_no"].iloc[-1]), *((None,) * 4 if kept is None else (int(v) for v in kept)), text(turns.iloc[-1]), text(first)))
        if len(out):
            yield out

    def close(self) -> None:
        pass


def rollout_stream(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Usage events of rollout lines (account_id, file, line_no, line), as `scan_rollout_usage` has them.

    The lines of a file come in any order within a micro-batch, and a later micro-batch holds
    later ones; lines up to the last known one are repetitions. `before` is the state that
    `rollout_state` gives for lines that a batch job has read.
    """
    spark = lines.sparkSession
    ship(spark)
    parsed = apply(spark, "rollout_parsed", rollout_lines=lines).select("account_id", "file", "line_no", "v_type", "p_type", "ts", "named", "has_total", *_COUNTERS)
    start = None if before is None else before.groupBy("account_id", "file")
    return parsed.groupBy("account_id", "file").transformWithStateInPandas(_Rollout(), _USAGE, "append", "None", start)


def rollout_state(lines: DataFrame) -> DataFrame:
    """What a stream of later lines needs to know of these: a row per file."""
    spark = lines.sparkSession
    parsed = apply(spark, "rollout_parsed", rollout_lines=lines)
    counts = (F.col("v_type") == "event_msg") & (F.col("p_type") == "token_count") & F.col("ts").isNotNull() & F.col("has_total")
    kind = lambda k: F.when((F.col("v_type") == k) & F.col("named").isNotNull(), F.col("line_no"))
    last = F.max_by(F.struct(*_COUNTERS), F.when(counts, F.col("line_no")))
    found = parsed.groupBy("account_id", "file").agg(F.max("line_no").alias("line_no"), last.alias("c"), F.max_by("named", kind("turn_context")).alias("turn"), F.min_by("named", kind("session_meta")).alias("session"))
    return found.select("account_id", "file", "line_no", *[F.col(f"c.{c}").alias(c) for c in _COUNTERS], "turn", "session")


_OPEN = "first_ts long, last_ts long, first_pct double, last_pct double, peak double, peak_ts long, anchor long, minutes long, plan string, resets_at long, n long"
_WAITING = "ts long, used_percent double, source string, window_minutes long, resets_at long, plan_type string"
_CLOSED = (
    "account_id string, provider string, window_id string, first_ts long, last_ts long, covered_secs long, peak_pct double, peak_ts long, "
    "first_pct double, last_pct double, resets_at long, window_minutes long, plan_type string, n_points long"
)


def merged_second(rows: list[tuple]) -> tuple:
    """Rows of one second as one: the largest percent, each other field from the row of the largest percent that has it, of equal percents from the last source."""
    rows = sorted(rows, key=lambda r: (r[1], r[2] or ""), reverse=True)
    known = lambda i: next((r[i] for r in rows if r[i] is not None), None)
    return rows[0][0], rows[0][1], known(3), known(4), known(5)


def fold(now: list | None, row: tuple) -> tuple[list, list | None]:
    """The open instance after `row` (ts, percent, minutes, resets_at, plan), and the one that it closes."""
    ts, percent, minutes, resets, plan = row
    if now is not None:
        first, last, first_pct, last_pct, peak, peak_ts, anchor, length, kept, latest, n = now
        closes = (
            (length is not None and minutes is not None and length != minutes)
            or (anchor is not None and resets is not None and abs(anchor - resets) > RESET_SLACK)
            or percent < last_pct - DROP
            or (length is not None and ts - last > length * 60)
            or (kept is not None and plan is not None and kept != plan)
        )
        if not closes:
            if percent > peak:
                peak, peak_ts = percent, ts
            return [first, ts, first_pct, percent, peak, peak_ts, resets if anchor is None else anchor, minutes if length is None else length, kept if plan is None else plan, latest if resets is None else resets, n + 1], None
    return [ts, ts, percent, percent, percent, ts, resets, minutes, plan, resets, 1], now


class _Tracker(StatefulProcessor):
    """The open instance, and the rows that another one of their second may still join."""

    def __init__(self, timed: bool, close_at_reset: bool):
        self.timed, self.close_at_reset = timed, close_at_reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getListState("waiting", _WAITING)

    def _ends(self, now: list) -> int | None:
        """The second from which on no row can belong to the instance any more: a whole window has passed, or its reset if asked for."""
        ends = [now[1] + now[7] * 60 + 1] if now[7] is not None else []
        if self.close_at_reset and now[9] is not None:
            ends.append(now[9] + 1)
        return min(ends, default=None)

    def _advance(self, key, waiting: list[tuple], timer) -> Iterator[pd.DataFrame]:
        now = list(self.open.get()) if self.open.exists() else None
        # rows before `limit` are complete
        limit = timer.getCurrentWatermarkInMs() // 1000 if self.timed else max((r[0] for r in waiting), default=0)
        ready: dict[int, list[tuple]] = {}
        for r in waiting:
            if r[0] < limit:
                ready.setdefault(r[0], []).append(r)
        left, closed = [r for r in waiting if r[0] >= limit], []
        for ts in sorted(ready):
            now, gone = fold(now, merged_second(ready[ts]))
            if gone is not None:
                closed.append(gone)
        if self.timed and now is not None:
            end = self._ends(now)
            if end is not None and end <= min([limit, *(r[0] for r in left)]):
                closed.append(now)
                now = None
        if now is None:
            self.open.clear()
        else:
            self.open.update(tuple(now))
        self.waiting.put(left) if left else self.waiting.clear()
        if self.timed:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            wake = [r[0] + 1 for r in left] + ([e] if now is not None and (e := self._ends(now)) is not None else [])
            if wake:
                self.handle.registerTimer(max(min(wake) * 1000, timer.getCurrentWatermarkInMs() + 1))
        if closed:
            rows = [(*key, c[0], c[1], c[1] - c[0], c[4], c[5], c[2], c[3], c[9], c[7], c[8], c[10]) for c in closed]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _CLOSED.split(", ")])
            yield frame.astype({"resets_at": "Int64", "window_minutes": "Int64"})

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[[c.split()[0] for c in _WAITING.split(", ")]].astype(object)
        new = new.where(new.notna(), None)
        whole = lambda v: None if v is None else int(v)
        came = [(int(t), float(p), s, whole(m), whole(r), plan) for t, p, s, m, r, plan in zip(*(new[c] for c in new.columns))]
        yield from self._advance(key, self._held() + came, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._held(), timerValues)

    def close(self) -> None:
        pass


def instance_stream(snapshots: DataFrame, delay: str | None = None, close_at_reset: bool = False) -> DataFrame:
    """Instances as they close, as `instance_summary` has them but for their number; the open one stays in the state.

    Rows of one second are merged before they count: the newest second waits in the state
    until a later one comes, so that a second may be cut by micro-batches. Without a `delay`
    later micro-batches must not be earlier in time. With one, snapshots need a timestamp
    column `at`: rows wait for the watermark and may come out of order up to it, and an
    instance also closes when the watermark proves that no row can join it (a whole window
    has passed). `close_at_reset` closes it at its reset already; a row that comes after the
    reset, yet of the same instance to the batch, then starts another one.
    """
    ship(snapshots.sparkSession)
    if delay:
        snapshots = snapshots.withWatermark("at", delay)
    if "source" not in snapshots.columns:
        snapshots = snapshots.withColumn("source", F.lit(None).cast("string"))
    return snapshots.groupBy("account_id", "provider", "window_id").transformWithStateInPandas(_Tracker(bool(delay), close_at_reset), _CLOSED, "append", "EventTime" if delay else "None")


def into_table(events: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("account_id", "dedup_key")):
    """A writer of a stream of events into a table of parts, one a micro-batch, that holds each key once.

    A micro-batch that is run again writes the same part anew, and only keys that no other
    part has enter, so that a replay changes nothing. Rows that come after the watermark are
    not in `events`: `late_rows` finds them in a batch, and `add_late` adds them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _enter(batch.dropDuplicates(list(keys)), path, f"batch={batch_id}", keys)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _enter(rows: DataFrame, path: str, part: str, keys: tuple[str, ...]) -> None:
    spark = rows.sparkSession
    if exists(spark, path):
        others = spark.read.option("recursiveFileLookup", True).schema(rows.schema).parquet(path).where(~F.col("_metadata.file_path").contains(f"/{part}/"))
        rows = rows.join(others.select(*keys), list(keys), "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/{part}")


def add_late(rows: DataFrame, path: str, name: str, keys: tuple[str, ...] = ("account_id", "dedup_key")) -> None:
    """Late rows as a part of their own, by a name that makes a repetition replace itself."""
    _enter(rows.dropDuplicates(list(keys)), path, f"late={name}", keys)


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """All parts of a table that `into_table` and `add_late` write."""
    return spark.read.option("recursiveFileLookup", True).schema(schema).parquet(path)
