"""The engine's tables on disk, kept up to date by what changed.

    files/generation=G       what each scan left of the files that it read (the newest row of a source counts)
    raw_events/generation=G  valid events of every file before deduplication, in buckets of (account_id, dedup_key)
    events/bucket=,day=      one event per key: the first of its copies by source and line
    snapshots/bucket=,day=   the first snapshot of each source, window and second
    polls/generation=G       the ids of payloads that were taken or refused
    scans/generation=G       what each scan saw and lost

A generation is one scan that found a change. `files` is written last, so a scan that broke
off has no generation there: its raw rows are not read, and the next scan judges their keys
again. One scan at a time may write.

`events` and `snapshots` are partitioned by account bucket and day. A scan replaces only the
partitions in which a row differs, so that bytes written follow the change; reads of a range
open only the partitions of its days and accounts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import discard, exists, made, remove, written

DAY = 86400
COUNTS = "input_tokens long, cached_input_tokens long, cache_w_5m long, cache_w_1h long, cache_w_unsplit long, output_tokens long"
EVENT = f"account_id string, provider string, dedup_key string, source_file string, epoch long, line_no long, ts long, model string, {COUNTS}, session_id string"
SNAPSHOT = "account_id string, provider string, source string, window_id string, window_minutes long, used_percent double, resets_at long, ts long, plan_type string"
FILE = "account_id string, source_file string, kind string, file string, size long, mtime timestamp, head string, done long, lines long, epoch long"
SCAN = "source string, account_id string, files long, n_lines long, parse_errors long, events long, snapshots long, warnings long, scanned_at timestamp"
POLL = "account_id string, payload_id string"
PLACE = ["bucket", "day"]


@dataclass(frozen=True)
class Store:
    """Tables below `path`. `accounts` buckets of accounts and `keys` buckets of event keys are fixed when the store is made."""

    spark: SparkSession
    path: str
    accounts: int = 16
    keys: int = 32

    # reading

    def _generations(self, name: str, schema: str) -> DataFrame:
        at, schema = f"{self.path}/{name}", f"{schema}, generation int"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        """Of the last scan that was finished; 0 before any."""
        return self._generations("files", FILE).agg(F.max("generation")).first()[0] or 0

    def files(self) -> DataFrame:
        """The newest state of each source."""
        newest = W.partitionBy("account_id", "source_file").orderBy(F.col("generation").desc())
        return self._generations("files", FILE).withColumn("pick", F.row_number().over(newest)).where("pick = 1").drop("pick")

    def raw_events(self) -> DataFrame:
        """All raw events, also of replaced states of files. A table in buckets of its key: a join on the key leaves it where it is."""
        name = "raw_" + hashlib.md5(self.path.encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"create table {name} ({EVENT}, generation int) using parquet partitioned by (generation) clustered by (account_id, dedup_key) into {self.keys} buckets location '{self.path}/raw_events'")
        made(self.spark, f"{self.path}/raw_events")
        self.spark.sql(f"msck repair table {name} sync partitions")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _placed(self, name: str, schema: str) -> DataFrame:
        at, schema = f"{self.path}/{name}", f"{schema}, bucket int, day int"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def _ranged(self, df: DataFrame, t0: int | None, t1: int | None, accounts: list[str] | None) -> DataFrame:
        if t0 is not None:
            df = df.where((F.col("day") >= t0 // DAY) & (F.col("ts") >= t0))
        if t1 is not None:
            df = df.where((F.col("day") <= (t1 - 1) // DAY) & (F.col("ts") < t1))
        if accounts is not None:
            buckets = [r[0] for r in self.spark.createDataFrame([(a,) for a in accounts], "account_id string").select(self.bucket()).distinct().collect()]
            df = df.where(F.col("bucket").isin(buckets) & F.col("account_id").isin(accounts))
        return df

    def events(self, t0: int | None = None, t1: int | None = None, accounts: list[str] | None = None) -> DataFrame:
        """Deduplicated events with t0 <= ts < t1 of the accounts (default: all); only their partitions are opened."""
        return self._ranged(self._placed("events", EVENT), t0, t1, accounts)

    def snapshots(self, t0: int | None = None, t1: int | None = None, accounts: list[str] | None = None) -> DataFrame:
        return self._ranged(self._placed("snapshots", SNAPSHOT), t0, t1, accounts)

    def polls(self) -> DataFrame:
        return self._generations("polls", POLL).where(F.col("generation") <= self.generation())

    def scans(self) -> DataFrame:
        """A row per finished scan that found something, source and account: each line is counted in the scan that read it."""
        return self._generations("scans", SCAN).where(F.col("generation") <= self.generation())

    def lifetime_parse_errors(self) -> int:
        """Lines lost over all scans."""
        return int(self.scans().agg(F.sum("parse_errors")).first()[0] or 0)

    # writing

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("account_id"), F.lit(self.accounts)).cast("int").alias("bucket")

    def append(self, name: str, df: DataFrame, generation: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/generation={generation}")

    def append_raw(self, events: DataFrame, generation: int) -> None:
        names = [c.split()[0] for c in EVENT.split(", ")]
        table = self.raw_events()  # declares it
        name = "raw_" + hashlib.md5(self.path.encode()).hexdigest()
        dealt = events.select(*names, F.lit(generation).cast("int").alias("generation")).repartition(self.keys, "account_id", "dedup_key")
        assert table.columns == dealt.columns
        dealt.write.insertInto(name)

    def drop_unfinished(self) -> None:
        """Removes what a scan that broke off left beside the tables in place."""
        g = self.generation() + 1
        for name in ("raw_events", "scans", "polls"):
            remove(self.spark, f"{self.path}/{name}/generation={g}")

    def replace(self, name: str, schema: str, gone: DataFrame, come: DataFrame, on: list[str]) -> int:
        """Rows whose `on` columns are in `gone` leave the table, `come` enters: partitions that differ are written anew, others are not touched. Returns how many were."""
        names = [c.split()[0] for c in schema.split(", ")]
        placed = come.select(*names).withColumn("bucket", self.bucket()).withColumn("day", F.expr(f"cast(floor(ts / {DAY}) as int)"))
        placed = written(placed, f"{name}-come")
        gone = written(gone.select(*on).distinct(), f"{name}-gone")
        table = self._placed(name, schema)
        old = table.join(gone, on, "left_semi").select(*names, *PLACE)
        both = old.withColumn("side", F.lit(-1)).unionByName(placed.withColumn("side", F.lit(1)))
        differ = both.groupBy(*names, *PLACE).agg(F.sum("side").alias("side")).where("side <> 0")
        places = [(r.bucket, r.day) for r in differ.select(*PLACE).distinct().collect()]  # partitions' names, no more than the table has
        if places:
            here = F.concat_ws("/", *PLACE).isin([f"{b}/{d}" for b, d in places]) & F.col("day").isin(sorted({d for _, d in places})) & F.col("bucket").isin(sorted({b for b, _ in places}))
            after = table.where(here).join(gone, on, "left_anti").select(*names, *PLACE).unionByName(placed.where(here))
            after = written(after, f"{name}-after")
            left = {(r.bucket, r.day) for r in after.select(*PLACE).distinct().collect()}
            if left:
                dealt = after.repartition(*PLACE).sortWithinPartitions(*PLACE, "account_id", "ts")
                dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(f"{self.path}/{name}")
            for b, d in set(places) - left:
                remove(self.spark, f"{self.path}/{name}/bucket={b}/day={d}")
            discard(after)
        discard(placed, gone)
        return len(places)

    def compact(self) -> None:
        """Brings the raw events that count, and the states of files, into one generation: replaced states and small files go. The other tables need no care."""
        g = self.generation()
        states = written(self.files().drop("generation"), "states")
        live = self.raw_events().where(F.col("generation") <= g).drop("generation").join(states.select("account_id", "source_file", "epoch"), ["account_id", "source_file", "epoch"], "left_semi")
        live = written(live, "live")
        self.drop_unfinished()
        self.append_raw(live, g + 1)
        self.append("files", states, g + 1)
        for name in ("raw_events", "files"):
            for old in range(1, g + 1):
                remove(self.spark, f"{self.path}/{name}/generation={old}")
        discard(states, live)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
