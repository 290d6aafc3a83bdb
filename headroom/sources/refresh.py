"""Ingestion as one job over a store: a scan reads what is new, and judges again only what that touches.

Transcripts that grew are read from where the last scan stopped. Rollouts (whose counters
depend on the lines before) and spools are read whole when they change. The events of what
was read go to the store's raw table; of all their keys, and of those that a rewritten file
held before, the first copy is chosen anew among all files, and only the partitions of
`events` and `snapshots` in which a row then differs are written. A tree without a change
costs the listing: nothing is read, derived or written, and nothing is counted twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.relations import apply
from .logs import SEEN, changed, listing, new_lines
from .store import EVENT, FILE, SNAPSHOT, Store, union_all
from .tables import discard, written

#: Raw inputs of the relations, empty.
EMPTY_LOGS = {
    "transcript_lines": "account_id string, file string, line_no long, line string", "rollout_lines": "account_id string, file string, line_no long, line string",
    "spool_lines": "account_id string, file string, line_no long, ts long, line string", "poll_payloads": "account_id string, payload_id string, ts long, body string",
}
ROLLOUT, SPOOL = r"(^|/)rollout-[^/]*\.jsonl$", r"(^|/)spool[^/]*\.jsonl$"
PROVIDERS = {"rollout": "alpha", "transcript": "beta", "spool": "beta"}


@dataclass
class Scan:
    """What a scan found: files that it read, rows of the store's `scans`, and how many partitions it wrote."""

    generation: int
    files: int
    partitions: int
    summary: DataFrame


def by_folder(folders: DataFrame) -> "callable":
    """An account's name for each file, from (folder, account_id): the deepest folder above the file."""

    def account(files: DataFrame) -> DataFrame:
        parts = F.split("file", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        met = files.select("file", F.explode(above).alias("folder")).join(folders, "folder")
        named = met.groupBy("file").agg(F.max_by("account_id", F.length("folder")).alias("account_id"))
        return files.join(named, "file")

    return account


def _named(files: DataFrame, accounts) -> DataFrame:
    if callable(accounts) and not isinstance(accounts, Column):
        return accounts(files)
    return files.withColumn("account_id", F.lit(accounts) if isinstance(accounts, str) else accounts)


def sources(files: DataFrame, accounts, archive: str | None) -> DataFrame:
    """Files with account_id, kind and source_file. A rollout is known by its name, so that moving it to the archive changes nothing; its active copy beats an archived one."""
    kind = F.when(F.col("file").rlike(ROLLOUT), "rollout").when(F.col("file").rlike(SPOOL), "spool").otherwise("transcript")
    named = _named(files, accounts).withColumn("kind", kind)
    named = named.withColumn("source_file", F.when(F.col("kind") == "rollout", F.element_at(F.split("file", "/"), -1)).otherwise(F.col("file")))
    old = F.lit(False) if archive is None else F.col("file").contains(archive)
    order = W.partitionBy("account_id", "source_file").orderBy("old", "file")
    return named.withColumn("old", old).withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("old", "pick")


def _derived(spark: SparkSession, given: dict[str, DataFrame]):
    kept: dict[str, DataFrame] = {}
    return kept, lambda name: apply(spark, name, kept, **given)


def refresh(store: Store, roots: list[str], accounts: str | Column, archive: str | None = None, polls: DataFrame | None = None, providers: dict[str, str] = PROVIDERS) -> Scan:
    """One scan of all *.jsonl files below `roots`, of any number of accounts.

    `accounts` is an account's name, an expression over `file`, or what `by_folder` makes of
    a table. rollout-*.jsonl are rollouts (those under a path that contains `archive` count
    only where no active file of the account has their name), spool*.jsonl are spools, all
    others transcripts. `polls` (account_id, payload_id, ts, body, provider) are landed
    payloads; each id is taken once, and one that is refused shows in the summary and stops
    nothing. An unfinished last line waits for the next scan; a file that vanished keeps its
    rows. Files that no account claims are left alone.
    """
    spark, g = store.spark, store.generation() + 1
    states = store.files().drop("generation")
    now = sources(listing(spark, roots), accounts, archive).where(F.col("account_id").isNotNull())
    known = now.select("account_id", "source_file", "kind", "file", "size", "mtime")
    before = known.select("account_id", "source_file", "file").join(states.drop("file", "kind"), ["account_id", "source_file"])
    found = changed(known.select("file", "size", "mtime"), before.select(*[c.split()[0] for c in SEEN.split(", ")]))
    found = written(found.join(known.select("account_id", "source_file", "kind", "file"), "file").join(before.select("file", "epoch"), "file", "left"), "changed")
    payloads = None
    if polls is not None:
        seen = store.polls().select("account_id", "payload_id").withColumnRenamed("payload_id", "id")
        payloads = written(polls.dropDuplicates(["account_id", "payload_id"]).join(seen, (polls["account_id"] == seen["account_id"]) & (polls["payload_id"] == seen["id"]), "left_anti"), "payloads")
    n_files, n_payloads = found.count(), payloads.count() if payloads is not None else 0
    if not n_files and not n_payloads:
        discard(found, *([payloads] if payloads is not None else []))
        return Scan(g - 1, 0, 0, store.scans().limit(0))
    # rollouts and spools are read whole whenever they change: another epoch of theirs
    whole = F.col("kind") != "transcript"
    anew = F.col("rewritten") | (whole & F.col("known"))
    epoch = F.when(~F.col("known"), F.lit(1)).when(anew, F.col("epoch") + 1).otherwise(F.col("epoch")).cast("long")
    read = found.withColumn("anew", anew).withColumn("epoch", epoch).withColumn("done", F.when(whole, F.lit(0)).otherwise(F.col("done"))).withColumn("lines", F.when(whole, F.lit(0)).otherwise(F.col("lines")))
    lines = written(new_lines(read, ("account_id", "kind", "source_file", "epoch")), "lines")
    of_kind = lambda k: lines.where(F.col("kind") == k).select("account_id", F.col("source_file").alias("file"), "line_no", "line")
    empty = lambda n: spark.createDataFrame([], EMPTY_LOGS[n])
    spooled = of_kind("spool").withColumn("ts", F.lit(0).cast("long")).select("account_id", "file", "line_no", "ts", "line")
    kept, derived = _derived(spark, {"transcript_lines": of_kind("transcript"), "rollout_lines": of_kind("rollout"), "spool_lines": spooled, "poll_payloads": payloads.select("account_id", "payload_id", "ts", "body") if n_payloads else empty("poll_payloads")})
    names = [c.split()[0] for c in EVENT.split(", ")]
    zero, epochs = F.lit(0).cast("long"), read.select("account_id", "source_file", "epoch")
    counts = ["input_tokens", "cached_input_tokens", "cache_w_5m", "cache_w_1h", "cache_w_unsplit", "output_tokens"]
    said = derived("ingest_lines").where("reason is null").select("account_id", "dedup_key", F.col("file").alias("source_file"), "line_no", "ts", "model", *counts, "session_id", F.lit(providers["transcript"]).alias("provider"))
    counted = derived("scan_rollout_usage").select("account_id", "dedup_key", F.col("file").alias("source_file"), "line_no", "ts", "model", "input_tokens", "cached_input_tokens", zero.alias("cache_w_5m"), zero.alias("cache_w_1h"), "cache_w_unsplit", "output_tokens", F.lit(None).cast("string").alias("session_id"), F.lit(providers["rollout"]).alias("provider"))
    fresh = written(said.unionByName(counted).join(epochs, ["account_id", "source_file"]).select(*names), "fresh")
    partitions = _replace_events(store, g, read, fresh)
    points = [
        derived("rollout_points").where("valid").select("account_id", F.lit(providers["rollout"]).alias("provider"), F.concat(F.lit("rollout:"), "file").alias("source"), "line_no", "window_id", "window_minutes", "used_percent", "resets_at", "ts", "plan_type"),
        derived("spool_points").select("account_id", F.lit(providers["spool"]).alias("provider"), F.concat(F.lit("spool:"), "file").alias("source"), "line_no", "window_id", "window_minutes", "used_percent", "resets_at", "ts", F.lit(None).cast("string").alias("plan_type")),
    ]
    first = W.partitionBy("account_id", "source", "window_id", "ts").orderBy("line_no")
    points = union_all(*points).withColumn("pick", F.row_number().over(first)).where("pick = 1")
    changed_sources = read.where(whole).select("account_id", F.concat_ws(":", "kind", "source_file").alias("source"))
    partitions += store.replace("snapshots", SNAPSHOT, changed_sources, points, ["account_id", "source"])
    summary = derived("scan_summary")
    if n_payloads:
        partitions += _add_polls(store, derived("poll_points"), payloads)
        store.append("polls", payloads.select("account_id", "payload_id"), g)
    store.append("scans", summary.withColumn("scanned_at", F.current_timestamp()), g)
    counted_lines = lines.groupBy("account_id", "source_file").agg(F.max("line_no").alias("last"))
    state = read.join(counted_lines, ["account_id", "source_file"], "left").withColumn("lines", F.coalesce("last", "lines")).withColumn("done", F.greatest("stop", "done"))
    store.append("files", state.select(*[c.split()[0] for c in FILE.split(", ")]), g)  # the scan counts from here on
    discard(found, lines, fresh, *kept.values(), *([payloads] if payloads is not None else []))
    return Scan(g, n_files, partitions, store.scans().where(F.col("generation") == g))


def _replace_events(store: Store, g: int, read: DataFrame, fresh: DataFrame) -> int:
    """Judges the keys of the new rows again, those that the files read anew held before, and those of a scan that broke off."""
    key = ["account_id", "dedup_key"]
    raw = store.raw_events()
    anew = read.where("anew").select("account_id", "source_file")
    held = raw.where(F.col("generation") < g).join(F.broadcast(anew) if _few(anew) else anew, ["account_id", "source_file"], "left_semi").select(*key)
    broken = raw.where(F.col("generation") >= g).select(*key)
    touched = written(fresh.select(*key).unionByName(held).unionByName(broken).distinct(), "touched")
    store.drop_unfinished()
    store.append_raw(fresh, g)
    # the raw table stays in its buckets: only the touched keys travel
    copies = store.raw_events().join(touched, key, "left_semi")
    state = store.files().select("account_id", "source_file", "epoch")
    newer = read.select("account_id", "source_file", "epoch")
    state = state.join(newer.select("account_id", "source_file"), ["account_id", "source_file"], "left_anti").unionByName(newer)
    order = W.partitionBy(*key).orderBy("source_file", "line_no")
    winners = copies.join(state, ["account_id", "source_file", "epoch"]).withColumn("pick", F.row_number().over(order)).where("pick = 1")
    n = store.replace("events", EVENT, touched, winners, key)
    discard(touched)
    return n


FEW = 100_000  # names of files that may be broadcast


def _few(names: DataFrame) -> bool:
    return names.limit(FEW + 1).count() <= FEW


def _add_polls(store: Store, points: DataFrame, payloads: DataFrame) -> int:
    """Snapshots of new payloads; the first of a window and second stays, whichever scan brought it."""
    key = ["account_id", "source", "window_id", "ts"]
    owner = payloads.select("account_id", "payload_id", "provider")
    fresh = points.join(owner, ["account_id", "payload_id"]).withColumn("source", F.lit("poll"))
    fresh = fresh.withColumn("pick", F.row_number().over(W.partitionBy(*key).orderBy("payload_id"))).where("pick = 1")
    fresh = fresh.join(store.snapshots().where("source = 'poll'").select(*key), key, "left_anti")
    return store.replace("snapshots", SNAPSHOT, fresh.limit(0), fresh, key)
