"""Trie of conversation prefixes, by truncation peeling.

A node of depth d is a distinct sequence of first d turns. Peeling descends from the deepest
level: the nodes that survived from the level below, with their last turn stripped, meet the
conversations that end at this level and are grouped anew by what is left. A group is a node
of this level, found and summed up at once: its members, children, leaves and saved tokens
are sums over what met there.

A turn is known by the SHA-256 of all turns up to it, so that a path is an array of hashes
and texts leave in the scan. Peeling level by level as one Spark job each is kept for what
needs it: subtrees of at most LIGHT turns are whole in one task each, which peels all of
their levels, whatever their depth; only nodes with larger subtrees ("heavy"; all their
ancestors are heavy too) are grouped by Spark, a job a level. So the jobs are as many as the
deepest heavy node has turns, not the longest conversation. Equal conversations are merged
before anything is dealt out, so that copies weigh as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, ship, written

LIGHT = 100_000  # turns of distinct conversations in a subtree that one task peels
ID_CHUNK = 4096  # ids of one list that travel as one row
ROOT = hashlib.sha256(b"").hexdigest()
_NODE = "depth int, key binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation has from the first one of its hundred: unsigned crc32 of its id, modulo 6."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation with the first turns of conversation c - c % 100 in place of its own; turns are (hash of role and text, code points).

    Turns stand by turn (null first), then by their hash; null roles and texts are empty.
    Rows without a conv_id belong to no conversation. Texts do not leave the scan.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    lean = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.unhex(said).alias("said"), F.char_length(text).cast("long").alias("size"))
    own = lean.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "said", "size"))), lambda t: F.struct(t["said"].alias("said"), t["size"].alias("size"))).alias("turns"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", borrowed(F.col("conv_id")))
    # a hundred conversations share one base at most: no key of this join is hot
    first = own.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("lent"))
    both = own.join(first, "base", "left")
    lent = F.slice(F.coalesce("lent", F.array().cast("array<struct<said:binary,size:bigint>>")), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(lent, rest).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, path, sizes): the hash of each prefix, from the root's on."""
    for batch in batches:
        turns = batch.column(1)
        said, size = turns.flatten().field("said").to_pylist(), turns.flatten().field("size")
        offsets = turns.offsets.to_pylist()
        start, flat, at = offsets[0], [], [0]
        for a, b in zip(offsets, offsets[1:]):
            h = bytes.fromhex(ROOT)
            flat.append(h)
            for s in said[a - start : b - start]:
                h = hashlib.sha256(h + s).digest()
                flat.append(h)
            at.append(len(flat))
        path = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.binary()))
        sizes = pa.ListArray.from_arrays(pa.array([o - start for o in offsets], pa.int32()), size)
        yield pa.RecordBatch.from_arrays([batch.column(0), path, sizes], ["conv_id", "path", "sizes"])


class _Node:
    __slots__ = ("path", "sizes", "conv_id", "n", "children", "leaves", "saved")

    def __init__(self, path, sizes):
        self.path, self.sizes, self.conv_id, self.n, self.children, self.leaves, self.saved = path, sizes, None, 0, 0, 0, 0


def peel(ended: list[tuple], tops: list[int]) -> Iterator[tuple]:
    """All nodes of whole subtrees, from (path, sizes, smallest id, conversations) of what ends in them and the depth of each one's subtree.

    Yields (depth, key, parent, conv_id, n_convs, n_children, n_leaves, saved_tokens, parent_conv_id);
    the parent's id is None for the top of a subtree, which lies outside.
    """
    levels: dict[int, list] = {}
    for row, top in zip(ended, tops):
        levels.setdefault(len(row[0]) - 1, []).append((row, top))
    alive: dict[bytes, tuple[_Node, int]] = {}
    found: list[tuple[int, bytes, bytes | None, _Node, int]] = []
    for depth in range(max(levels, default=-1), -1, -1):
        if not alive and depth not in levels:
            continue
        here: dict[bytes, tuple[_Node, int]] = {}
        for below, top in alive.values():  # what survived, without its last turn
            node = here.setdefault(below.path[depth], (_Node(below.path, below.sizes), top))[0]
            node.conv_id = below.conv_id if node.conv_id is None else min(node.conv_id, below.conv_id)
            node.n += below.n
            node.children += 1
            node.leaves += below.leaves
            node.saved += below.saved
        for (path, sizes, conv_id, n), top in levels.pop(depth, ()):  # what ends here
            node = here.setdefault(path[depth], (_Node(path, sizes), top))[0]
            node.conv_id = conv_id if node.conv_id is None else min(node.conv_id, conv_id)
            node.n += n
        alive = {}
        for key, (node, top) in here.items():
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.sizes[depth - 1] if depth else 0
            found.append((depth, key, node.path[depth - 1] if depth else None, node, top))
            if depth > top:
                alive[key] = (node, top)
    ids = {(depth, key): node.conv_id for depth, key, _, node, _ in found}
    for depth, key, parent, node, top in found:
        yield depth, key, parent, node.conv_id, node.n, node.children, node.leaves, node.saved, ids[depth - 1, parent] if depth > top else None


_LIGHT_NODE = _NODE + ", path array<binary>, sizes array<long>"


def _peeled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Subtrees come whole, one after the other; some are peeled together, and no more than LIGHT turns and one subtree are held."""
    columns = ["depth", "key", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id"]

    def out(rows: list) -> pd.DataFrame:
        paths = {bytes(r.path[r.top]): r for r in rows}
        nodes = list(peel([([bytes(k) for k in r.path], r.sizes, r.conv_id, r.n) for r in rows], [r.top for r in rows]))
        frame = pd.DataFrame(nodes, columns=columns)
        tops = [paths[n[1]] if n[8] is None else None for n in nodes]
        frame["path"] = [None if r is None else list(r.path[: r.top + 1]) for r in tops]
        frame["sizes"] = [None if r is None else list(r.sizes[: r.top]) for r in tops]
        return frame.astype({"parent_conv_id": "Int64"})

    held, turns, last = [], 0, None
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.subtree != last and turns >= LIGHT:
                yield out(held)
                held, turns = [], 0
            last = r.subtree
            held.append(r)
            turns += len(r.path)
    if held:
        yield out(held)


def _grouped(rows: DataFrame, depth: int) -> DataFrame:
    """One level by Spark: rows (path, sizes, conv_id, n, kind, leaves, saved) that meet at `depth`, as its nodes."""
    key = F.element_at("path", depth + 1)
    size = F.element_at("sizes", depth) if depth else F.lit(0).cast("long")
    level = rows.withColumn("key", key).groupBy("key").agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"),
        F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("below"),
    )
    parent = F.element_at("path", depth) if depth else F.lit(None).cast("binary")
    saved = F.col("below") + (F.col("n_convs") - 1) * size
    return level.select(F.lit(depth).alias("depth"), "key", parent.alias("parent"), "conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.slice("path", 1, depth + 1).alias("path"), F.slice("sizes", 1, depth).alias("sizes"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list of ids, which comes in order, a part a row: no list is held."""
    key, digest = None, None
    for batch in batches:
        keys, shas = [], []
        for k, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                digest.update(b"," + part.encode())
                continue
            if key is not None:
                keys.append(key)
                shas.append(digest.hexdigest())
            key, digest = k, hashlib.sha256(part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256): the ids of the conversations that end at each node, hashed in order; lists travel in parts of ID_CHUNK ids' range."""
    ended = paths.select(F.element_at("path", -1).alias("key"), "conv_id", F.floor(F.col("conv_id") / F.lit(ID_CHUNK)).alias("part"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ended.groupBy("key", "part").agg(ids.alias("ids"))
    return parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_hashed, "key binary, ends_sha256 string")


def _heavy(ended: DataFrame, light: int) -> tuple[DataFrame, int]:
    """(rows with `top`, deepest heavy level): the top of a row's light subtree, below its last heavy node; a heavy node holds over `light` turns of more than one row.

    Heavy nodes have heavy parents, so that levels are looked at from the root on until one has none.
    """
    rows, depth = ended.withColumn("top", F.lit(0)), 0
    while True:
        still = rows.where((F.col("top") == depth) & (F.size("path") > depth))
        keys = still.groupBy(F.element_at("path", depth + 1).alias("heavy")).agg(F.count("*").alias("k"), F.sum(F.size("path")).alias("t"))
        keys = written(keys.where((F.col("k") > 1) & (F.col("t") > light)).select("heavy"), "heavy")
        if not keys.limit(1).count():
            discard(keys)
            return rows, depth - 1
        at = F.when((F.col("top") == depth) & (F.size("path") > depth), F.get("path", F.lit(depth)))
        before, rows = rows, written(rows.withColumn("__at", at).join(keys, F.col("__at") == F.col("heavy"), "left").withColumn("top", F.when(F.col("heavy").isNotNull(), depth + 1).otherwise(F.col("top"))).drop("__at", "heavy"), "tops")
        discard(keys)
        if depth:
            discard(before)
        depth += 1


def prefix_trie(conversations: DataFrame, light: int = LIGHT) -> DataFrame:
    """A row per node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Needs conv_id, turn, role and text; other columns are ignored. Rows without a conv_id
    belong to no conversation; equal turns of one conversation stand by the hash of what
    they say; repeated rows are turns of their own. A conversation left without turns ends
    at the root. An empty table has no nodes. Any depth works: one conversation's hashes
    (about 40 bytes a turn) are the most that must stand together.
    """
    ship(conversations.sparkSession)
    schema = "conv_id long, path array<binary>, sizes array<long>"
    paths = written(rebuilt(conversations).mapInArrow(_paths, schema), "paths")
    hashes = written(ends(paths), "ends")
    # equal conversations are one row, whatever their number
    ended = paths.groupBy(F.element_at("path", -1).alias("key")).agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    ended = written(ended.drop("key"), "ended")
    rows, deepest = _heavy(ended, light)
    rows = written(rows, "dealt")
    own = rows.where(F.size("path") > F.col("top"))
    own = own.withColumn("subtree", F.get("path", F.col("top"))).repartition("subtree").sortWithinPartitions("subtree")
    nodes = written(own.select("path", "sizes", "conv_id", "n", "top", "subtree").mapInPandas(_peeled, _LIGHT_NODE), "light")
    plain = [f.split()[0] for f in _NODE.split(", ")]
    inside = nodes.where("parent_conv_id is not null or depth = 0")
    tops = nodes.where("parent_conv_id is null and depth > 0").select(*plain[:-1], "path", "sizes")
    levels = [inside.select(plain)]
    surviving, written_levels = tops.where(F.col("depth") == deepest + 1), []
    for depth in range(deepest, -1, -1):
        up = surviving.select("path", "sizes", "conv_id", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        zero = F.lit(0).cast("long")
        here = rows.where(F.size("path") == F.lit(depth + 1)).where(F.col("top") > depth).select("path", "sizes", "conv_id", "n", zero.alias("child"), zero.alias("leaves"), zero.alias("saved"))
        level = written(_grouped(up.unionByName(here), depth), f"level{depth}")
        written_levels.append(level)
        levels.append(surviving.select(plain[:-1]).join(level.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left").select(plain))
        surviving = level.unionByName(tops.where(F.col("depth") == depth))
    if deepest >= 0:  # the root
        levels.append(surviving.where("depth = 0").select(*plain[:-1], F.lit(None).cast("long").alias("parent_conv_id")))
    every = reduce(DataFrame.unionByName, levels)
    out = every.join(hashes, "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(ROOT)).alias("ends_sha256")
    )
    out = written(out, "trie")
    for table in (paths, hashes, ended, rows, nodes, *written_levels):
        discard(table)
    return out
