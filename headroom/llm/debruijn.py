"""Substring dedup of long word sequences over a compacted de Bruijn graph.

Edges are the sequences of `window` words (k-mers), nodes their first and last window - 1
words; a document is a walk. Only edges that occur in several documents matter, and they
leave the scan in runs, as is usual for graphs that do not fit one machine:

1. Runs of edges that share a minimizer (`blocks`) meet by it. A run that is whole in
   several documents is one compact edge. Where different runs meet at a minimizer, their
   single edges are joined.
2. Every later occurrence of an edge has source coordinates: the document and place where
   the edge comes first. A node does not branch if all occurrences that enter it come by one
   edge and all that leave it go by one, in their documents and at their sources alike; an
   occurrence that ends there, or goes on along an edge that is not repeated, is a branch too.
   The edges at such nodes are one path. Paths are compacted by pointer doubling, a join per
   doubling, so that a path of n edges takes log2(n) joins.
3. Whoever walks the first edge of a path walks all of it, so a path's first edge alone says
   where it is repeated: each of its occurrences, as long as the path, is one repeated span
   (document, words, source document, source words). The other edges are not looked at again.
4. The words at both coordinates of each span are compared (by a 160-bit digest of the
   words themselves, so that texts need not travel) before the result is given, and the
   spans are cut out of the documents' own words. Hashes that disagreed with the words
   would raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .blocks import NODE_ROW, SHIFT, Shape, cut_spans, emit, hot_grams, ordered_key, place_of, word_symbols
from .common import discard, partitions, written

ANCHOR = 24
_EDGE_ROW = "e1 long, e2 long, u long, v long, key long, place long, src_key long, src_place long"


def _edges(window: int):
    """The single edges of the asked runs: two independent hashes, nodes, document and place; of equal ones in a batch, where the first stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.text_slices(batch, 1):
                hashes, second, words = word_symbols(rows.column(1))
                asked = rows.column(2)
                count = np.diff(asked.offsets.to_numpy())
                pos = asked.flatten().to_numpy()
                doc = np.repeat(np.arange(rows.num_rows), count)
                n = pos % SHIFT
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(pos // SHIFT, n) + inner
                doc = np.repeat(doc, n)
                at = place + words[doc]
                first, other = K.prefix_hash(hashes), K.prefix_hash(second)
                key = rows.column(0).to_numpy()[doc]
                h1, h2 = K.span_hash(first, at, at + window), K.span_hash(other, at, at + window)
                order = np.lexsort((place, key, h2, h1))
                at, h1, h2, key, place = at[order], h1[order], h2[order], key[order], place[order]
                same = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
                src = np.maximum.accumulate(np.where(same, 0, np.arange(len(key)))) if len(key) else np.zeros(0, np.int64)
                plain = ~(same & (key > key[src])) if len(key) else np.zeros(0, bool)
                u, v = K.span_hash(first, at, at + window - 1), K.span_hash(first, at + 1, at + window)
                cols = [h1.view(np.int64), h2.view(np.int64), u.view(np.int64), v.view(np.int64), key, place, pa.array(key[src], mask=plain), pa.array(place[src], mask=plain)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[c.split()[0] for c in _EDGE_ROW.split(", ")])

    return run


def repeated_edges(docs: DataFrame, window: int) -> DataFrame:
    """(edge, u, v, n, key, place, src_key, src_place): every run of n edges that also starts in an earlier document, src.

    `u` and `v` are the nodes at its ends. A run is a compact edge, or a single one.
    """
    shape, n = Shape(window, min(ANCHOR, max(1, window // 2)), word_symbols), partitions(docs)
    rows = docs.select("key", "text").mapInArrow(emit(shape, hot_grams(docs, shape, n), False, nodes=True), NODE_ROW)
    rows = rows.repartition(n, "gram").sortWithinPartitions("gram", "block", "key", "pos")  # serves all windows below
    by_gram, by_block = W.partitionBy("gram"), W.partitionBy("gram", "block")
    first = F.min(F.struct("key", "pos")).over(by_block)
    several = F.min("block").over(by_gram) != F.max("block").over(by_gram)
    rows = rows.select("gram", "block", "key", "pos", "u", "v", "src_key", "src_pos", first.alias("first"), several.alias("several"))
    known = F.col("src_key").isNotNull()
    repeat = known | (F.col("key") > F.col("first.key"))
    rows = rows.where(repeat | F.col("several")).select(
        "block", "u", "v", "key", "pos", F.when(known, F.col("src_key")).when(repeat, F.col("first.key")).alias("src_key"), F.when(known, F.col("src_pos")).when(repeat, F.col("first.pos")).alias("src_pos")
    )
    rows = written(rows, "runs")
    whole = rows.where("src_key is not null").select(
        F.col("block").alias("edge"), "u", "v", F.greatest(F.col("pos") % SHIFT, F.lit(1)).cast("long").alias("n"), "key", place_of("pos").alias("place"), "src_key", place_of("src_pos").alias("src_place")
    )
    asked = rows.where("src_key is null").groupBy("key").agg(F.collect_list("pos").alias("asked"))
    single = written(docs.select("key", "text").join(asked, "key").mapInArrow(_edges(window), _EDGE_ROW), "edges")
    met = single.where("src_key is null").groupBy("e1", "e2").agg(F.min(F.struct("key", "place")).alias("first"), F.max("key").alias("last")).where("first.key < last")
    later = single.where("src_key is null").join(met, ["e1", "e2"]).where("key > first.key")
    columns = [F.xxhash64("e1", "e2").alias("edge"), "u", "v", F.lit(1).cast("long").alias("n"), "key", "place"]
    later = later.select(*columns, F.col("first.key").alias("src_key"), F.col("first.place").alias("src_place"))
    return whole.union(later).union(single.where("src_key is not null").select(*columns, "src_key", "src_place"))


def linked(runs: DataFrame) -> DataFrame:
    """(edge, n, prev, prev_n) of distinct edges: `prev` is the one edge by which a node that does not branch is entered, null where the edge begins a path."""
    line = W.partitionBy("key").orderBy("place")
    ahead, back = (f(F.struct("edge", "u", "v", "n", "place", "src_key", "src_place")).over(line) for f in (F.lead, F.lag))
    on = lambda a, b: (b("place") == a("place") + a("n")) & (b("u") == a("v")) & (b("src_key") == a("src_key")) & (b("src_place") == a("src_place") + a("n"))
    far = lambda c: lambda name: F.col(c)[name]
    walks = runs.repartition(partitions(runs), "key").withColumn("ahead", ahead).withColumn("back", back)
    walks = walks.select("edge", "n", F.when(on(F.col, far("ahead")), F.col("ahead.edge")).alias("next"), F.when(on(far("back"), F.col), F.col("back.edge")).alias("prev"))
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    edges = written(walks.groupBy("edge").agg(F.min("n").alias("n"), one("next"), one("prev")), "graph")
    there = edges.select(F.col("edge").alias("p"), F.col("n").alias("prev_n"), F.col("next").alias("p_next"))
    met = edges.join(there, (F.col("prev") == F.col("p")) & (F.col("p_next") == F.col("edge")) & (F.col("p") != F.col("edge")), "left")
    return met.select("edge", "n", F.col("p").alias("prev"), "prev_n")


def compacted(edges: DataFrame, max_rounds: int = 48) -> DataFrame:
    """(path, n): the nonbranching paths of `edges` (edge, n, prev, prev_n) by their first edge, with all their windows.

    A path that runs in a circle has no first edge: each of its edges is a path of its own.
    """
    now = edges.select("edge", "n", "prev", F.coalesce("prev_n", F.lit(0)).cast("long").alias("at"), F.col("prev").isNull().alias("done"), F.coalesce("prev", "edge").alias("path"))
    now = written(now, "paths")
    total, left = now.count(), now.where("not done").limit(1).count()
    rounds = 0
    while left and rounds < max_rounds and (1 << rounds) <= 2 * total:
        # the pointer of the edge that mine points to becomes mine
        far = now.select(F.col("edge").alias("prev"), F.col("prev").alias("far"), F.col("at").alias("more"), F.col("done").alias("end"), F.col("path").alias("head"))
        open_, closed = now.where("not done"), now.where("done")
        step = open_.join(far, "prev").select("edge", "n", F.col("far").alias("prev"), (F.col("at") + F.col("more")).alias("at"), F.col("end").alias("done"), F.col("head").alias("path"))
        after = written(closed.union(step.select("edge", "n", F.coalesce("prev", "path").alias("prev"), "at", "done", "path")), "paths")
        discard(now)
        now, rounds = after, rounds + 1
        left = now.where("not done").limit(1).count()
    path, at = F.when(F.col("done"), F.col("path")).otherwise(F.col("edge")), F.when(F.col("done"), F.col("at")).otherwise(0)
    return now.groupBy(path.alias("path")).agg(F.max(at + F.col("n")).alias("n"))


def repeated_spans(runs: DataFrame) -> DataFrame:
    """(key, place, n, src_key, src_place): each later occurrence of a path, n windows, with where it comes first."""
    paths = compacted(linked(runs))
    return runs.drop("n").join(paths, F.col("edge") == F.col("path")).select("key", "place", "n", "src_key", "src_place")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_words, n_removed, n_spans and kept_sha256, the hash of the words left.

    A word is removed if a window of `window` words that covers it also starts in a
    document with a smaller doc_id; all is judged on the input. A null or empty text has
    no words; shorter texts than a window keep all. Rows that share a doc_id, or have none
    (these come last), count as separate documents in the order of their texts. Other
    columns are ignored, and an empty table gives no rows.
    """
    keyed, _ = ordered_key(docs)
    runs = written(repeated_edges(keyed, window), "repeats")
    spans = written(repeated_spans(runs), "spans")
    return cut_spans(keyed, spans, window, words_of, b" ".join).withColumnRenamed("size", "n_words")
