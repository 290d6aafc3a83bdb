"""Exact top-k search by inner product, with a three-phase uniform threshold.

A vector's components are cut into m slices. For a query, each slice is a list of its own:
the partial products of the slice with every candidate. The three phases:

1. Every block of candidates gathers, for each query, the best entries of its m lists, adds
   up their partial products, and gives the best k + 1 sums. The (k+1)-th best of all blocks
   is a safe cutoff: at least so many candidates reach it.
2. The cutoff goes back to every block with its query. A candidate that reaches it has a
   partial product of at least cutoff / m in some list: those entries suffice. What a list
   has not shown is below cutoff / m, which bounds every sum from above.
3. Candidates whose bound reaches the cutoff get their remaining partial products, and those
   that reach it exactly, ties by the smaller id, leave the block: k + 1 a query at most.

Equal vectors are one class with its k + 1 smallest ids, so that a vector that a third of
all rows share is compared once, as a query and as a candidate. Classes of queries and of
candidates meet in blocks of bounded size; each pair of blocks is a group of its own, and
what leaves it does not grow with it. (k + 1, as a query is no candidate of its own.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, ship, written
from .vectors import scaled, usable

SCALE = 256
SLICES = 4
QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 32768  # classes in a block, at most on average
CELLS = 64  # blocks of candidates to deal out before blocks grow to their full size
SCORES = 1 << 21  # scores that a task holds at a time for each list


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector): the whole numbers in the fewest bytes each, without the zeros at the end, so that equal vectors are equal bytes."""
    for batch in batches:
        x, _ = scaled(batch.column(1), SCALE)
        most = np.abs(x).max(axis=1, initial=0)
        ends = np.where(x.any(axis=1), x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1), 0) if x.shape[1] else np.zeros(len(x), int)
        rows = []
        for row, m, end in zip(x, most, ends):
            width = 2 if m < 2**15 else 4 if m < 2**31 else 8
            rows.append(bytes([width]) + row[:end].astype(f"<i{width}").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["vec_id", "vector"])


def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        own = np.frombuffer(v, dtype=f"<i{v[0]}", offset=1)
        out[i, : len(own)] = own
    return out


def _lists(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """The lists of queries `q`: partial products with all candidates, a matrix per slice, exact."""
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if bound >= 2**63:
        raise ValueError("a score does not fit into a long")
    kind = np.float64 if bound < 2**53 else np.int64  # doubles hold whole numbers below 2^53
    return [q[:, part].astype(kind) @ c[:, part].astype(kind).T for part in np.array_split(np.arange(q.shape[1]), slices)]


def _best(scores: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Positions of the highest scores, ties to the lower place."""
    return np.lexsort((places, -scores))[:most]


def gather(lists: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Phase 1: for each query the positions of the best entries of each list, each once."""
    n = lists[0].shape[1]
    if n <= most:
        return [np.arange(n)] * len(lists[0])
    tops = np.concatenate([np.argpartition(s, n - most, axis=1)[:, n - most :] for s in lists], axis=1)
    return [np.unique(row) for row in tops]


def sufficient(lists: list[np.ndarray], cutoff: np.ndarray) -> np.ndarray:
    """Phase 2: which candidates (columns) have an entry of cutoff / m, and can still reach the cutoff by what their other entries may be."""
    kind = lists[0].dtype
    uniform = (-(-cutoff // len(lists))).astype(kind)[:, None]  # whole numbers: an entry not below the mean is not below its ceiling
    seen, bound = np.zeros(lists[0].shape, dtype=bool), np.zeros(lists[0].shape, dtype=kind)
    for s in lists:
        seen |= s >= uniform
        bound += np.maximum(s, uniform)
    return seen & (bound >= cutoff.astype(kind)[:, None])


def _cell(k: int, slices: int, resolve: bool):
    """One block of queries against one of candidates: phase 1, or phases 2 and 3 where queries bring their cutoff."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        mine = group["asks"].to_numpy(dtype=bool)
        asked, given = group[mine], group[~mine].sort_values(["place", "class"])
        out = {"query": [], "class": [], "place": [], "score": []}
        if len(asked) and len(given):
            dims = max((len(v) - 1) // v[0] for v in group["vector"])
            q, c = _matrix(list(asked["vector"]), dims), _matrix(list(given["vector"]), dims)
            places, classes, names = given["place"].to_numpy(), given["class"].to_numpy(), asked["class"].to_numpy()
            cutoffs = asked["cutoff"].to_numpy(dtype=np.int64)
            step = max(1, SCORES // len(c))
            for at in range(0, len(q), step):
                lists = _lists(q[at : at + step], c, slices)
                if resolve:
                    left = [np.flatnonzero(row) for row in sufficient(lists, cutoffs[at : at + step])]
                else:
                    left = gather(lists, k)
                for i, found in enumerate(left):
                    total = sum(s[i, found] for s in lists).astype(np.int64)  # phase 3: the remaining entries
                    if resolve:
                        reach = total >= cutoffs[at + i]
                        found, total = found[reach], total[reach]
                    top = _best(total, found, k)
                    out["query"].append(np.full(len(top), names[at + i]))
                    out["class"].append(classes[found[top]])
                    out["place"].append(places[found[top]])
                    out["score"].append(total[top])
        return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for n, v in out.items()}).astype("int64")

    return run


_FOUND = "query long, class long, place long, score long"


def _cells(classes: DataFrame, asked: DataFrame, blocks: int, query_blocks: int) -> DataFrame:
    """Every class of candidates beside every block of queries, and the queries beside every block of candidates, by cell."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    given = classes.select(F.lit(False).alias("asks"), "class", "place", "vector", F.lit(0).cast("long").alias("cutoff"), F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"), every(query_blocks).alias("query_block"))
    asking = asked.select(F.lit(True).alias("asks"), "class", "place", "vector", "cutoff", every(blocks).alias("block"), F.pmod(F.xxhash64("class", F.lit(7)), F.lit(query_blocks)).cast("int").alias("query_block"))
    return given.unionByName(asking).groupBy("block", "query_block")


def _blocks(n: int) -> int:
    """Blocks of `n` candidates: CELLS of them until they have their full size, but none below 1024."""
    return max(1, -(-n // max(1024, min(CANDIDATE_BLOCK, n // CELLS))))


def _first(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The `most` best rows of each query; Spark cuts each task's part before it deals them out."""
    order = W.partitionBy(by).orderBy(F.col("score").desc(), "place", "class")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def top_k(vectors: DataFrame, k: int = 5, queries: Column | None = None, column: str = "embedding", slices: int = SLICES) -> DataFrame:
    """A row per query and rank: query_id, rank, vec_id, score.

    `queries` says which rows ask (default: vec_id divisible by 50). Vectors that are null or
    hold null or non-finite entries neither ask nor answer; what a vector lacks beside a longer
    one counts as 0, so an empty vector scores 0. A row is no candidate of its own, but
    repeated rows are of each other, and each asks for itself. A row without a vec_id asks
    nothing and stands last among equal scores. Fewer than k other rows: all of them. Empty
    tables give no rows; other columns are ignored. Scores must fit into a long; entries of
    2^45 or more are refused.
    """
    spark = vectors.sparkSession
    ship(spark)
    ask = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)) if queries is None else F.coalesce(queries, F.lit(False))
    own = vectors.where(usable(column)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"), ask.alias("asks"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in _packed(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], ["vec_id", "vector", "asks"])

    rows = own.mapInArrow(pack, "vec_id long, vector binary, asks boolean").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("place", F.coalesce("vec_id", F.lit(2**63 - 1))), "vectors")
    # the k + 1 rows of smallest id of each vector: all of a class that can be in an answer
    order = W.partitionBy("vector").orderBy("place", "row")
    first = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    classes = first.groupBy("vector").agg(F.min_by("row", "nth").alias("class"), F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "row", "vec_id"))).alias("members"))
    classes = written(classes, "classes")
    wanting = rows.where("asks").select("vector").distinct()
    asked = written(classes.join(wanting, "vector").select("class", "place", "vector"), "asked")
    n, q = classes.count(), asked.count()
    blocks = _blocks(n)
    query_blocks = max(1, -(-q // QUERY_BLOCK))
    bare = classes.select("class", "place", "vector")
    gathered = _cells(bare, asked.withColumn("cutoff", F.lit(0).cast("long")), blocks, query_blocks).applyInPandas(_cell(k + 1, slices, False), _FOUND)
    cutoffs = _first(gathered, "query", k + 1).groupBy("query").agg(F.when(F.max("nth") == k + 1, F.min("score")).alias("cutoff"))
    lowest = F.lit(-(2**62))  # fewer candidates than k + 1 in all: every one reaches it
    sent = asked.join(cutoffs.withColumnRenamed("query", "class"), "class", "left").withColumn("cutoff", F.coalesce("cutoff", lowest))
    sent = written(sent, "cutoffs")
    found = _cells(bare, sent, blocks, query_blocks).applyInPandas(_cell(k + 1, slices, True), _FOUND)
    best = _first(found, "query", k + 1).join(classes.select("class", "members"), "class")
    # k + 1 rows at most for each class of queries, then every row that asks takes its k from them
    answer = F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("score")).alias("below"), m["place"].alias("place"), m["row"].alias("row"), m["vec_id"].alias("vec_id")))))), 1, k + 1)
    answers = best.groupBy("query").agg(answer.alias("answer"))
    members = rows.where("asks").select("vec_id", "row", "vector").join(asked.select("vector", F.col("class").alias("query")), "vector").select("vec_id", "row", "query")
    each = members.join(answers, "query").withColumn("answer", F.slice(F.filter("answer", lambda a: a["row"] != F.col("row")), 1, k))
    each = each.select(F.col("vec_id").alias("query_id"), F.posexplode("answer").alias("at", "a"))
    out = written(each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), (-F.col("a.below")).alias("score")), "top_k")
    for table in (rows, classes, asked, sent):
        discard(table)
    return out
