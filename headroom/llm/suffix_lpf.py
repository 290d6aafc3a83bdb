"""Byte-level substring dedup by longest previous factors.

A byte string that starts at place p has occurred before, at `window` bytes or more,
exactly if the longest previous factor (LPF) of p reaches `window`. LPF comes from the
suffix array: of all earlier positions, the previous and the next smaller position in
suffix order share the longest prefixes with p.

Only suffixes that can have an earlier partner are sorted. `blocks` groups suffixes by
the minimizer of their first `window` bytes, so that equal prefixes meet in one group.
Equal blocks are equal suffix ranges: only the first of them is sorted, and all later
ones have an LPF of their whole length. Where a group has several different blocks, their
bytes are dealt by minimizer; each group gets its own suffix array with the LCP of
neighbours, both up to `window` bytes (no longer prefix can matter), and its LPF array.
Every repeat has the place where it stands first. Repeats that follow each other there too
are one span, and the bytes of all spans are compared with those at their sources before
the result is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .blocks import SHIFT, Shape, byte_symbols, compared_blocks, cut_spans, joined_spans, ordered_key, place_of
from .common import partitions, written

ANCHOR = 32
MOST_WINDOWS = 1 << 18


def suffix_order(raw: np.ndarray, starts: np.ndarray, window: int, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by group, first `window` bytes and text position; and how many of these bytes each shares with the one before (none across groups)."""
    wide = -(-window // 8) * 8
    view = np.lib.stride_tricks.sliding_window_view(raw, window)[starts]
    if wide != window:
        view = np.concatenate([view, np.zeros((len(starts), wide - window), np.uint8)], axis=1)
    words = np.ascontiguousarray(view).view(">u8").astype(np.uint64)
    order = np.lexsort((rank, *(words[:, i] for i in reversed(range(words.shape[1]))), group))
    words, group = words[order], group[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = words[1:] != words[:-1]
        at = differ.argmax(1)
        row = np.arange(len(at))
        x = words[1:][row, at] ^ words[:-1][row, at]
        shared = np.zeros(len(x), np.int64)  # equal bytes at the front of the word that differs
        for byte in range(7, 0, -1):
            shared += (x >> np.uint64(8 * byte)) == 0
        lcp[1:] = np.where(differ.any(1), np.minimum(8 * at + shared, window), window)
        lcp[1:][group[1:] != group[:-1]] = 0
    return order, lcp


def nearest_smaller(rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in suffix order the nearest one before it with a smaller text position (-1: none), and the bytes that both share.

    Pointers start at the neighbour and jump along the pointers of larger positions, all at
    once, so that they double their reach; the smallest LCP on the way goes along.
    """
    at = np.arange(len(rank)) - 1
    shared = lcp.copy()
    todo = np.flatnonzero((at >= 0) & (rank[at] > rank))
    while len(todo):
        p = at[todo]
        shared[todo], at[todo] = np.minimum(shared[todo], shared[p]), at[p]
        p = at[todo]
        todo = todo[(p >= 0) & (shared[todo] > 0) & (rank[p] > rank[todo])]
    none = (at < 0) | (shared <= 0)
    return np.where(none, -1, at), np.where(none, 0, shared)


def previous_factors(rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor of each suffix in suffix order, and the suffix (by its place in that order, -1: none) where it stands.

    Of all earlier text positions, the previous and the next smaller one in suffix order
    share the longest prefixes.
    """
    n = len(rank)
    before, left = nearest_smaller(rank, lcp)
    # the same seen from the end: the LCP with the suffix after becomes that with the one before
    back = np.zeros(n, np.int64)
    back[1:] = lcp[1:][::-1]
    after, right = nearest_smaller(rank[::-1], back)
    after, right = np.where(after < 0, -1, n - 1 - after)[::-1], right[::-1]
    return np.maximum(left, right), np.where(left >= right, before, after)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by gram, cut between grams into tables of about `most` windows; a larger group stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column("gram").to_numpy()
        n = batch.column("pos").to_numpy() % SHIFT
        lo = 0
        for cut in np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, batch.num_rows).tolist():
            if held and size > most:
                last = held[-1].column("gram")[held[-1].num_rows - 1].as_py()
                if last != gram[lo]:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
            held.append(batch.slice(lo, cut - lo))
            size += int(n[lo:cut].sum())
            lo = cut
    if held:
        yield pa.Table.from_batches(held)


def _lpf(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, MOST_WINDOWS):
            table = table.combine_chunks()
            piece = table.column("piece").chunk(0)
            off = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
            raw = np.frombuffer(piece.buffers()[2], np.uint8)[off[0] : off[-1]]
            off -= off[0]
            gram, key, pos = (table.column(c).to_numpy() for c in ("gram", "key", "pos"))
            n = pos % SHIFT
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            starts = off[row] + inner
            # suffixes whose content is alone need no sorting
            content = K.span_hash(K.prefix_hash(K.BYTE[raw]), starts, starts + window)
            _, back, times = np.unique(content, return_inverse=True, return_counts=True)
            pick = times[back] > 1
            row, inner, starts, content = row[pick], inner[pick], starts[pick], content[pick]
            if not len(row):
                continue
            place = pos[row] // SHIFT + inner
            _, doc = np.unique(key[row], return_inverse=True)
            rank = np.empty(len(row), np.int64)
            rank[np.lexsort((place, doc))] = np.arange(len(row))
            # equal suffixes have equal content hashes, so a large table is sorted in parts
            parts = (content >> np.uint64(40)) % np.uint64(max(1, len(row) // MOST_WINDOWS))
            for part in range(int(parts.max()) + 1):
                mine = np.flatnonzero(parts == part)
                order, lcp = suffix_order(raw, starts[mine], window, gram[row[mine]], rank[mine])
                mine = mine[order]
                length, source = previous_factors(rank[mine], lcp)
                long = np.flatnonzero(length >= window)
                src, mine = mine[source[long]], mine[long]
                yield pa.RecordBatch.from_arrays([pa.array(key[row[mine]]), pa.array(place[mine]), pa.array(key[row[src]]), pa.array(place[src])], names=["key", "place", "src_key", "src_place"])

    return run


def repeated_strings(docs: DataFrame, window: int = 100) -> DataFrame:
    """(key, place, n, src_key, src_place): n places in a row whose `window`-byte strings also start earlier, there."""
    shape = Shape(window, min(ANCHOR, max(1, window // 2)), byte_symbols)
    compared = written(compared_blocks(docs, shape, same_document=True), "blocks")
    asked = compared.where("gram is not null").select("gram", "key", "pos")
    length = (F.col("pos") % SHIFT + (window - 1)).cast("int")
    piece = F.substring(F.col("text").cast("binary"), (F.col("pos") / SHIFT).cast("int") + 1, length)
    pieces = docs.select("key", "text").join(asked, "key").select("gram", "key", "pos", piece.alias("piece"))
    pieces = pieces.repartition(partitions(docs), "gram").sortWithinPartitions("gram", "key", "pos")
    found = pieces.mapInArrow(_lpf(window), "key long, place long, src_key long, src_place long")
    whole = compared.where("gram is null").select("key", place_of("pos").alias("place"), (F.col("pos") % SHIFT).alias("n"), "src_key", place_of("src_pos").alias("src_place"))
    return whole.union(found.select("key", "place", F.lit(1).cast("long").alias("n"), "src_key", "src_place"))


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode()


def suffix_dedup(docs: DataFrame, window: int = 100) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_bytes, n_removed, n_spans and kept_sha256, the hash of the bytes left.

    A byte is removed if a string of `window` bytes that covers it also starts earlier: in
    a document with a smaller doc_id, or before it in the same one; overlaps count, and
    all is judged on the input. A null text is empty; shorter texts than a window keep
    all. Rows that share a doc_id, or have none (these come last), count as separate
    documents in the order of their texts. Other columns are ignored, and an empty table
    gives no rows. What is left of a text may end inside a UTF-8 sequence.
    """
    keyed, _ = ordered_key(docs)
    spans = written(joined_spans(repeated_strings(keyed, window)), "spans")
    return cut_spans(keyed, spans, window, bytes_of, bytes).withColumnRenamed("size", "n_bytes")
