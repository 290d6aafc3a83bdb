"""Numpy kernels that work on a whole Arrow batch of texts at once.

Every function is pure and runs inside a Spark task. Texts are handled as UTF-8
bytes; a word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Hashes are
64-bit polynomials over random byte values, finished with an avalanche mix, and do not
depend on the process, so that tasks and reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling, at most 8 MB are kept."""
    have = _powers.get(base)
    if have is None:
        have = np.array([1], dtype=np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 2**64))])
    if len(have) <= 1 << 20:
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; null is empty. Arrow's own buffers are used, not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, first word of each text plus the total) of all words."""
    n = len(raw)
    solid = ~SPACE[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE, step: int = 1 << 18) -> np.ndarray:
    """A hash of each word's bytes, in steps that bound the memory."""
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), step):
        s, e = starts[lo : lo + step], ends[lo : lo + step]
        lens = e - s
        at = np.cumsum(lens) - lens
        inside = np.arange(int(lens.sum())) - np.repeat(at, lens)
        v = values[raw[inside + np.repeat(s, lens)]]
        v *= powers(BASE, int(lens.max()))[inside]
        out[lo : lo + step] = mix(np.add.reduceat(v, at) + lens.astype(np.uint64))
    return out


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of values[i] * BASE**i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of values[start:end], the same wherever that sequence stands."""
    return mix((prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start])


def ngram_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive values, across text borders too."""
    m = len(prefix) - n
    if m <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[n:] - prefix[:-n]) * powers(BASE_INV, m))


def window_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the smallest of keys[i : i + width], the leftmost one of equals in their upper 40 bits."""
    n = len(keys)
    if n < width:
        return np.zeros(0, np.int64)
    assert n < 1 << 24
    low = U64((1 << 24) - 1)
    best = (keys & ~low) | np.arange(n, dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        gap = width - have
        best = np.minimum(best[:-gap], best[gap:])
    return (best & low).astype(np.int64)


def text_slices(batch: pa.RecordBatch, column: int, max_bytes: int = 1 << 20):
    """The batch in runs of rows whose texts have about `max_bytes` together; a longer text stands alone."""
    lens = np.diff(utf8(batch.column(column))[1])
    lo, held = 0, 0
    for i, n in enumerate(lens.tolist()):
        if held and held + n > max_bytes:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(lens):
        yield batch.slice(lo)


def segments(values: np.ndarray, offsets: np.ndarray, window: int, most: int = 1 << 20):
    """Cuts long texts so that no piece has more than `most` windows, and groups short ones.

    Yields (values, offsets, text of each piece, first place in its text). A window lies in
    exactly one piece, and a piece ends `window` - 1 values after its last window start.
    """
    group: list[tuple[int, int, int, int]] = []
    held = 0

    def packed():
        at = np.concatenate([[0], np.cumsum([hi - lo for _, lo, hi, _ in group])])
        part = np.concatenate([values[lo:hi] for _, lo, hi, _ in group])
        return part, at, np.array([g[0] for g in group]), np.array([g[3] for g in group])

    for doc, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for a in range(0, max(0, hi - lo - window + 1), most):
            b = min(a + most + window - 1, hi - lo)
            if group and held + b - a > most:
                yield packed()
                group, held = [], 0
            group.append((doc, lo + a, lo + b, a))
            held += b - a
    if group:
        yield packed()
