"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents as one bit-plane per id bit, most
significant first. Plane by plane, the ids whose bit is 0 move before those whose bit is
1, in stable order; a running popcount per 512 bits gives rank in constant time, and
select by a search of these counts. From the planes alone a shard answers access(i),
count(id) and the places of an id (occurrences), without unpacking the ids.

Documents are range-partitioned by doc_id, each partition encodes its texts in order and
cuts shards of about `shard_tokens` ids at document borders, and Spark writes them as
Parquet rows (a shard per row), so that any Hadoop file system will do. Only counts by
partition are summed over all partitions to place a shard in the whole sequence.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions, shared_dir, ship

BLOCK = 512
SHARD_SCHEMA = (
    "part int, shard int, first_token long, n_tokens long, bits int, doc_ids binary, doc_tokens binary, planes binary, ranks binary"
)
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_OTHER_SPACE = re.compile(r"[^\S \t-\r]|\0")
_CONTROLS = ("\0", "\x1c", "\x1d", "\x1e", "\x1f")
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
_PLAIN = re.compile(r"([ \n]?)([A-Za-z]+)([.,;:!?]*)")  # one blank, one word of letters, one run of marks


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of unsigned ids."""

    def __init__(self, n: int, bits: int, planes: bytes, ranks: bytes):
        self.n, self.bits = n, bits
        self.planes = np.frombuffer(planes, np.uint8).reshape(bits, -1)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(bits, -1)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        wide = -(-max(n, 1) // BLOCK) * BLOCK
        planes = np.zeros((bits, wide // 8), np.uint8)
        ranks = np.zeros((bits, wide // BLOCK + 1), "<u4")
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        after = np.empty_like(now)
        for level in range(bits):
            bit = (now & now.dtype.type(1 << (bits - 1 - level))) != 0
            packed = np.packbits(bit)
            planes[level, : len(packed)] = packed
            ones = np.bitwise_count(planes[level].view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
            np.cumsum(ones, out=ranks[level, 1:])
            zeros = n - int(ranks[level, -1])
            np.compress(bit, now, out=after[zeros:])
            np.compress(~bit, now, out=after[:zeros])
            now, after = after, now
        return cls(n, bits, planes.tobytes(), ranks.tobytes())

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        rest = self.planes[level, block * (BLOCK // 8) : -(-i // 8)]
        ones = int(np.bitwise_count(rest).sum())
        if i % 8:
            ones -= int(np.bitwise_count(np.uint8(rest[-1] & (0xFF >> (i % 8)))))
        return int(self.ranks[level, block]) + ones

    def zeros(self, level: int) -> int:
        return self.n - int(self.ranks[level, -1])

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(self.bits):
            bit = (int(self.planes[level, i // 8]) >> (7 - i % 8)) & 1
            ones = self.rank1(level, i)
            i = self.zeros(level) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int) -> tuple[int, int]:
        lo, hi = 0, self.n
        for level in range(self.bits):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros(level) + a, self.zeros(level) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int) -> int:
        """How often an id occurs."""
        lo, hi = self._range(value)
        return hi - lo

    def select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros of a plane: the running counts find the block, only its bits are unpacked."""
        counts = self.ranks[level].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts)) * BLOCK - counts
        block = np.searchsorted(counts, k, "right") - 1
        out = np.empty(len(k), np.int64)
        rows = self.planes[level].reshape(-1, BLOCK // 8)
        for lo in range(0, len(k), 4096):
            b = block[lo : lo + 4096]
            seen = np.cumsum(np.unpackbits(rows[b], axis=1) == bit, axis=1, dtype=np.int16)
            out[lo : lo + 4096] = b * BLOCK + (seen > (k[lo : lo + 4096] - counts[b])[:, None]).argmax(1)
        return out

    def occurrences(self, value: int) -> list[int]:
        """The places of an id, rising: select, from the last plane up to the first."""
        lo, hi = self._range(value)
        at = np.arange(lo, hi)
        for level in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros(level) if bit else at)
        return at.tolist()

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions undone from the last plane to the first."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            zeros, up = self.zeros(level), np.empty_like(now)
            now[zeros:] |= now.dtype.type(1 << (self.bits - 1 - level))
            np.place(up, bit, now[zeros:])
            np.place(up, ~bit, now[:zeros])
            now = up
        return now


class Encoder:
    """Encodes texts with a tokenizers file, each distinct run of blanks and word once; a file that is not plain byte-level BPE gets whole texts.

    A border between a non-space and a following ASCII space is always a border of the
    byte-level pre-tokenizer, and each pre-token is encoded on its own, so that the ids
    of a text are those of its pieces joined. A new piece of ASCII letters, with a blank
    in front and marks behind, goes to the library's model directly: its pre-tokens are
    known. A text with other white space than ASCII, or with the string of an added token,
    is encoded whole by the library. The first `keep` distinct pieces are remembered by a
    worker; later ones are encoded as they come.
    """

    def __init__(self, path: str, keep: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.byte_level = _byte_level(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.known, self.marks = keep, {}, {}
        self.model = self.tokenizer.model.tokenize

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _mark(self, text: str) -> bytes:
        got = self.marks.get(text)
        if got is None:
            got = self._whole([text])[0]
            if len(self.marks) < 4096:
                self.marks[text] = got
        return got

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are not known yet."""
        out: list[bytes | None] = []
        rest = []
        for p in pieces:
            m = _PLAIN.fullmatch(p)
            if m is None:
                out.append(None)
                rest.append(p)
                continue
            blank, word, marks = m.groups()
            # the byte-level alphabet writes a blank as U+0120 and ASCII letters as they are
            ids = array("I", [t.id for t in self.model("\u0120" + word if blank == " " else word)]).tobytes()
            out.append((self._mark(blank) if blank == "\n" else b"") + ids + (self._mark(marks) if marks else b""))
        more = iter(self._whole(rest)) if rest else iter(())
        return [next(more) if i is None else i for i in out]

    def _pieces(self, text: str) -> list[str]:
        """The pieces, each with its blanks in front; a text without runs of blanks is cut at its spaces and lines."""
        if any(c in text for c in _CONTROLS) or not text.isascii() and _OTHER_SPACE.search(text) or any(a in text for a in self.added):
            return [text]
        if any(run in text for run in _RUNS):
            return _CHUNK.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """32-bit ids of each text, in the machine's byte order (little-endian ones only are supported)."""
        if not self.byte_level:
            return self._whole(texts)
        known = self.known
        cut = [self._pieces(t) for t in texts]
        ids = [list(map(known.get, c)) for c in cut]
        new = list({p for c, i in zip(cut, ids, strict=True) if None in i for p, v in zip(c, i, strict=True) if v is None})
        more = dict(zip(new, self._ids(new), strict=True))
        out = [b"".join([more[p] if v is None else v for p, v in zip(c, i, strict=True)] if None in i else i) for c, i in zip(cut, ids, strict=True)]
        if len(known) < self.keep:
            known.update((p, i) for p, i in more.items() if len(p) <= 32)
        return out


def _byte_level(path: str) -> bool:
    """Whether a tokenizers file cuts texts as the Encoder does: BPE over the byte-level pre-tokenizer's own pattern, nothing normalised, nothing put in front or behind."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    cut, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    return plain and not said.get("normalizer") and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it outlives a task, so that pieces are encoded once in a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode_partition(path: str, end_id: int, bits: int, shard_tokens: int, group_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        tokens: list[bytes] = []
        done, shard, held = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal done, shard, held
            lens = np.array([len(t) // 4 for t in tokens], "<u4")
            flat = np.frombuffer(b"".join(tokens), "<u4")
            if int(flat.max(initial=0)) >> bits:
                raise ValueError(f"id {flat.max()} does not fit into {bits} bits")
            wm = WaveletMatrix.build(flat, bits)
            row = [part, shard, done, len(flat), bits]
            blobs = [np.array([-1 if i is None else i for i in ids], "<i8").tobytes() + bytes(i is None for i in ids), lens.tobytes(), wm.planes.tobytes(), wm.ranks.tobytes()]
            done, shard, held = done + len(flat), shard + 1, 0
            ids.clear()
            tokens.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 4
            names = ["part", "shard", "first_token", "n_tokens", "bits", "doc_ids", "doc_tokens", "planes", "ranks"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row + blobs, types, strict=True)], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                piece = batch.slice(lo, 64)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for i, t in zip(piece.column(0).to_pylist(), encode(texts), strict=True):
                    if held and held + len(t) // 4 + 1 > shard_tokens:
                        yield flush()
                    ids.append(i)
                    tokens.append(t + end)
                    held += len(t) // 4 + 1
        if tokens:
            yield flush()

    return run


def write_token_shards(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    bits: int | None = None,
    shard_tokens: int = 1 << 20,
    n_partitions: int | None = None,
    order: list[Column] | None = None,
) -> None:
    """Encodes `docs` (doc_id, text; other columns are ignored) and writes the shards.

    A null text is empty and still gets its end id; a null doc_id stands before all
    others; repeated rows are written as often as they come, in order of their text. An
    empty table writes no shard. A document is never cut: one longer than `shard_tokens`
    has a shard of its own. `bits` are as many as the vocabulary needs; an id that does not
    fit is refused. With `order`, documents stand by these columns instead.
    """
    ship(docs.sparkSession)
    n = n_partitions or partitions(docs)
    bits = bits or max(_vocabulary(tokenizer_path) - 1, end_id).bit_length()
    if order:
        names = [f"__{i}" for i in range(len(order))]
        ordered = docs.select("doc_id", "text", *[c.alias(a) for c, a in zip(order, names)]).repartitionByRange(n, *names).sortWithinPartitions(*names).select("doc_id", "text")
    else:  # ids tell documents apart; the range is cut by them alone, so that no text is read for it
        ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_encode_partition(tokenizer_path, end_id, bits, shard_tokens, 1 << 20), SHARD_SCHEMA)
    shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def _decode_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {n: batch.column(n)[r].as_py() for n in ("part", "first_token", "n_tokens", "bits", "doc_ids", "doc_tokens", "planes", "ranks")}
            lens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
            ids = np.frombuffer(row["doc_ids"][: 8 * len(lens)], "<i8")
            missing = np.frombuffer(row["doc_ids"][8 * len(lens) :], np.bool_)
            flat = WaveletMatrix(row["n_tokens"], row["bits"], row["planes"], row["ranks"]).decode().astype("<u4")
            ends = np.cumsum(lens)
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lens), row["part"], np.int32)), pa.array(ids, mask=missing), pa.array(row["first_token"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards alone."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row per partition of the writer: the tokens of all partitions before it
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("part", ahead.alias("ahead"))
    rows = shards.mapInArrow(_decode_partition, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(sums, "part").select("doc_id", (F.col("ahead") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the shards into the shared folder and reads the documents back from them."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_shards(docs, path, tokenizer_path, **options)
    return read_token_shards(docs.sparkSession, path)
