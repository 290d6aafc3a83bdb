"""MinHash near-dedup with odd sketches.

Each document gets MinHash bands for candidate search and an odd sketch for candidate
verification. The odd sketch folds a consistent MinHash sample of the shingle set (the
hashes that end in `level` zero bits; all of them up to SAMPLE shingles) into a bitmap of
parities. The XOR of two sketches is the odd sketch of the symmetric difference, so that
its population count tells that difference, and with the sample sizes the Jaccard
similarity, most precisely where the similarity is high.

Equal sets are merged first; only their first document takes part. Documents that share a
band value form a bucket, and only the connected components of the links are asked for:

1. A bucket of up to BLOCK documents is one part, a larger one is dealt by hash to parts
   of about that size, each with the bucket's first document as a visitor. A task
   compares a part on sketches alone; what leaves it is a spanning forest of the pairs
   that are surely similar, and the pairs too close to call that the forest does not
   connect. All of these are confirmed on the full shingle sets, and only confirmed pairs
   are links.
2. In a larger bucket, the documents outside its largest component so far visit all parts.
   These are VISITED * BLOCK documents long, but MOST in number: beyond that the parts grow,
   so that the rows dealt out are at most 2 * MOST times the bucket's. A bucket that the
   first round has connected is done, so that a group of copies costs in proportion to its
   size.
3. Where the sketches were sure of a pair that its sets refute, a forest may have hidden
   other links: the parts of these documents are compared anew without forests.

A document meets its sketches and its label once a round, with the list of its buckets;
only then is it dealt to the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .blocks import ordered_key, row_keys
from .common import components, discard, free_name, partitions, written

SHINGLE = 5
BANDS, ROWS = 20, 4  # a pair at 0.85 shares no band with probability (1 - 0.85**4)**20 < 4e-7
BITS, SAMPLE = 1024, 512
BLOCK = 1024
VISITED, MOST = 4, 8  # blocks in a part that is visited, and parts of a bucket that are, unless VISITED makes fewer
PAIRS = 1 << 17  # compared at once
SALTS = 64
SLACK = (0.035, 0.10)  # over 5 standard deviations of the estimate: whole sets, samples
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.Generator(np.random.PCG64(8)).integers(1, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: ASCII lower case, SHINGLE words; fewer words are one shingle."""
    raw, offsets = K.utf8(texts)
    raw = K.LOWER[raw]
    starts, ends, words = K.word_spans(raw, offsets)
    prefix = K.prefix_hash(K.word_hashes(raw, starts, ends))
    grams = K.ngram_hashes(prefix, SHINGLE)
    for lo, hi in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(grams[lo : hi - SHINGLE + 1])
        elif hi > lo:
            yield K.span_hash(prefix, np.array([lo]), np.array([hi]))
        else:
            yield np.zeros(0, np.uint64)


def odd_sketch(hashes: np.ndarray, level: int) -> tuple[bytes, int]:
    """Parity bitmap and size of the sample of `hashes` at a level."""
    picked = hashes[(hashes & np.uint64((1 << level) - 1)) == 0] if level else hashes
    at = (K.mix(picked ^ np.uint64(0xA5A5A5A55A5A5A5A)) % np.uint64(BITS)).astype(np.int64)
    parity = (np.bincount(at, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).tobytes(), len(picked)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in K.text_slices(batch, 1):
            keys, sizes, ones, twos, bands, levels, first, second = ([] for _ in range(8))
            for key, h in zip(rows.column(0).to_pylist(), shingle_sets(rows.column(1)), strict=True):
                n = len(h)
                keys.append(key)
                sizes.append(n)
                ones.append(int(h.sum().view(np.int64)) if n else 0)
                twos.append(int(K.mix(h ^ np.uint64(0x1234567)).sum().view(np.int64)) if n else 0)
                level = max(0, (n - 1).bit_length() - (SAMPLE.bit_length() - 1)) if n else 0
                levels.append(level)
                if not n:
                    bands.append([])
                    first.append((b"", 0))
                    second.append((b"", 0))
                    continue
                low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
                for a in range(0, n, 4096):
                    low = np.minimum(low, (h[a : a + 4096, None] * _SEEDS[None, :]).min(0))
                low = K.mix(low).reshape(BANDS, ROWS)
                bands.append(K.mix((low * _BAND[:, :ROWS]).sum(1) + _BAND[:, ROWS]).view(np.int64))
                first.append(odd_sketch(h, level))
                # a partner just over the next border of sizes is sketched one level higher
                second.append(odd_sketch(h, level + 1) if n > 0.8 * (SAMPLE << level) else (b"", 0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(levels, pa.int32()),
                    pa.array([s for s, _ in first], pa.binary()), pa.array([n for _, n in first], pa.int32()),
                    pa.array([s for s, _ in second], pa.binary()), pa.array([n for _, n in second], pa.int32()),
                ],
                names=["key", "n_shingles", "set1", "set2", "bands", "level", "sketch", "sampled", "sketch_up", "sampled_up"],
            )


_SKETCH = ["n_shingles", "level", "bands", "sketch", "sampled", "sketch_up", "sampled_up"]
_SIGNATURE = "key long, n_shingles long, set1 long, set2 long, bands array<long>, level int, sketch binary, sampled int, sketch_up binary, sampled_up int"


def estimate(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the XOR population count and the sum of both sample sizes."""
    differ = -BITS / 2 * np.log1p(-np.minimum(2 * x / BITS, 0.999))
    differ = np.minimum(differ, total)
    return (total - differ) / np.maximum(total + differ, 1)


class _Bucket:
    """Columns of the rows of a task, and sketch comparison of pairs of them."""

    def __init__(self, table: pa.Table):
        col = lambda n: table.column(n).to_numpy()
        self.key, self.size, self.level = col("key"), col("n_shingles"), col("level")
        blank = bytes(BITS // 8)
        self.sketch = [np.frombuffer(b"".join(v or blank for v in table.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("sketch", "sketch_up")]
        self.band = col("band")
        bands = table.column("bands").combine_chunks() if isinstance(table.column("bands"), pa.ChunkedArray) else table.column("bands")
        self.bands = bands.flatten().to_numpy().reshape(-1, BANDS)
        self.sampled = [col("sampled").astype(np.int64), col("sampled_up").astype(np.int64)]

    def compare(self, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, estimate - threshold) of the pairs that may reach the threshold."""
        gap = self.level[a] - self.level[b]
        ok = (np.minimum(self.size[a], self.size[b]) >= threshold * np.maximum(self.size[a], self.size[b]) - 1e-9) & (np.abs(gap) <= 1)
        a, b, gap = a[ok], b[ok], gap[ok]
        up_a, up_b = (gap < 0)[:, None], (gap > 0)[:, None]
        sa = np.where(up_a, self.sketch[1][a], self.sketch[0][a])
        sb = np.where(up_b, self.sketch[1][b], self.sketch[0][b])
        total = np.where(gap < 0, self.sampled[1][a], self.sampled[0][a]) + np.where(gap > 0, self.sampled[1][b], self.sampled[0][b])
        over = estimate(np.bitwise_count(sa ^ sb).sum(1), total) - threshold
        slack = np.where(np.maximum(self.level[a], self.level[b]) > 0, SLACK[1], SLACK[0])
        # tiny samples: one element more or less shifts the estimate by more than the slack
        slack = np.maximum(slack, 8.0 / np.maximum(total, 1))
        ok = over >= -slack
        return a[ok], b[ok], np.where(over[ok] >= slack[ok], 1.0, 0.0)


class _Forest:
    """The sure pairs that span what all sure pairs of a part connect, and the unsure ones between its trees."""

    def __init__(self, label: np.ndarray):
        _, self.root = np.unique(label, return_inverse=True)
        self.sure: list[tuple[np.ndarray, np.ndarray]] = []
        self.unsure: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_unsure = 0

    def add(self, a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> None:
        """Pairs of rows, sorted by `a`."""
        self.unsure.append((a[sure == 0], b[sure == 0]))
        self.n_unsure += len(self.unsure[-1][0])
        a, b = a[sure > 0], b[sure > 0]
        cut = np.flatnonzero(a[1:] != a[:-1]) + 1
        for x, ys in zip(a[np.append(0, cut)].tolist() if len(a) else (), np.split(b, cut), strict=False):
            own = self.root[x]
            trees, first = np.unique(self.root[ys], return_index=True)
            first = first[trees != own]
            if len(first):
                joins = np.zeros(len(self.root), bool)
                joins[trees] = True
                self.root[joins[self.root]] = own
                self.sure.append((np.full(len(first), x), ys[first]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, sure) since the last call."""
        none = [(np.zeros(0, np.int64),) * 2]
        a, b = (np.concatenate(v) for v in zip(*none, *self.sure, strict=True))
        x, y = (np.concatenate(v) for v in zip(*none, *self.unsure, strict=True))
        apart = self.root[x] != self.root[y]
        self.sure, self.unsure, self.n_unsure = [], [], 0
        return np.append(a, x[apart]), np.append(b, y[apart]), np.repeat([1.0, 0.0], [len(a), int(apart.sum())])


AT_HOME, VISITOR, RESIDENT = 0, 1, 2  # visitors and those at home ask, residents and those at home answer


def _candidates(threshold: float, forest: bool):
    """Pairs of each part with different labels; rows come sorted by bucket and part."""

    def emit(d: _Bucket, a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        # a pair leaves only from the first band that it shares; what the forest of a later
        # bucket connects by such a pair was connected in that first bucket already
        first = (d.bands[a] == d.bands[b]).argmax(1) == d.band[a]
        a, b, sure = a[first], b[first], sure[first]
        x, y = d.key[a], d.key[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sure > 0)], names=["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "part"], 20_000):
            d = _Bucket(table)
            bucket, part, side = (table.column(c).to_numpy() for c in ("bucket", "part", "side"))
            _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
            cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]))
            size = np.diff(np.append(cut, len(bucket)))
            # small groups all at once: each row with those before it
            small = np.repeat(size <= 16, size)
            place = np.arange(len(bucket)) - np.repeat(cut, size)
            reps = np.where(small, place, 0)
            b = np.repeat(np.arange(len(bucket)), reps)
            a = b - 1 - (np.arange(len(b)) - np.repeat(np.cumsum(reps) - reps, reps))
            meet = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == AT_HOME))
            a, b = a[meet], b[meet]
            for lo in range(0, len(a), PAIRS):
                yield emit(d, *d.compare(a[lo : lo + PAIRS], b[lo : lo + PAIRS], threshold))
            for lo, n in zip(cut[size > 16].tolist(), size[size > 16].tolist(), strict=True):
                ask = np.flatnonzero(side[lo : lo + n] != RESIDENT)
                answer = np.flatnonzero(side[lo : lo + n] != VISITOR)
                own, trees = side[lo : lo + n], _Forest(label[lo : lo + n])
                step = max(1, PAIRS // max(1, len(answer)))
                for i in range(0, len(ask), step):
                    a, b = (v.ravel() for v in np.meshgrid(ask[i : i + step], answer, indexing="ij"))
                    meet = (trees.root[a] != trees.root[b]) & ((own[a] != own[b]) | (a < b))
                    a, b, sure = d.compare(a[meet] + lo, b[meet] + lo, threshold)
                    if not forest:
                        yield emit(d, a, b, sure)
                        continue
                    trees.add(a - lo, b - lo, sure)
                    if trees.n_unsure > 8 * PAIRS or i + step >= len(ask):
                        a, b, sure = trees.pairs()
                        yield emit(d, a + lo, b + lo, sure)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], most: int) -> Iterator[pa.Table]:
    """Rows sorted by `by`, cut between groups into tables of about `most` rows; a larger group stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        lo = 0
        if held and size >= most:  # to the end of the group that is open
            same = np.ones(batch.num_rows, bool)
            for c, name in zip(cols, by, strict=True):
                same &= c == held[-1].column(name)[held[-1].num_rows - 1].as_py()
            lo = int(same.argmin()) if not same.all() else batch.num_rows
            held.append(batch.slice(0, lo))
            size += lo
            if lo == batch.num_rows:
                continue
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        cuts = np.flatnonzero(change) + 1
        while batch.num_rows - lo + size >= most:
            later = cuts[cuts >= max(lo + most - size, lo + 1)]
            if not len(later):
                break
            held.append(batch.slice(lo, int(later[0]) - lo))
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, lo = [], 0, int(later[0])
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
            size += batch.num_rows - lo
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in K.text_slices(batch, 1):
            sets = pa.array([h.tobytes() for h in shingle_sets(rows.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), sets], names=["key", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("key"), blocks).cast("long")


def _every(blocks: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), blocks - 1)


def _place(x: Column, part: Column, side: Column) -> Column:
    return F.struct(x["band"].alias("band"), x["bucket"].alias("bucket"), part.alias("part"), side.cast("int").alias("side"))


def _parts(x: Column, size: int) -> Column:
    """The places (band, bucket, part, side) of a document of bucket `x` in the first round: its part, and all of them for the bucket's first document."""
    blocks = F.ceil(x["m"] / size).cast("long")
    home = _block(blocks)
    head = F.transform(_every(blocks), lambda p: _place(x, p, F.when(p == home, AT_HOME).otherwise(VISITOR)))
    return F.when(x["head"] == F.col("key"), head).otherwise(F.array(_place(x, home, F.lit(AT_HOME))))


def _visits(x: Column, size: int) -> Column:
    """The places of a document of bucket `x` where those outside the largest label of more than `size` documents visit all parts; none in buckets of one label."""
    length = F.greatest(F.lit(VISITED * size).cast("long"), F.ceil(x["m"] / MOST).cast("long"))
    blocks, guests = (F.ceil(n / length).cast("long") for n in (x["m"], x["others"]))
    home, guest = _block(blocks), _block(guests)
    part = lambda guest, at: (guest + 1) * (1 << 30) + at
    asks = F.transform(_every(blocks), lambda p: _place(x, part(guest, p), F.when(p == home, AT_HOME).otherwise(VISITOR)))
    # those that visit from another part of the guests answer at home too
    others = F.filter(_every(guests), lambda g: ~x["out"] | (g != guest))
    answers = F.transform(others, lambda g: _place(x, part(g, home), F.lit(RESIDENT)))
    return F.when(x["others"] > 0, F.when(x["out"], F.concat(asks, answers)).otherwise(answers)).otherwise(F.array().cast(_PLACES))


_PLACES = "array<struct<band:int,bucket:bigint,part:bigint,side:int>>"


def _with_others(rows: DataFrame, size: int) -> DataFrame:
    """`rows` (key, label, bucket, m and others) with `others`, the documents outside the bucket's largest label (0 in buckets of up to `size`), and `out`, whether this is one."""
    count = rows.where(F.col("m") > size).groupBy("bucket", "label").agg(F.count("*").alias("n"))
    count = count.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    found = rows.join(count, "bucket", "left")
    return found.withColumns({"out": F.coalesce(F.col("label") != F.col("main"), F.lit(False)), "others": F.coalesce("others", F.lit(0).cast("long"))}).drop("main")


def similar_links(keyed: DataFrame, signatures: DataFrame, percent: int, size: int = BLOCK) -> DataFrame:
    """(node, component): confirmed links between different shingle sets connect all that all such links connect."""
    n = partitions(keyed)
    reps = signatures.where("n_shingles > 0").groupBy("set1", "set2", "n_shingles").agg(F.min("key").alias("key")).select("key")
    reps = signatures.join(reps, "key", "left_semi")
    rows = reps.select("key", F.posexplode("bands").alias("band", "bucket"))
    count = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min("key").alias("head")).where("m > 1")
    lists = rows.join(count, "bucket").groupBy("key").agg(F.collect_list(F.struct("band", "bucket", "m", "head")).alias("buckets"))
    sketches = signatures.select("key", *_SKETCH)
    held = written(lists.join(sketches, "key").select("key", *_SKETCH, "buckets"), "buckets")
    buckets_of = lambda docs: docs.withColumn("x", F.explode("buckets")).select(*(c for c in docs.columns if c != "buckets"), "x.*")

    def confirmed(docs: DataFrame, places: Callable[[Column], Column], forest: bool) -> tuple[DataFrame, DataFrame]:
        """Links among the candidates of the places of `docs` (sketches, label, buckets), and the documents of candidates that were sure and are no links."""
        parts = docs.select("key", "label", *_SKETCH, F.explode(F.flatten(F.transform("buckets", places))).alias("x")).select("key", "label", *_SKETCH, "x.*")
        parts = parts.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "key")
        pairs = parts.mapInArrow(_candidates(percent / 100, forest), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))
        pairs = written(pairs, "pairs")
        asked = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        sets = keyed.select("key", "text").join(asked.hint("merge"), "key", "left_semi").mapInArrow(_sets, "key long, shingles binary")
        sets = written(sets, "sets")
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
        both = both.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        links = written(both.mapInArrow(_confirm(percent), "a long, b long"), "links")
        wrong = pairs.where("sure").join(links, ["a", "b"], "left_anti")
        wrong = written(wrong.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wrong")
        discard(sets)
        return links, wrong

    def labelled(links: DataFrame) -> DataFrame:
        """(key, label, band, bucket, m, head)"""
        found = components(links).withColumnRenamed("node", "key")
        docs = held.select("key", "buckets").join(found, "key", "left").select("key", F.coalesce("component", "key").alias("label"), "buckets")
        return buckets_of(written(docs, "labels"))

    def listed(rows: DataFrame) -> DataFrame:
        """A row a document again, with its sketches."""
        columns = [c for c in rows.columns if c not in ("key", "label")]
        return rows.groupBy("key").agg(F.first("label").alias("label"), F.collect_list(F.struct(*columns)).alias("buckets")).join(held.select("key", *_SKETCH), "key")

    links, wrong = confirmed(held.withColumn("label", F.col("key")), lambda x: _parts(x, size), True)
    if buckets_of(held.select("key", "buckets")).where(F.col("m") > size).limit(1).count():
        large = labelled(links).where(F.col("m") > size)
        more, still = confirmed(listed(_with_others(large, size).where("others > 0")), lambda x: _visits(x, size), True)
        links, wrong = links.union(more), wrong.union(still)
    rows = buckets_of(held.select("key", "buckets"))
    done = rows.select("bucket").limit(0)
    while wrong.limit(1).count():
        again = rows.join(wrong, "key", "left_semi").select("bucket").distinct().join(done, "bucket", "left_anti")
        again = written(again, "again")
        some = labelled(links).join(again, "bucket", "left_semi")
        # pairs of two labels in a larger bucket meet at visits
        more, wrong = confirmed(listed(_with_others(some, size)), lambda x: F.when(x["m"] > size, _visits(x, size)).otherwise(_parts(x, size)), False)
        links, done = links.union(more), done.union(again)
        wrong = rows.join(wrong, "key", "left_semi").join(done, "bucket", "left_anti").select("key").distinct()
    return components(links)


def labelled_sets(keyed: DataFrame, percent: int) -> DataFrame:
    """(key, n_shingles, component) of each row of `keyed` (key, text); component is the smallest key that links reach."""
    if not 80 <= percent <= 100:
        raise ValueError("bands and sketches are set for similarities of 80 % and above")
    signatures = written(keyed.select("key", "text").mapInArrow(_signatures, _SIGNATURE), "signatures")
    sets = ["set1", "set2", "n_shingles"]
    found = similar_links(keyed, signatures, percent)
    # an equal set may stand in any number of rows: each set is dealt to SALTS parts, of which those that occur get its component
    rows = signatures.where("n_shingles > 0").select("key", *sets, F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    parts = rows.groupBy(*sets, "salt").agg(F.min("key").alias("first"))
    firsts = parts.groupBy(*sets).agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    firsts = firsts.join(found, F.col("first") == F.col("node"), "left").select(*sets, F.explode("salts").alias("salt"), F.coalesce("component", "first").alias("component"))
    out = rows.join(firsts, [*sets, "salt"]).select("key", "n_shingles", "component")
    return out.union(signatures.where("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component")))


def minhash_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_shingles, component_id and kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    5-word shingles; component_id is the smallest doc_id that links reach, and the
    document with that id is kept. A null or empty text has no shingles and is linked with
    nothing. Rows that share a doc_id, or have none (these come last), count as separate
    documents in the order of their texts: only the first of a component is kept. Other
    columns are ignored, and an empty table gives no rows.
    """
    if not 80 <= percent <= 100:
        raise ValueError("bands and sketches are set for similarities of 80 % and above")
    keyed, plain = ordered_key(docs)
    out = labelled_sets(keyed, percent)
    kept = (F.col("component") == F.col("key")).alias("kept")
    if plain:
        return out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept)
    ids = keyed.select("key", "doc_id")
    out = out.join(ids, "key").join(ids.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return out.select("doc_id", "n_shingles", "component_id", kept)


def first_rows(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs` that are the first of their component, with all their columns.

    Rows are judged one by one, as in `minhash_dedup`: of repeated rows, and of copies
    without an id, one stays; rows that share an id but not a text are documents of their
    own. A row without shingles stays.
    """
    name = free_name(docs, "key")
    rows = row_keys(docs, name)
    out = labelled_sets(rows.select(F.col(name).alias("key"), "text"), percent)
    gone = out.where("component <> key").select(F.col("key").alias(name))
    return rows.join(gone, name, "left_anti").drop(name)
