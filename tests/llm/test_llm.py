"""The training-data operators against brute force on small tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from headroom.llm import debruijn, decontaminate, language, licenses, mixing, near_dup, pu_quality, suffix_lpf, token_shards, vector_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def words(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def make_texts():
    passage, line = words(120), words(30)
    texts = [" ".join(words(rng.randint(1, 400))) for _ in range(30)]
    texts += [" ".join(words(40) + passage + words(20)), " ".join(words(10) + passage[20:] + words(60)), " ".join(passage)]
    texts += [" ".join(words(50) + line + words(50)) for _ in range(5)]
    texts += [texts[0], texts[0], texts[3], "", None, "  \n\t ", "one", "x " * 400, "Ünïcode " * 60, "\x00odd\x00", " ".join(words(5000)) + " " + " ".join(passage)]
    base = words(200)
    for i in range(12):
        near = list(base)
        for _ in range(i // 3):
            near[rng.randrange(200)] = rng.choice(VOCABULARY)
        texts.append(" ".join(near).upper() if i == 4 else " ".join(near))
    return texts


TEXTS = make_texts()


def table(spark, texts, ids=None):
    rows = [(i, t, None, None, None) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOC).repartition(3)


def cut_words(texts, window=50):
    first, listed = {}, [(t or "").encode().split() for t in texts]
    for i, w in enumerate(listed):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, w in enumerate(listed):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        yield i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def cut_bytes(texts, window=100):
    seen = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if b[p : p + window] in seen:
                gone[p : p + window] = True
            seen.add(b[p : p + window])
        yield i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def test_debruijn(spark):
    got = debruijn.substring_dedup(table(spark, TEXTS)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(cut_words(TEXTS))


def test_suffix_lpf(spark):
    got = suffix_lpf.suffix_dedup(table(spark, TEXTS)).select("doc_id", "n_bytes", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(cut_bytes(TEXTS))


def test_paths_are_compacted_where_nothing_branches(spark):
    edges = {f"c{i}": (i, i + 1, 2) for i in range(40)} | {"f1": (100, 101, 1), "f2": (101, 102, 1), "f3": (101, 103, 1), "f4": (103, 104, 3), "f5": (104, 105, 1)} | {"r1": (200, 201, 1), "r2": (201, 202, 1), "r3": (202, 200, 1)}
    names = {e: i for i, e in enumerate(edges)}
    back = {i: e for e, i in names.items()}
    walks = {10: [f"c{i}" for i in range(40)], 11: ["f1", "f2"], 12: ["f1", "f3", "f4", "f5"], 13: ["r1", "r2", "r3", "r1", "r2", "r3"], 14: [f"c{i}" for i in range(40)]}
    rows = []
    for key, walk in walks.items():
        place = 7 * key
        for e in walk:
            u, v, n = edges[e]
            rows.append((names[e], u, v, n, key, place, 1, place - key))
            place += n
    schema = "edge long, u long, v long, n long, key long, place long, src_key long, src_place long"
    paths = lambda walked: {back[r.path]: r.n for r in debruijn.compacted(debruijn.linked(spark.createDataFrame(walked, schema))).collect()}
    want = {"c0": 80, "f1": 1, "f2": 1, "f3": 5, "r1": 3}  # two edges leave node 101; the ring's walk begins at r1
    assert paths(rows) == want
    short = [r for r in rows if not (r[4] == 14 and r[0] >= 10)]  # document 14 stops in the middle of the chain: a branch
    assert paths(short) == want | {"c0": 20, "c10": 60}
    moved = [(*r[:6], 2, r[7]) if r[4] == 14 and r[0] >= 10 else r for r in rows]  # its source changes there
    assert paths(moved) == want | {"c0": 20, "c10": 60}
    ring = spark.createDataFrame([(1, 1, 3, 1), (2, 1, 1, 1), (3, 1, 2, 1)], "edge long, n long, prev long, prev_n long")
    assert {(r.path, r.n) for r in debruijn.compacted(ring).collect()} == {(1, 1), (2, 1), (3, 1)}  # no first edge


def test_spans_have_source_coordinates(spark):
    passage = words(90)
    texts = [" ".join([*words(5), *passage, *words(5)]), " ".join([*words(40), *passage, *words(7)]), " ".join([*words(3), *passage[10:80], *words(60)])]
    keyed = spark.createDataFrame(list(enumerate(texts)), "key long, text string").selectExpr("key", "key doc_id", "text")
    spans = debruijn.repeated_spans(debruijn.written(debruijn.repeated_edges(keyed, 50), "repeats"))
    got = {(s.key, s.place, s.n, s.src_key, s.src_place) for s in spans.collect()}
    covered = {(k, p + i, q, o + i) for k, p, n, q, o in got for i in range(n)}
    assert covered == {(1, 40 + i, 0, 5 + i) for i in range(41)} | {(2, 3 + i, 0, 15 + i) for i in range(21)}
    wrong = spans.withColumn("src_place", spans.src_place + 1)
    with pytest.raises(RuntimeError, match="unequal text"):
        debruijn.cut_spans(keyed, wrong, 50, debruijn.words_of, b" ".join)


def test_longest_previous_factors():
    r = np.random.default_rng(3)
    for alphabet, window in ((2, 6), (3, 9), (4, 16)):
        raw = r.integers(97, 97 + alphabet, 400).astype(np.uint8)
        text, starts = raw.tobytes(), np.arange(400 - window + 1)
        order, lcp = suffix_lpf.suffix_order(raw, starts, window, np.zeros(len(starts), np.int64), starts)
        length, source = suffix_lpf.previous_factors(starts[order], lcp)
        for i, p in enumerate(starts[order].tolist()):
            best = max([next((k for k in range(window) if text[p + k] != text[q + k]), window) for q in range(p)], default=0)
            assert length[i] == best
            if best:
                q = int(starts[order][source[i]])
                assert q < p and text[q : q + best] == text[p : p + best]


def test_hot_minimizers_change_nothing(spark, monkeypatch):
    from headroom.llm import blocks

    every = lambda docs, shape, n: np.array([r[0] for r in docs.select("key", "text").mapInArrow(blocks._sampled_grams(shape), "gram long, n long").select("gram").distinct().collect()], np.int64).view(np.uint64)[::2].copy()
    monkeypatch.setattr(blocks, "hot_grams", lambda *a: np.sort(every(*a)))
    got = suffix_lpf.suffix_dedup(table(spark, TEXTS)).select("doc_id", "n_bytes", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(cut_bytes(TEXTS))
    got = debruijn.substring_dedup(table(spark, TEXTS)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(cut_words(TEXTS))


def test_repeated_and_missing_ids(spark):
    docs = table(spark, [TEXTS[0], TEXTS[0], TEXTS[0], "a b"], [7, 7, None, None])
    got = debruijn.substring_dedup(docs).collect()
    assert sorted(r.n_removed > 0 for r in got) == [False, False, True, True]
    got = near_dup.minhash_dedup(docs).collect()
    assert sum(r.kept for r in got) == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (debruijn.substring_dedup(docs), suffix_lpf.suffix_dedup(docs), near_dup.minhash_dedup(docs), language.language_id(docs), pu_quality.quality(docs, labels), mixing.curriculum_assign(docs), vector_dedup.embedding_dedup(vectors)):
        assert df.count() == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts, percent):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def test_minhash(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.minhash_dedup(table(spark, TEXTS)).collect()}
    assert got == brute_components(TEXTS, 85)


@pytest.mark.parametrize("slack", [None, (-0.2, -0.2)])
def test_minhash_large_buckets(spark, monkeypatch, slack):
    """Buckets larger than a part, some of several components; and estimates that are sure of what the sets refute."""
    r = random.Random(8)
    texts = []
    for n in (60, 40, 25):
        base = words(120)
        for _ in range(n):
            near = list(base)
            for _ in range(r.randint(0, 3)):
                near[r.randrange(120)] = r.choice(VOCABULARY)
            texts.append(" ".join(near))
    shared = words(60)
    texts += [" ".join(shared + words(r.randint(8, 14))) for _ in range(30)]
    monkeypatch.setattr(near_dup.similar_links, "__defaults__", (12,))
    if slack:  # below the threshold by far, a pair still counts as sure
        monkeypatch.setattr(near_dup, "SLACK", slack)
        monkeypatch.setattr(near_dup._Bucket, "compare", sure_of_all(near_dup._Bucket.compare))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dup.minhash_dedup(table(spark, texts)).collect()}
    assert got == brute_components(texts, 85)


@pytest.mark.parametrize(("visited", "most"), [(1, 2), (1, 100), (4, 8)])
def test_minhash_parts_that_grow(spark, monkeypatch, visited, most):
    """Documents that meet in large buckets without being linked; parts are visited whatever their number and length."""
    r = random.Random(18)
    base, texts = words(150), []
    for _ in range(150):
        near = list(base)
        for _ in range(r.choice((1, 1, 2, 3, 4))):
            near[r.randrange(150)] = r.choice(VOCABULARY)
        texts.append(" ".join(near))
    monkeypatch.setattr(near_dup.similar_links, "__defaults__", (12,))
    monkeypatch.setattr(near_dup, "VISITED", visited)
    monkeypatch.setattr(near_dup, "MOST", most)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dup.minhash_dedup(table(spark, texts)).collect()}
    assert got == brute_components(texts, 85)
    assert 20 < sum(x[2] for x in got.values()) < 130


def test_minhash_rows_dealt_out_stay_in_proportion(spark, monkeypatch):
    """No document meets its sketches once a band or part, and a large bucket's rows are at most 2 * MOST times its documents."""
    dealt, joins = [], []
    listed = type(table(spark, TEXTS)).join
    monkeypatch.setattr(near_dup.similar_links, "__defaults__", (12,))
    monkeypatch.setattr(near_dup, "VISITED", 1)
    monkeypatch.setattr(near_dup, "MOST", 2)

    def mapped(self, run, schema, *more, f=type(table(spark, TEXTS)).mapInArrow):
        if "part" in self.columns:
            dealt.append(self.groupBy("key", "bucket").count().agg({"count": "max"}).first()[0])
        return f(self, run, schema, *more)

    def joined(self, other, on=None, how=None):
        if isinstance(on, str) and how is None and "sketch" in other.columns:
            joins.append((self.count(), self.select("key").distinct().count()))
        return listed(self, other, on, how)

    r, base, texts = random.Random(19), words(150), []
    for _ in range(100):
        near = list(base)
        for _ in range(r.choice((2, 3, 4))):
            near[r.randrange(150)] = r.choice(VOCABULARY)
        texts.append(" ".join(near))
    docs = table(spark, texts)
    monkeypatch.setattr(type(docs), "mapInArrow", mapped)
    monkeypatch.setattr(type(docs), "join", joined)
    near_dup.minhash_dedup(docs, percent=80).count()
    assert len(dealt) >= 2 and max(dealt[1:]) <= 4, dealt
    assert joins and all(rows == keys for rows, keys in joins), joins


def sure_of_all(compare):
    def run(self, a, b, threshold):
        a, b, sure = compare(self, a, b, threshold - 0.15)
        return a, b, np.ones(len(a))

    return run


def test_first_rows_of_components(spark):
    schema = "doc_id long, text string, key int, _key int"
    rows = [(7, "x y z", 1, 1), (7, "x y z", 1, 1), (7, "other words", 2, 2), (9, "y", 3, 3), (None, "x y z", 4, 4), (None, "lone", 5, 5), (None, None, 6, 6), (None, None, 6, 6), (3, "", 7, 7)]
    got = near_dup.first_rows(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["doc_id", "text", "key", "_key"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], *rows[2:4], *rows[5:]]))
    assert near_dup.first_rows(spark.createDataFrame([], schema)).count() == 0


def test_odd_sketch_estimate():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 400, dtype=np.uint64)
    for share in (0.8, 0.9, 0.97):
        b = np.concatenate([a[: int(400 * share)], r.integers(0, 2**63, 400 - int(400 * share), dtype=np.uint64)])
        (x, n), (y, m) = near_dup.odd_sketch(a, 0), near_dup.odd_sketch(b, 0)
        ones = np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs(near_dup.estimate(np.array([ones]), np.array([n + m]))[0] - true) < near_dup.SLACK[0]


def test_wavelet_and_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    ids = np.random.default_rng(1).integers(0, 50257, 3001)
    m = token_shards.WaveletMatrix.build(ids, 16)
    assert (m.decode() == ids).all() and [m.access(i) for i in range(0, 3001, 37)] == ids[::37].tolist()
    assert m.occurrences(int(ids[9])) == np.flatnonzero(ids == ids[9]).tolist() and m.count(int(ids[9])) == (ids == ids[9]).sum()
    odd = np.arange(1, 700) % 3  # zeros beyond the last id belong to no one
    m = token_shards.WaveletMatrix.build(odd, 2)
    assert all(m.occurrences(v) == np.flatnonzero(odd == v).tolist() for v in range(4)) and m.count(3) == 0
    path = P.path("byte_bpe_50k.json")
    texts = [*TEXTS, "hello <|endoftext|> world", "<|endoftext", "A.B, c;d !e\nf. \n\ng's",  "a  b", "\n\n x\ty ", "\xa0  b\x1c !", "don't  I'll\r\n\r\n ok"]
    got = [tuple(r) for r in token_shards.token_shards(table(spark, texts), path, shard_tokens=500).orderBy("doc_id").collect()]
    plain, start, want = Tokenizer.from_file(path), 0, []
    for i, t in enumerate(texts):
        b = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(b), zlib.crc32(b.tobytes())))
        start += len(b)
    assert got == want


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), None, [None, "a", "b", "c"][i % 4], 0) for i in range(400)] + [(400, None, None, "d", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.curriculum_assign(docs).collect()
    assert len(got) == 401 and all(r.taken <= 2 * r.size for r in got)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 1 for s, t in target.items())
    order = mixing.curriculum_mix(docs).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert sum(r.taken for r in order) == sum(taken.values())


def test_schedule_inverts_its_area():
    s = mixing.Schedule(1.0, (0.0, 0.6, 1.0), (0.4, 0.8, 2.2))
    assert s.areas()[-1] == pytest.approx(0.6 * 0.6 + 0.4 * 1.5)


def test_decontamination(spark):
    item = words(40)
    changed = list(item)
    changed[1] = "zzz"  # 34 of 38 shingles in common
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    texts = [" ".join(words(100) + item + words(50)), " ".join(item).upper(), " ".join(words(30) + changed), " ".join(words(200)), None, "", " ".join(item[:12] + words(80))]
    got = {r.doc_id: r for r in decontaminate.contaminated(table(spark, texts), bench).collect()}
    assert set(got) == {0, 1, 2} and got[0].start == 100 and got[0].similarity == 1 and got[2].similarity == pytest.approx(34 / 38)
    assert sorted(r.doc_id for r in decontaminate.clean(table(spark, texts), bench).collect()) == sorted(set(range(7)) - set(got))


def test_licenses(spark):
    texts = ["Released under the MIT License.\n" + TEXTS[0], TEXTS[1] + "\nThis work is licensed under the GNU General Public License, version 3.", TEXTS[2], None, "", "license"]
    got = {(r.doc_id, r.license) for r in licenses.license_scan(table(spark, texts), licenses.template_table(spark)).collect()}
    assert got == {(0, "MIT"), (1, "GPL-3.0")}


def test_language(spark):
    syllables = {"xa": ["ka", "ti", "mo"], "yb": ["ru", "sel", "ig"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[g]) for _ in range(3)) for _ in range(40)), g, "s", 0) for i in range(200) for g in [("xa", "yb")[i % 2]]]
    rows += [(200, None, "xa", "s", 0), (201, "123 !!", "xa", "s", 0)]
    got = {r.doc_id: r for r in language.language_id(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i].lang_pred == ("xa", "yb")[i % 2] and 0 <= got[i].score <= 1 for i in range(200))
    assert got[200].lang_pred == got[201].lang_pred == "und"


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = pu_quality.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97 and got.score.between(0, 1).all()


def test_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 32))
    x[300:340] = x[0] + 0.05 * r.normal(size=(40, 32))
    x[340:344] = x[5] * 3
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 32), (602, [float("nan")] * 32), (603, [])]
    got = {g.vec_id: g for g in vector_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(600)])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert got[343].component_id == 5 and got[5].n_links == 4 and got[600].n_links == 0 and got[603].kept


def pairs_at(r, n, pairs, low, high):
    """`n` unit vectors, evenly spread over 64 dimensions, the last `pairs` of them at cosines from low to high with the first ones."""
    x = r.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):
        c, v = r.uniform(low, high), x[n - 1 - i]
        v = v - (v @ x[i]) * x[i]
        x[n - 1 - i] = c * x[i] + np.sqrt(1 - c * c) * v / np.linalg.norm(v)
    return x


@pytest.mark.parametrize("options", [{}, {"block": 700}])
def test_vector_links_across_cells(spark, options):
    r = np.random.default_rng(11)
    # evenly spread pairs at 0.90 to 0.93, tight groups and a chain
    x = pairs_at(r, 11_000, 800, 0.9001, 0.93)
    groups = np.repeat(pairs_at(r, 10, 0, 0, 0), 120, axis=0) + 0.04 * r.normal(size=(1200, 64))
    chain = np.zeros((60, 64))
    chain[np.arange(60), 0], chain[np.arange(60), 1] = np.cos(0.4 * np.arange(60) / 4), np.sin(0.4 * np.arange(60) / 4)
    x = np.concatenate([x, groups, chain])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    result = vector_dedup.embedding_dedup(vectors, **options).cache()
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in result.collect()}
    u = vector_dedup.unit_rows(x)
    a, b = np.nonzero(u @ u.T >= 0.9)
    a, b = a[a != b], b[a != b]
    label = np.arange(len(x))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        if (low == label).all():
            break
        label = low
    links = np.bincount(a, minlength=len(x))
    assert links[:800].min() >= 1
    assert got == {i: (links[i], label[i], label[i] == i) for i in range(len(x))}
    found, there = vector_dedup.audit_recall(vectors, result)
    assert found == there > 0


def test_vector_bounds_rule_out_far_cells_only():
    r = np.random.default_rng(4)
    centres = vector_dedup.unit_rows(r.normal(size=(20, 16)))
    x = vector_dedup.unit_rows(centres[r.integers(0, 20, 2000)] + 0.1 * r.normal(size=(2000, 16)))
    sim = x @ centres.T
    home, least = sim.argmax(1), np.ones(20)
    np.minimum.at(least, home, sim.max(1))
    cells = vector_dedup.possible(x, home, centres, least, 0.9)
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert cells[a, home[b]].all() and cells.mean() < 0.5


def test_short_items_in_long_texts(spark):
    notice = "LicenseRef-All-Rights-Reserved"
    texts = [TEXTS[0] + "\nAll rights reserved.\n" + TEXTS[1], "All rights reserved.", "(c) X. All rights reserved.", TEXTS[2], "all rights", None]
    got = {(r.doc_id, r.license): (r.n_places, r.start) for r in licenses.license_scan(table(spark, texts), licenses.template_table(spark)).collect()}
    assert got == {(0, notice): (1, len(TEXTS[0].split())), (1, notice): (1, 0), (2, notice): (1, 2)}
    item, long = words(3), words(30)
    bench = spark.createDataFrame([(1, " ".join([*item, "zq1"])), (2, "zq2 zq3"), (3, " ".join(long)), (4, "zq9")], "item_id long, text string")
    texts = [" ".join([*words(60), *item, "ZQ1", *words(9)]), "zq2 zq3", "a zq2 zq3", " ".join([*words(7), *long, "zq9"]), " ".join(words(90)), "zq2", None]
    got = {(r.doc_id, r.item_id, r.start, r.n_words, r.similarity) for r in decontaminate.contaminated(table(spark, texts), bench).collect()}
    assert got == {(0, 1, 60, 4, 1.0), (1, 2, 0, 2, 1.0), (2, 2, 1, 2, 1.0), (3, 3, 7, 30, 1.0), (3, 4, 37, 1, 1.0)}
    empty = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert decontaminate.contaminated(table(spark, texts), empty).count() == 0


def test_parameters_that_would_lose_rows_are_refused():
    from headroom.llm import blocks

    assert blocks.Shape(150, 24, blocks.word_symbols).width == 127
    for window in (151, 152, 400):
        with pytest.raises(ValueError):
            blocks.Shape(window, 24, blocks.word_symbols)
    for percent in (50, 79):
        with pytest.raises(ValueError, match="80 %"):
            near_dup.minhash_dedup(None, percent=percent)
