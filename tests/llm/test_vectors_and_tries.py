"""Whitening, threshold search and prefix tries against brute force, with their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from headroom.llm import debruijn, mixing, prefix_trie, token_shards, topk, whitening

VECTOR = "vec_id long, embedding array<float>, label int, class long, place long, row long, vector int, asks int, block int, query int"
NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0, 0.0], [1.0, None, 2.0], [NAN, 1.0], [1.0, INF], [0.5]]


def vectors(spark, rows):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, 1, 7, 7, 7, 7, 7, 7, 7) for i, v in rows], VECTOR).repartition(3)


def usable(rows):
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def some_vectors(n, dims, seed):
    g = np.random.default_rng(seed)
    mixed = g.normal(size=(n, dims)) @ g.normal(size=(dims, dims)) / dims
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(mixed)]
    return rows + [(None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1])]


def check_whitening(rows, got, components=32):
    kept = usable(rows)
    dims = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v + [0.0] * (dims - len(v))] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    centred = apart.astype(float) / n
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    wide = min(components, dims)
    assert len(got) == n * wide and {r.n for r in got} == {n}
    deviations = sorted(((-1 if i is None else i), int((a * a).sum())) for (i, _), a in zip(kept, apart))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.deviation) for r in got if r.component == 1) == deviations
    shares = {r.component: r.explained for r in got}
    assert [shares[k + 1] for k in range(wide)] == pytest.approx(list(np.maximum(values[:wide], 0) / values.sum()), abs=1e-12)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    # projections: the Gram matrix of whitened rows is that of the definition, whatever the signs
    order = {}
    for r in got:
        order.setdefault((r.vec_id is not None, r.vec_id, r.deviation), {}).setdefault(r.component, r.whitened)
    full = [k for k in range(1, wide + 1) if values[k - 1] > 1e-9 * values[0]]
    assert all((w[k] is not None) == (k in full) for w in order.values() for k in w)
    _, axes = np.linalg.eigh(covariance)
    for k in full:
        wanted = centred @ axes[:, ::-1][:, k - 1] / np.sqrt(values[k - 1])
        for (i, _), a, w in zip(kept, apart, wanted):
            assert abs(abs(order[(i is not None, i, int((a * a).sum()))][k]) - abs(w)) < 1e-6


def test_whitening(spark):
    rows = some_vectors(300, 9, 1)
    check_whitening(rows, whitening.whiten(vectors(spark, rows)).collect())


def test_whitening_of_odd_vectors(spark):
    rows = some_vectors(40, 6, 2) + list(enumerate(ODD, 900)) + [(950, [2e3, -3e2, 0.0, 0.0, 0.0, 0.0])]
    check_whitening(rows, whitening.whiten(vectors(spark, rows)).collect())


def test_whitening_without_variance(spark):
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, [2.0, 4.0])])).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True)}
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in got)
    for none in ([], [(1, None), (2, [NAN])], [(1, []), (2, [])]):
        assert whitening.whiten(vectors(spark, none)).collect() == []


def test_scatter_is_exact():
    g = np.random.default_rng(3)
    y = g.integers(0, 2**40, size=(333, 5))
    y[:, 2] = 4
    bits = [int(c.max()).bit_length() for c in y.T]
    want = y.astype(object).T @ y.astype(object)
    assert (np.triu(whitening.scatter(y, bits)) == np.triu(want)).all()


def brute_top(rows, k, every):
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in usable(rows)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(kept) if b != a)
            out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_top_k(spark, monkeypatch, small_blocks):
    if small_blocks:  # many blocks of queries and of candidates
        monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
        monkeypatch.setattr(topk, "_blocks", lambda n: -(-n // 64))
    g = np.random.default_rng(4)
    near = [[float(x) for x in v] for v in 1 + g.normal(size=(80, 7)) / 300]
    rows = some_vectors(300, 7, 5) + list(enumerate(near, 400)) + [(600 + i, near[0]) for i in range(120)] + list(enumerate(ODD, 1000)) + [(50, near[1]), (50, near[1]), (None, near[1])]
    got = topk.top_k(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_top(rows, 5, 50)


def test_top_k_of_few_and_large(spark):
    rows = [(0, [1.0, 2.0]), (50, [3.0]), (51, [-1.0, -1.0])]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect()), key=repr) == brute_top(rows, 5, 50)
    big = [(50 * i, [2.0**20 + i, -(2.0**19) * i, 0.0, 1.0]) for i in range(9)]  # scores beyond 2^53
    assert sorted(map(tuple, topk.top_k(vectors(spark, big)).collect()), key=repr) == brute_top(big, 5, 50)
    for none in ([], [(0, None)], [(0, [1.0])], [(1, [1.0]), (2, [1.0])]):
        assert topk.top_k(vectors(spark, none)).collect() == []


def test_uniform_threshold_keeps_all_that_reach_the_cutoff():
    g = np.random.default_rng(6)
    q, c = g.integers(-300, 300, size=(20, 12)), g.integers(-300, 300, size=(500, 12))
    lists = topk._lists(q, c, 4)
    total = q @ c.T
    cutoff = np.sort(total, axis=1)[:, -6]
    kept = topk.sufficient(lists, cutoff)
    assert kept[total >= cutoff[:, None]].all() and kept.sum() < 0.5 * kept.size


CONVERSATION = "conv_id long, turn int, role string, text string, path int, sizes int, top int, key int, n int, subtree int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7, 7, 7) for r in rows], CONVERSATION).repartition(3)


def brute_trie(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in said.values():
        turns.sort(key=lambda t: (t[:2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))
    built = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(t[2:] for t in said.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, own in members.items():
        d = len(node)
        below = [m for m in members if m[:d] == node]
        kids = sum(len(m) == d + 1 for m in below)
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ended = ",".join(str(c) for c in sorted(own) if len(built[c]) == d)
        out.append((min(own), d, min(members[node[:-1]]) if d else None, len(own), kids, leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed, n=60):
    g = random.Random(seed)
    rows = []
    for c in [*range(n), *range(100, 100 + n), 5000, 5001, -7, -100, -107]:
        for t in range(g.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, None if t == 0 and g.random() < 0.2 else t, g.choice(["user", "assistant", None]), g.choice(["hi", "yes", "né 🎈", "", None, "the end"])))
    rows += [(None, 0, "user", "nobody"), (3, 0, "user", "hi"), (3, 0, "user", "hi")]
    rows += [(200 + i, t, "user", f"copy {t}") for i in range(40) for t in range(3)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(150)] + [(301, t, "user", f"long {t}") for t in range(149)]
    g.shuffle(rows)
    return rows


@pytest.mark.parametrize("light", [prefix_trie.LIGHT, 40])
def test_prefix_trie(spark, light):
    rows = talk(8)
    got = prefix_trie.prefix_trie(conversations(spark, rows), light).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


def test_prefix_trie_of_little(spark):
    for rows in ([], [(None, 1, "user", "x")], [(1, None, None, None)], [(5, 0, "user", "a"), (5, 1, "user", "b")]):
        got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
        assert sorted(map(tuple, got), key=repr) == brute_trie(rows)
    assert prefix_trie.ROOT == hashlib.sha256(b"").hexdigest()


def test_schedules_decide_positions(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 7), "abc"[i % 3]) for i in range(90)] + [(None, f"no id {i}", "a") for i in range(30)], "doc_id long, text string, source string")
    flat = tuple(mixing.Schedule(s.weight) for s in mixing.DEFAULT_SCHEDULES)
    row = lambda r: (r.doc_id, r.size, r.taken)
    by_schedule, by_flat = (mixing.curriculum_assign(docs, s).collect() for s in (mixing.DEFAULT_SCHEDULES, flat))
    assert sorted(map(repr, map(row, by_schedule))) == sorted(map(repr, map(row, by_flat)))
    places = lambda rows: sorted(p.position for r in rows for p in r.passes)
    assert places(by_schedule) != places(by_flat)
    # halfway through training a source that falls from 1.5 to 0.5 has given 5/8 of its words
    first = [(p.position, p.taken) for r in by_schedule if r.source == "a" for p in r.passes]
    assert sum(t for p, t in first if p < 0.5) / sum(t for _, t in first) == pytest.approx(0.625, abs=0.03)


def test_tokenizers_of_other_kinds(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, texts = P.path("word_bpe_49k.json"), ["Hello  World, it's 42!", " two\n\nLines\tÉTÉ ", "", "plain"]
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_shards.token_shards(docs, path).orderBy("start").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ([*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts)]
    with pytest.raises(Exception, match="does not fit"):
        token_shards.write_token_shards(docs, str(tmp_path / "few"), path, bits=8)


def test_paths_decide_the_spans(spark, monkeypatch):
    """A passage that several documents walk is one span each, and without compaction the words removed are others."""
    g = random.Random(9)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(5))
    passage, tail = [word() for _ in range(400)], [word() for _ in range(120)]
    texts = [" ".join([word() for _ in range(20)] + (passage if i < 4 else passage[100:300] + tail) + [word() for _ in range(20)]) for i in range(6)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "key long, doc_id long, text string").repartition(2)
    runs = debruijn.repeated_edges(docs, 50).checkpoint()
    spans = [tuple(r) for r in debruijn.repeated_spans(runs).select("key", "n").collect()]
    assert sum(n for k, n in spans if k == 1) == 351 and sum(n for k, n in spans if k == 5) == 151 + 120 and len([k for k, _ in spans if k == 1]) <= 6 < runs.where("key = 1").count()
    whole = {r.doc_id: r.n_removed for r in debruijn.substring_dedup(docs.drop("key")).collect()}
    assert whole == {0: 0, 1: 400, 2: 400, 3: 400, 4: 200, 5: 320}
    monkeypatch.setattr(debruijn, "compacted", lambda edges: edges.where("prev is null").selectExpr("edge path", "n"))
    assert {r.doc_id: r.n_removed for r in debruijn.substring_dedup(docs.drop("key")).collect()} != whole
