"""Edge cases of every operator, and brute force for the native scans."""

import random
from collections import Counter

import numpy as np
import pytest

from headroom.llm import debruijn, decontaminate, language, license_texts, licenses, mixing, near_dup, pu_quality, suffix_lpf, text_scan, token_shards, vector_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = (
    ", key int, item int, w int, s int, start int, n_words int, size int, print int, bucket int, part int, side int, label int, place int, ahead int, node int, component int, gram int, block int, pos int, "
    "edge int, path int, u int, v int, places int, digests int, score int, held_out int, lang_pred int, predicted int, positive int, unit int, cell int, copies int, _hit int, _n int, _id int, pass int, taken int, position int"
)
N_CLASH = CLASH.count(" int")
rng = random.Random(21)
VOCABULARY = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(500)]


def words(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def frame(spark, rows, clash=False):
    rows = [(*r, *([7] * N_CLASH if clash else [])) for r in rows]
    return spark.createDataFrame(rows, DOC + (CLASH if clash else "")).repartition(3)


def as_rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


BENCH = "item_id long, text string"
ITEM = " ".join(words(30))


def scan_licenses(spark):
    return lambda docs: licenses.license_scan(docs, licenses.template_table(spark))


def operators(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, " ".join(words(12)))], BENCH)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    public = pytest.importorskip("public_tokenizers")
    return {
        "mix": mixing.curriculum_assign, "order": lambda d: mixing.curriculum_mix(d).select("doc_id", "text", "source", "position"),
        "licenses": scan_licenses(spark), "substrings": debruijn.substring_dedup, "suffixes": suffix_lpf.suffix_dedup,
        "language": lambda d: language.language_id(d), "tokens": lambda d: token_shards.token_shards(d, public.path("byte_bpe_50k.json")),
        "quality": lambda d: pu_quality.quality(d, labels), "contaminated": lambda d: decontaminate.contaminated(d, bench),
        "clean": lambda d: decontaminate.clean(d, bench).select("doc_id", "text"), "minhash": near_dup.minhash_dedup, "first": lambda d: near_dup.first_rows(d).select("doc_id", "text"),
    }


NAMES = ["mix", "order", "licenses", "substrings", "suffixes", "language", "tokens", "quality", "contaminated", "clean", "minhash", "first"]
LONG = " ".join([*words(30_000), ITEM, "Released under the MIT License.", *words(2000)])
ROWS = [
    (0, " ".join(words(80)), "xa", "a", 1), (1, None, None, None, None), (2, "", "xa", "a", 0), (3, " \n\t ", "xb", "b", 3), (4, f"{ITEM} {' '.join(words(70))}", "xa", None, 1), (5, LONG, "xb", "b", 1),
    (6, " ".join(["tie"] * 300), "xa", "a", 1), (7, " ".join(["tie"] * 300), "xa", "a", 1), (8, "Released under the MIT License.", None, "c", 1), (9, "x", "xa", "c", 1),
]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](frame(spark, [], True)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_and_odd_rows_change_nothing(spark, name):
    """Nulls, empty, blank and very long texts, ties; the same with columns of all names that operators use inside."""
    plain = operators(spark)[name](frame(spark, ROWS))
    clash = operators(spark)[name](frame(spark, ROWS, True)).select(plain.columns)
    assert as_rows(clash) == as_rows(plain)
    if name not in ("order", "licenses", "contaminated", "clean", "first"):
        assert sorted(r.doc_id for r in plain.collect()) == list(range(10))


@pytest.mark.parametrize("name", NAMES)
def test_repeated_rows_and_missing_ids(spark, name):
    """Rows come twice, share an id or have none: each row gives a row (or stands for itself in a search), and nothing fails."""
    rows = [*ROWS, ROWS[0], ROWS[4], (0, "another text of id nought", "xa", "a", 1), (None, f"{ITEM} x", "xa", "a", 1), (None, f"{ITEM} x", "xa", "a", 1), (None, None, None, None, None)]
    got = operators(spark)[name](frame(spark, rows)).collect()
    if name in ("mix", "substrings", "suffixes", "language", "tokens", "quality", "minhash"):
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    if name == "contaminated":
        assert {(r.doc_id, r.item_id) for r in got} == {(4, 1), (5, 1), (None, 1)}
    if name == "clean":
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows if not (r[1] and ITEM in r[1]))
    if name == "licenses":
        assert {(r.doc_id, r.license) for r in got} == {(5, "MIT"), (8, "MIT")}


def test_vectors_with_clashing_names(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(60, 8)), np.ones((3, 8))])
    rows = [(i, v.tolist(), "l", *[7] * N_CLASH) for i, v in enumerate(x)] + [(None, [1.0] * 8, "l", *[7] * N_CLASH), (5, x[5].tolist(), "l", *[7] * N_CLASH), (99, None, "l", *[7] * N_CLASH)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string" + CLASH)
    got = vector_dedup.embedding_dedup(vectors)
    plain = vector_dedup.embedding_dedup(vectors.select("vec_id", "embedding"))
    assert as_rows(got) == as_rows(plain) and got.count() == len(rows)
    assert sum(v.n_links for v in got.collect()) % 2 == 0


# brute force for the native scans


def shingles_of(listed, k=5):
    return [tuple(listed[i : i + k]) for i in range(len(listed) - k + 1)] if len(listed) >= k else [tuple(listed)]


def best_windows(doc, item, score):
    """The best score over all item-sized windows of a document."""
    m = len(item)
    if not doc or not item or (len(doc) < min(m, 5)):
        return 0
    whole = [doc[i : i + m] for i in range(max(1, len(doc) - m + 1))]
    return max(score(shingles_of(w, min(5, m)), shingles_of(item, min(5, m))) for w in whole)


def multiset(a, b):
    both = sum((Counter(a) & Counter(b)).values())
    return both / (len(a) + len(b) - both)


def contained(a, b):
    return len(set(a) & set(b)) / len(set(b))


def edited(item, n):
    out = list(item)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice(VOCABULARY)]
    return out


def test_decontamination_against_brute_force(spark):
    items = [words(n) for n in (5, 6, 12, 20, 30, 40, 60)] + [["again", "and"] * 12, words(3), words(1)]
    texts = [words(rng.randint(0, 90)) for _ in range(40)]
    for item in items * 3:
        texts.append(words(rng.randint(0, 40)) + edited(item, rng.randint(0, max(1, len(item) // 12))) + words(rng.randint(0, 40)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], BENCH)
    docs = frame(spark, [(i, " ".join(w).upper() if i % 3 == 0 else " ".join(w), None, None, None) for i, w in enumerate(texts)])
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(d, i): s for d, doc in enumerate(texts) for i, item in enumerate(items) if (s := best_windows(doc, item, multiset)) >= 0.8}
    assert set(got) == set(want) and len(want) >= 18
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("small", [True, False])
def test_licenses_against_brute_force(spark, monkeypatch, small):
    """All templates, whole and edited; with and without broadcasts."""
    if not small:
        monkeypatch.setattr(text_scan, "BROADCAST_BYTES", 0)
    marks = str.maketrans("", "", licenses.MARKS)
    cut = lambda text: text.lower().translate(marks).split()
    templates = [(name, text, cut(text)) for name, text in license_texts.TEMPLATES]
    assert sum(len(w) - 4 for _, _, w in templates) > 1500
    texts = []
    for i, (_, text, listed) in enumerate(templates):
        body = text if i % 2 else "\n".join(f"# {part}" for part in text.split(". "))
        texts.append(" ".join(words(20)) + "\n" + body + "\n" + " ".join(words(20)))
        texts.append(" ".join(words(10) + edited(listed, len(listed) // 40) + words(10)))
    texts += [" ".join(words(60)) for _ in range(20)]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {(r.doc_id, r.license): r.containment for r in licenses.license_scan(docs, licenses.template_table(spark)).collect()}
    want = {}
    for d, text in enumerate(texts):
        doc = cut(text)
        for name, _, item in templates:
            share = best_windows(doc, item, contained)
            if share >= 0.8:
                want[d, name] = max(share, want.get((d, name), 0))
    assert set(got) <= set(want)
    # what a window contains less well than another template of the same length is left to that one
    assert {d for d, _ in got} == {d for d, _ in want}
    for (d, name), share in want.items():
        if (d, name) in got:
            assert got[d, name] == pytest.approx(share)
        else:
            assert max(s for (x, _), s in got.items() if x == d) >= share
    assert all((2 * i, name) in got for i, (name, _, _) in enumerate(templates))


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 100 and (got.lang_pred == got.lang).mean() > 0.97


@pytest.mark.parametrize(("n", "dim"), [(6000, 6), (10_000, 7)])
def test_vectors_spread_over_few_dimensions(spark, n, dim):
    """Links everywhere, across all borders of cells: all are found, and each counts at both of its ends."""
    x = np.random.default_rng(2).normal(size=(n, dim))
    u = vector_dedup.unit_rows(x)
    true = np.concatenate([(u[i : i + 1000] @ u.T >= 0.9).sum(1) for i in range(0, n, 1000)]) - 1
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    result = vector_dedup.embedding_dedup(vectors, block=900).cache()
    links = {r.vec_id: r.n_links for r in result.collect()}
    assert [links[i] for i in range(n)] == true.tolist() and sum(links.values()) % 2 == 0
    found, there = vector_dedup.audit_recall(vectors, result)
    assert found == there > 0
