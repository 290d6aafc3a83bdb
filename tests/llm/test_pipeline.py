"""Stages of the corpus pipeline against brute force."""

import random

import corpus_pipeline
from headroom.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_copies_from_80_percent_leave(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    listed = []
    for _ in range(8):
        base = [word() for _ in range(300)]
        listed.append(base)
        for changed in (2, 6, 7, 8, 12):  # each changed word takes five shingles along
            copy = list(base)
            for i in range(changed):
                copy[10 + 20 * i] = word()
            # each copy has a base of its own, so that no chain of copies links it
            listed += [copy]
            base = [word() for _ in range(300)]
            listed += [base]
    rows = [(i, " ".join(w), "xa", "s", 0) for i, w in enumerate(listed)]
    sets = [shingle_set(w) for w in listed]
    gone = {i for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    between = {i for i in range(1, len(sets)) if 80 <= 100 * len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) < 85}
    assert len(between) >= 8 and between <= gone
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_dup_stage(spark, docs, "").collect()}
    assert got == set(range(len(sets))) - gone


def rows_in(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def tiny(spark, rows, more=""):
    return spark.createDataFrame(rows, DOC + more).repartition(2)


def test_rows_with_equal_or_no_ids(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(7, a, "xa", "s", 1), (7, a, "xa", "s", 1), (7, b, "xa", "s", 1), (9, "nine ten eleven", "xa", "s", 1), (None, a, "xa", "s", 1), (None, "lone text", None, None, None), (11, None, None, None, None), (12, "", None, None, None)]
    kept = corpus_pipeline.near_dup_stage(spark, tiny(spark, rows), "")
    want = [rows[0], *rows[2:4], *rows[5:]]
    assert rows_in(kept) == sorted(map(repr, want)) and kept.columns == corpus_pipeline.COLUMNS


def bench_dir(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_clashing_names_and_empty_tables(spark, tmp_path):
    item = "what is the first of all the questions that we ask here"
    sf = bench_dir(spark, tmp_path, [(1, item), (2, None)])
    names = ", _hit int, _n int, _id int, _nth int, _size int, key int, size int, bucket int, place int, taken int"
    rows = [(i, t, "xa", "s", 1, *[i] * 10) for i, t in enumerate([f"before {item} after", "plain words of a clean text", None, "", f"before {item} after"])]
    rows += [(1, f"{item} again", "xa", "s", 1, *[5] * 10), (None, item, "xa", "s", 1, *[6] * 10), (None, "clean as well", "xa", "s", 1, *[7] * 10)]
    docs = tiny(spark, rows, names)
    got = corpus_pipeline.decontamination_stage(spark, docs, sf)
    assert rows_in(got) == sorted(repr(r[:5]) for r in (rows[1], rows[2], rows[3], rows[7]))
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
    assert mixed.columns == corpus_pipeline.COLUMNS and {r.text for r in mixed.collect()} <= {r[1] for r in rows if r[1]}
    assert {r.doc_id for r in corpus_pipeline.near_dup_stage(spark, docs, sf).collect()} == {0, 1, 2, 3, None}
    assert corpus_pipeline.language_stage(spark, docs, sf).columns == corpus_pipeline.COLUMNS
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, tiny(spark, [], names), sf).count() == 0


def test_whole_pipeline(spark, tmp_path):
    """run() against its decisions by hand: copies, a benchmark passage and texts without letters leave, the rest is mixed and encoded."""
    import zlib

    import numpy as np
    import pytest

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = ["".join(rng.choice(["ka", "ti", "mo", "ru"]) for _ in range(3)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    rows = [(i, text(60), "xa", "abc"[i % 3], 1) for i in range(60)]
    rows += [(100, rows[5][1], "xa", "a", 1), (101, rows[6][1] + " more", "xa", "b", 1), (102, f"{text(30)} {item} {text(20)}", "xa", "a", 1), (103, "123 456 !!", "xa", "a", 1), (104, None, "xa", "a", 1), (105, "", "xa", "a", 1)]
    sf = bench_dir(spark, tmp_path, [(1, item)])
    tiny(spark, rows).write.parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).orderBy("start").collect()]
    ids = [g[0] for g in got]
    assert set(ids) <= set(range(60)) and max(ids.count(i) for i in ids) <= 2
    # the shards hold the copies in training order, not by id
    mixed = mixing.curriculum_mix(tiny(spark, [r for r in rows if r[0] < 60])).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed) and ids == [r.doc_id for r in mixed] != sorted(ids)
    # shares: 150 % of all words over three sources, weights 3, 1, 2, no source above twice its size
    share = {s: sum(60 for i in ids if "abc"[i % 3] == s) / 1200 for s in "abc"}
    assert abs(share["a"] - 2) < 0.06 and abs(share["c"] - 5 / 3) < 0.06 and abs(share["b"] - 5 / 6) < 0.06
    plain, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for doc_id, at, n, crc in got:
        want = np.array([*plain.encode(rows[doc_id][1], add_special_tokens=False).ids, 2], "<u4")
        assert (at, n, crc) == (start, len(want), zlib.crc32(want.tobytes()))
        start += n
