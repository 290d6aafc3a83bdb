"""Language identification with bit-sliced Bloom filters over letter n-grams.

All languages share one table of slots; bit l of a slot belongs to language l, so that
one lookup of an n-gram (the AND of its HASHES slots) returns the bitmask of all
languages that contain it. A text's popcount per language, corrected for the share of
n-grams that a filter of that fill returns by chance, decides.

The filters are learnt from a bounded sample of labelled rows: about SAMPLE documents of
each language. An n-gram belongs to a language if it is there at least MIN_COUNT times
and at least LEAST_SHARE times as often as in the language where it is most frequent, so
that foreign passages inside a document do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import kernels as K
from .common import held_remainder, ship, written

ORDER = 4
HASHES = 3
SLOTS = 1 << 22
SAMPLE = 2000
MIN_COUNT = 3
LEAST_SHARE = 0.3
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS


def letter_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of each letter n-gram, blanks collapsed and around words; and the letters of each text."""
    joined = "".join("\0" + (t or "").replace("\0", " ") + " " for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(points == 0) - 1
    letter = _letters()[np.minimum(points, 0x10FFFF)]
    count = np.bincount(doc[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]  # one blank before and one after each word; two words share theirs only if one stands between
    seq, doc = np.where(letter, points, 32)[keep].astype(np.uint64), doc[keep]
    if len(seq) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), count
    h = np.zeros(len(seq) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        h = h * np.uint64(K.BASE) + seq[i : len(seq) - ORDER + 1 + i]
    same = doc[ORDER - 1 :] == doc[: len(doc) - ORDER + 1]
    return doc[: len(h)][same], K.mix(h[same]), count


def slots_of(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [((grams + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageFilter:
    languages: list[str]
    table: np.ndarray  # slots x words of 64 languages, or one column of a smaller type
    prior: np.ndarray

    @classmethod
    def build(cls, languages: list[str], prior: np.ndarray, language: np.ndarray, grams: np.ndarray, slots: int = SLOTS) -> LanguageFilter:
        words = max(1, -(-len(languages) // 64))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        table = np.zeros((words, slots), kind)
        for at in slots_of(grams, slots):
            for w in range(words):
                mine = language // 64 == w
                np.bitwise_or.at(table[w], at[mine], (kind(1) << (language[mine] % 64).astype(kind)))
        return cls(languages, table, prior)

    def false_rates(self) -> np.ndarray:
        """Share of n-grams that each language's filter returns by chance: its fill to the power of the hashes."""
        fill = [np.count_nonzero(self.table[i // 64] & self.table.dtype.type(1 << (i % 64))) / self.table.shape[1] for i in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def predict(self, texts: list[str | None], false: np.ndarray) -> tuple[list[str], np.ndarray]:
        doc, grams, letters = letter_grams(texts)
        n = np.bincount(doc, minlength=len(texts))
        at = slots_of(grams, self.table.shape[1])
        score = np.zeros((len(texts), len(self.languages)))
        for w in range(len(self.table)):
            mask = self.table[w][at[0]]
            for more in at[1:]:
                mask &= self.table[w][more]
            for i in range(w * 64, min(len(self.languages), w * 64 + 64)):
                hit = np.bincount(doc, weights=(mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), minlength=len(texts))
                score[:, i] = np.maximum(hit - false[i] * n, 0) / (1 - false[i])
        score += 1e-6 * self.prior  # texts without a known n-gram get the most frequent language
        best = score.argmax(1)
        top = score[np.arange(len(texts)), best]
        # the share of n-grams known to the language, weighed by how far it leads
        second = np.partition(score, -2, axis=1)[:, -2] if score.shape[1] > 1 else np.zeros(len(texts))
        sure = np.clip(top / np.maximum(n, 1), 0, 1) * (top / np.maximum(top + second, 1e-12))
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters > 0, sure, 0.0)


def _count_grams(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.text_slices(batch, 1):
                lang = np.array([index[v] for v in rows.column(0).to_pylist()])
                doc, grams, _ = letter_grams(rows.column(1).to_pylist())
                for i in np.unique(lang).tolist():
                    g, n = np.unique(grams[lang[doc] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], names=["language", "gram", "n"])

    return run


def learn(docs: DataFrame, train: Column, sample: int = SAMPLE, slots: int = SLOTS) -> LanguageFilter:
    """Filters from the rows of `docs` (doc_id, text, lang) that `train` marks; rows without lang or text are left out."""
    ship(docs.sparkSession)
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros((1, slots), np.uint8), np.zeros(0))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))) for name, n in sizes.items()])
    index = {name: i for i, name in enumerate(languages)}
    counts = known.where(part < share).select("lang", "text").mapInArrow(_count_grams(index), "language int, gram long, n long")
    counts = counts.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    # the share of each n-gram in its language, against its largest share; totals are one row per language
    counts = written(counts, "grams")
    all_of = counts.groupBy("language").agg(F.sum("n").alias("all"))
    counts = counts.join(all_of, "language").withColumn("share", F.col("n") / F.col("all"))
    counts = counts.withColumn("most", F.max("share").over(W.partitionBy("gram")))
    kept = counts.where((F.col("n") >= MIN_COUNT) & (F.col("share") >= LEAST_SHARE * F.col("most"))).select("language", "gram").toArrow()
    total = sum(sizes.values())
    prior = np.array([sizes[name] / total for name in languages])
    return LanguageFilter.build(languages, prior, kept["language"].to_numpy().astype(np.int64), kept["gram"].to_numpy().view(np.uint64), slots)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """`docs` with lang_pred and score; it must have a column text, and names of its own that clash are replaced.

    A text that is null or has no letter is `und` with score 0, and so is every text if
    the model knows no language. Texts of any length are read whole, ties go to the
    language that stands first.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    shared, false = spark.sparkContext.broadcast(model), model.false_rates()
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.text_slices(batch, at):
                texts = rows.column(at).to_pylist()
                if shared.value.languages:
                    lang, score = shared.value.predict(texts, false)
                else:
                    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learnt from the rows that are not held out."""
    out = F.coalesce(held_remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    model = learn(docs, ~out)
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
