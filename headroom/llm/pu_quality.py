"""Quality classifier learnt from trusted positives and unlabelled text.

Non-negative PU learning with the logistic loss: minimise
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
R_p from trusted positives (label 1), R_u from unlabelled documents of the corpus. Where
the second term would turn negative it counts as zero and so has no gradient: the model
cannot gain by pushing the unlabelled risk below what the prior allows. The class prior is
estimated first: no region holds a smaller share of the unlabelled text than prior times
its share of the positives, so the least such ratio over the regions of a positive
against unlabelled classifier bounds it.

Negative labels are never used. The model is fitted on a bounded sample (SAMPLE rows of
each kind); scoring reads every whole text. Features do not depend on the language:
frequencies of byte-class trigrams, and a few word statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import held_remainder, ship

SAMPLE = 8000
CLASSES = 7  # lower, upper, digit, blank, line end, punctuation, beyond ASCII
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]], _CLASS[128:] = 3, 4, 6
WORD_FEATURES = 9
FEATURES = CLASSES**3 + WORD_FEATURES


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text."""
    raw, offsets = K.utf8(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kind = _CLASS[raw]
    out = np.zeros((n, FEATURES), np.float32)
    if len(raw) > 2:
        tri = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        inside = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][inside] * CLASSES**3 + tri[inside], minlength=n * CLASSES**3)
        out[:, : CLASSES**3] = np.sqrt(counts.reshape(n, -1) / np.maximum(size - 2, 1)[:, None])
    starts, ends, words = K.word_spans(raw, offsets)
    h = K.word_hashes(raw, starts, ends)
    many = np.diff(words)
    owner = np.repeat(np.arange(n), many)
    total = np.maximum(many, 1)
    rows = [np.log1p(size) / 10, np.log1p(many) / 10]
    rows.append(np.bincount(owner, weights=np.minimum(ends - starts, 40), minlength=n) / total / 10)
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    rows.append(np.bincount(owner[order], weights=fresh, minlength=n) / total)
    for gap in (1, 2):
        same = np.zeros(len(h), bool)
        same[gap:] = (h[gap:] == h[:-gap]) & (owner[gap:] == owner[:-gap])
        rows.append(np.bincount(owner, weights=same, minlength=n) / total)
    last = kind[np.maximum(ends - 1, 0)] == 5
    rows.append(np.bincount(owner, weights=last, minlength=n) / total)
    rows.append(np.bincount(owner, weights=last & (kind[starts] == 5), minlength=n) / total)
    rows.append(many == 0)
    out[:, CLASSES**3 :] = np.stack(rows, 1)
    return out


@dataclass
class LinearModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(gradient, dim: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = gradient(w, t)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, rng: np.random.Generator, least: float = 0.2) -> float:
    """Share of positives in `u`: the least ratio of shares over score regions that hold `least` of the positives, on halves not used to fit."""
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    hp, hu = len(p) // 2, len(u) // 2

    def gradient(w, t):
        a, b = rng.integers(0, hp, 256), rng.integers(0, hu, 256)
        x = np.concatenate([p[a], u[b]])
        y = np.concatenate([np.ones(256), np.zeros(256)])
        return x.T @ (_sigmoid(x @ w) - y) / 512 + 1e-4 * w

    w = _adam(gradient, p.shape[1], 600, 0.02)
    sp, su = np.sort(p[hp:] @ w), np.sort(u[hu:] @ w)
    cuts = sp[: max(1, int((1 - least) * len(sp)))][:: max(1, len(sp) // 200)]
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    noise = np.sqrt(1 / (above_p * len(sp)) + 1 / (np.maximum(above_u, 1e-9) * len(su)))
    return float(np.clip((above_u / above_p * (1 + noise)).min(), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0, steps: int = 3000, batch: int = 512) -> LinearModel:
    """The non-negative PU estimate of a linear model."""
    rng = np.random.default_rng(seed)
    if not len(positive) or not len(unlabelled):
        dim = FEATURES
        return LinearModel(np.zeros(dim), np.ones(dim), np.zeros(dim), 0.0, 0.5)
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    prepare = lambda x: np.concatenate([np.clip((x - mean) / scale, -4, 4), np.ones((len(x), 1))], 1).astype(np.float64)
    p, u = prepare(positive), prepare(unlabelled)
    prior = estimate_prior(p, u, rng)

    def gradient(w, t):
        a, b = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        sa, sb = _sigmoid(a @ w), _sigmoid(b @ w)
        # logistic losses: -log s for label 1, -log(1 - s) for label 0
        negative = -np.log1p(-np.minimum(sb, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sa, 1 - 1e-12)).mean()
        up = b.T @ sb / batch - prior * (a.T @ sa) / batch
        if negative < 0:
            return prior * (a.T @ (sa - 1)) / batch + 1e-4 * w
        return prior * (a.T @ (sa - 1)) / batch + up + 1e-4 * w

    w = _adam(gradient, p.shape[1], steps, 0.01)
    return LinearModel(mean, scale, w[:-1], float(w[-1]), prior)


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in K.text_slices(batch, 1):
            x = features(rows.column(1))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["positive", "x"])


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> LinearModel:
    """Fits on `docs` (doc_id, text) and `labels` (doc_id, quality); only rows that `train` marks count, and only labels of 1 are read."""
    ship(docs.sparkSession)
    rows = docs.where(train).select("doc_id", "text")
    trusted = labels.where(train & (F.col("quality") == 1)).select("doc_id").distinct()
    part = lambda salt: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    n_trusted, n_rows = trusted.count(), rows.count()
    trusted = trusted.where(part("trusted") < min(1.0, sample / max(n_trusted, 1)))
    # about `sample` ids by the filter above: the join side has a size that does not grow
    # and of the rows that share an id one, so that neither do the rows sent to the driver
    one = lambda df, mark: df.groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(mark).alias("positive"), "text")
    positive = one(rows.join(F.broadcast(trusted), "doc_id", "left_semi"), True)
    unlabelled = one(rows.where(part("unlabelled") < min(1.0, 2 * sample / max(n_rows, 1))), False)
    got = positive.union(unlabelled).mapInArrow(_as_rows, "positive boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    mark = got["positive"].to_numpy(zero_copy_only=False).astype(bool)
    # rows come in any order: sorted by content, reruns agree
    x, mark = x[(order := np.lexsort((x[:, 0], x[:, 2], x[:, -2], x[:, -8], mark)))], mark[order]
    return fit(x[mark], x[~mark])


def score(docs: DataFrame, model: LinearModel) -> DataFrame:
    """`docs` with score (0 to 1, higher is better) and predicted (1 from 0.5 on); clashing columns are replaced.

    Null and empty texts are scored like any other, on features of an empty text.
    """
    docs = docs.drop("score", "predicted")
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.text_slices(batch, at):
                s = shared.value.score(features(rows.column(at)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learnt from labels that are not held out."""
    out = F.coalesce(held_remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    model = learn(docs, labels, ~out)
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
