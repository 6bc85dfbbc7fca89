"""Quality classifier: supervised subword embeddings.

Every word, its character 3- and 4-grams and each pair of neighbouring words is
hashed to one of ``buckets`` learned vectors; a document is their average, and
a softmax layer on it gives the probability of each class.  A word that repeats
the one before it is a pair of its own kind, whatever the word.  Vectors and
layer are trained together by stochastic gradient descent in numpy.

Training reads at most ``most_rows`` labelled documents, those of least hash
(a documented bound; whole texts).  Their features are counted in the tasks, at
most ``buckets`` numbers a document, and one task trains.  A score then is a
sum over one number a bucket, which is all that reaches the driver.

Scores read ``text`` alone, whole, whatever its length.  Null and empty texts score the trained prior (an
average of nothing).  Null labels are not used; of several labels of a document
the least holds.  Repeated rows score alike.  With no labels, or of one class
only, every score is the share of good labels, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import Powers, code_points, mix64, span_hashes, word_spans

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(text: str | None, buckets: int, powers: Powers) -> np.ndarray:
    """Bucket of every word, character n-gram and word pair of the whole text."""
    if not text:
        return np.zeros(0, np.int64)
    cp = code_points(text)
    start, end = word_spans(cp)
    if not len(start):
        return np.zeros(0, np.int64)
    words = span_hashes(cp, start, end, powers)
    pairs = np.where(words[1:] == words[:-1], _C[3], mix64(words[1:] * _C[1] + words[:-1]))
    # n-grams run over each word with a mark before and after it
    ink = np.zeros(len(cp) + 2, np.uint64)
    ink[1:-1] = cp
    blank = np.ones(len(cp) + 2, bool)
    blank[1:-1] = (cp == 32) | ((cp >= 9) & (cp <= 13))
    ink[blank] = 1
    out = [words, pairs]
    for n in (3, 4):
        k = len(ink) - n + 1
        if k < 1:
            continue
        h = np.zeros(k, np.uint64)
        inside = np.ones(k, bool)
        for j in range(n):
            h += ink[j : j + k] * _C[j]
            if 0 < j < n - 1:
                inside &= ~blank[j : j + k]
        out.append(mix64(h[inside] + np.uint64(n)))
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Classifier:
    """What scoring needs: one number a bucket and a bias."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None, powers: Powers) -> float:
        f = features(text, len(self.weight), powers)
        z = self.bias + (float(self.weight[f].mean()) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = 1 << 15, dim: int = 8, most_rows: int = 3000, epochs: int = 12, rate: float = 0.4, seed: int = 11) -> Classifier:
    """Fit on ``labels(doc_id, <label>)`` and the texts of ``docs``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_rows).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for part in parts:
            got = [np.unique(features(t, buckets, powers), return_counts=True) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["_y"], "f": [g[0].astype(np.int32) for g in got], "n": [g[1].astype(np.float32) for g in got]})

    counted = rows.select("doc_id", "text", "_y").mapInPandas(run, "doc_id long, y int, f array<int>, n array<float>")

    def fitted(got: pd.DataFrame) -> pd.DataFrame:
        weight, bias = fit(got, buckets, dim, epochs, rate, seed)
        return pd.DataFrame({"weight": [weight], "bias": [bias]})

    # at most most_rows documents, of at most ``buckets`` features each, meet in the one task that trains
    out = counted.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fitted, "weight array<float>, bias double").first()
    return Classifier(np.zeros(buckets, np.float32), 0.0) if out is None else Classifier(np.array(out.weight, np.float32), out.bias)


def fit(got: pd.DataFrame, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Weight of each bucket and bias, by stochastic gradient descent over documents (y, f, n)."""
    got = got.sort_values(["doc_id", "y"], kind="stable", ignore_index=True)
    y = got["y"].to_numpy(np.float64)
    share = y.mean()
    if not 0 < share < 1:
        return np.zeros(buckets, np.float32), float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -6, 6))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    fs = [np.asarray(f) for f in got["f"]]
    ws = [np.asarray(n, np.float64) / max(1.0, float(np.sum(n))) for n in got["n"]]
    total, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            lr = rate * (1 - step / total)
            step += 1
            f, w = fs[i], ws[i]
            mean = w @ vectors[f]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1  # the gradient of the loss by z
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            vectors[f] -= (lr * min(len(f), 200)) * w[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; one of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = Powers()
        for part in parts:
            yield pd.Series([shared.value.score(t, powers) for t in part], dtype="float64")

    from pyspark.sql.functions import pandas_udf

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.drop("score").withColumn("score", pandas_udf(run, "double")("text"))


def held_out(doc_id: str = "doc_id"):
    """True for rows whose labels are kept for testing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
