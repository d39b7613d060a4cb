"""Quality scores: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters, digits and non-ASCII bytes, or runs of other ASCII signs. Words and pairs of
neighbouring words are hashed into 2**BITS features; a feature's value is its share of the document's. The
model is fitted on at most EXAMPLES labelled documents, in order of their hashed ids; its weights go to all
executors, where a document's score is a sparse dot product, summed for many documents at once. Documents
without words have the score of the intercept; null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .shared import steps, utf8
from .words import BASES, Words, mix, own_words

#: Features, as a power of two; labelled documents used at most; passes over them.
BITS, EXAMPLES, PASSES = 18, 8000, 4
#: Of the updates: learning rate, its smoothing, and the two penalties; a feature's value is its share times SCALE.
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.02, 24.0

#: Classes of bytes: white space and controls, signs, then letters, digits and non-ASCII.
CLASSES = np.full(256, 2, np.int8)
CLASSES[:33] = 0
CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of documents that lie one after another, and where each document's begin."""
    w = Words(data, offsets, CLASSES)
    h = w.hashes()
    pairs = mix(h[:-1] * np.uint64(BASES[1]) + h[1:]) if len(h) else h
    inner = w.doc()[1:] == w.doc()[:-1] if len(h) else np.zeros(0, bool)
    at = np.concatenate([np.arange(len(h)), np.flatnonzero(inner) + 0.5])
    order = np.argsort(at, kind="stable")
    f = (np.concatenate([h, pairs[inner]]) >> np.uint64(64 - bits)).astype(np.int64)[order]
    per_doc = w.counts + np.maximum(w.counts - 1, 0)
    return f, np.concatenate([[0], np.cumsum(per_doc)])


def fit(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights and intercept."""
    n = 1 << BITS
    z, s, w = np.zeros(n), np.zeros(n), np.zeros(n)
    z0 = s0 = w0 = 0.0
    rows = []
    for x in texts:
        data = np.frombuffer(x.encode(), np.uint8)
        f, _ = features(data, np.array([0, len(data)]))
        at, times = np.unique(f, return_counts=True)
        rows.append((at, SCALE * times / max(1, len(f))))
    for _ in range(PASSES):
        for (at, x), y in zip(rows, labels, strict=True):
            w[at] = np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(s[at])) / ALPHA + L2))
            w0 = -z0 / ((BETA + np.sqrt(s0)) / ALPHA)
            g0 = 1 / (1 + np.exp(-np.clip(w0 + x @ w[at], -35, 35))) - y
            g = g0 * x
            z[at] += g - (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / ALPHA * w[at]
            s[at] += g * g
            z0 += g0 - (np.sqrt(s0 + g0 * g0) - np.sqrt(s0)) / ALPHA * w0
            s0 += g0 * g0
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2))
    return w.astype(np.float32), float(-z0 / ((BETA + np.sqrt(s0)) / ALPHA))


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, intercept: float) -> np.ndarray:
    f, firsts = features(data, offsets)
    sums = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
    n = np.diff(firsts)
    return intercept + SCALE * (sums[firsts[1:]] - sums[firsts[:-1]]) / np.maximum(n, 1)


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, threshold: float = 0.3, most: int = EXAMPLES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    rows = sample(docs, labels, "quality", modulus, remainder, most, text, key).orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()  # bounded by `most`
    weights, intercept = fit([r["text"] for r in rows], [r["label"] for r in rows])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words()
        for b in batches:
            data, offsets = utf8(b.column(2))
            out = [margins(data, offsets[i : j + 1], weights, intercept) for i, j in steps(offsets)]
            m = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(m, -700, 700))))], ["doc_id", "held_out", "score"])

    kept = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key, modulus, remainder).alias("held_out"), F.col(text).alias("text"))
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, by labels outside the held-out fifth."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
