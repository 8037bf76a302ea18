"""A quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

Words are runs of ASCII letters, digits and characters beyond ASCII, or runs of other
visible characters, lower-cased. Single words and pairs of neighbours are hashed to 2^18
features; a feature's value is log(1 + count), and a document's features have length 1.
The model is fitted to a bounded sample of labelled rows (TRAIN_DOCS, chosen by a hash of
the id, never from the held-out rows), in several passes of per-coordinate FTRL-proximal
updates. Scoring is a sparse dot product with the broadcast weights (1 MB, whatever the
corpus). Only the text enters a score. Null and empty texts have the bias feature only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIXED, U, crc_bucket, pair_hash, read, word_chunks

BITS, TRAIN_DOCS, PASSES, THRESHOLD = 18, 4000, 6, 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.005, 0.01
HELD_OUT, FOLDS = 2, 4


def features(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of a run of texts, by row; the bias is not among them."""
    h, n = words.hash, len(words.count)
    row = np.repeat(np.arange(n), words.count)
    key = [(row << BITS) | (h >> U(64 - BITS)).astype(np.int64)]
    if len(h) > 1:
        near = row[1:] == row[:-1]
        key.append(((row[1:] << BITS) | (pair_hash(h[:-1], h[1:]) >> U(64 - BITS)).astype(np.int64))[near])
    key, count = np.unique(np.concatenate(key), return_counts=True)
    row, value = key >> BITS, np.log1p(count)
    length = np.sqrt(np.bincount(row, value * value, n))
    return row, key & ((1 << BITS) - 1), value / np.maximum(length[row], 1e-12)


def _vectors(batches):
    for b in batches:
        for w in word_chunks(b.column(1), MIXED):
            row, feature, value = features(w)
            edges = np.searchsorted(row, np.arange(len(w.count) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(w.lo, w.hi - w.lo), pa.ListArray.from_arrays(edges, feature.astype(np.int32)), pa.ListArray.from_arrays(edges, value.astype(np.float32))], names=["label", "feature", "value"]
            )


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights, the bias last, from (label, features, values), in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for label, feature, value in rows:
            i, x = np.append(feature, 1 << BITS), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights fitted to at most about TRAIN_DOCS labelled documents that are not held out. Rows without id, label or document are left out."""
    known = labels.where("doc_id is not null and quality is not null").where(crc_bucket("doc_id", FOLDS) != HELD_OUT).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    every = max(1, known.count() // TRAIN_DOCS)
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id"), "label").limit(2 * TRAIN_DOCS)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("id")).select("label", docs["text"])
    got = rows.select("label", "text").mapInArrow(_vectors, "label int, feature array<int>, value array<float>").toArrow().combine_chunks()
    if not got.num_rows:
        return ftrl([])
    label, feature, value = (got[c].chunk(0) for c in ("label", "feature", "value"))
    edges = np.cumsum([0, *np.asarray(feature.value_lengths())])
    flat, values = np.asarray(feature.flatten()).astype(np.int64), np.asarray(value.flatten()).astype(np.float64)
    data = [(y, flat[s:e], values[s:e]) for y, s, e in zip(label.to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    data.sort(key=lambda x: (x[1].tobytes(), x[0]))
    order = np.random.RandomState(1).permutation(len(data))
    return ftrl([data[i] for i in order])


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            for words in word_chunks(b.column(1), MIXED):
                row, feature, value = features(words)
                dot = np.bincount(row, w[feature] * value, len(words.count)) + float(w[-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(words.lo, words.hi - words.lo), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = scores(docs, train(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
