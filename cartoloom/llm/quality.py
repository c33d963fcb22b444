"""Quality rules: hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

Features are the relative frequencies of hashed words, word pairs and four-byte sequences of the whole text. The model is
fitted in one task on at most TRAIN_ROWS labelled documents (chosen by hash of doc_id), over the features that occur in
them; a fifth of them is held out to calibrate the probability by Platt's sigmoid. Where that fifth has fewer than two rows
of a class (so with fewer than about ten labels of one), nothing is held out, and the calibration uses the fitted rows. A text is kept if its probability of being good is at least KEEP, and is for review if it is
below REVIEW. Scores come from Arrow batches; all documents are scored, over their whole text.

A null text counts as empty. An empty text has no features: its probability is the calibrated one of the bias alone. Where
the labels lack a class (or are empty), no model can be fitted: every probability is the share of good labels (1.0 if
there are none), and everything at or above KEEP stays. Null ids, repeated rows and further columns change nothing: every
row is scored on its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cartoloom.llm import _text as T
from cartoloom.llm._features import Sparse, adam, compact, counted, fitted, sample, sigmoid, stack
from cartoloom.llm._spark import mapped, table

TRAIN_ROWS = 2000
KEEP, REVIEW = 0.5, 0.8
BITS = 16
SIZE = 1 << BITS
SCALE = 30.0


def _grams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, index) of the words, word pairs and byte sequences; each kind has its own part of the table."""
    w = T.words(texts)
    mask = T.U(SIZE - 1)
    single = (w.row, (w.hash & mask).astype(np.int64))
    same = w.row[1:] == w.row[:-1]
    pairs = T.mix(w.hash[:-1] * T.U(3) + w.hash[1:])
    pairs[w.hash[:-1] == w.hash[1:]] = T.U(0)  # a word twice is one feature, whatever the word
    pair = (w.row[1:][same], (pairs[same] & mask).astype(np.int64) + SIZE)
    d, n = w.data.astype(np.uint32), max(0, len(w.data) - 3)
    code = d[:n] | d[1 : n + 1] << 8 | d[2 : n + 2] << 16 | d[3 : n + 3] << 24
    inside = np.ones(len(d), bool)
    for k in (1, 2, 3):
        tails = w.byte_offsets[1:] - k
        inside[tails[tails >= 0]] = False
    inside = inside[:n]
    row = np.repeat(np.arange(len(w.byte_offsets) - 1), np.diff(w.byte_offsets))[:n]
    index = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) + 2 * SIZE
    return [single, pair, (row[inside], index[inside])]


def features(texts: pa.Array) -> Sparse:
    """SCALE times the relative frequency within each kind of n-gram."""
    kinds = [counted(row, index, len(texts), 3 * SIZE) for row, index in _grams(texts)]
    row = np.concatenate([k.row for k in kinds])
    value = np.concatenate([k.value * SCALE / np.maximum(np.add.reduceat(np.r_[k.value, 0], np.minimum(k.offsets[:-1], len(k.value)))[k.row], 1) if len(k.value) else k.value for k in kinds])
    index = np.concatenate([k.index for k in kinds])
    order = np.argsort(row, kind="stable")
    return Sparse(index[order], value[order], np.searchsorted(row[order], np.arange(len(texts) + 1)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for row, index in _grams(texts):
            n = np.bincount(row, minlength=len(texts))
            out += SCALE * np.bincount(row, self.weights[index], len(texts)) / np.maximum(n, 1)
        return out

    def probability(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.logit(texts) + self.shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid, by Newton steps with Platt's softened targets and a little damping."""
    good, bad = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ theta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -1, 1)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def fit(texts: pa.Array, y: np.ndarray, steps: int = 120) -> Model:
    """y: 1 good, 0 bad. Classes count equally in the fit; the calibration brings their shares back."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(3 * SIZE), 40.0 if len(y) == 0 or y[0] else -40.0)
    batch = pa.RecordBatch.from_arrays([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], ["text"])
    ids, x = compact(stack([features(p.column(0)) for p in T.pieces(batch)]))
    held = np.arange(len(y)) % 5 == 4
    if min(y[held].sum(), (1 - y[held]).sum()) < 2:
        held[:] = False
    share = np.where(y > 0, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y)[~held].sum())) * ~held

    def grad(w: list[np.ndarray]) -> list[np.ndarray]:
        g = (sigmoid(x.dot(w[0]) + w[1][0]) - y) * share
        return [x.back(g, len(ids)) + 1e-6 * w[0], np.array([g.sum()])]

    own, bias = adam(grad, [np.zeros(len(ids)), np.zeros(1)], steps, 0.02)
    z = x.dot(own) + bias[0]
    weights = np.zeros(3 * SIZE)
    weights[ids] = own
    used = held if held.any() else np.ones(len(y), bool)
    return Model(weights.astype(np.float32), float(bias[0]), *platt(z[used], y[used]))


def train(spark: SparkSession, sf_dir: str, rows: int = TRAIN_ROWS) -> Model:
    return fitted(sample(spark, sf_dir, "quality", rows), lambda t: fit(t.column("text"), t.column("label").to_numpy().astype(np.float64)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality, keep, review), one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.8 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                p = shared.value.probability(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p), pa.array(p >= KEEP), pa.array((p >= KEEP) & (p < REVIEW))], ["doc_id", "quality", "keep", "review"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality double, keep boolean, review boolean")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are kept, with all their columns: the model runs inside the scan, nothing is shuffled."""
    shared = spark.sparkContext.broadcast(train(spark, sf_dir))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, text):
                yield piece.filter(pa.array(shared.value.probability(piece.column(text)) >= KEEP))

    return mapped(docs, run)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), train(spark, sf_dir))
