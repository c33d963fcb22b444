"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Each text is a sparse row: its words' relative frequencies (hashed), nine statistics of its structure, and one-hot hashed
language and source. The machine adds low-rank interactions of every pair of features to a linear score; the sum over pairs
is taken in linear time, as half the difference of the squared sum and the sum of squares in each of RANK dimensions. It
is fitted by full-batch Adam, in one task, on at most TRAIN_ROWS labelled documents and over the features that occur in them
(others have no weight); every document is scored over its whole text.

Null texts count as empty, whose statistics are 0; a null language or source is a value of its own. Where the labels lack a
class, no model can be fitted: the probability is the share of good labels (1.0 if there are none). Rows are scored one by
one, so repeated rows get equal scores and null ids do no harm; only doc_id, text, lang and source are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cartoloom.llm import _text as T
from cartoloom.llm._features import Sparse, adam, compact, counted, fitted, sample, sigmoid, stack
from cartoloom.llm._spark import table

TRAIN_ROWS = 2000
GOOD = 0.5
RANK = 8
WORDS, STATS, META = 1 << 15, 9, 64
SIZE = WORDS + STATS + 2 * META
SCALE = 10.0
_B = np.arange(256)
_CLASSES = np.stack([(_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57), T.IS_SPACE, _B == 10, ~T.IS_WORD & ~T.IS_SPACE, _B == 124]).astype(np.uint8)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def structure(w: T.Words) -> np.ndarray:
    """Log length; shares of capitals, digits, space, lines, symbols and bars; repeated neighbours; mean word length."""
    sizes, n_words = np.diff(w.byte_offsets), np.diff(w.offsets)
    columns = [np.log1p(sizes) / 10]
    for flags in _CLASSES:
        columns.append(_ratio(T.segment_sum(flags[w.data], w.byte_offsets), sizes))
    again = np.zeros(len(w.hash))
    if len(again) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    columns.append(_ratio(T.segment_sum(again, w.offsets), n_words))
    columns.append(_ratio(T.segment_sum((w.end - w.start).astype(float), w.offsets), n_words) / 10)
    return np.stack(columns, 1)


def _hashed(values: pa.Array) -> np.ndarray:
    """A bucket for each value; null has bucket 0."""
    coded = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).cast(pa.string()).dictionary_encode()
    data, offsets = T.raw(coded.dictionary)
    h = (T.span_hashes(data, offsets[:-1], offsets[1:]) % T.U(META - 1)).astype(np.int64) + 1
    at = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    return np.where(at < 0, 0, h[at]) if len(h) else np.zeros(len(at), np.int64)


def features(texts: pa.Array, lang: pa.Array, source: pa.Array) -> Sparse:
    n, w = len(texts), T.words(texts)
    bag = counted(w.row, (w.hash & T.U(WORDS - 1)).astype(np.int64), n, WORDS)
    bag.value = SCALE * bag.value / np.maximum(np.diff(w.offsets), 1)[bag.row]
    stats = structure(w)
    rows = np.arange(n)
    index = np.concatenate([bag.index, np.tile(np.arange(STATS) + WORDS, n), _hashed(lang) + WORDS + STATS, _hashed(source) + WORDS + STATS + META])
    value = np.concatenate([bag.value, stats.ravel(), np.ones(2 * n)])
    row = np.concatenate([bag.row, np.repeat(rows, STATS), rows, rows])
    order = np.argsort(row, kind="stable")
    return Sparse(index[order], value[order], np.searchsorted(row[order], np.arange(n + 1)))


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, x: Sparse) -> Sparse:
        """The row with its statistics standardised as in the fit, and clipped."""
        stat = (x.index >= WORDS) & (x.index < WORDS + STATS)
        at = x.index[stat] - WORDS
        value = x.value.copy()
        value[stat] = np.clip((value[stat] - self.mean[at]) / self.spread[at], -5, 5)
        return Sparse(x.index, value, x.offsets)

    def logit(self, x: Sparse) -> np.ndarray:
        """bias + sum w_j x_j + sum over j < k of <v_j, v_k> x_j x_k, in time linear in the row."""
        x = self.scaled(x)
        v = self.factors[x.index] * x.value[:, None]
        pairs = T.segment_sum(v, x.offsets) ** 2 - T.segment_sum(v * v, x.offsets)
        return self.bias + x.dot(self.linear) + 0.5 * pairs.sum(1)


def fit(x: Sparse, y: np.ndarray, steps: int = 100, seed: int = 3) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return Model(40.0 if len(y) == 0 or y[0] else -40.0, np.zeros(SIZE), np.zeros((SIZE, RANK)), np.zeros(STATS), np.ones(STATS))
    stats = x.value[(x.index >= WORDS) & (x.index < WORDS + STATS)].reshape(-1, STATS)
    mean, spread = stats.mean(0), stats.std(0) + 1e-6
    ids, x = compact(Model(0.0, np.zeros(0), np.zeros(0), mean, spread).scaled(x))
    # dimension by dimension: its values lie in a row. Every text has its statistics, so none is empty
    value, row, begin = x.value.astype(np.float32), x.row, x.offsets[:-1]

    def grad(w: list[np.ndarray]) -> list[np.ndarray]:
        bias, linear, factors = w
        parts, sums, z = [], [], bias[0] + x.dot(linear)
        for f in factors.astype(np.float32):
            parts.append(f[x.index] * value)
            sums.append(np.add.reduceat(parts[-1], begin))
            z += 0.5 * (sums[-1] ** 2 - np.add.reduceat(parts[-1] ** 2, begin))
        g = (sigmoid(z) - y) / len(y)
        each = g.astype(np.float32)[row] * value
        own = [np.bincount(x.index, each * (s[row] - v), len(ids)) for s, v in zip(sums, parts)]
        return [np.array([g.sum()]), x.back(g, len(ids)) + 1e-6 * linear, np.stack(own) + 1e-6 * factors]

    start = np.ascontiguousarray(np.random.default_rng(seed).normal(0, 0.01, (SIZE, RANK))[ids].T)
    bias, own_linear, own_factors = adam(grad, [np.zeros(1), np.zeros(len(ids)), start], steps, 0.03)
    linear, factors = np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32)
    linear[ids], factors[ids] = own_linear, own_factors.T
    return Model(float(bias[0]), linear, factors, mean, spread)


def fit_rows(rows: pa.Table) -> Model:
    """rows: text, lang, source and label."""
    parts = [features(p.column("text"), p.column("lang"), p.column("source")) for b in rows.combine_chunks().to_batches() for p in T.pieces(b)]
    return fit(stack(parts), rows.column("label").to_numpy().astype(np.float64))


def train(spark: SparkSession, sf_dir: str, rows: int = TRAIN_ROWS) -> Model:
    return fitted(sample(spark, sf_dir, "quality", rows, columns=("lang", "source")), fit_rows)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality, good), one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1.2 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                p = sigmoid(shared.value.logit(features(*piece.columns[1:])))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p), pa.array(p >= GOOD)], ["doc_id", "quality", "good"])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality double, good boolean")


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), train(spark, sf_dir))
