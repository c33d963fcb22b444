"""Hashed features of texts as sparse rows, and the bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.llm import _text as T
from cartoloom.llm._spark import spared, table


def _times(v: np.ndarray, value: np.ndarray) -> np.ndarray:
    """v * value, in the place of v where the type is the same."""
    return np.multiply(v, value, out=v if v.dtype == value.dtype else None)


@dataclass
class Sparse:
    """Rows of (index, value) pairs; offsets are the borders of the rows."""

    index: np.ndarray
    value: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.offsets))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        v = weights[self.index]
        return T.segment_sum(_times(v, self.value if v.ndim == 1 else self.value[:, None]), self.offsets)

    def back(self, grad: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, _times(np.repeat(grad, np.diff(self.offsets)), self.value), size)


def stack(parts: list[Sparse]) -> Sparse:
    """The rows of all parts. Empties the list, so that they are not in memory twice."""
    bases = np.cumsum([0, *(len(p.index) for p in parts)])
    offsets = np.concatenate([np.zeros(1, np.int64), *(p.offsets[1:] + b for p, b in zip(parts, bases))])
    index, value = np.empty(bases[-1], np.int64), np.empty(bases[-1])
    for base in bases[-2::-1]:
        p = parts.pop()
        index[base : base + len(p.index)], value[base : base + len(p.index)] = p.index, p.value
    return Sparse(index, value, offsets)


def counted(row: np.ndarray, index: np.ndarray, rows: int, size: int) -> Sparse:
    """Occurrences as rows of distinct indexes with their counts."""
    key, n = np.unique(row * size + index, return_counts=True)
    return Sparse(key % size, n.astype(np.float64), np.searchsorted(key, np.arange(rows + 1) * size))


def sample(spark: SparkSession, sf_dir: str, label: str, most: int, seed: int = 7, columns: tuple[str, ...] = ()) -> DataFrame:
    """At most `most` documents with a label, chosen by a seeded hash of doc_id: doc_id, label, text and columns.

    A doc_id with several labels has the largest, one with several rows the row with the largest text (then the largest
    columns); null labels and ids don't count. This is the one place where a bound holds: only models are fitted on these rows.
    """
    chosen = table(spark, sf_dir, "labels").where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *columns)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max(F.struct("text", *columns)).alias("row"))
    return rows.select("doc_id", "label", "row.*")


def fitted(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What fit gives for the rows in order of doc_id; it runs in one task, so that the driver needs no room for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(parts)))], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(spared(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(rows.limit(0).toArrow())


def compact(x: Sparse) -> tuple[np.ndarray, Sparse]:
    """The indexes that occur, and the rows with indexes among them."""
    there = np.zeros(int(x.index.max(initial=-1)) + 1, bool)  # indexes are below the size of a hash table; a sort takes far more
    there[x.index] = True
    ids = np.flatnonzero(there)
    place = np.zeros(len(there), np.int64)
    place[ids] = np.arange(len(ids))
    return ids, Sparse(place[x.index], x.value, x.offsets)


def adam(grad, weights: list[np.ndarray], steps: int, rate: float) -> list[np.ndarray]:
    """Minimise by full-batch Adam; grad(weights) gives the gradients."""
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        for i, g in enumerate(grad(weights)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
