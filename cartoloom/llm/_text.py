"""Words of Arrow text columns as 64-bit hashes, straight from the UTF-8 buffers.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters; letters of ASCII and
Latin-1 are lower-cased. No Python object is made per word: the hash of a word is the difference of two prefix
sums of byte values times powers of an odd base modulo 2^64, divided by the power at the word's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_B = np.arange(256)
IS_WORD = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B == 95) | (_B >= 128)
IS_SPACE = np.isin(_B, [9, 10, 11, 12, 13, 32])
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
BYTE_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=U) | U(1)
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n + 1 of each."""
    if not _tables or len(_tables[0]) <= n:
        size = max(n + 1, 1 << 20)
        _tables[:] = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            t = np.full(size, base, dtype=U)
            t[0] = 1
            _tables.append(np.cumprod(t, dtype=U))
    return _tables[0], _tables[1]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the rows in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str | int = "text", limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most limit bytes of text, but at least one row: they bound the working memory."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    out = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(lead):
        b = data[lead]
        up = lead[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        out[up] += 0x20
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true, broken at row borders."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < n]
    first[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@dataclass
class Words:
    """Words in text order: hash, byte range and row; offsets[r] to offsets[r + 1] are row r's words."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    byte_offsets: np.ndarray


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(low))
    sums = np.zeros(len(low) + 1, U)
    np.cumsum(BYTE_VALUE[low] * up[: len(low)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def words(texts: pa.Array) -> Words:
    data, offsets = raw(texts)
    start, end = runs(IS_WORD[data], offsets)
    per_row = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(per_row))
    return Words(span_hashes(lowered(data), start, end), start, end, row, per_row, data, offsets)


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    return int(words(pa.array([word])).hash[0])


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the rows given by offsets, which cover all values; 0 for empty rows."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, offsets[:-1][some], axis=0, dtype=np.float64)
    return out


def char_offsets(data: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """Character positions of byte positions at, counted from byte base."""
    if len(at) == 0:
        return np.zeros(0, np.int64)
    lead = np.zeros(int(at.max()) - base + 1, np.int64)
    np.cumsum((data[base : int(at.max())] & 0xC0) != 0x80, out=lead[1:])
    return lead[at - base]
