"""Exact byte-level BPE of Arrow text columns at vector speed.

The pre-tokens of a batch are found by array operations on code points; each distinct pre-token is encoded once by
tiktoken and kept by its hash, so an occurrence costs a look-up in a hash table. The result is the same as encode_ordinary's.
The folder of the vocabulary (TOKENIZERS unless told otherwise) must be on every executor.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa

from cartoloom.llm import _text as T

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Pre-tokens that a worker remembers; when there are more it forgets all and starts again.
REMEMBERED = 1_000_000


def _class(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)[0]
    if kind == "L":
        return LETTER
    if kind == "N":
        return NUMBER
    return SPACE if c.isspace() and not 0x1C <= code <= 0x1F else OTHER


@functools.cache
def _classes() -> np.ndarray:
    return np.fromiter(map(_class, range(0x10000)), np.uint8, 0x10000)


@functools.cache
def _mixed() -> np.ndarray:
    return T.mix(np.arange(0x10000, dtype=T.U) + T.U(1))


def _scrambled(code: np.ndarray) -> np.ndarray:
    """T.mix of each code point and one, from a table for all but the rare high ones."""
    out = _mixed()[np.minimum(code, 0xFFFF)]
    high = np.flatnonzero(code > 0xFFFF)
    out[high] = T.mix(code[high].astype(T.U) + T.U(1))
    return out


def pre_tokens(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the code points; offsets are the borders of the rows."""
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[np.minimum(code, 0xFFFF)]
    for high in np.unique(code[code > 0xFFFF]):
        kind[code == high] = _class(int(high))
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    inner = ~border[1:n]  # whether i + 1 is in the row of i
    start[:-1] |= space[:-1] & ~space[1:] & inner
    start[1:] &= ~((code[:-1] == 32) & ~space[1:] & inner)
    quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & inner)
    for q in quote.tolist():  # contractions; an apostrophe between a letter and a letter is rare
        rest = code[q + 1 : q + 3]
        two = len(rest) == 2 and not border[q + 2] and (int(rest[0]), int(rest[1])) in ((114, 101), (118, 101), (108, 108))
        length = 2 if two else 1 if rest[0] in (115, 116, 109, 100) else 0
        if length:
            start[q + 1] = False
            after = q + 1 + length
            if after < n and not border[after]:
                start[after] |= kind[after] == LETTER
    return np.flatnonzero(start)


class Bpe:
    """A vocabulary with its memory of encoded pre-tokens. One for each worker: see tokenizer()."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        # hashes of the known pre-tokens in order, and their places among them as they were learnt
        self.known, self.place = np.zeros(0, T.U), np.zeros(0, np.int64)
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, pre_tokens: list[str]) -> None:
        found = [self.encoding.encode_ordinary(t) for t in pre_tokens]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.flat = np.concatenate([self.flat, np.fromiter((x for one in found for x in one), np.int32, int(sizes.sum()))])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of the known pre-tokens each one is; the borders of the rows in them."""
        data, offsets = T.raw(texts)
        text = data.tobytes().decode("utf-8")
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        rows = offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)
        start = pre_tokens(code, rows)
        end = np.r_[start[1:], len(code)] if len(start) else start
        up, down = T.powers(len(code))
        sums = np.zeros(len(code) + 1, T.U)
        np.cumsum(_scrambled(code) * up[: len(code)], out=sums[1:])
        hashes = T.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(T.U))
        back, distinct = pd.factorize(hashes)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        order = np.argsort(distinct)  # neighbours are looked up one after another
        asked = distinct[order]
        slot = np.searchsorted(self.known, asked)
        at = np.empty(len(distinct), np.int64)
        there = np.append(self.known, T.U(0))[slot] == asked if len(self.known) else np.zeros(len(asked), bool)
        there &= slot < len(self.known)
        at[order[there]] = self.place[slot[there]]
        new = order[~there]
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[back[::-1]] = np.arange(len(back))[::-1]
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.place = np.insert(self.place, slot[~there], at[new])
            self.known = np.insert(self.known, slot[~there], distinct[new])
            self._learn([text[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        return at[back], np.searchsorted(start, rows)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens in each text; null has none."""
        at, rows = self._pieces(texts)
        return np.diff(np.r_[0, np.cumsum(np.diff(self.begin)[at])][rows])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the borders of the texts in them."""
        at, rows = self._pieces(texts)
        each = np.diff(self.begin)[at]
        ends = np.cumsum(each)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[at] - ends + each, each)
        return self.flat[take], np.r_[0, ends][rows]


@functools.cache
def tokenizer(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Bpe:
    return Bpe(f"{folder}/{name}")
