"""PII by a linear-chain conditional random field over word-shape features.

The field is fitted on a small labelled table (labelled_rows: a few hundred sentences made from a seed, with e-mail
addresses, telephone numbers, card and account numbers, network addresses and secrets among plain words, years, prices,
versions and dates). Tokens are separated by white space. The features of a token are shape features of itself and of its
two neighbours, so nothing is learnt by heart but a few cue words.

Decoding is exact Viterbi in numpy batches. A token is plain if neither it nor a neighbour has a digit or one of the signs
@ = " '; all plain tokens have the same features, and where the field prefers "outside" for them by more than any change
of the two transitions at a token can win back, every best path labels them so. Only the runs between them need the
recursion; where that bound doesn't hold for a fitted field, whole texts are decoded. Runs are decoded in blocks of BLOCK
tokens, CELLS tokens at a time: what a block does to the best scores is a matrix, so the scores at the borders of a long run's
blocks follow from one matrix each, and memory beyond six bytes a token doesn't grow with a run.

A token's shape, runs and digits are classes: all shapes that begin with the same 24 signs are one class, and all tokens of 20
digits or more are one. Spans, redaction and the other features go by whole tokens.

Null and empty texts have no spans; redaction leaves null null. Spans are character offsets of the text, trimmed of
punctuation, in text order, and neighbours with one label are one span. Every row is decoded on its own: null ids, repeated
rows and columns of any name pass through. Redaction replaces each span by its label in brackets and renews n_chars where
the text changed (if the column is there); a null n_chars stays null.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cartoloom.llm import _text as T
from cartoloom.llm import crf
from cartoloom.llm._spark import mapped, table

LABELS = ("O", "EMAIL", "PHONE", "NUMBER", "IP", "SECRET")
BITS = 12
SIZE = 1 << BITS
_B = np.arange(256)
_SIGNAL = ((_B >= 48) & (_B <= 57)) | np.isin(_B, [ord(c) for c in "@=\"'"])
_CUES = {"token", "key", "secret", "password", "pwd", "apikey", "api_key", "=", ":", "tel", "phone", "call", "email", "mail", "card", "iban", "account", "ip", "version", "v", "page", "chapter", "in", "since", "year"}
_TRIM = " \t\n\r.,;:!?#$%&*|\"'<>[]{}="


def _bucket(feature: str) -> int:
    h = 2166136261
    for b in feature.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % SIZE


def shape(token: str) -> str:
    """Letters as a (runs once), digits as 9 (each), other signs as they are (runs once), at most 24 signs."""
    s = re.sub(r"\d", "9", re.sub(r"[^\W\d_]+", "a", token))
    return re.sub(r"([^9])\1+", r"\1", s)[:24]


#: Longer tokens aren't remembered, which bounds the memory by bytes.
REMEMBERED = 64


def _own(token: str) -> tuple[str, ...]:
    core = token.strip(_TRIM)
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    out = [f"shape={shape(core)}", f"runs={re.sub('9+', '9', shape(core))}", f"digits={min(digits, 20)}", f"cue={core.lower() if core.lower() in _CUES else token if token in _CUES else ''}"]
    if "@" in core:
        out.append("at+dot" if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s.]+", core) else "at")
    if digits >= 4 and letters >= 2 and len(core) >= 16:
        out.append("dense")
        if re.fullmatch(r"[0-9a-fA-F]+|[\w\-+/]{20,}", core):
            out.append("hex")
    if digits and not letters:
        out.append(f"numeric{min(digits // 4, 5)}")
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", core):
        out.append("quad")
    if core != token and any(c in "\"'" for c in token):
        out.append("quoted")
    return tuple(out)


def _hashed(token: str) -> tuple[tuple[int, ...], ...]:
    """The hashed features of a token as itself, and as a neighbour before and after."""
    own = _own(token)
    return tuple(tuple(_bucket(place + f) for f in (own[1:4] if place else own)) for place in ("", "-", "+"))


_remembered = functools.lru_cache(100_000)(_hashed)


def _ids(token: str) -> tuple[tuple[int, ...], ...]:
    return _remembered(token) if len(token) <= REMEMBERED else _hashed(token)


PLAIN = "a"
WIDTH = 14
BLOCK, CELLS = 256, 50_000


def feature_rows(tokens: list[str], before: str = PLAIN, after: str = PLAIN) -> list[list[int]]:
    """Feature ids of each token of a block; at the ends of a run are plain tokens."""
    found = [_ids(t) for t in (before, *tokens, after)]
    return [[*own[0], *left[1], *right[2]] for left, own, right in zip(found, found[1:], found[2:])]


def plain(token: str) -> str:
    """What a token counts as for the features: tokens without a signal, but for the cue words, are all alike."""
    if any(c.isdigit() or c in "@=\"'" for c in token):
        return token
    core = token.strip(_TRIM).lower()
    return core if core in _CUES else token if token in _CUES else PLAIN


def labelled_rows(seed: int = 11, rows: int = 600) -> list[list[tuple[str, int]]]:
    """The labelled table: sentences of (token, label)."""
    r = np.random.default_rng(seed)

    def pick(*options):
        return options[int(r.integers(len(options)))]

    def num(n: int) -> str:
        return "".join(str(int(d)) for d in r.integers(0, 10, n))

    def word(least: int = 1) -> str:
        return "".join(pick("an", "er", "tion", "ma", "ve", "lo", "ch", "ó", "keit", "st", "eau", "í") for _ in range(int(r.integers(least, 4))))

    def junk(token: str) -> str:
        token = token.upper() if r.random() < 0.05 else token
        return token + (pick("!!", "###", "$$$", "%%%", "&&&", "***", ",", ".", ";", "") if r.random() < 0.2 else "")

    def hexed(n: int) -> str:
        return "".join(pick(*"0123456789abcdef") for _ in range(n))

    def entity() -> list[tuple[str, int]]:
        kind = int(r.integers(1, 6))
        if kind == 1:
            user = pick(f"{word()}.{num(2)}", word(), f"{word()}_{num(3)}", f"{word()}.{word()}", f"{word()}+{word()}", num(3))
            return [(f"{user}@{pick('mail' + num(1), word(), word() + '-' + word())}.{pick('example.com', 'org', 'co.uk', 'example.net', 'de')}", 1)]
        if kind == 2:
            parts = pick(f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"+{num(2)}-{num(3)}-{num(7)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}")
            return [(p, 2) for p in parts.split()]
        if kind == 3:
            parts = pick(num(16), num(16), num(15), " ".join(num(4) for _ in range(4)), "-".join(num(4) for _ in range(4)), f"{num(3)}-{num(2)}-{num(4)}", f"DE{num(20)}", num(12))
            return [(p, 3) for p in parts.split()]
        if kind == 4:
            return [(".".join(str(int(x)) for x in r.integers(1, 256, 4)), 4)]
        value = pick(hexed(40), hexed(32), hexed(64), "AKIA" + hexed(16).upper(), "ghp_" + hexed(36), hexed(24))
        head = pick([("token", 0), ("=", 0)], [("key", 0), ("=", 0)], [("secret", 0), ("=", 0)], [("password", 0), (":", 0)], [])
        quote = pick('"', '"', "'", "")
        return [*head, (f"{quote}{value}{quote}", 5)]

    def other() -> list[tuple[str, int]]:
        return [(pick(num(1) + ".", f"{num(1)}.{num(1)}.", "19" + num(2), "20" + num(2), f"{num(2)},{num(3)}", f"${num(3)}.{num(2)}", f"{num(1)}.{num(2)}.{num(1)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}:{num(2)}", num(5), num(3) + "%", "x = " + num(1), f"\"{word()}\"", f"{word()}'s", f"{word()}{num(1)}", num(6)), 0)]

    table_ = []
    for _ in range(rows):
        row: list[tuple[str, int]] = []
        for _ in range(int(r.integers(1, 5))):
            row += [(word(), 0) for _ in range(int(r.integers(0, 5)))]
            row += entity() if r.random() < 0.6 else [(t, 0) for t, _ in other() for t in t.split()]
        row += [(word(), 0) for _ in range(int(r.integers(0, 4)))]
        table_.append([(junk(t), k) for t, k in row])
    return table_


@dataclass
class Field:
    model: crf.Crf
    skip: bool  # whether plain tokens among plain ones are outside on every best path


def padded(rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids [n, t, WIDTH] with -1 for none, and the mask."""
    length = max(map(len, rows))
    out = np.full((len(rows), length, WIDTH), -1, np.int32)
    mask = np.zeros((len(rows), length), bool)
    for i, row in enumerate(rows):
        mask[i, : len(row)] = True
        for t, ids in enumerate(row):
            out[i, t, : len(ids)] = ids[:WIDTH]
    return out, mask


def scores(model: crf.Crf, features: np.ndarray) -> np.ndarray:
    return np.vstack([model.emission, np.zeros((1, model.labels))])[np.where(features < 0, SIZE, features)].sum(2)


@functools.cache
def fitted(seed: int = 11, rows: int = 600) -> Field:
    sentences = labelled_rows(seed, rows)
    features, mask = padded([feature_rows([plain(t) for t, _ in s]) for s in sentences])
    gold = np.zeros(mask.shape, np.int64)
    for i, s in enumerate(sentences):
        gold[i, : len(s)] = [k for _, k in s]
    model = crf.fit(features, gold, mask, SIZE, len(LABELS), steps=60)
    e = scores(model, padded([feature_rows([PLAIN])])[0])[0, 0]
    t = np.vstack([model.step, model.first])
    win = (t.max(0) - t.min(0)).max() + (model.step.max(1) - model.step.min(1)).max() + np.ptp(model.step)
    return Field(model, bool(e[0] - e[1:].max() > win))


def decoded(data: np.ndarray, start: np.ndarray, end: np.ndarray, breaks: np.ndarray, sizes: np.ndarray, model: crf.Crf) -> np.ndarray:
    """The best labels of the tokens data[start:end]; breaks and sizes are the runs."""
    found, step = np.zeros(len(start), np.int8), model.step
    blocks = -(-sizes // BLOCK)
    head = np.cumsum(blocks) - blocks  # the first block of each run
    run = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(run)) - head[run]
    begin = breaks[run] + nth * BLOCK
    length = np.minimum(BLOCK, sizes[run] - nth * BLOCK)

    def token(i: int) -> str:
        return plain(data[start[i] : end[i]].tobytes().decode("utf-8", "replace"))

    def groups(of: np.ndarray):
        """(blocks, scores, mask) of blocks of like length, about CELLS tokens at once."""
        of = of[np.argsort(length[of], kind="stable")]
        ends = np.cumsum(length[of]) // CELLS
        for part in np.split(of, np.flatnonzero(np.diff(ends)) + 1) if len(of) else []:
            rows = []
            for b in part.tolist():
                lo, hi = int(begin[b]), int(begin[b] + length[b])
                left, right = breaks[run[b]] < lo, hi < breaks[run[b]] + sizes[run[b]]
                rows.append(feature_rows([token(i) for i in range(lo, hi)], token(lo - 1) if left else PLAIN, token(hi) if right else PLAIN))
            features, mask = padded(rows)
            yield part, scores(model, features), mask

    many = blocks[run] > 1
    for part, score, mask in groups(np.flatnonzero(~many)):
        for b, labels in zip(part.tolist(), crf.viterbi(score, mask, step, model.first)):
            found[begin[b] : begin[b] + length[b]] = labels[: length[b]]
    if not many.any():
        return found
    k = model.labels
    matrix, enter = np.zeros((len(run), k, k)), np.zeros((len(run), k))
    for part, score, mask in groups(np.flatnonzero(many)):
        matrix[part] = crf.through(score, mask, step)
        heads = nth[part] == 0
        matrix[part[heads], 0] = crf.advance(score[heads], mask[heads], step, np.broadcast_to(model.first, (int(heads.sum()), k)))[0]
    for b in np.flatnonzero(many & (nth > 0)).tolist():  # enter: the best scores before a block, less their largest
        one = matrix[b - 1, 0] if nth[b] == 1 else (enter[b - 1][:, None] + matrix[b - 1]).max(0)
        enter[b] = one - one.max()
    moved = enter[:, :, None] + step  # into a block's first token
    came, last = {}, {}
    for part, score, mask in groups(np.flatnonzero(many)):
        into = np.where((nth[part] == 0)[:, None], model.first, moved[part].max(1))
        best, back = crf.advance(score, mask, step, into)
        for i, b in enumerate(part.tolist()):
            came[b] = back[i, : length[b]].copy()
            last[b] = int(best[i].argmax())
    for r in np.flatnonzero(blocks > 1).tolist():
        label = last[head[r] + blocks[r] - 1]
        for b in range(int(head[r] + blocks[r] - 1), int(head[r]) - 1, -1):
            labels = crf.trace(came.pop(b)[None], np.array([label]))[0]
            found[begin[b] : begin[b] + length[b]] = labels
            label = int(moved[b][:, labels[0]].argmax())
    return found


@dataclass
class Spans:
    row: np.ndarray
    start: np.ndarray  # bytes, from the start of the data
    end: np.ndarray
    label: np.ndarray


def find(texts: pa.Array, field: Field) -> tuple[Spans, np.ndarray, np.ndarray]:
    """The spans of all texts in order; the bytes and row borders of the texts."""
    data, offsets = T.raw(texts)
    start, end = T.runs(~T.IS_SPACE[data], offsets)
    rows = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    none = np.zeros(0, np.int64)
    if field.skip:
        signals = np.concatenate([[0], np.cumsum(_SIGNAL[data])])
        near = signals[end] > signals[start]
        for _ in range(2):  # the signal's neighbours, whose features differ, and theirs, so that every run ends plain
            wide = near.copy()
            wide[1:] |= near[:-1] & (row[1:] == row[:-1])
            wide[:-1] |= near[1:] & (row[1:] == row[:-1])
            near = wide
    else:
        near = np.ones(len(start), bool)
    at = np.flatnonzero(near)
    if len(at) == 0:
        return Spans(none, none, none, none), data, offsets
    breaks = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])])
    sizes = np.diff(np.r_[breaks, len(at)])
    found = decoded(data, start[at], end[at], breaks, sizes, field.model)
    hit = np.flatnonzero(found)
    if len(hit) == 0:
        return Spans(none, none, none, none), data, offsets
    first = np.flatnonzero(np.r_[True, (np.diff(at[hit]) > 1) | (row[at[hit[1:]]] != row[at[hit[:-1]]]) | (found[hit[1:]] != found[hit[:-1]])])
    last = np.r_[first[1:] - 1, len(hit) - 1]
    s, e = start[at[hit[first]]].copy(), end[at[hit[last]]].copy()
    trim = np.zeros(256, bool)
    trim[[ord(c) for c in _TRIM]] = True
    for i in range(len(s)):
        while e[i] > s[i] and trim[data[e[i] - 1]]:
            e[i] -= 1
        while s[i] < e[i] and trim[data[s[i]]]:
            s[i] += 1
    keep = e > s
    return Spans(row[at[hit[first]]][keep], s[keep], e[keep], found[hit[first]][keep]), data, offsets


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))


def _redacted(spans: Spans, data: np.ndarray, offsets: np.ndarray, r: int) -> str:
    out, at = [], int(offsets[r])
    for k in range(np.searchsorted(spans.row, r), np.searchsorted(spans.row, r, "right")):
        out += [data[at : spans.start[k]].tobytes(), f"[{LABELS[spans.label[k]]}]".encode()]
        at = int(spans.end[k])
    return b"".join([*out, data[at : offsets[r + 1]].tobytes()]).decode("utf-8", "replace")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, redacted) for each row of docs; redacted is null where nothing was found."""
    field = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                spans, data, offsets = find(piece.column(1), field)
                lists: list[list[dict]] = [[] for _ in range(piece.num_rows)]
                text: list[str | None] = [None] * piece.num_rows
                for r in np.unique(spans.row).tolist():
                    own = np.flatnonzero(spans.row == r)
                    a, b = (T.char_offsets(data, int(offsets[r]), x[own]).tolist() for x in (spans.start, spans.end))
                    lists[r] = [{"start": s, "end": e, "label": LABELS[k]} for s, e, k in zip(a, b, spans.label[own])]
                    text[r] = _redacted(spans, data, offsets, r)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lists, SPANS), pa.array(text, pa.string())], ["doc_id", "spans", "redacted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:int,end:int,label:string>>, redacted string")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """docs with the text's PII replaced, in place: nothing is shuffled and no row goes."""
    field = fitted()
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, at):
                spans, data, offsets = find(piece.column(at), field)
                changed = np.unique(spans.row).tolist()
                if changed:
                    columns = list(piece.columns)
                    new = {r: _redacted(spans, data, offsets, r) for r in changed}
                    columns[at] = pa.array([new.get(r, t) for r, t in enumerate(columns[at].to_pylist())], columns[at].type)
                    if size >= 0:
                        columns[size] = pa.array([n if n is None or r not in new else len(new[r]) for r, n in enumerate(columns[size].to_pylist())], columns[size].type)
                    piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
                yield piece

    return mapped(docs, run)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
