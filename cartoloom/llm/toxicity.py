"""Toxic spans by a linear-chain conditional random field with two labels.

Labelled tokens come from the labelled documents (at most TRAIN_ROWS, chosen by hash of doc_id, without near copies): a
word of a toxic document is labelled toxic if the labels show it, or its first 4, 5 or 6 bytes, to be. The count in toxic
documents (the lesser of the documents and of the different pairs of neighbours there, so that neither long documents nor
copies of one passage count often) must be ODDS times what the count in clean documents and the share of toxic ones let
expect, and too large for chance at level ALPHA over all tested. The field's features are the lower-cased word and those
beginnings (for inflected words), each by two independent hashes, so that a clean word passes for a toxic one only if both
collide; its transitions carry the spans. It is fitted on at most WINDOWS windows of WINDOW tokens of each kind: around toxic
tokens, around clean ones that begin like them, and around any clean ones; a window never crosses a document's border.

Every token of every text then gets its marginal probability of being toxic from an exact forward-backward pass, run over
all texts of a batch at once, on the odds, in blocks of BLOCK tokens. A document's score is its largest marginal; expected is the sum
of the marginals; spans are the character offsets of maximal runs of tokens whose marginal is at least SPAN. A document is
toxic if its score is at least TOXIC.

Null and empty texts score 0 and have no spans. Where no word can be labelled (no toxic labels, or empty labels), all
scores are 0. Rows are scored one by one, so null ids and repeated rows do no harm; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cartoloom.llm import _text as T
from cartoloom.llm import crf
from cartoloom.llm._features import fitted, sample
from cartoloom.llm._spark import table
from cartoloom.llm.simhash import fingerprint_batch

TRAIN_ROWS = 4000
CONTEXTS, ODDS, ALPHA = 2, 20.0, 0.5
COPY_BITS = 30
TOXIC = SPAN = 0.5
BITS = 18
SIZE = 1 << BITS
PREFIXES = (4, 5, 6)
FEATURES = 2 * SIZE * (1 + len(PREFIXES))
WINDOW, WINDOWS = 8, 1500
#: Tokens that the forward-backward recursion takes one after another.
BLOCK = 256


def units(w: T.Words) -> np.ndarray:
    """[n, 4]: the hashes of each word and of its first 4, 5 and 6 bytes, 0 where it isn't longer."""
    low = T.lowered(w.data)
    out = [w.hash]
    for k in PREFIXES:
        longer = w.end - w.start > k
        out.append(np.where(longer, T.span_hashes(low, w.start, np.minimum(w.end, w.start + k)), T.U(0)))
    return np.stack(out, 1)


def _feature(u: np.ndarray) -> np.ndarray:
    """Two feature ids of each unit, each in a table of its own; a unit that is missing has the last id, of weight 0."""
    mask, kinds = T.U(SIZE - 1), np.arange(u.shape[-1]) * 2 * SIZE
    one = (u & mask).astype(np.int64) + kinds
    two = (u >> T.U(BITS) & mask).astype(np.int64) + kinds + SIZE
    ids = np.concatenate([one, two], -1)
    ids[np.concatenate([u == 0, u == 0], -1)] = FEATURES
    return ids


@dataclass
class Model:
    """weight[f]: log-odds of toxic that feature f adds; step[j, k] and first[k]: log factors of the labels."""

    weight: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def marginals(self, w: T.Words) -> np.ndarray:
        """The probability of toxic of each token, by exact forward and backward odds.

        Rows are cut into blocks of BLOCK tokens that all go in step. What a block does to the odds is a 2 x 2 matrix, so
        the odds at the borders of a long row's blocks follow from one matrix each, however long it is.
        """
        n = len(w.hash)
        if n == 0 or not self.weight.any():
            return np.zeros(n)
        gain = np.exp(np.clip(self.weight[_feature(units(w))].sum(1), -30, 30))
        (oo, ot), (to, tt) = np.exp(self.step)
        sizes = np.diff(w.offsets)
        blocks = -(-sizes // BLOCK)
        head = np.cumsum(blocks) - blocks  # the first block of each row
        row = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(row)) - head[row]
        length = np.minimum(BLOCK, sizes[row] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        enter, leave = np.full(len(row), np.exp(self.first[1] - self.first[0])), np.ones(len(row))

        def lanes(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The first token of each block, whether it begins a row, and how many blocks are longer than t."""
            size = length[of]
            return w.offsets[:-1][row[of]] + nth[of] * BLOCK, nth[of] == 0, np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")

        several = order[blocks[row[order]] > 1]
        if len(several):
            begin, first, active = lanes(several)
            m = np.zeros((2, 2, len(several)))
            m[0, 0] = m[1, 1] = 1
            for t in range(len(active) - 1):
                k = active[t]
                a, b, g = m[:, 0, :k], m[:, 1, :k], gain[begin[:k] + t]
                o, x = a * oo + b * to, a * ot + b * tt
                if t == 0:
                    o, x = np.where(first[:k], a, o), np.where(first[:k], b, x)
                m[:, 0, :k], m[:, 1, :k] = o, x * g
                if t % 8 == 7:
                    m[:, :, :k] /= m[:, :, :k].max((0, 1))
            whole = np.zeros((2, 2, len(row)))
            whole[:, :, several] = m
            for k in range(1, int(blocks.max())):
                at = head[blocks > k] + k
                (a, b), (c, d) = whole[:, :, at - 1]
                enter[at] = np.clip((b + d * enter[at - 1]) / (a + c * enter[at - 1]), 1e-30, 1e30)
            for k in range(int(blocks.max()) - 1, 0, -1):
                at = head[blocks > k] + k
                (a, b), (c, d) = whole[:, :, at]
                leave[at - 1] = np.clip((c + d * leave[at]) / (a + b * leave[at]), 1e-30, 1e30)

        begin, first, active = lanes(order)
        forward, after = np.empty(n), np.empty(n)
        odds = enter[order]
        for t in range(len(active) - 1):
            odds = odds[: active[t]]
            at = begin[: active[t]] + t
            moved = (ot + tt * odds) / (oo + to * odds)
            if t == 0:
                moved = np.where(first, odds, moved)
            odds = np.clip(moved * gain[at], 1e-30, 1e30)
            forward[at] = odds
        back, ends = np.ones(0), leave[order]
        for t in range(len(active) - 2, -1, -1):
            now = ends[: active[t]].copy()
            x = back * gain[begin[: len(back)] + t + 1]
            now[: len(back)] = (to + tt * x) / (oo + ot * x)
            back = np.clip(now, 1e-30, 1e30)
            after[begin[: active[t]] + t] = back
        o = forward * after
        return o / (1 + o)


def no_copies(texts: pa.Array) -> np.ndarray:
    """The rows of the (bounded) sample that are no near copy of an earlier one: families of copies would look like evidence."""
    parts, base = [(np.zeros(0, np.int64), np.zeros((0, 2), T.U))], 0
    for piece in T.pieces(pa.RecordBatch.from_arrays([texts], ["text"])):  # the bits of all words at once would be large
        at, bits = fingerprint_batch(piece.column(0))
        parts.append((at + base, bits))
        base += piece.num_rows
    rows, fp = (np.concatenate(x) for x in zip(*parts))
    keep: list[int] = []
    for i in range(len(rows)):
        if not keep or int(np.bitwise_count(fp[keep] ^ fp[i]).sum(1).min()) > COPY_BITS:
            keep.append(i)
    return rows[keep]


def telling(u: np.ndarray, context: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The values of u (one for each token, 0 for none) that the labels show to be toxic."""
    u, context, doc = u[u != 0], context[u != 0], doc[u != 0]
    ids, at = np.unique(u, return_inverse=True)
    at = at.astype(T.U)

    def distinct(other: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many different values of other each unit has in its own occurrences."""
        pairs = np.unique(T.mix(at[own] + T.U(1)) ^ T.mix(other[own] * T.U(7)), return_index=True)[1]
        return np.bincount(at[own][pairs].astype(np.int64), minlength=len(ids))

    toxic, share = y[doc] == 1, float(np.mean(y == 1))
    n = np.minimum(distinct(context, toxic), distinct(doc.astype(T.U), toxic))
    clean = distinct(doc.astype(T.U), ~toxic)
    tested = np.flatnonzero(n >= CONTEXTS)
    if len(tested) == 0 or share in (0.0, 1.0):
        return ids[:0]
    tail = np.array([lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + a * log(share) + b * log(1 - share) for a, b in zip(n[tested].tolist(), clean[tested].tolist())])
    sure = (tail < log(ALPHA / len(tested))) & (n[tested] * (1 - share) >= ODDS * share * clean[tested])
    return ids[tested[sure]]


def labelled_tokens(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, row, toxic) of all tokens of the labelled documents."""
    parts, contexts, docs = [np.zeros((0, 1 + len(PREFIXES)), T.U)], [np.zeros(0, T.U)], [np.zeros(0, np.int64)]
    lo = 0
    for piece in T.pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
        w = T.words(piece.column(0))
        first, lo = lo, lo + piece.num_rows
        if len(w.hash) == 0:
            continue
        before = np.r_[T.U(0), w.hash[:-1]]
        after = np.r_[w.hash[1:], T.U(0)]
        before[w.offsets[:-1][np.diff(w.offsets) > 0]] = T.U(1)
        after[w.offsets[1:][np.diff(w.offsets) > 0] - 1] = T.U(2)
        parts.append(units(w))
        contexts.append(T.mix(before * T.U(5) + after))
        docs.append(first + w.row)
    u, c, d = np.concatenate(parts), np.concatenate(contexts), np.concatenate(docs)
    tags = np.zeros(len(d), bool)
    for kind in range(u.shape[1]):
        tags |= np.isin(u[:, kind], telling(u[:, kind], c, d, y))
    return u, d, tags & (y[d] == 1)


def fit(texts: pa.Array, y: np.ndarray, windows: int = WINDOWS, seed: int = 5) -> Model:
    """y: 1 toxic, 0 clean, for each text. Without a toxic token the model has no weights."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    nothing = Model(np.zeros(FEATURES + 1), np.zeros((2, 2)), np.zeros(2))
    if len(y) == 0:
        return nothing
    single = no_copies(texts)
    y = y[single]
    u, doc, tags = labelled_tokens(texts.take(pa.array(single, pa.int64())), y)
    if not tags.any():
        return nothing
    r = np.random.default_rng(seed)
    alike = np.isin(u[:, 1], u[tags, 1]) & (u[:, 1] != 0) & ~tags
    centres = [r.permutation(np.flatnonzero(x))[:windows] for x in (tags, alike, ~tags)]
    centre = np.concatenate(centres)
    low, high = np.searchsorted(doc, doc[centre]), np.searchsorted(doc, doc[centre], "right")
    start = np.maximum(low, np.minimum(centre - r.integers(0, WINDOW, len(centre)), high - WINDOW))
    span = start[:, None] + np.arange(WINDOW)
    mask = span < high[:, None]
    span = np.where(mask, span, start[:, None])
    f, g = _feature(u[span]), tags[span].astype(np.int64)
    ids, back = np.unique(f, return_inverse=True)  # the fit works on the features that occur
    back = np.where(f == FEATURES, -1, back.reshape(f.shape))
    model = crf.fit(back, g, mask, len(ids), 2, steps=60, rate=0.3, l2=1e-4)
    weight = np.zeros(FEATURES + 1)
    weight[ids] = model.emission[:, 1] - model.emission[:, 0]
    weight[FEATURES] = 0
    return Model(weight.astype(np.float32), model.step, model.first)


def train(spark: SparkSession, sf_dir: str, rows: int = TRAIN_ROWS) -> Model:
    return fitted(sample(spark, sf_dir, "toxic", rows), lambda t: fit(t.column("text"), t.column("label").to_numpy()))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def tagged(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """(score, expected number of toxic tokens, spans) of each text."""
    w = T.words(texts)
    p = model.marginals(w)
    n = len(w.offsets) - 1
    score, some = np.zeros(n), np.diff(w.offsets) > 0
    if some.any():
        score[some] = np.maximum.reduceat(p, w.offsets[:-1][some])
    spans: list[list[dict]] = [[] for _ in range(n)]
    hit = np.flatnonzero(p >= SPAN)
    if len(hit):
        first = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (w.row[hit[1:]] != w.row[hit[:-1]])])
        last = np.r_[first[1:] - 1, len(hit) - 1]
        rows, start, end = w.row[hit[first]], w.start[hit[first]], w.end[hit[last]]
        for r in np.unique(rows).tolist():
            own = rows == r
            base = int(w.byte_offsets[r])
            spans[r] = [{"start": a, "end": b} for a, b in zip(T.char_offsets(w.data, base, start[own]).tolist(), T.char_offsets(w.data, base, end[own]).tolist())]
    return score, T.segment_sum(p, w.offsets), spans


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, expected, toxic, spans), one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # larger pieces than elsewhere: the recursion's steps are shared by all blocks of one
            for piece in T.pieces(batch, "text", 1 << 21):
                p, expected, spans = tagged(piece.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p), pa.array(expected), pa.array(p >= TOXIC), pa.array(spans, SPANS)], ["doc_id", "score", "expected", "toxic", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, expected double, toxic boolean, spans array<struct<start:int,end:int>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), train(spark, sf_dir))
