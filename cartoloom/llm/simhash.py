"""SimHash near-dedup with a pigeonring filter.

A document's fingerprint has 128 bits: bit j is the majority of bit j over the hashes of its distinct words (a tie is
0). Two documents are near copies if their fingerprints differ in at most TAU = 16 bits; a group is a connected
component of that relation.

The search is exact. The fingerprint is cut into six consecutive segments on a ring, with budgets t = (2, 2, 2, 2, 2, 1)
whose sum plus five is TAU. By the pigeonring principle any pair within TAU has a segment i such that for every length l
the l consecutive segments from i differ in at most sum(t_j + 1) - 1 bits. For the chain's first link a segment is cut into
parts, of which all but t_i are equal in both: each choice of so many parts is a key, and only fingerprints with an equal
key are compared. The full chain of six is the Hamming check, and the chains between tell which segment a pair belongs to,
so that it is found once.

Fingerprints are dealt into chunks by their hash, and every two chunks meet in one task, in numpy: a task's memory is that of
two chunks, whatever the data, and thousands of fingerprints that share a key are compared in rows. Equal fingerprints are
collapsed before the search, so thousands of exact copies cost one row. The search has no cap on bucket sizes or partners.
Pairs of a large group grow with its square; before they are joined and linked, each task thins its pairs to a forest with
the same components.

Null or empty texts, and texts without a word, have no fingerprint: they are never copies of anything. The document with
the least doc_id of a group stays; rows whose doc_id is null are searched by nobody and always stay; repeated rows of a
doc_id are one document, of which near_dedup keeps one row. Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoloom.llm import _text as T
from cartoloom.llm._spark import columns, cut, spared, stored, table

TAU = 16
#: (half, shift, width) of each segment; budgets sum to TAU - 5.
SEGMENTS = ((0, 0, 21), (0, 21, 21), (0, 42, 22), (1, 0, 21), (1, 21, 21), (1, 42, 22))
BUDGETS = (2, 2, 2, 2, 2, 1)
#: Fingerprints of a chunk at most and, while there are few chunks, at least; so many chunks that tasks keep all cores busy.
CHUNK, LEAST_CHUNK, CHUNKS = 1 << 18, 1 << 15, 20
#: From this size on a chunk's segments are cut into four parts and not three.
FINE = 1 << 15
#: Pairs compared at once: what stays in a core's cache.
AT_ONCE = 1 << 15
#: Pairs that are thinned to a forest at once.
THINNED = 1 << 19


#: For each byte its bits, a byte for each, as one number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(T.U).ravel()


def fingerprint_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their fingerprints as two columns of uint64)."""
    w = T.words(texts)
    if len(w.hash) == 0:
        return np.zeros(0, np.int64), np.zeros((0, 2), T.U)
    which, words = pd.factorize(w.hash)
    at, found = pd.factorize(w.row * len(words) + which)
    first = np.empty(len(found), np.int64)  # the first place of each distinct word of each row, in order
    first[at[::-1]] = np.arange(len(at))[::-1]
    h, row = w.hash[first], w.row[first]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[starts, len(row)])
    both = np.stack([h, T.mix(h ^ T.U(0xA5A5A5A5DEADBEEF))], axis=1)
    # eight counters to a number: sums of at most 255 words don't run over, and are then added up apart
    counters = _SPREAD[both.view(np.uint8).reshape(len(h), 16)]
    parts = np.flatnonzero((np.arange(len(h)) - np.repeat(starts, sizes)) % 255 == 0)
    some = np.add.reduceat(counters, parts, axis=0).view(np.uint8).reshape(len(parts), 128)
    ones = np.add.reduceat(some, np.searchsorted(parts, starts), axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > sizes[:, None], axis=1)
    return row[starts], packed.view(T.U).reshape(-1, 2)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2) of the documents that have an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                rows, fp = fingerprint_batch(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows)), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64))], ["doc_id", "h1", "h2"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(spared(run), "doc_id long, h1 long, h2 long")


def _cuts(i: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of the parts of segment i, of which no more than its budget can differ."""
    _, shift, width = SEGMENTS[i]
    n = parts if BUDGETS[i] == 2 else 2
    edges = [shift + width * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _field(h: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (h >> T.U(shift)) & T.U((1 << width) - 1)


def _keys(fp: np.ndarray, i: int, chosen: tuple[tuple[int, int], ...]) -> np.ndarray:
    h, key = fp[SEGMENTS[i][0]], np.zeros(fp.shape[1], T.U)
    for shift, width in chosen:
        key = (key << T.U(width)) | _field(h, shift, width)
    return key.astype(np.uint16)


def _grouped(fp: np.ndarray, i: int, chosen: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the keys, where each key begins in it, the half of the fingerprints that the key says nothing of)."""
    keys = _keys(fp, i, chosen)
    order = np.argsort(keys, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(keys, minlength=1 << sum(w for _, w in chosen)))]
    return order, starts, fp[1 - SEGMENTS[i][0]][order]


def chunk_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, distances) of all pairs within TAU, each once; a and b are two rows of uint64.

    same: both are one chunk, of which each unordered pair counts once.
    """
    parts, m = 4 if max(a.shape[1], b.shape[1]) > FINE else 3, len(SEGMENTS)
    choices = [list(itertools.combinations(_cuts(i, parts), len(_cuts(i, parts)) - BUDGETS[i])) for i in range(m)]

    def checked(x: np.ndarray, y: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidates by key k of segment i those within TAU, unless an earlier key has them."""
        differ = a[:, x] ^ b[:, y]
        distance = np.bitwise_count(differ).sum(axis=0, dtype=np.int32)
        near = np.flatnonzero((distance <= TAU) & (x < y) if same else distance <= TAU)
        differ = differ[:, near]
        diff = [np.bitwise_count(_field(differ[half], shift, width)).astype(np.int32) for half, shift, width in SEGMENTS]
        first = np.ones(len(near), bool)
        for j in range(i + 1):
            chain, total = np.ones(len(near), bool), 0
            for length in range(1, m + 1):
                total = total + diff[(j + length - 1) % m]
                chain &= total <= sum(BUDGETS[(j + n) % m] + 1 for n in range(length)) - 1
            first &= chain if j == i else ~chain
        for earlier in choices[i][:k]:
            first &= np.any([_field(differ[SEGMENTS[i][0]], *cut) != 0 for cut in earlier], axis=0)
        near = near[first]
        return x[near], y[near], distance[near]

    for i in range(m):
        for k, chosen in enumerate(choices[i]):
            order_a, starts_a, half_a = _grouped(a, i, chosen)
            order_b, starts_b, half_b = (order_a, starts_a, half_a) if same else _grouped(b, i, chosen)
            held, n = [], 0
            for a0, a1, b0, b1 in _rectangles(starts_a, starts_b):
                # one half alone leaves few of those that aren't near
                few = np.flatnonzero(np.bitwise_count(half_a[a0:a1, None] ^ half_b[b0:b1]) <= TAU)
                if few.size:
                    x, y = np.divmod(few, b1 - b0)
                    held.append((x + a0, y + b0))
                    n += few.size
                    if n > AT_ONCE:
                        yield checked(*_places(held, order_a, order_b), i, k)
                        held, n = [], 0
            if n:
                yield checked(*_places(held, order_a, order_b), i, k)


def _places(held: list[tuple[np.ndarray, np.ndarray]], order_a: np.ndarray, order_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = (np.concatenate(c) for c in zip(*held))
    return order_a[x], order_b[y]


def _rectangles(starts_a: np.ndarray, starts_b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, from, to) of rows of a and b that share a key, AT_ONCE pairs at most."""
    shared = np.flatnonzero((np.diff(starts_a) > 0) & (np.diff(starts_b) > 0))
    for a0, a1, b0, b1 in zip(*(s[shared + k].tolist() for s in (starts_a, starts_b) for k in (0, 1))):
        if (a1 - a0) * (b1 - b0) <= AT_ONCE:
            yield a0, a1, b0, b1
            continue
        columns = min(b1 - b0, AT_ONCE)
        rows = AT_ONCE // columns
        for p in range(a0, a1, rows):
            for q in range(b0, b1, columns):
                yield p, min(p + rows, a1), q, min(q + columns, b1)


def near_pairs(distinct: DataFrame) -> DataFrame:
    """All pairs of the distinct fingerprints (h1, h2) within TAU: a1, a2, b1, b2, distance, the first the lesser.

    Every two chunks meet by the number of their pair; nothing else is shuffled. distinct is counted first.
    """
    n = distinct.count()
    chunks = max(1, min(n // LEAST_CHUNK, CHUNKS), -(-n // CHUNK))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            chunk, fp = batch.column(0).to_numpy(), np.stack([batch.column(k).to_numpy() for k in (1, 2)], axis=1)
            for c in np.unique(chunk).tolist():
                held.setdefault(c, []).append(fp[chunk == c].tobytes())
        for c, pieces in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([b"".join(pieces)], pa.binary())], ["chunk", "data"])

    chunk = F.pmod(F.xxhash64("h1", "h2"), F.lit(chunks)).cast("int").alias("chunk")
    dealt = distinct.select(chunk, "h1", "h2").repartition(chunks, "chunk").mapInArrow(spared(packed), "chunk int, data binary")
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    least, most = F.least("chunk", "other"), F.greatest("chunk", "other")
    pairs = chunks * (chunks + 1) // 2
    number = (least * (2 * chunks - least + 1) / 2 + most - least).cast("int").alias("number")  # without gaps
    a, b = (other.where(F.col("chunk") == end).select(number, "chunk", F.col("data").alias(name)).repartition(pairs, "number") for name, end in (("a", least), ("b", most)))
    # the size of files says little of what is joined, so chunks would soon be taken for small enough to broadcast
    met = a.join(b.hint("merge").withColumnRenamed("chunk", "chunk_b"), "number").select((F.col("chunk") == F.col("chunk_b")).alias("same"), "a", "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, x, y = (column[k] for column in batch.columns)
                yield from _met(x.as_buffer(), y.as_buffer(), same.as_py())

    return met.mapInArrow(spared(compared), "a1 long, a2 long, b1 long, b2 long, distance int")


def _met(x: pa.Buffer, y: pa.Buffer, same: bool) -> Iterator[pa.RecordBatch]:
    """Batches of the near pairs of two chunks. Both are made anew, each in its own order, so one that meets itself is x alone."""
    x, y = (np.frombuffer(z, np.int64).reshape(-1, 2) for z in (x, x if same else y))
    halves = [np.ascontiguousarray(z.T).view(T.U) for z in (x, y)]
    for at_x, at_y, distance in _gathered(chunk_pairs(*halves, same)):
        u, v = x[at_x], y[at_y]
        swap = ((u[:, 0] > v[:, 0]) | ((u[:, 0] == v[:, 0]) & (u[:, 1] > v[:, 1])))[:, None]
        low, high = np.where(swap, v, u), np.where(swap, u, v)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (*low.T.copy(), *high.T.copy())), pa.array(distance)], ["a1", "a2", "b1", "b2", "distance"])


def _gathered(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """The same rows in fewer and larger pieces."""
    held, n = [], 0
    for piece in found:
        held.append(piece)
        n += len(piece[0])
        if n > 1 << 16:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (a1, a2, b1, b2) with the same components, fewer than there are fingerprints: each with one of its component."""
    n = len(pairs)
    ends = np.concatenate([pairs[:, :2], pairs[:, 2:]])
    one, two = pd.factorize(ends[:, 0])[0], pd.factorize(ends[:, 1])[0]
    node, which = pd.factorize(one.astype(np.int64) * (two.max() + 1) + two)
    place = np.empty(len(which), np.int64)
    place[node[::-1]] = np.arange(len(node))[::-1]
    u, v = node[:n], node[n:]
    root = np.arange(len(which))
    while True:
        x, y = root[u], root[v]
        low = np.minimum(x, y)
        if np.array_equal(x, y):
            break
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, up := root[root]):
            root = up
    rest = np.flatnonzero(root != np.arange(len(root)))
    return np.concatenate([ends[place[root[rest]]], ends[place[rest]]], axis=1)


def thinned(pairs: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): pairs with the same components, in each task fewer than there are fingerprints wherever many meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([*map(pa.array, rows.T.copy())], ["a1", "a2", "b1", "b2"])
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            n += batch.num_rows
            if n > THINNED:
                held = [forest(np.concatenate(held))]
                n = len(held[0])
                if n > THINNED // 2:
                    yield out(held[0])
                    held, n = [], 0
        if n:
            yield out(forest(np.concatenate(held)))

    return pairs.select("a1", "a2", "b1", "b2").mapInArrow(spared(run), "a1 long, a2 long, b1 long, b2 long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of the edges (u, v); alternating stars.

    Each round points neighbours at the least member of their star; the rounds grow with the logarithm of the longest
    path, and each is cut in the shared folder.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # large star: the larger neighbours of u go to the least of u and its neighbours
        n = both(state)
        least = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = n.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        state = cut(small.where("u <> v").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of) for every document that isn't the least of its group."""
    fp = cut(fingerprints(docs))
    heads = stored(fp.groupBy("h1", "h2").agg(F.min("doc_id").alias("head")))
    pairs = thinned(near_pairs(heads.select("h1", "h2")))
    left, right = heads.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("head").alias("u")), heads.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("head").alias("v"))
    # the size of files says little of their rows in memory, so these too would be broadcast as they grow
    roots = components(pairs.join(left.hint("merge"), ["a1", "a2"]).join(right.hint("merge"), ["b1", "b2"]).select("u", "v"))
    linked = heads.join(roots, heads["head"] == roots["node"], "left").select("h1", "h2", F.coalesce("root", "head").alias("duplicate_of"))
    return fp.select("doc_id", "h1", "h2").distinct().join(linked, ["h1", "h2"]).where(F.col("doc_id") != F.col("duplicate_of")).select("doc_id", "duplicate_of").groupBy("doc_id").agg(F.min("duplicate_of").alias("duplicate_of"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The documents without the near copies: one row of each group stays, with all its columns.

    The texts are shuffled once, by doc_id: tasks keep one row of a repeated doc_id before that, and the join that follows
    has the same partitioning. Rows without doc_id are not shuffled.
    """
    drop = duplicates(docs).select("doc_id")
    number = "_" + "_".join(["row", *docs.columns])  # longer than any column, hence no clash
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last()))
    known = docs.where("doc_id IS NOT NULL")
    one = known.select("*", first.alias(number)).where(F.col(f"`{number.replace('`', '``')}`") == 1).select(*columns(docs))
    return one.join(drop, "doc_id", "left_anti").select(*columns(docs)).union(docs.where("doc_id IS NULL").select(*columns(docs)))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))
