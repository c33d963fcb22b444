"""Stupid-backoff trigram scores of every document, from counts over the whole table.

For the word w after u v (two begin marks before the first word) the score is log c(u v w) / c(u v) if the trigram was counted
at least LEAST times, else log ALPHA + log c(v w) / c(v .) if the pair was, else 2 log ALPHA + log c(w) / N, where c(v .) is how
many pairs v begins and N is the number of all words. (Every n-gram of a scored document is counted once by the document
itself; LEAST leaves that count out.) A document's score is the sum over its words; perplexity is exp(-score / n_words).

The tables of counts, each by the 64-bit hash of its n-gram:

* Words: a table in the shared folder. Those that begin the most pairs, at most TOP, are also broadcast (8 MB) and get codes.
* Pairs and trigrams of the DENSE commonest words: at most DENSE^2 + DENSE^3 counts, broadcast. No other n-gram can hold more
  than 1 / DENSE of all positions, however skewed the corpus is.
* All other pairs and trigrams. Each position becomes a row (u, v, w, next word) that is sent to the partition of its pair (of
  the word v, where v has no code, so that c(v .) is complete there). The counts of the pair, of the trigrams that end with it
  and of those that begin with it (does the next word back off?) are then made and joined to the rows in that one place.

A position of a dense pair isn't sent by its pair: what isn't known from the broadcast counts goes as two half rows, by the
trigram that ends with the pair and by the one that begins with it. Pairs counted less than LEAST times whose word has no code
leave their partition as rows (doc_id, w, times), which an equi-join with the table of words completes.

The rows of one document batch (PIECE_BYTES of text) for one partition travel as one compressed binary: a list of the distinct
words, by code or hash, and their places in it. There are never more binaries than positions; they hold some thousand positions up to 30 GB of
text and fewer beyond, as the number of partitions grows with the text (PARTITION_BYTES) and batches don't.

Words are those of _text (lower-cased runs of word characters), told apart by 64-bit hashes. Null texts, empty texts and texts
without a word have n_words 0, score 0 and a null perplexity. Rows without doc_id are left out. Rows that repeat a doc_id all
count for the corpus, and their scores and words add up. An empty table gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.llm import _text as T
from cartoloom.llm._spark import stored, table

ALPHA, LEAST = 0.4, 2
#: Words with codes, and those whose pairs and trigrams are counted beforehand.
TOP, DENSE = 260_000, 64
#: Bytes of text for each partition of the rows, and for each set of binaries that a task sends.
PARTITION_BYTES, PIECE_BYTES = 8 << 20, 8 << 20
#: Codes: the marks, then the words from the commonest on; a word is its code, or its hash, which is RARE at least.
BEGIN, END, RARE = 0, 1, 1 << 18
FULL, ENDS, BEGINS = 0, 1, 2


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word."""
    w = T.words(texts)
    return np.where(w.hash < RARE, w.hash + T.U(RARE), w.hash), w.row.astype(np.int32)


def around(h: np.ndarray, row: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the second before it, the one before it, and the one after; begin and end stand beyond the row."""
    n = len(h)
    second, before, after = (np.full(n, x, h.dtype) for x in (begin, begin, end))
    if n:
        same = row[1:] == row[:-1]
        before[1:] = np.where(same, h[:-1], before[1:])
        after[:-1] = np.where(same, h[1:], after[:-1])
    if n > 1:
        second[2:] = np.where(row[2:] == row[:-2], h[:-2], second[2:])
    return second, before, after


@dataclass
class Known:
    """The broadcast counts. hashes (sorted) and codes of the words that have one; by code how many pairs a word begins (n) and
    how often it occurs (m); counts of the dense pairs and trigrams; number of words."""

    hashes: np.ndarray
    codes: np.ndarray
    n: np.ndarray
    m: np.ndarray
    total: int = 0
    pairs: np.ndarray | None = None
    trigrams: np.ndarray | None = None

    @property
    def dense(self) -> int:
        return len(self.pairs)

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, or the hash."""
        if len(self.hashes) == 0:
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.codes[at], hashes)

    def of(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """counts by code; 1 for a word without one."""
        return np.where(values < RARE, counts[np.minimum(values, RARE - 1).astype(np.int64)], 1)

    def ending(self, c3: np.ndarray, c2: np.ndarray, c1: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the word w adds, but for the count of the pair before it; a word without code counts as 1 in c(w)."""
        hit = np.log(np.maximum(c3, 1)) - np.where(v == BEGIN, np.log(max(1, self.n[BEGIN])), 0.0)
        pair = np.log(ALPHA) + np.log(np.maximum(c2, 1)) - np.log(np.maximum(c1, 1))
        one = 2 * np.log(ALPHA) + np.log(np.maximum(self.of(w, self.m), 1)) - np.log(max(1, self.total))
        return np.where(c3 >= LEAST, hit, np.where(c2 >= LEAST, pair, one))


def word_counts(docs: DataFrame) -> DataFrame:
    """(v, n, m) of the words and the begin mark: how many pairs each begins, how often it occurs. Exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, "text", 1 << 22):
                found, rows, base = [], [], 0
                for small in T.pieces(piece, "text", 1 << 20):
                    h, row = hashes_of(small.column(0))
                    found.append(h)
                    rows.append(row + base)
                    base += small.num_rows
                at, words = pd.factorize(np.concatenate(found))
                before = around(at, np.concatenate(rows), len(words), len(words))[1]
                n, m = np.bincount(before, minlength=len(words) + 1), np.bincount(at, minlength=len(words) + 1)
                words = np.append(words, T.U(BEGIN)).view(np.int64)
                del found, rows, at, before
                _trim()
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n), pa.array(m)], ["v", "n", "m"])

    counts = docs.select("text").mapInArrow(run, "v long, n long, m long")
    return stored(counts.groupBy("v").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def common_words(counts: DataFrame, top: int = TOP) -> Known:
    """The words that begin the most pairs, at most top: all of at least a number of pairs that a histogram (64 steps to a
    doubling, so some 4,000 rows) shows to leave no more than top."""
    words = counts.where(f"v <> {BEGIN} AND n > 0").withColumn("step", F.floor(F.log2("n") * 64).cast("int"))
    least, seen = 1 << 30, 0
    for r in words.groupBy("step").count().orderBy(F.desc("step")).toLocalIterator():
        seen += r["count"]
        if seen > top:
            break
        least = r["step"]
    rows = words.where(F.col("step") >= least).select("v", "n", "m").toArrow()  # at most top rows
    v, n, m = (rows.column(c).to_numpy() for c in ("v", "n", "m"))
    order = np.lexsort((v, -n))
    codes = np.empty(len(v), np.uint64)
    codes[order] = np.arange(len(v)) + 2
    by_hash = np.argsort(v.view(T.U))
    whole = counts.agg(F.sum("m"), F.sum(F.when(F.col("v") == BEGIN, F.col("n")))).first()
    known = Known(v.view(T.U)[by_hash], codes[by_hash], np.zeros(RARE, np.int64), np.zeros(RARE, np.int64), int(whole[0] or 0))
    known.n[codes.astype(np.int64)], known.m[codes.astype(np.int64)] = n, m
    known.n[BEGIN] = whole[1] or 0
    return known


def dense_counts(docs: DataFrame, known: Known, dense: int = DENSE) -> Known:
    """known with the counts of the pairs and trigrams whose words all have codes below dense."""
    few = known.codes < dense
    shared = docs.sparkSession.sparkContext.broadcast(Known(known.hashes[few], known.codes[few], known.n[:0], known.m[:0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dense**2 + dense**3, np.int64)
        for batch in batches:
            for piece in T.pieces(batch, "text", 1 << 20):
                h, row = hashes_of(piece.column(0))
                w = np.minimum(shared.value.coded(h), T.U(dense)).astype(np.int64)
                s, v, _ = around(w, row, BEGIN, END)
                two = np.flatnonzero((v < dense) & (w < dense))
                pair = v[two] * dense + w[two]
                three = s[two] < dense
                total[: dense**2] += np.bincount(pair, minlength=dense**2)
                total[dense**2 :] += np.bincount(s[two][three] * dense**2 + pair[three], minlength=dense**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["at", "n"])

    found = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most dense^2 + dense^3 rows
    counts = np.zeros(dense**2 + dense**3, np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    known.pairs, known.trigrams = counts[: dense**2].reshape(dense, dense), counts[dense**2 :].reshape(dense, dense, dense)
    return known


def pack(columns: list[np.ndarray], values: np.ndarray, kinds: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Columns of indexes of values: the distinct values in order, as differences (so codes, which go by how common a word is,
    take about a byte), and for each index its place among them. kinds: how many rows there are of each kind."""
    at, distinct = pd.factorize(np.concatenate(columns))
    listed = values[distinct]
    order = np.argsort(listed)
    rank = np.empty(len(distinct), np.int64)
    rank[order] = np.arange(len(distinct))
    width = 2 if len(distinct) <= 1 << 16 else 4
    planes = rank[at].astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    words = pack_numbers([listed[order].view(np.int64)], squeeze)
    return np.array([len(words), width, *kinds], "<u4").tobytes() + words + squeeze.compress(planes)


def unpack(data: bytes, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(kind of each row, the columns of values)."""
    size, width, *kinds = np.frombuffer(data, "<u4", 5).tolist()
    (listed,) = unpack_numbers(data[20 : 20 + size], ["<i8"])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[20 + size :]), np.uint8).reshape(width, -1)
    rank = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
    return np.repeat(np.arange(3, dtype=np.int8), kinds), np.split(listed.view(T.U)[rank], columns)


def pack_numbers(columns: list[np.ndarray], squeeze: zstandard.ZstdCompressor) -> bytes:
    """64-bit numbers, by bytes of like place; the first column as differences."""
    columns = [np.diff(columns[0], prepend=0), *columns[1:]]
    return squeeze.compress(b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns))


def unpack_numbers(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(len(kinds), 8, -1)
    out = [np.ascontiguousarray(x.T).view(kind).ravel() for x, kind in zip(planes, kinds)]
    return [np.cumsum(out[0]), *out[1:]]


def positions(docs: DataFrame, partitions: int, shared) -> DataFrame:
    """(part, rows, owners, sums): binaries of the positions for a partition, of the doc_ids and how many of the positions each
    has; and, with rows null, of the doc_ids of a batch, their words, and what is known of their scores already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, known, P = zstandard.ZstdCompressor(level=1), shared.value, T.U(partitions)
        for batch in batches:
            for piece in T.pieces(batch, "text", PIECE_BYTES):
                found, rows, base = [], [], 0
                for small in T.pieces(piece, "text", 1 << 20):
                    h, r = hashes_of(small.column(1))
                    found.append(h)
                    rows.append(r + base)
                    base += small.num_rows
                w, words = pd.factorize(np.concatenate(found))
                w, row, ids = w.astype(np.int32), np.concatenate(rows), piece.column(0).to_numpy(zero_copy_only=False)
                del found, rows
                value = np.append(known.coded(words), [T.U(BEGIN), T.U(END)])  # the piece's words by index, then the marks
                begin, end = len(words), len(words) + 1
                s, v, a = around(w, row, begin, end)
                small = value < known.dense
                both = small[v] & small[w]
                full, two = np.flatnonzero(~both), np.flatnonzero(both)

                cs, cv, cw, ca = (np.where(small, value, 0)[x[two]].astype(np.int64) for x in (s, v, w, a))
                c2, three, more = known.pairs[cv, cw], small[s[two]], a[two] != end
                share = np.where(three, known.ending(known.trigrams[cs, cv, cw], c2, known.n[cv], cv, cw), 0.0)
                follows = more & small[a[two]] & (known.trigrams[cv, cw, ca] >= LEAST)
                share -= np.where(follows, np.log(np.maximum(c2, 1)), 0.0)
                sums = [ids, np.bincount(row, minlength=len(ids)), np.bincount(row[two], share, len(ids))]

                ends, begins = two[~three], two[more & ~small[a[two]]]
                at = np.concatenate([full, ends, begins])
                kind = np.repeat(np.arange(3, dtype=np.int8), [len(full), len(ends), len(begins)])
                mixed, plain = T.mix(value), value < RARE
                pair = lambda x: T.mix(mixed[v[x]] * T.U(3) + mixed[w[x]])  # noqa: E731, B023
                where = [np.where(plain[v[full]], pair(full), mixed[v[full]]), T.mix(pair(ends) * T.U(5) + mixed[s[ends]]), T.mix(pair(begins) * T.U(7) + mixed[a[begins]])]
                part = (np.concatenate(where) % P).astype(np.int32)
                order = np.argsort(part, kind="stable")
                first = np.flatnonzero(np.diff(part[order], prepend=-1))
                parts, packed, owners = [], [], []
                for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
                    own, k = at[order[lo:hi]], kind[order[lo:hi]]
                    columns = [np.where(k == BEGINS, begin, s[own]), v[own], w[own], np.where(k == ENDS, end, a[own])]
                    runs = np.flatnonzero(np.diff(row[own], prepend=-1))
                    parts.append(int(part[order[lo]]))
                    packed.append(pack(columns, value, np.bincount(k, minlength=3), squeeze))
                    owners.append(pack_numbers([ids[row[own[runs]]], np.diff(runs, append=hi - lo)], squeeze))
                parts.append(int(T.mix(ids[:1].view(T.U))[0] % P))
                columns = [pa.array(parts, pa.int32()), pa.array([*packed, None], pa.binary()), pa.array([*owners, None], pa.binary()), pa.array([None] * len(packed) + [pack_numbers(sums, squeeze)], pa.binary())]
                del s, v, w, a, row, part, order, at, kind, value, mixed, words, packed, owners, both, full, two, where
                _trim()
                yield pa.RecordBatch.from_arrays(columns, ["part", "rows", "owners", "sums"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, rows binary, owners binary, sums binary")


def _trim() -> None:
    """Give freed memory back to the system, where the C library can: two workers and a JVM share an executor's."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def counted(keys: np.ndarray) -> np.ndarray:
    """For each row: how many rows have the same key."""
    at, distinct = pd.factorize(keys)
    return np.bincount(at, minlength=len(distinct))[at]


def shares(kind: np.ndarray, s: np.ndarray, v: np.ndarray, w: np.ndarray, a: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """What each row of a partition adds to its document's score, and whether c(w) of a word without code is missing in it."""
    full, begins = kind == FULL, kind == BEGINS
    pair = T.mix(T.mix(v) * T.U(3) + T.mix(w))
    c2 = np.zeros(len(v), np.int64)
    c2[full] = counted(pair[full])
    c2[~full] = known.pairs[v[~full].astype(np.int64), w[~full].astype(np.int64)]
    c1 = known.of(v, known.n)
    lone = full & (v >= RARE)  # all rows of such a word are here
    c1[lone] = counted(v[lone])
    c3, next3 = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    c3[~begins] = counted(T.mix(pair[~begins] * T.U(5) + T.mix(s[~begins])))
    after = np.flatnonzero((kind != ENDS) & (a != END))
    next3[after] = counted(T.mix(pair[after] * T.U(7) + T.mix(a[after])))
    share = np.where(begins, 0.0, known.ending(c3, c2, c1, v, w))
    # the pair s v is the row before: its logarithm is taken off there, where it is known whether the next trigram is a hit
    share -= np.where(next3 >= LEAST, np.log(np.maximum(c2, 1)), 0.0)
    return share, ~begins & (c3 < LEAST) & (c2 < LEAST) & (w >= RARE)


def score(docs: DataFrame, partitions: int | None = None, top: int = TOP, dense: int = DENSE) -> DataFrame:
    """(doc_id, n_words, score, perplexity) of each document, by the counts of all of them."""
    docs = docs.where("doc_id IS NOT NULL")
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(1, int(-(-size // PARTITION_BYTES)))
    counts = word_counts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(dense_counts(docs, common_words(counts, top), dense))  # 11 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rows, owners, names = [], [], [], ["doc_id", "n", "share", "w", "times"]
        for batch in batches:  # one partition: PARTITION_BYTES of text, whatever the corpus
            for packed, owner, sums in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if packed is None:
                    ids, n, share = unpack_numbers(sums, ["<i8", "<i8", "<f8"])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(share), pa.array(np.full(len(ids), -1)), pa.array(np.zeros(len(ids), np.int64))], names)
                else:
                    kind, columns = unpack(packed, 4)
                    kinds.append(kind)
                    rows.append(columns)
                    owners.append(unpack_numbers(owner, ["<i8", "<i8"]))
        if not rows:
            return
        w = np.concatenate([r[2] for r in rows])
        share, missing = shares(np.concatenate(kinds), *(np.concatenate(c) for c in zip(*rows)), shared.value)
        ids, sizes = (np.concatenate(x) for x in zip(*owners))
        del rows, kinds, owners
        back, at = pd.factorize(ids)
        each = np.repeat(back, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int64)), pa.array(np.bincount(each, share, len(at))), pa.array(np.full(len(at), -1)), pa.array(np.zeros(len(at), np.int64))], names)
        rest = pd.DataFrame({"doc_id": at[each[missing]], "w": w[missing].view(np.int64)}).value_counts(sort=False).rename("times").reset_index()
        del share, missing, each, w, back
        _trim()
        yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"].to_numpy()), pa.array(np.zeros(len(rest), np.int64)), pa.array(np.zeros(len(rest))), pa.array(rest["w"].to_numpy()), pa.array(rest["times"].to_numpy())], names)

    rows = positions(docs, partitions, shared).repartitionById(partitions, "part")
    parts = rows.mapInArrow(run, "doc_id long, n long, share double, w long, times long")
    # w is -1 in the sums; elsewhere a word without code that pairs counted less than LEAST times end with, so many times
    parts = stored(parts.repartition("doc_id").groupBy("doc_id", "w").agg(*(F.sum(c).alias(c) for c in ("n", "share", "times"))))
    rest = parts.where("times > 0").join(counts.select(F.col("v").alias("w"), "m"), "w")
    rest = rest.groupBy("doc_id").agg(F.sum(F.col("times") * F.log("m")).alias("share")).select("doc_id", F.lit(0).cast("long").alias("n"), "share")
    sums = parts.where("times = 0").select("doc_id", "n", "share").unionByName(rest).groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum("share").alias("score"))
    return sums.withColumn("perplexity", F.expr("CASE WHEN n_words > 0 THEN exp(-score / n_words) END"))


#: The same in DuckDB. Perplexity and score are compared to six digits after the point.
STUPID_BACKOFF_SQL = r"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10ffff}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
words AS (
  SELECT row_number() OVER () AS r, doc_id, w FROM lists),
rows_ AS (
  SELECT r, doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM words),
grams AS (
  SELECT r, doc_id, word,
    coalesce(lag(word, 1) OVER (PARTITION BY r ORDER BY i), '<s>') AS v,
    coalesce(lag(word, 2) OVER (PARTITION BY r ORDER BY i), '<s>') AS u
  FROM rows_),
counted AS (
  SELECT doc_id, r,
    count(*) OVER (PARTITION BY u, v, word) AS c3, count(*) OVER (PARTITION BY v, word) AS c2,
    count(*) OVER (PARTITION BY v) AS c1, count(*) OVER (PARTITION BY word) AS c0, u, v, word
  FROM grams),
pairs AS (SELECT v, word, count(*) AS n FROM grams GROUP BY ALL),
begins AS (SELECT count(*) AS n FROM grams WHERE v = '<s>'),
shares AS (
  SELECT doc_id, CASE WHEN c3 >= 2
    THEN ln(c3) - ln(CASE WHEN counted.v = '<s>' THEN (SELECT n FROM begins) ELSE pairs.n END)
    WHEN c2 >= 2 THEN ln(0.4) + ln(c2) - ln(c1)
    ELSE 2 * ln(0.4) + ln(c0) - ln((SELECT count(*) FROM grams)) END AS share
  FROM counted LEFT JOIN pairs ON pairs.v = counted.u AND pairs.word = counted.v),
sums AS (SELECT doc_id, count(*) AS n_words, sum(share) AS score FROM shares GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(score, 0.0), 6) AS score,
  CASE WHEN n_words > 0 THEN round(exp(-score / n_words), 6) END AS perplexity
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN sums USING (doc_id)
"""


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 6).alias("score"), F.round("perplexity", 6).alias("perplexity"))
