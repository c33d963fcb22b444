"""Media columns: content-defined chunks of payloads, a deduplicated chunk store, and verified reconstruction.

A gear hash rolls over the payload: h = 2 h + G[byte] modulo 2^32, so it depends on the last 32 bytes. A chunk may end after
any byte where the hash's top CUT_BITS bits are 0; the first such end that leaves at least LEAST bytes is taken, and a chunk
never has more than MOST bytes. The hash of all positions comes from five doubling steps over the batch's bytes.

chunks gives (media_id, seq, start, length, digest, payload): digest is SHA-256, the payload is compressed by itself. The
store keeps one payload for each digest; the owner is the least (media_id, seq). References are those of the distinct media:
rows that repeat one add none, and chunks that only a losing payload has belong to no medium. Media are ordered lists of digests. A
payload can be put together again from the store alone (reconstruct). verify does so for every medium: its store has a part for
each medium, the chunks that it owns, and all else that a medium's list names comes from the parts of the owners. The stored
bytes of each chunk are hashed again and checked against the digest and are put together in order; length and SHA-256 of what
results must be those of the original payload. Payloads are shuffled once, into the store, and only shared ones again.

Of different payloads of a medium that are equally long, the one with the largest polynomial hash counts: the sum of
(byte + 1) * B^(n - 1 - i) modulo 2^61 - 1; that of a concatenation is h(x) B^len(y) + h(y).

A null payload is no medium and has a row without chunks (n_chunks 0, verified null); an empty one has no chunks and is
verified. Repeated rows and null ids: media are told apart by media_id; rows that repeat one are one medium if their payloads
are the same, else the largest payload counts; null ids are left out. Other columns are never looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from cartoloom.llm import _text as T
from cartoloom.llm._spark import cut, table

LEAST, MOST, CUT_BITS = 256, 8192, 10
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6 | 1
GEAR = np.random.default_rng(99).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNK = "seq int, start long, length int, digest binary, payload binary, poly long"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the window of the last 32 bytes, by doubling."""
    h = GEAR[data]
    span = 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is evaluated before it is added
        span *= 2
    return h


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each row of the bytes: the ends of its chunks, from the start of the data."""
    out: list[list[int]] = []
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    lows, highs = np.searchsorted(marks, offsets[:-1], "right"), np.searchsorted(marks, offsets[1:], "right")
    for lo, hi, start, end in zip(lows.tolist(), highs.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, at = [], start
        for m in marks[lo:hi].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST and m - start >= 32:  # the window lies within the row
                ends.append(m)
                at = m
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end > at:
            ends.append(end)
        out.append(ends)
    return out


def polynomial(data: bytes) -> int:
    """The polynomial hash of one payload, eight bytes at a time."""
    h = 0
    for b in data:
        h = (h * BASE + b + 1) % PRIME
    return h


@functools.cache
def _powers(n: int) -> int:
    return pow(BASE, n, PRIME)


def compose(parts: list[tuple[int, int]]) -> int:
    """The hash of a concatenation from the (hash, length) of its parts, in order."""
    h = 0
    for one, length in parts:
        h = (h * _powers(length) + one) % PRIME
    return h


_limbs: list[np.ndarray] = []


def _mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1 for arrays of numbers below it."""
    u = np.uint64
    lo, hi = a & u(0x7FFFFFFF), a >> u(31)
    blo, bhi = b & u(0x7FFFFFFF), b >> u(31)
    mid = lo * bhi + hi * blo  # below 2^62
    out = lo * blo + ((mid & u((1 << 30) - 1)) << u(31)) % u(PRIME) + (mid >> u(30)) + (hi * bhi * u(2)) % u(PRIME)
    return out % u(PRIME)


def polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hashes of the ranges, which are at most MOST bytes each and tile the data in order."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if not _limbs:
        powers = [1]
        for _ in range(MOST):
            powers.append(powers[-1] * BASE % PRIME)
        _limbs.append(np.array(powers, np.uint64))
    length = ends - starts
    exponent = np.repeat(ends, length) - 1 - np.arange(int(starts[0]), int(ends[-1]))
    # (byte + 1) * power: at most 2^9 * 2^61, so the power is split into halves of 31 and 30 bits
    power, value = _limbs[0][exponent], data[int(starts[0]) : int(ends[-1])].astype(np.uint64) + np.uint64(1)
    at = starts - int(starts[0])
    lo = np.add.reduceat((power & np.uint64(0x7FFFFFFF)) * value, at)  # below 2^31 * 2^9 * 2^13
    hi = np.add.reduceat((power >> np.uint64(31)) * value, at)
    return (lo % np.uint64(PRIME) + _mulmod(hi % np.uint64(PRIME), np.full(len(hi), 1 << 31, np.uint64))) % np.uint64(PRIME)


def chunk_batch(payloads: pa.Array, bytes_too: bool = True) -> tuple[list[list[dict]], list[int | None]]:
    """The chunks of each payload, and the hash of the whole; their payloads are null unless bytes_too."""
    data, offsets = T.raw(payloads)
    ends = cut_points(data, offsets)
    flat = np.array([e for row in ends for e in row], np.int64)
    starts = np.r_[0, flat[:-1]] if len(flat) else flat
    poly = polynomials(data, starts, flat).tolist()
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
    view, out, whole, k = memoryview(data), [], [], 0
    valid = payloads.is_valid().to_pylist()
    for r, row in enumerate(ends):
        at, chunks, parts = int(offsets[r]), [], []
        for seq, end in enumerate(row):
            raw = view[at:end]
            chunks.append({"seq": seq, "start": at - int(offsets[r]), "length": end - at, "digest": hashlib.sha256(raw).digest(), "payload": squeeze.compress(raw) if bytes_too else None, "poly": poly[k]})
            parts.append((poly[k], end - at))
            at, k = end, k + 1
        out.append(chunks)
        whole.append(compose(parts) if valid[r] else None)
    return out, whole


CHUNKS = pa.list_(pa.struct([("seq", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("digest", pa.binary()), ("payload", pa.binary()), ("poly", pa.int64())]))


def chunked(media: DataFrame, bytes_too: bool = True) -> DataFrame:
    """(media_id, n_bytes, poly, sha, chunks): chunks in order; payload is null unless bytes_too. media: media_id, payload (text or binary).

    sha is the SHA-256 of the whole payload, from its own bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, "payload", 1 << 19):
                column = piece.column(1)
                column = column.cast(pa.large_binary()).view(pa.large_string()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column
                chunks, whole = chunk_batch(column, bytes_too)
                data, offsets = T.raw(column)
                view, ends = memoryview(data), offsets.tolist()
                sha = [None if one is None else hashlib.sha256(view[a:b]).digest() for one, a, b in zip(whole, ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(offsets)), pa.array(whole, pa.int64()), pa.array(sha, pa.binary()), pa.array(chunks, CHUNKS)], ["media_id", "n_bytes", "poly", "sha", "chunks"])

    return media.where("media_id IS NOT NULL").select(F.col("media_id").cast("long").alias("media_id"), "payload").mapInArrow(run, f"media_id long, n_bytes long, poly long, sha binary, chunks array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>")


def chunk_store(chunks: DataFrame) -> DataFrame:
    """(digest, payload, length): each distinct chunk once. chunks: digest, payload, length, a row for each reference."""
    return chunks.groupBy("digest").agg(F.first("payload").alias("payload"), F.first("length").alias("length"))


def reconstruct(recipes: DataFrame, store: DataFrame) -> DataFrame:
    """(media_id, payload) put together from the store. recipes: media_id, seq, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            whole = [b"".join(expand.decompress(x["payload"]) for x in row) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], ["media_id", "payload"])

    joined = recipes.join(store.select("digest", "payload"), "digest").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("chunks"))
    return joined.mapInArrow(run, "media_id long, payload binary")


def _checked(rows: DataFrame) -> DataFrame:
    """rows with intact: whether the stored bytes have the digest. rows: digest, payload and any others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            intact = [hashlib.sha256(expand.decompress(x)).digest() == d for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(intact, pa.bool_())], [*batch.schema.names, "intact"])

    return rows.mapInArrow(run, types.StructType([*rows.schema.fields, types.StructField("intact", types.BooleanType())]))


def rebuilt(media: DataFrame) -> DataFrame:
    """The media with verified in place of sha and parts: whether the parts, put together in order, are the original's bytes.

    media: media_id, n_bytes, sha, parts (an array of seq, payload, intact in order), digests, shared_chunks, stored_bytes. Parts
    whose intact is null are checked against the digests here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            good = []
            for r in range(batch.num_rows):  # one medium in memory at a time
                n, want, parts = batch.column(1)[r].as_py(), batch.column(2)[r].as_py(), batch.column(3)[r].as_py() or []
                if want is None:
                    good.append(None)
                    continue
                whole, size, intact, digests = hashlib.sha256(), 0, True, batch.column(4)[r]
                for part in parts:
                    raw = expand.decompress(part["payload"])
                    whole.update(raw)
                    size += len(raw)
                    intact &= hashlib.sha256(raw).digest() == digests[part["seq"]].as_py() if part["intact"] is None else part["intact"]
                good.append(intact and size == n and whole.digest() == want)
            digests = batch.column(4)
            count = digests.value_lengths().cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), count, batch.column(5), batch.column(6), digests, pa.array(good, pa.bool_())], ["media_id", "n_bytes", "n_chunks", "shared_chunks", "stored_bytes", "chunks", "verified"])

    return media.select("media_id", "n_bytes", "sha", "parts", "digests", "shared_chunks", "stored_bytes").mapInArrow(run, "media_id long, n_bytes long, n_chunks int, shared_chunks long, stored_bytes long, chunks array<binary>, verified boolean")


def _winners(media: DataFrame, chunk: str, bytes_too: bool = True) -> DataFrame:
    """(media_id, n_bytes, sha, chunks): of each medium's payloads the one that counts; chunk makes one of chunks from c, digest first."""
    one = chunked(media, bytes_too).select("media_id", "n_bytes", "poly", F.expr(f"transform(chunks, c -> {chunk})").alias("chunks"), "sha")
    return one.groupBy("media_id").agg(F.max(F.struct("n_bytes", "poly", "chunks", "sha")).alias("m")).select("media_id", "m.n_bytes", "m.sha", "m.chunks")


def verify(media: DataFrame) -> DataFrame:
    """(media_id, n_bytes, n_chunks, shared_chunks, stored_bytes, chunks, verified) of each medium.

    chunks is the ordered list of digests; stored_bytes is the medium's part of the store (the chunks it owns);
    shared_chunks counts its chunks with further references; verified: rebuilt from the store, it is the original.
    """
    recipe = _winners(media, "c.digest", bytes_too=False).select("media_id", F.posexplode("chunks").alias("seq", "digest"))
    owner = recipe.groupBy("digest").agg(F.min(F.struct("media_id", "seq")).alias("owner"), F.count("*").alias("refs")).where("refs > 1")
    mine = (F.col("owner.media_id") == F.col("media_id")) & (F.col("owner.seq") == F.col("seq"))
    links = cut(recipe.join(owner, "digest").select("media_id", "seq", "digest", mine.alias("mine")))  # of shared chunks only
    marks = links.groupBy("media_id").agg(F.count("*").alias("shared_chunks"), F.collect_list(F.expr("IF(mine, seq, NULL)")).alias("lent"), F.collect_list(F.expr("IF(mine, NULL, seq)")).alias("borrowed"))
    # used twice, but shuffled once: both times it is the same exchange
    held = _winners(media, "struct(c.digest, c.length, c.payload)").join(marks, "media_id", "left")
    lent = _checked(held.select(F.expr("inline(transform(lent, k -> struct(chunks[k].digest, chunks[k].payload)))")))
    got = links.where("NOT mine").join(lent, "digest").groupBy("media_id").agg(F.collect_list(F.struct("seq", "payload", "intact")).alias("got"))
    own = "transform({}, k -> struct(k AS seq, chunks[k].payload AS payload, CAST(NULL AS boolean) AS intact))"
    every = "IF(size(chunks) > 0, sequence(0, size(chunks) - 1), CAST(array() AS array<int>))"
    parts = F.expr(f"CASE WHEN size(borrowed) > 0 THEN array_sort(concat({own.format(f'array_except({every}, borrowed)')}, coalesce(got, array()))) ELSE {own.format(every)} END")
    taken = "aggregate(coalesce(borrowed, array()), 0L, (n, k) -> n + chunks[k].length)"
    return rebuilt(held.join(got, "media_id", "left").select("media_id", "n_bytes", "sha", parts.alias("parts"), F.col("chunks.digest").alias("digests"), F.coalesce("shared_chunks", F.lit(0)).cast("long").alias("shared_chunks"), F.expr(f"n_bytes - {taken}").alias("stored_bytes")))


def as_media(docs: DataFrame, payload: Column | None = None) -> DataFrame:
    """The documents' texts as payloads: the bytes of their UTF-8."""
    return docs.select(F.col("doc_id").alias("media_id"), (F.col("text") if payload is None else payload).alias("payload"))


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(as_media(table(spark, sf_dir, "documents"))).withColumnRenamed("media_id", "doc_id")
