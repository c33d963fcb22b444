"""Token ids as canonical length-limited Huffman code.

The ids of all texts are counted over the whole table; package-merge gives code lengths of at most MOST_BITS bits that are
optimal under that limit, and the canonical code follows from the lengths alone. A text's ids are written most significant
bit first, in blocks of BLOCK ids; a checkpoint holds the bit offset of each block's first code, so blocks decode
independently. The decoder looks MOST_BITS bits up in one table (symbol and length) and takes all blocks of a batch in step.

Null texts and texts without a token have no ids: an empty payload, no checkpoint, 0 tokens. Where there is one symbol only,
its code has one bit. An empty table has an empty code. Rows are coded one by one: repeated rows are counted and coded as
often as they occur, a null doc_id passes through, and other columns are never looked at. Ids of MOST_IDS or more are an
error, never wrapped. The vocabulary's folder must be on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.llm import _text as T
from cartoloom.llm import bpe
from cartoloom.llm._spark import stored, table

MOST_BITS = 16
BLOCK = 256
#: Ids travel in 16 bits; a vocabulary with larger ones is refused.
MOST_IDS = 1 << 16


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits for the counts (0 for a count of 0), by package-merge."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) == 0:
        return lengths
    if len(symbols) == 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << most:
        raise ValueError(f"{len(symbols)} symbols don't fit codes of {most} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaf = counts[symbols].astype(np.float64)
    # each level merges the leaves with the packages (pairs) of the level below; only how many leaves it takes matters
    levels, package = [], np.zeros(0)
    for _ in range(most):
        both = np.concatenate([leaf, package])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaf))
        merged = both[order]
        package = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(symbols) - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[symbols[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


@dataclass
class Code:
    """lengths and canonical codes by symbol; symbol and width by the next MOST_BITS bits."""

    lengths: np.ndarray
    codes: np.ndarray
    symbol: np.ndarray
    width: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Code:
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
        codes = np.zeros(len(lengths), np.uint32)
        symbol, width = np.zeros(1 << MOST_BITS, np.int32), np.zeros(1 << MOST_BITS, np.uint8)
        span = 1 << (MOST_BITS - lengths[symbols].astype(np.int64))
        start = np.cumsum(span) - span
        codes[symbols] = start >> (MOST_BITS - lengths[symbols].astype(np.int64))
        at = np.repeat(symbols, span)
        symbol[: len(at)] = at
        width[: len(at)] = lengths[at]
        return Code(lengths, codes, symbol, width)

    def encode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[list[int]]]:
        """Payload and checkpoints of each row of ids; every payload begins at a byte."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        bits = ends[offsets[1:]] - ends[offsets[:-1]]  # of each row
        room = (bits + 7) // 8 * 8
        base = np.cumsum(room) - room
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = ends[:-1] - ends[offsets[:-1]][row] + base[row]
        # a code of at most 16 bits that begins in byte b lies in bytes b to b + 2
        shifted = self.codes[ids].astype(np.int64) << (24 - size - (at & 7))
        out = np.zeros(int(room.sum()) // 8 + 3, np.int64)
        for k in range(3):
            part = (shifted >> (16 - 8 * k)) & 255
            out += np.bincount((at >> 3) + k, part, len(out)).astype(np.int64)
        data = out.astype(np.uint8).tobytes()
        payload = [data[b // 8 : (b + r) // 8] for b, r in zip(base.tolist(), room.tolist())]
        marks = [(ends[a:b:BLOCK] - ends[a]).tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return payload, marks

    def decode(self, payload: list[bytes], marks: list[list[int]], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and their row offsets: all blocks of all payloads in step, a table look-up for each id."""
        data = np.frombuffer(b"".join(payload) + b"\0\0\0\0", np.uint8).astype(np.int64)
        base = np.cumsum([0, *map(len, payload)])[:-1] * 8
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        ids = np.zeros(int(offsets[-1]), np.int32)
        per_row = np.array([len(m) for m in marks], np.int64)
        if per_row.sum() == 0:
            return ids, offsets
        row = np.repeat(np.arange(len(marks)), per_row)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        at = np.concatenate([np.asarray(m, np.int64) for m in marks if len(m)]) + base[row]
        left = np.minimum(counts[row] - nth * BLOCK, BLOCK)
        to = offsets[row] + nth * BLOCK
        order = np.argsort(-left, kind="stable")
        at, left, to = at[order], left[order], to[order]
        active = np.searchsorted(-left, -np.arange(int(left[0])), "left")
        for t in range(int(left[0])):
            m = active[t]
            byte, bit = at[:m] >> 3, at[:m] & 7
            window = (data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]) >> (8 - bit) & 0xFFFF
            ids[to[:m] + t] = self.symbol[window]
            at[:m] += self.width[window]
        return ids, offsets


def token_ids(docs: DataFrame, folder: str = bpe.TOKENIZERS, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each text as little-endian 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.tokenizer(folder, vocabulary)
        for batch in batches:
            for piece in T.pieces(batch, "text", 1 << 20):
                ids, offsets = coder.encode(piece.column(1))
                if len(ids) and int(ids.max()) >= MOST_IDS:
                    raise ValueError(f"token id {int(ids.max())} doesn't fit 16 bits")
                data = pa.py_buffer(ids.astype("<u2").tobytes())
                binary = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 2).astype(np.int32).tobytes()), data])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(offsets)), binary], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = T.raw(column.cast(pa.large_binary()).view(pa.large_string()))
    return data.view("<u2") if len(data) else np.zeros(0, np.uint16), offsets // 2


def count_ids(tokens: DataFrame) -> np.ndarray:
    """The count of every id over the whole table; each task sends one row for each id that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MOST_IDS, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch.column(0))[0], minlength=MOST_IDS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    counts = np.zeros(MOST_IDS, np.int64)
    found = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()  # at most 65,536 rows
    return counts


def encode(tokens: DataFrame, code: Code) -> DataFrame:
    """(doc_id, n_tokens, payload, checkpoints, verified); verified: the payload decodes to the ids again."""
    shared = tokens.sparkSession.sparkContext.broadcast(code)  # at most 1.2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, "ids", 1 << 20):
                ids, offsets = _ids(piece.column(2))
                payload, marks = shared.value.encode(ids, offsets)
                again, borders = shared.value.decode(payload, marks, np.diff(offsets))
                wrong = np.concatenate([[0], np.cumsum(again != ids)])
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(payload, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(wrong[borders[1:]] == wrong[borders[:-1]])], ["doc_id", "n_tokens", "payload", "checkpoints", "verified"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, n_tokens long, payload binary, checkpoints array<long>, verified boolean")


def lengths_row(code: Code, like: DataFrame) -> DataFrame:
    """A row like those of encode: the code lengths by id, one byte each, as payload; n_tokens, checkpoints and verified null."""
    row = like.sparkSession.createDataFrame([(bytearray(code.lengths.tobytes()),)], "lengths binary")
    return row.select(*(F.col("lengths").alias(c) if c == "payload" else F.lit(None).cast(t.dataType).alias(c) for c, t in ((t.name, t) for t in like.schema)))


def op6_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of encode, and one with n_tokens null whose payload holds the code lengths: all that decoding needs."""
    tokens = stored(token_ids(table(spark, sf_dir, "documents")))
    code = Code.of(code_lengths(count_ids(tokens)))
    rows = encode(tokens, code)
    return rows.unionByName(lengths_row(code, rows))
