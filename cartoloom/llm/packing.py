"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted, each at a cost. Pieces are placed in order of decreasing length, each into the
open bin that it leaves fullest (best fit). Where none has room, a bin of the size with the least net cost is opened: its
cost less the worth of the room that the pieces still to come can use, at the least cost per token of any size. At the
end each bin is downsized to the least permitted size that holds its contents.

A document longer than the largest size is cut into pieces of that size and a rest. Documents are packed in shards of
about SHARD_TOKENS tokens or SHARD_PIECES pieces, whichever makes more, by a hash of doc_id; their number grows with the
table, so a shard's work and memory are bounded. Bins never cross shards: each leaves at most a few part-filled ones.

Rows without doc_id and texts without a token give no piece. Rows that repeat a doc_id are packed as one document that
has the sum of their lengths. Ties in length go by doc_id. An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.llm._spark import cut, table
from cartoloom.llm.mixing import token_lengths

SIZES = (512, 1024, 2048, 4096, 8192)
SHARD_TOKENS = 1 << 25
SHARD_PIECES = 1 << 18
SCHEMA = "doc_id long, piece int, token_start long, n_tokens long, bin_id long, bin_size int, position int"


def cost(size: int) -> float:
    """Linear work, attention's quadratic work, and a constant for each bin."""
    return size + size * size / 65_536 + 64


def best_size(length: int, later: int, sizes: tuple[int, ...]) -> int:
    """The permitted size of at least length with the least net cost; later: tokens still to come."""
    unit = min(cost(s) / s for s in sizes)
    return min((cost(s) - unit * min(s - length, later), s) for s in sizes if s >= length)[1]


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, position of each piece in its bin, size of each bin). lengths: decreasing, at most the largest."""
    room: list[list[int]] = [[] for _ in range(max(sizes) + 1)]  # open bins by room, the latest last
    have = 0  # bit r: some bin has room r
    bins, at, used = [], [], []
    later = sum(lengths)
    for length in lengths:
        later -= length
        fits = have >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                have ^= 1 << r
        else:
            b, r = len(used), best_size(length, later, sizes)
            used.append(0)
        bins.append(b)
        at.append(used[b])
        used[b] += length
        if r > length:
            room[r - length].append(b)
            have |= 1 << (r - length)
    return bins, at, [next(s for s in sorted(sizes) if s >= u) for u in used]


def pack_lengths(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, shard_tokens: int = SHARD_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece (SCHEMA). lengths: doc_id, n_tokens, one row for each doc_id."""
    most = max(sizes)
    found = lengths.where("n_tokens > 0").agg(F.sum("n_tokens"), F.sum(F.expr(f"(n_tokens - 1) div {most} + 1"))).first()
    shards = max(1, *(int(-(-(n or 0) // each)) for n, each in zip(found, (shard_tokens, shard_pieces))))
    cuts = F.expr(f"sequence(0L, (n_tokens - 1) div {most})")
    pieces = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(cuts).alias("piece"))
    pieces = pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("token_start"), F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most).cast("long").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        bins, at, size = pack(pdf["n_tokens"].tolist(), sizes)
        return pdf.assign(bin_id=[(int(pdf["shard"].iloc[0]) << 32) + b for b in bins], bin_size=[size[b] for b in bins], position=at)[[c.split()[0] for c in SCHEMA.split(", ")]]

    return pieces.groupBy("shard").applyInPandas(run, SCHEMA)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The pieces of all documents and their bins (SCHEMA)."""
    rows = token_lengths(docs.where("doc_id IS NOT NULL"), "doc_id")
    return pack_lengths(cut(rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark, table(spark, sf_dir, "documents"))
