"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. The budget of a source is its weight (1 where none is given) times
a unit that all sources can supply: the least supply per weight. Sources without tokens don't count for the unit, nor do
scarce ones, whose supply per weight is below a given part of the (upper) median of all; they give all they have and leave the
others' budgets alone. A source without tokens has the budget 0. The registered query and the stage mix to WEIGHTS with SCARCE. Within a source each length first gives its
proportional whole number of documents; what remains of the budget is filled by one document per length in a seeded
order, and the last tokens by a bounded-knapsack dynamic program that finds the subset of the remaining documents whose
lengths come nearest to the rest without exceeding it. Where that leaves tokens over, picks are undone and the program runs
over them as well, in windows that double until the budget is met, all picks are undone (then the result is the best that
any subset gives), or the window is beyond WINDOW and eight times the longest document. Which documents of a length are taken is decided by a seeded hash.

Rows without doc_id are never taken; rows of one doc_id are taken or left together, and their lengths add up. A null
source is a source of its own. Texts without a token count as length 0 and are taken proportionally. Ties go by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoloom.llm import _text as T
from cartoloom.llm import bpe
from cartoloom.llm._spark import columns, cut, spared, table

SEED = 17
#: Target weights of the registered query and the stage: src0, the largest source, counts double; all others count 1.
WEIGHTS = {"src0": 2.0}
#: Sources with less than this part of the median supply per weight are scarce for them.
SCARCE = 0.1
#: A rest of the budget up to this many tokens goes to the dynamic program.
KNAPSACK = 16_384
#: Undone picks of up to this many tokens, or eight times the longest document, are tried again.
WINDOW = 1 << 20
#: Documents of one source and length are ranked in buckets of about so many.
RANKED = 1 << 16


def token_lengths(docs: DataFrame, *columns: str, folder: str = bpe.TOKENIZERS, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """The columns, which must be of the documents, and n_tokens, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.tokenizer(folder, vocabulary)
        for batch in batches:
            for piece in T.pieces(batch, "text", 1 << 20):
                n = coder.lengths(piece.column(len(columns)))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(columns)], pa.array(n)], [*columns, "n_tokens"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(spared(run), f"{kinds}, n_tokens long")


def nearest_subset(lengths: list[int], counts: list[int], rest: int) -> dict[int, int]:
    """How many of each length to take (at most its count) so that their sum is the largest that rest allows."""
    full = (1 << (rest + 1)) - 1
    reach, steps, first = 1, [], np.zeros(rest + 1, np.int32)  # first: the step that first reaches each sum
    for length, count in zip(lengths, counts):
        if not 0 < length <= rest:
            continue
        count, chunk = min(count, rest // length), 1
        while count:  # binary splitting makes the bounded counts single items
            n = min(chunk, count)
            new = reach << (length * n) & full & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                steps.append((length, n))
                reach |= new
            count, chunk = count - n, chunk * 2
        if reach >> rest & 1:
            break
    at, take = reach.bit_length() - 1, {}
    while at:
        length, n = steps[first[at]]
        take[length] = take.get(length, 0) + n
        at -= length * n
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take: at most budget tokens in all, as near to it as the method comes."""
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((lengths * take).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    moved, whole = True, False
    while rest > KNAPSACK and moved:
        moved = False
        for i in order:
            if rest <= KNAPSACK:
                break
            if take[i] < counts[i] and 0 < lengths[i] <= rest:
                take[i] += 1
                rest -= int(lengths[i])
                moved = True
    usable = lengths[(lengths > 0) & (lengths <= budget)]
    longest, step = (int(usable.max()), int(np.gcd.reduce(usable))) if len(usable) else (0, 1)
    window, most = max(KNAPSACK, 2 * longest), max(WINDOW, 8 * longest)
    while True:
        if rest > 0:
            found = nearest_subset([int(x) for x in lengths[order]], [int(x) for x in (counts - take)[order]], rest)
            for i, length in enumerate(lengths):
                take[i] += found.get(int(length), 0)
                rest -= int(length) * found.get(int(length), 0)
        if rest < step or whole or window > most:  # sums are multiples of step
            return take
        while rest < window and (lengths * take).any():  # undo picks of every length
            for i in order:
                if take[i] and lengths[i] and rest < window:
                    n = min(int(take[i]), max(1, int(take[i]) * window // budget))
                    take[i] -= n
                    rest += n * int(lengths[i])
        whole = not (lengths * take).any()
        window *= 2


def mix(lengths: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, scarce: float = 0.0) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents taken. lengths: doc_id, source, n_tokens, one row for each doc_id."""
    cells = cut(lengths.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")))
    supply = cells.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("supply"))
    # no table of the weights: rows made in Python take a second set of workers, which stay in every executor
    weight = F.coalesce(*(F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in (weights or {}).items()), F.lit(1.0))
    supply = supply.select("source", "supply", weight.alias("weight"))
    supply = supply.withColumn("each", F.expr("CASE WHEN supply > 0 AND weight > 0 THEN supply / weight END"))
    middle = supply.agg(F.expr("sort_array(collect_list(each))").alias("all")).select(F.expr("get(all, cast(size(all) div 2 AS int))").alias("middle"))
    least = supply.crossJoin(middle).where(F.col("each") >= F.col("middle") * scarce).agg(F.min("each").alias("unit"))
    whole = F.when(F.col("each") <= F.col("unit"), F.col("supply")).otherwise(F.coalesce(F.floor(F.col("unit") * F.col("weight")), F.lit(0)))
    budgets = supply.crossJoin(least).select(F.col("source").alias("of"), whole.cast("long").alias("budget"))

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("n_tokens")
        take = fit(cell["n_tokens"].to_numpy(), cell["docs"].to_numpy(), int(cell["budget"].iloc[0]), seed)
        return pd.DataFrame({"source": cell["source"], "n_tokens": cell["n_tokens"], "take": take})

    here = cells.join(budgets, F.col("source").eqNullSafe(F.col("of"))).select("source", "n_tokens", "docs", "budget")
    takes = here.groupBy("source").applyInPandas(run, "source string, n_tokens long, take long").where("take > 0")
    docs = cells.select(F.col("source").alias("s"), F.col("n_tokens").alias("n"), "docs")
    takes = takes.join(docs, F.col("source").eqNullSafe(F.col("s")) & (F.col("n_tokens") == F.col("n")))
    return taken(lengths, cut(takes.select("source", "n_tokens", "take", "docs")), seed)


def taken(lengths: DataFrame, takes: DataFrame, seed: int, size: int = RANKED) -> DataFrame:
    """Of each source and length the documents whose seeded hashes come first. takes: source, n_tokens, take, docs.

    The documents of a source and length lie in buckets of the hash, about size in each and in order of it. The counts of the
    buckets show which are taken whole and which not at all; only the one at the border is ranked, however many are alike.
    """
    cell = ["source", "n_tokens"]

    def joined(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
        own = other.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in other.columns))
        return rows.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))

    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)  # 63 bits, of which the upper 32 make the bucket
    rows = joined(lengths, takes, *cell).withColumn("hash", hashed).withColumn("bucket", F.expr(f"shiftright(hash, 31) * (docs div {size} + 1) div {1 << 32}"))
    parts = rows.where("take < docs")
    counts = parts.groupBy(*cell, "bucket").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    parts = joined(parts, counts, *cell, "bucket").where("before < take")
    rank = F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("hash", "doc_id"))
    border = parts.where("before + here > take").withColumn("rank", rank).where("before + rank <= take")
    return rows.where("take = docs").select("doc_id", *cell).union(parts.where("before + here <= take").select("doc_id", *cell)).union(border.select("doc_id", *cell))


def _measured(docs: DataFrame, **tokenizer: str) -> DataFrame:
    rows = token_lengths(docs.where("doc_id IS NOT NULL"), "doc_id", "source", **tokenizer)
    return cut(rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The documents taken, with all their columns."""
    return docs.join(mix(_measured(docs), WEIGHTS, scarce=SCARCE).select("doc_id"), "doc_id", "left_semi").select(*columns(docs))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_measured(table(spark, sf_dir, "documents")), WEIGHTS, scarce=SCARCE)
