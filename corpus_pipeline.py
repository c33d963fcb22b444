"""The corpus pipeline: quality rules, near-dedup, PII, mixing and packing over documents.

Each stage works on all rows that its predecessor kept, over their whole texts, and all but the last return the columns of
documents, whatever further columns there are and whatever their names. Null and empty texts go through the rules as empty
texts; they have no near copies, no PII and no tokens, so mixing takes them in proportion and packing gives them no piece.
Rows without doc_id leave at mixing. Rows that repeat a doc_id are judged one by one by the rules; near-dedup keeps the one
with the largest text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartoloom.llm import mixing, packing, pii, quality, simhash
from cartoloom.llm._spark import removed, stored, table

STAGES = [
    ("quality_rules", quality.filter_quality),
    ("simhash_near_dedup", simhash.near_dedup),
    ("pii", pii.redact),
    ("mix_sources", mixing.mix_sources),
    ("best_fit_packing", packing.best_fit_pack),
]

#: The fitted models and the knapsack of a stage have no equivalent in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage returned is deleted as soon as the next one's result is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                removed(spark, before)
            before = docs
    return docs
