"""Id sets and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def id_set(df: DataFrame, column: str = "id") -> DataFrame:
    return df.select(F.col(column).alias("id")).where("id IS NOT NULL").distinct()


def contains(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose id is in the set."""
    return df.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def either(*sets: DataFrame) -> DataFrame:
    """Ids that are in any of the sets."""
    out = sets[0]
    for other in sets[1:]:
        out = out.union(other)
    return out.distinct()


def cardinality(ids: DataFrame) -> DataFrame:
    """(n): exact number of distinct ids. Bitmaps of 32 KB ids each: partial counts combine before the shuffle."""
    buckets = ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return buckets.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def is_empty(ids: DataFrame) -> bool:
    return ids.isEmpty()


def members_of(members: Column, kind: int) -> Column:
    return F.size(F.filter(members, lambda m: m["type"] == kind))


def member_counts(relations: DataFrame) -> DataFrame:
    """(id, nodes, ways, relations): members of each type."""
    m = F.col("members")
    return relations.select("id", *(members_of(m, k).alias(n) for k, n in enumerate(("nodes", "ways", "relations"))))


def save(path: str, **sets: DataFrame) -> None:
    """Write id sets as one table, with a folder for each name."""
    parts = [ids.select("id", F.lit(name).alias("name")) for name, ids in sorted(sets.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    out.write.mode("overwrite").partitionBy("name").parquet(path)


def load(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    """The sets of these names; a name that isn't there has no ids."""
    rows = spark.read.schema("id long, name string").parquet(path)
    return [rows.where(F.col("name") == name).select("id") for name in names]


def statistics(**sets: DataFrame) -> DataFrame:
    """(name, n) for each id set."""
    parts = [cardinality(ids).select(F.lit(name).alias("name"), "n") for name, ids in sorted(sets.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def save_set(ids: DataFrame, path: str) -> None:
    ids.write.mode("overwrite").parquet(path)


def entities(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """One stream of all kinds; columns that a kind lacks are null."""
    kinds = [df.withColumn("type", F.lit(kind)) for kind, df in (("node", nodes), ("way", ways), ("relation", relations))]
    return kinds[0].unionByName(kinds[1], allowMissingColumns=True).unionByName(kinds[2], allowMissingColumns=True)
