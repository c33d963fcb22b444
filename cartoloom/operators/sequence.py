"""Global sequences without a global sort on one task: totals per partition, then offsets beside each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.checkpoint import cut


def running(df: DataFrame, order: list[str], size: Column, offset: str = "offset", index: str = "index", buckets: int | None = None) -> DataFrame:
    """df with the exclusive running sum of size and the row number from 0, in the global order.

    Rows are range-partitioned by the order, so each partition is an interval of it. A partition's own running sums need
    no other rows; what comes before it is one number per partition, of which there are as many as shuffle partitions.
    Rows that tie in the order are told apart by their place in it, so order should be unique.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = {*df.columns}
    name = lambda stem: stem if stem not in taken else "_" + "_".join([stem, *df.columns])
    part, own = name("part"), name("size")
    ranged = df.withColumn(own, size.cast("long")).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    ranged = cut(ranged)  # range borders are sampled: used twice, they must be the same
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(offset, F.coalesce(F.sum(own).over(w), F.lit(0))).withColumn(index, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    totals = ranged.groupBy(part).agg(F.sum(own).alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = totals.select(F.col(part).alias("of"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    out = local.join(F.broadcast(starts), F.col(part) == F.col("of"))
    return out.select(*df.columns, (F.col(offset) + F.col("bytes_before")).alias(offset), (F.col(index) + F.col("rows_before")).alias(index))


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Exactly the first n rows in order (all for -1): a top-k on every task, not a global sort."""
    return df if n < 0 else df.orderBy(*order).limit(n)


def first_n_where(df: DataFrame, order: list[str], n: int, counted: Column) -> DataFrame:
    """The first n counted rows, and all rows that don't count and come before the next counted one (all rows for -1)."""
    if n < 0:
        return df
    # the first counted row beyond the limit: the greatest of a top-(n + 1)
    keys = df.where(counted).select(F.struct(*order).alias("key")).orderBy("key").limit(n + 1)
    stop = keys.groupBy().agg(F.when(F.count("*") > n, F.max("key")).alias("stop"))
    return df.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.struct(*order) < F.col("stop"))).select(*df.columns)


def first_match(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """(group, name): the value of the first row of each group; one aggregation, no sort."""
    return df.groupBy(*group).agg(F.min_by(value, F.struct(*order)).alias(name))


def midpoint(df: DataFrame, group: list[str], order: list[str], size: Column, names: tuple[str, str] = ("before", "half")) -> DataFrame:
    """For each group the first row at which the running sum of size goes beyond half of the group's."""
    w = Window.partitionBy(*group).orderBy(*order)
    before, half = names
    all_rows = Window.partitionBy(*group)
    out = df.withColumn(before, F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn(half, F.sum(size).over(all_rows) / 2)
    hit = (F.col(before) + size > F.col(half)) & (F.col(before) <= F.col(half))
    return out.where(hit)


def circular(df: DataFrame, group: list[str], order: list[str], value: str, before: str = "before", after: str = "after") -> DataFrame:
    """The value before and after each row of its group; both ends wrap."""
    w, whole = Window.partitionBy(*group).orderBy(*order), Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(before, F.coalesce(F.lag(value).over(w), F.last(value).over(whole))).withColumn(after, F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))
