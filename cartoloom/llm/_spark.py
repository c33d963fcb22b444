"""Session helpers shared by the operators."""

from __future__ import annotations

import ctypes
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from cartoloom.checkpoint import cut, shared_dir

__all__ = ["columns", "cut", "mapped", "removed", "shared_dir", "spared", "stored", "table"]


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def spared(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker gives free memory back to the system.

    Workers outlive tasks and stages; each would keep about the most that any of its tasks took.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):
            pass  # not glibc

    return tidy


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over all columns of df, which run keeps in number and type; it sees them by place, not by name."""
    fields = df.schema.fields
    places = types.StructType([types.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    return df.toDF(*places.fieldNames()).mapInArrow(spared(run), places).toDF(*(f.name for f in fields))


def stored(df: DataFrame) -> DataFrame:
    """Like cut, for wide or large rows: columnar and compressed in the shared folder, with column pruning for the readers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a stored table, once nothing reads it any more."""
    for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
