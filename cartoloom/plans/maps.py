"""Line GeoJSON to map files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.checkpoint import cut
from cartoloom.operators.sequence import first_n_where
from cartoloom.sinks import mapfiles
from cartoloom.sources.geojson_lines import is_named, read_features


def split(features: DataFrame, limit: int = -1, points: bool = False, tags: bool = False, order: tuple[str, ...] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """(named, unnamed) of features: lat, lon, name and order. limit counts named rows; points drops the named ones, which
    count all the same; tags drops the unnamed ones."""
    kept = first_n_where(features, list(order), limit, is_named(F.col("name")))
    named, unnamed = kept.where(is_named(F.col("name"))), kept.where(~is_named(F.col("name")))
    return (named.where(F.lit(False)) if points else named), (unnamed.where(F.lit(False)) if tags else unnamed)


def write_map(spark: SparkSession, path: str, out: str, limit: int = -1, points: bool = False, tags: bool = False) -> DataFrame:
    """Write the files out.*; gives the errors (line, reason). Rows keep the order of the lines within the file."""
    features, errors = read_features(spark, path)
    numbered = cut(features.select("lat", "lon", "name", F.monotonically_increasing_id().alias("seq")))
    mapfiles.write(*split(numbered, limit, points, tags), out, ["seq"])
    return errors
