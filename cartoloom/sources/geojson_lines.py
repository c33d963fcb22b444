"""Line-delimited GeoJSON points, of any line length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "type string, id string, geometry struct<type: string, coordinates: array<double>>, properties map<string,string>, _corrupt_record string"


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, errors): features have id, lat, lon, properties, name; errors have line and reason.

    A line that isn't JSON is an error, as is a name that isn't a string; empty lines don't count.
    """
    raw = F.get_json_object("value", "$.properties.name")
    # a string's JSON begins with a quote: get_json_object drops it, to a variant it stays a type
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.properties.name", "variant"))
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("f"), raw.alias("name"), kind.alias("kind"))
    reason = F.when(F.col("f._corrupt_record").isNotNull() | F.col("f").isNull(), "not JSON").when(F.col("name").isNotNull() & (F.col("kind") != "STRING"), "the name is not a string")
    parsed = parsed.withColumn("reason", reason)
    coordinates = F.col("f.geometry.coordinates")
    number = lambda k: F.coalesce(F.get(coordinates, F.lit(k)), F.lit(0.0))
    features = parsed.where("reason IS NULL").select("f.id", number(1).alias("lat"), number(0).alias("lon"), F.col("f.properties").alias("properties"), "name")
    return features, parsed.where("reason IS NOT NULL").select(F.col("value").alias("line"), "reason")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path))


def is_named(name: Column) -> Column:
    """A name counts from two bytes on."""
    return F.coalesce(F.octet_length(name) > 1, F.lit(False))
