"""Nodes of map extracts in XML; ways and relations, and their tags, are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.functions import tags
from cartoloom.functions.text import number_or_zero
from cartoloom.schemas import XML_NODE


def _columns(node: Column) -> list[Column]:
    lat, lon = number_or_zero(node["_lat"]), number_or_zero(node["_lon"])
    return [F.coalesce(node["_id"], F.lit("")).alias("id"), lat.alias("lat"), lon.alias("lon"), tags.from_pairs(node["tag"]).alias("tags")]


def parse_nodes(xml: DataFrame) -> DataFrame:
    """(id, lat, lon, tags) of rows of XML text: an id that is missing is "", a coordinate that can't be read is 0."""
    return xml.select(F.from_xml("xml", XML_NODE).alias("node")).select(*_columns(F.col("node")))


def read_nodes(spark: SparkSession, path: str, compression: str = "auto", split_bytes: int = 64 << 20) -> DataFrame:
    reader = spark.read.format("xmlrecords").option("rowTag", "node").option("compression", compression).option("splitBytes", str(split_bytes))
    return parse_nodes(reader.load(path))
