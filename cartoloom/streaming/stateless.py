"""The stateless tools over folders that files are added to: Structured Streaming file sources.

Joins, limits and global sequences need whole inputs and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartoloom.plans import extracts, pages
from cartoloom.schemas import XML_NODE, XML_PAGE
from cartoloom.sources import osm_xml
from cartoloom.sources.geojson_lines import parse_lines


def stream_nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.format("xml").option("rowTag", "node").schema(XML_NODE).load(folder)
    return rows.select(*osm_xml._columns(F.struct("*")))


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(XML_PAGE).load(folder)
    return rows.select("id", "title", "ns", F.get("revision", F.lit(0))["text"]["_VALUE"].alias("text"))


def stream_features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.readStream.text(folder))


def stream_node_lines(spark: SparkSession, folder: str) -> DataFrame:
    return extracts.point_lines(stream_nodes(spark, folder))


def stream_page_points(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lines, errors)."""
    points, errors = pages.located(stream_pages(spark, folder))
    return pages.point_lines(points), errors


def stream_page_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return pages.tokenised(stream_pages(spark, folder))


def write_lines(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append lines to text files, each input file once; ends when all that is there is done."""
    return rows.select("value").writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
