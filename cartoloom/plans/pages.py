"""Encyclopedia pages to GeoJSON points, or to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.functions import coord
from cartoloom.functions.text import token_list
from cartoloom.operators.sequence import first_n
from cartoloom.sinks import lines
from cartoloom.sources.wiki_xml import read_pages


def located(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of pages: points have id, title, lat, lon; errors id, title, reason.

    Pages without a template are in neither; pages without a revision are errors.
    """
    parsed = pages.select("id", "title", "text", coord.parse(F.col("text")).alias("at"))
    points = parsed.where(F.col("at.lat").isNotNull()).select("id", "title", "at.lat", "at.lon")
    reason = F.when(F.col("text").isNull(), "no revision").otherwise(F.col("at.error"))
    return points, parsed.select("id", "title", reason.alias("reason")).where("reason IS NOT NULL")


def point_lines(points: DataFrame) -> DataFrame:
    return lines.point_features(points, F.struct(F.col("title").alias("name")))


def tokenised(pages: DataFrame, limit: int = -1) -> DataFrame:
    """(id, tokens) of the pages, in order of id if there is a limit (-1: none)."""
    return first_n(pages.select("id", "text"), ["id"], limit).select("id", token_list(F.coalesce("text", F.lit(""))).alias("tokens"))


def page_point_lines(spark: SparkSession, path: str, index: str | None = None, compression: str = "auto") -> tuple[DataFrame, DataFrame]:
    points, errors = located(read_pages(spark, path, index, compression))
    return point_lines(points), errors


def page_token_lines(spark: SparkSession, path: str, index: str | None = None, compression: str = "auto", limit: int = 100_000) -> DataFrame:
    return lines.token_rows(tokenised(read_pages(spark, path, index, compression), limit))
