"""Map extracts to denormalised JSON lines, or to GeoJSON points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.checkpoint import stored
from cartoloom.functions import tags
from cartoloom.operators.denormalise import has_way_member, located, measured, needed_way_ids, node_members, placed_relations, way_points
from cartoloom.sinks import lines
from cartoloom.sources.osm_pbf import read_kinds
from cartoloom.sources.osm_xml import read_nodes


def denormalised(nodes: DataFrame, ways: DataFrame, relations: DataFrame, conditions: str | None, way_nodes: bool = False, node_features: bool = False, rounded: bool = False) -> DataFrame:
    """(value): nodes, ways and relations that meet the conditions, as JSON lines; None lets all pass.

    node_features prints nodes as GeoJSON features instead of typed records. The nodes are shuffled once, to keep those that
    a wanted way or relation needs; these are stored, as are the measured ways, which both kinds of lines come from.
    """
    kept = nodes.where(tags.matches(F.col("tags"), conditions))
    kept = kept if conditions is None else kept.where(tags.has_tags(F.col("tags")))
    wanted = relations.where(tags.matches(F.col("tags"), conditions) & has_way_member())
    used = needed_way_ids(wanted).withColumn("used", F.lit(True))
    flagged = ways.join(used, "id", "left").withColumn("own", tags.matches(F.col("tags"), conditions)).where("own OR used")
    ids = flagged.select(F.explode("node_ids").alias("id")).union(node_members(wanted)).distinct()
    points = stored(located(nodes.join(ids, "id", "left_semi"), rounded))
    shown = measured(way_points(flagged, points)).select("id", *(["points"] if way_nodes else []), "centroid", "bounds")
    measures = stored(flagged.select("id", "tags", "own").join(shown, "id"))
    way_lines = lines.way_records(measures.where("own"), way_nodes)
    relation_lines = lines.relation_records(placed_relations(wanted, measures, points))
    return (lines.node_features if node_features else lines.node_records)(kept).union(way_lines).union(relation_lines)


def extract_lines(spark: SparkSession, path: str, conditions: str | None, way_nodes: bool = False, node_features: bool = False) -> DataFrame:
    return denormalised(*read_kinds(spark, path), conditions, way_nodes, node_features, rounded=True)


def point_lines(nodes: DataFrame) -> DataFrame:
    """(value): GeoJSON features with id and properties. nodes: id (text), lat, lon, tags."""
    return lines.point_features(nodes, F.col("tags"), F.col("id"))


def xml_point_lines(spark: SparkSession, path: str, compression: str = "auto") -> DataFrame:
    return point_lines(read_nodes(spark, path, compression))
