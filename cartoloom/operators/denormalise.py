"""Ways and relations with the coordinates of what they refer to, by ordered equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.functions import codec, geo
from cartoloom.functions import tags as tag_functions
from cartoloom.functions.text import round_coordinate
from cartoloom.operators.sequence import first_match
from cartoloom.schemas import NODE_TYPE, WAY_TYPE


def located(nodes: DataFrame, rounded: bool = False) -> DataFrame:
    """(id, lat, lon, entrance, wheelchair); rounded to seven places first if the source is finer."""
    lat, lon = (round_coordinate(F.col(c)) if rounded else F.col(c) for c in ("lat", "lon"))
    return nodes.select("id", lat.alias("lat"), lon.alias("lon"), codec.entrance_class(F.col("tags")).alias("entrance"), codec.wheelchair_class(F.col("tags")).alias("wheelchair"))


def way_points(ways: DataFrame, points: DataFrame) -> DataFrame:
    """(id, points): the points of each way in its order, repeats kept.

    All or nothing: a way with a node that isn't there is left out, and so is one without nodes. ways: id, node_ids.
    """
    refs = ways.select("id", F.posexplode("node_ids").alias("pos", "node_id"))
    found = refs.join(points.withColumnRenamed("id", "point_id"), F.col("node_id") == F.col("point_id"), "left")
    item = F.struct("pos", F.struct("lat", "lon", "entrance", "wheelchair").alias("point"))
    grouped = found.groupBy("id").agg(F.collect_list(item).alias("items"), F.bool_and(F.col("point_id").isNotNull()).alias("whole"))
    return grouped.where("whole").select("id", F.transform(F.array_sort("items"), lambda x: x["point"]).alias("points"))


def measured(points: DataFrame) -> DataFrame:
    """(id, points, centroid, bounds) of (id, points)."""
    p = F.col("points")
    return points.select("id", "points", geo.centroid(p).alias("centroid"), geo.bounds(p).alias("bounds"))


def denormalised_ways(ways: DataFrame, nodes: DataFrame, conditions: str | None = None, rounded: bool = False) -> DataFrame:
    """(id, tags, centroid, bounds, points) of the ways whose tags meet the conditions."""
    wanted = ways.where(tag_functions.matches(F.col("tags"), conditions))
    return wanted.select("id", "tags").join(measured(way_points(wanted, located(nodes, rounded))), "id")


def has_way_member():
    return F.exists("members", lambda m: m["type"] == WAY_TYPE)


def needed_way_ids(relations: DataFrame) -> DataFrame:
    """Distinct ids of the ways that the relations refer to."""
    return relations.select(F.explode("members").alias("m")).where(F.col("m.type") == WAY_TYPE).select(F.col("m.id").alias("id")).distinct()


def node_members(relations: DataFrame) -> DataFrame:
    """(id) of the relations' own node members, with repeats."""
    return relations.select(F.explode("members").alias("m")).where(F.col("m.type") == NODE_TYPE).select(F.col("m.id").alias("id"))


def needed_node_ids(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Distinct ids of the nodes of those ways, and of the relations' own node members."""
    inner = ways.join(needed_way_ids(relations), "id", "left_semi").select(F.explode("node_ids").alias("id"))
    return inner.union(node_members(relations)).distinct()


def relation_ways(relations: DataFrame, way_boxes: DataFrame) -> DataFrame:
    """(relation_id, pos, way_id, centroid, bounds): member ways up to the first that can't be resolved.

    way_boxes: id, centroid, bounds. Positions are those among the relation's way members; later ways are dropped.
    """
    ways = F.filter("members", lambda m: m["type"] == WAY_TYPE)
    refs = relations.select(F.col("id").alias("relation_id"), F.posexplode(ways).alias("pos", "m")).select("relation_id", "pos", F.col("m.id").alias("way_id"))
    found = refs.join(way_boxes.withColumnRenamed("id", "found_id"), F.col("way_id") == F.col("found_id"), "left")
    # the first failure is the relation's own minimum: grouped once and joined on the key it is partitioned by
    item = F.struct("pos", "way_id", F.col("found_id").isNotNull().alias("ok"), "centroid", "bounds")
    grouped = found.groupBy("relation_id").agg(F.collect_list(item).alias("items"), F.min(F.when(F.col("found_id").isNull(), F.col("pos"))).alias("fail"))
    kept = F.filter("items", lambda x: F.col("fail").isNull() | (x["pos"] < F.col("fail")))
    return grouped.select("relation_id", F.inline(kept)).drop("ok")


def largest_way(kept: DataFrame) -> DataFrame:
    """(id, centroid, bounds, ways) of each relation's way with the largest box (of equals the first), and how many it has."""
    size = F.struct(geo.area(F.col("bounds")).alias("area"), (-F.col("pos")).alias("first"))
    best = kept.where(F.col("bounds").isNotNull()).groupBy("relation_id").agg(F.max_by(F.struct("centroid", "bounds"), size).alias("best"), F.count("*").alias("ways"))
    return best.select(F.col("relation_id").alias("id"), "best.centroid", "best.bounds", "ways")


def admin_centres(relations: DataFrame, points: DataFrame) -> DataFrame:
    """(id, centre): of administrative boundaries the first node member with that role that is there."""
    admin = relations.where(F.col("tags")["boundary"] == "administrative")
    refs = admin.select("id", F.posexplode("members").alias("pos", "m")).where((F.col("m.type") == NODE_TYPE) & (F.col("m.role") == "admin_centre"))
    refs = refs.select("id", "pos", F.col("m.id").alias("node_id"))
    found = refs.join(points.withColumnRenamed("id", "point_id"), F.col("node_id") == F.col("point_id"))
    centre = F.struct("lat", "lon", F.lit("admin_centre").alias("type"))
    return first_match(found, ["id"], ["pos"], centre, "centre")


def denormalised_relations(relations: DataFrame, ways: DataFrame, nodes: DataFrame, conditions: str | None = None, rounded: bool = False) -> DataFrame:
    """(id, tags, centroid, bounds, ways) of the relations with a way whose tags meet the conditions.

    Only ways that the relations refer to reach the joins.
    """
    wanted = relations.where(tag_functions.matches(F.col("tags"), conditions) & has_way_member())
    used = ways.join(needed_way_ids(wanted), "id", "left_semi")
    points = located(nodes, rounded)
    return placed_relations(wanted, measured(way_points(used, points)), points)


def placed_relations(relations: DataFrame, boxes: DataFrame, points: DataFrame) -> DataFrame:
    """(id, tags, centroid, bounds, ways) of relations whose ways' boxes (id, centroid, bounds) and nodes' points are there."""
    best = largest_way(relation_ways(relations, boxes.select("id", "centroid", "bounds")))
    out = relations.select("id", "tags").join(best, "id").join(admin_centres(relations, points), "id", "left")
    return out.select("id", "tags", F.coalesce("centre", "centroid").alias("centroid"), "bounds", "ways")
