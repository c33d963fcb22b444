"""Geometry of ordered points as column expressions; points are array<struct<lat, lon, entrance, wheelchair>>.

All of it stays in the JVM: higher-order functions over the array, no exploding and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartoloom.functions.binding import let

EARTH_M = 6_378_137.0
LEAST_SIDE = 1e-6
#: Degrees by which a vertex must turn to count for a polygon's centroid.
TURN = 1e-2


def _each(points: Column, field: str) -> Column:
    return F.transform(points, lambda p: p[field])


def bounds(points: Column) -> Column:
    """struct<n, s, e, w>; null for no points."""
    lat, lon = _each(points, "lat"), _each(points, "lon")
    box = F.struct(F.array_max(lat).alias("n"), F.array_min(lat).alias("s"), F.array_max(lon).alias("e"), F.array_min(lon).alias("w"))
    return F.when(F.size(points) > 0, box)


def spherical_mean(points: Column) -> Column:
    """The direction of the mean of the unit vectors: struct<lat, lon>."""

    def vector(p: Column) -> Column:
        lat, lon = F.radians(p["lat"]), F.radians(p["lon"])
        return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))

    def mean(vectors: Column) -> Column:
        total = lambda c: F.aggregate(vectors, F.lit(0.0), lambda acc, v: acc + v[c]) / F.size(vectors)
        return F.struct(*(total(c).alias(c) for c in "xyz"))

    def direction(m: Column) -> Column:
        return F.struct(F.degrees(F.atan2(m["z"], F.hypot(m["x"], m["y"]))).alias("lat"), F.degrees(F.atan2(m["y"], m["x"])).alias("lon"))

    return let(let(F.transform(points, vector), mean), direction)


def bearing(a: Column, b: Column) -> Column:
    """Initial bearing from a to b in degrees, between -180 and 180."""
    turn, lat1, lat2 = F.radians(b["lon"] - a["lon"]), F.radians(a["lat"]), F.radians(b["lat"])
    return F.degrees(F.atan2(F.sin(turn) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(turn)))


def neighbours(points: Column) -> Column:
    """For each point of the closed ring: struct<before, here, after>; both ends wrap."""
    n = F.size(points)
    at = lambda k: F.element_at(points, (F.pmod(k, n) + 1).cast("int"))
    return F.transform(points, lambda p, i: F.struct(at(i - 1).alias("before"), p.alias("here"), at(i + 1).alias("after")))


def simplified(points: Column, turn: float = TURN) -> Column:
    """The points at which the ring turns; a repeated closing vertex is a vertex like any other."""
    bent = F.filter(neighbours(points), lambda t: F.abs(bearing(t["before"], t["here"]) - bearing(t["before"], t["after"])) > turn)
    return F.transform(bent, lambda t: t["here"])


def _segments(points: Column) -> Column:
    a, b = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.zip_with(a, b, lambda p, q: F.hypot(q["lon"] - p["lon"], q["lat"] - p["lat"]))


def line_centroid(points: Column) -> Column:
    """The point halfway along the line; for a line without length the spherical mean."""
    # (travelled, index, step) of the first segment that goes beyond half of the way
    start = F.struct(F.lit(0.0).alias("travelled"), F.lit(-1).alias("index"), F.lit(0).alias("next"), F.lit(0.0).alias("step"))

    def walked(segments: Column) -> Column:
        def walk(half: Column) -> Column:
            def step(state: Column, d: Column) -> Column:
                found = state["index"] >= 0
                hit = ~found & (state["travelled"] + d > half)
                return F.struct(
                    F.when(found | hit, state["travelled"]).otherwise(state["travelled"] + d).alias("travelled"),
                    F.when(hit, state["next"]).otherwise(state["index"]).alias("index"),
                    (state["next"] + 1).alias("next"),
                    F.when(hit, d).otherwise(state["step"]).alias("step"),
                )

            return F.struct(half.alias("half"), F.aggregate(segments, start, step).alias("at"))

        return let(F.aggregate(segments, F.lit(0.0), lambda acc, d: acc + d) / 2, walk)

    def middle(found: Column) -> Column:
        at = found["at"]
        a, b = F.get(points, at["index"]), F.get(points, at["index"] + 1)
        share = (found["half"] - at["travelled"]) / F.nullif(at["step"], F.lit(0.0))
        between = let(share, lambda s: F.struct((a["lat"] + s * (b["lat"] - a["lat"])).alias("lat"), (a["lon"] + s * (b["lon"] - a["lon"])).alias("lon")))
        return F.when(at["index"] >= 0, between).otherwise(spherical_mean(points))

    return let(let(_segments(points), walked), middle)


def polygon_centroid(points: Column) -> Column:
    return let(simplified(points), lambda kept: spherical_mean(F.when(F.size(kept) > 0, kept).otherwise(points)))


def is_closed(points: Column) -> Column:
    """More than two points, and the last is where the first is."""
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    return (F.size(points) > 2) & (first["lat"] == last["lat"]) & (first["lon"] == last["lon"])


def entrance(points: Column) -> Column:
    """The main entrance, else the first accessible one, else the first; null without one."""

    def best(doors: Column) -> Column:
        pick = lambda cond: F.get(F.filter(doors, cond), F.lit(0))
        return F.coalesce(pick(lambda p: p["entrance"] == 2), pick(lambda p: p["wheelchair"] != 0), F.get(doors, F.lit(0)))

    return let(F.filter(points, lambda p: p["entrance"] > 0), best)


def centroid(points: Column) -> Column:
    """struct<lat, lon, type>: an entrance if there is one (type `entrance`), else of the polygon or the line."""
    typed = lambda p, kind: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), kind.alias("type"))
    middle = F.when(is_closed(points), polygon_centroid(points)).otherwise(line_centroid(points))
    place = let(entrance(points), lambda door: F.when(door.isNotNull(), typed(door, F.lit("entrance"))).otherwise(let(middle, lambda m: typed(m, F.lit(None).cast("string")))))
    return F.when(F.size(points) > 0, place)


def area(box: Column) -> Column:
    """Square metres of a bounding box, its sides at least LEAST_SIDE; only to rank boxes."""
    width = F.radians(box["e"] - box["w"]) * F.cos(F.radians((box["n"] + box["s"]) / 2)) * EARTH_M
    height = F.radians(box["n"] - box["s"]) * EARTH_M
    return F.greatest(width, F.lit(LEAST_SIDE)) * F.greatest(height, F.lit(LEAST_SIDE))
