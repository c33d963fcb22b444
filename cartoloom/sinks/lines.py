"""JSON lines, GeoJSON, token tables, and errors. Every line is valid JSON."""

from __future__ import annotations

import os
import time
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoloom.functions import tags as tag_functions
from cartoloom.functions.text import seven_decimals


def point_text(at: Column) -> Column:
    """struct<lat, lon[, type]> with coordinates as texts of seven places."""
    return F.when(at.isNotNull(), F.struct(seven_decimals(at["lat"]).alias("lat"), seven_decimals(at["lon"]).alias("lon"), at["type"].alias("type")))


def bounds_text(box: Column) -> Column:
    return F.when(box.isNotNull(), F.struct(*(seven_decimals(box[c]).alias(c) for c in "nsew")))


def node_features(nodes: DataFrame) -> DataFrame:
    """(value): a GeoJSON feature without an id for each node; properties only if there are tags."""
    properties = F.when(F.size("tags") > 0, tag_functions.trim(F.col("tags")))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return nodes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def node_records(nodes: DataFrame) -> DataFrame:
    """(value): the typed record of each node, {id, type, lat, lon, tags}."""
    return nodes.select(F.to_json(F.struct("id", F.lit("node").alias("type"), "lat", "lon", tag_functions.trim(F.col("tags")).alias("tags"))).alias("value"))


def way_records(ways: DataFrame, with_nodes: bool = False) -> DataFrame:
    """(value): {id, type, tags, centroid, bounds[, nodes]}; nodes are the points as texts."""
    columns = [F.col("id"), F.lit("way").alias("type"), tag_functions.trim(F.col("tags")).alias("tags"), point_text(F.col("centroid")).alias("centroid"), bounds_text(F.col("bounds")).alias("bounds")]
    if with_nodes:
        columns.append(F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("nodes"))
    return ways.select(F.to_json(F.struct(*columns)).alias("value"))


def relation_records(relations: DataFrame) -> DataFrame:
    columns = [F.col("id"), F.lit("relation").alias("type"), tag_functions.trim(F.col("tags")).alias("tags"), point_text(F.col("centroid")).alias("centroid"), bounds_text(F.col("bounds")).alias("bounds")]
    return relations.select(F.to_json(F.struct(*columns)).alias("value"))


def point_features(points: DataFrame, properties: Column, feature_id: Column | None = None) -> DataFrame:
    """(value): a feature in lon, lat order for each row of lat, lon."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    head = [F.lit("Feature").alias("type")] + ([feature_id.alias("id")] if feature_id is not None else [])
    return points.select(F.to_json(F.struct(*head, geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def token_rows(pages: DataFrame) -> DataFrame:
    """(value): id, a tab, the tokens joined by blanks. pages: id, tokens (array)."""
    return pages.select(F.concat_ws("\t", F.col("id").cast("string"), F.array_join("tokens", " ")).alias("value"))


def write_lines(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """One file for each partition, in a folder."""
    writer = rows.select("value").write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


class Rate:
    """Counts records and reports how many there are and how many come in a second, every so many and at the end."""

    def __init__(self, to: TextIO, every: int = 10_000) -> None:
        self.to, self.every, self.n, self.begun = to, every, 0, time.monotonic()
        self.last = self.begun

    def count(self) -> None:
        self.n += 1
        if self.n % self.every == 0:
            now = time.monotonic()
            print(f"{self.n:,} records so far ({self.every / max(now - self.last, 1e-9):.1f}/s)", file=self.to)
            self.last = now

    def end(self) -> None:
        took = time.monotonic() - self.begun
        print(f"{self.n:,} records in {took:.1f} s ({self.n / max(took, 1e-9):.1f}/s)", file=self.to)


def write_single(rows: DataFrame, path: str, strict: bool = False, compression: str | None = None, rate: Rate | None = None) -> None:
    """One local file, streamed through the driver partition by partition, in the rows' order; strict: one JSON array."""
    import bz2
    import gzip

    kind = compression or ("gzip" if path.endswith(".gz") else "bz2" if path.endswith(".bz2") else "none")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with {"none": open, "gzip": gzip.open, "bz2": bz2.open}[kind](path, "wt", encoding="utf-8") as f:
        write_to(rows, f, strict, rate)


def write_to(rows: DataFrame, f: TextIO, strict: bool = False, rate: Rate | None = None) -> None:
    f.write("[\n" if strict else "")
    for k, row in enumerate(rows.select("value").toLocalIterator(prefetchPartitions=True)):
        f.write((",\n" if strict and k else "") + row.value + ("" if strict else "\n"))
        if rate:
            rate.count()
    f.write("\n]\n" if strict else "")


def strict_text(rows: DataFrame, order: list[str]) -> DataFrame:
    """(value): all rows as one JSON array, in order; only for what fits one row."""
    item = F.struct(*order, "value")
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]), ","), F.lit("]")).alias("value"))


def records(rows: DataFrame):
    """The rows as Python objects, one after another, without collecting them; close the iterator to stop."""
    import json

    for row in rows.select("value").toLocalIterator(prefetchPartitions=True):
        if row.value:
            yield json.loads(row.value)
