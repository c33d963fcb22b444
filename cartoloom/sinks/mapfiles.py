"""The eight parallel column files of a map: names with their offsets, points and indexes, and unnamed points.

`.tag_text` UTF-8 names, NUL after each; `.tag_offset` int64 of each name's first byte; `.pre_offset` the same as text, a
line each; `.tag_points` and `.map_points` doubles, lat * 60 and lon * -60; `.tag_index` int64; `.tag_category` int64 0;
`.map_data` three doubles 0. All numbers are little-endian. The first name is the sentinel FAIL at -6000, -60000 (not scaled),
index -1 and offset 0.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.functions.text import byte_length, scaled
from cartoloom.operators.sequence import running

SENTINEL = ("FAIL", -6000.0, -60000.0)
NAMED = ("tag_text", "tag_offset", "pre_offset", "tag_points", "tag_index", "tag_category")
UNNAMED = ("map_points", "map_data")


def named_columns(named: DataFrame, order: list[str]) -> DataFrame:
    """(index, offset, name, y, x) of the named rows, after the sentinel's five bytes. named: name, lat, lon and order."""
    numbered = running(named, order, byte_length(F.col("name")))
    at = scaled(F.col("lat"), F.col("lon"))
    return numbered.select("index", (F.col("offset") + len(SENTINEL[0]) + 1).alias("offset"), "name", at["y"].alias("y"), at["x"].alias("x"))


def unnamed_columns(unnamed: DataFrame, order: list[str]) -> DataFrame:
    """(index, y, x) in order."""
    numbered = running(unnamed, order, F.lit(1)).drop("offset")
    at = scaled(F.col("lat"), F.col("lon"))
    return numbered.select("index", at["y"].alias("y"), at["x"].alias("x"))


def named_bytes(text: list[str], offset: np.ndarray, y: np.ndarray, x: np.ndarray, index: np.ndarray) -> dict[str, bytes]:
    n = len(text)
    return {
        "tag_text": b"".join(t.encode() + b"\0" for t in text),
        "tag_offset": offset.astype("<i8").tobytes(),
        "pre_offset": b"".join(b"%d\n" % o for o in offset.tolist()),
        "tag_points": np.stack([y, x], 1).astype("<f8").tobytes(),
        "tag_index": index.astype("<i8").tobytes(),
        "tag_category": np.zeros(n, "<i8").tobytes(),
    }


def unnamed_bytes(y: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
    return {"map_points": np.stack([y, x], 1).astype("<f8").tobytes(), "map_data": np.zeros((len(y), 3), "<f8").tobytes()}


def _parts(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(first, one binary for each file) for each batch of the sorted rows: the bytes are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            number = {n: c[n].to_numpy(zero_copy_only=False) for n in c if n != "name"}
            made = named_bytes(c["name"].to_pylist(), number["offset"], number["y"], number["x"], number["index"]) if "name" in c else unnamed_bytes(number["y"], number["x"])
            yield pa.RecordBatch.from_arrays([pa.array([int(number["index"][0])])] + [pa.array([made[n]], pa.binary()) for n in names], ["first", *names])

    return rows.repartitionByRange("index").sortWithinPartitions("index").mapInArrow(run, "first long, " + ", ".join(f"{n} binary" for n in names))


def write(named: DataFrame, unnamed: DataFrame, path: str, order: list[str]) -> None:
    """Write the eight files path.<name>; empty inputs leave the sentinel alone."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    name, y, x = SENTINEL
    head = named_bytes([name], np.array([0]), np.array([y]), np.array([x]), np.array([-1]))
    for names, rows, first in ((NAMED, named_columns(named, order), head), (UNNAMED, unnamed_columns(unnamed, order), {})):
        files = {n: open(f"{path}.{n}", "wb") for n in names}
        try:
            for n, data in first.items():
                files[n].write(data)
            for row in _parts(rows, names).toLocalIterator(prefetchPartitions=True):  # range partitions come in order
                for n in names:
                    files[n].write(row[n])
        finally:
            for f in files.values():
                f.close()
