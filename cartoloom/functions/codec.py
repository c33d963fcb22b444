"""Entrance and wheelchair classes, and the compact byte forms of points and id lists."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def entrance_class(tags: Column) -> Column:
    """2 for main, 1 for yes, home and staircase, else 0."""
    kind = F.lower(tags["entrance"])
    return F.when(kind == "main", 2).when(kind.isin("yes", "home", "staircase"), 1).otherwise(0)


def wheelchair_class(tags: Column) -> Column:
    """2 for yes, 0 for no or nothing, 1 for anything else."""
    kind = F.lower(tags["wheelchair"])
    return F.when(kind == "yes", 2).when(kind == "no", 0).when(kind.isNotNull(), 1).otherwise(0)


def flag_byte(entrance: Column, wheelchair: Column) -> Column:
    return F.shiftleft(entrance, 6).bitwiseOR(F.shiftleft(wheelchair, 4))


def flags_of(byte: Column) -> Column:
    return F.struct(F.shiftright(byte, 6).bitwiseAND(F.lit(3)).alias("entrance"), F.shiftright(byte, 4).bitwiseAND(F.lit(3)).alias("wheelchair"))


def pack_point(lat: float, lon: float, entrance: int = 0, wheelchair: int = 0) -> bytes:
    """Six bytes for each coordinate (a double without its last 16 bits), and a flag byte if there is an entrance."""
    body = struct.pack(">d", lat)[:6] + struct.pack(">d", lon)[:6]
    return body + bytes([entrance << 6 | wheelchair << 4]) if entrance else body


def unpack_point(data: bytes) -> tuple[float, float, int, int]:
    if len(data) not in (12, 13):
        raise ValueError(f"a point has 12 or 13 bytes, not {len(data)}")
    lat, lon = (struct.unpack(">d", data[k : k + 6] + b"\0\0")[0] for k in (0, 6))
    flags = data[12] if len(data) == 13 else 0
    return lat, lon, flags >> 6 & 3, flags >> 4 & 3


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f">{len(ids)}q", *ids)


def unpack_ids(data: bytes) -> list[int]:
    if len(data) % 8:
        raise ValueError("an id list has a multiple of 8 bytes")
    return list(struct.unpack(f">{len(data) // 8}q", data))


@F.pandas_udf(T.BinaryType())
def packed_point(lat: pd.Series, lon: pd.Series, entrance: pd.Series, wheelchair: pd.Series) -> pd.Series:
    """pack_point of each row: the bytes of all rows at once."""
    body = np.concatenate([x.to_numpy(">f8").view(np.uint8).reshape(-1, 8)[:, :6] for x in (lat, lon)], 1)
    flags = (entrance.to_numpy(np.uint8) << 6 | wheelchair.to_numpy(np.uint8) << 4).astype(np.uint8)
    rows = np.concatenate([body, flags[:, None]], 1)
    return pd.Series([row[:size].tobytes() for row, size in zip(rows, np.where(entrance > 0, 13, 12).tolist())])


POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("entrance", T.IntegerType()), T.StructField("wheelchair", T.IntegerType())])


@F.pandas_udf(POINT)
def unpacked_point(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unpack_point(bytes(x)) for x in data], columns=POINT.fieldNames())


def packed_ids(ids: Column) -> Column:
    """pack_ids of each list, by built-in functions."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 16, "0")), ""))


def unpacked_ids(data: Column) -> Column:
    """The lists again; bytes that don't fill an id are an error."""
    n = F.octet_length(data)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 8, F.lit(0)), F.lit(8)), lambda k: k + 8 <= n)
    ids = F.transform(at, lambda k: F.conv(F.hex(F.substring(data, k + 1, F.lit(8))), 16, -10).cast("long"))
    return F.when(data.isNull(), None).when(n % 8 == 0, ids).otherwise(F.raise_error(F.lit("an id list has a multiple of 8 bytes")).cast("array<bigint>"))
