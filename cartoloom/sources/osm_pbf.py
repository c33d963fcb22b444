"""Block-compressed binary map extracts (the public PBF format) as a Spark data source.

A file is a sequence of blobs of at most 32 MB, each decoded by itself. The reader finds the blobs by their headers (some
20 bytes each) and makes one partition of each run of blobs of about splitBytes; a task decodes its blobs with zlib and
numpy and yields Arrow batches of the ENTITY schema. Filters on `kind` are taken over: groups of other kinds are skipped.

Paths are files, or folders of *.pbf, that driver and executors can open. A file without data has no entities.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from cartoloom.checkpoint import stored
from cartoloom.schemas import ENTITY
from cartoloom.sources import files

KINDS = ("node", "way", "relation")
MOST_BLOB = 32 << 20


def fields(data: memoryview) -> Iterator[tuple[int, Any]]:
    """(field number, value) of a message: a number for varints, a view for bytes."""
    at, end = 0, len(data)
    while at < end:
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
            yield tag >> 3, value
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > end:
                raise ValueError("a field goes beyond its message")
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def varints(data: memoryview) -> np.ndarray:
    """All packed varints of a view, as unsigned 64-bit numbers."""
    b = np.frombuffer(data, np.uint8)
    if len(b) == 0:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, starts)


def zigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def deltas(data: memoryview) -> np.ndarray:
    return np.cumsum(zigzag(varints(data)))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def blobs(path: str) -> Iterator[tuple[int, int, str]]:
    """(offset of the blob, size, type) of each blob of the file."""
    with files.opened(path) as f:
        size, at = files.size(path), 0
        while at < size:
            f.seek(at)
            head = f.read(4)
            if len(head) < 4:
                raise ValueError(f"{path}: cut off at {at}")
            (length,) = struct.unpack(">I", head)
            if length > 1 << 16:
                raise ValueError(f"{path}: no blob header at {at}")
            header = dict(fields(memoryview(f.read(length))))
            at += 4 + length
            yield at, int(header[3]), bytes(header[1]).decode()
            at += int(header[3])


def inflate(blob: bytes) -> memoryview:
    found = dict(fields(memoryview(blob)))
    if 1 in found:
        return found[1]
    if 3 in found:
        return memoryview(zlib.decompress(found[3]))
    if 4 in found:
        return memoryview(lzma.decompress(found[4]))
    if 7 in found:
        import zstandard

        return memoryview(zstandard.ZstdDecompressor().decompress(bytes(found[7]), max_output_size=MOST_BLOB))
    raise ValueError(f"unknown compression in a blob: fields {sorted(found)}")


def check_header(data: memoryview) -> None:
    for number, value in fields(data):
        if number == 4 and bytes(value) not in (b"OsmSchema-V0.6", b"DenseNodes", b"HistoricalInformation"):
            raise ValueError(f"the extract needs {bytes(value).decode()}")


def decode(data: memoryview, kinds: frozenset[str]) -> dict[str, list]:
    """The entities of one block as columns of the ENTITY schema."""
    out: dict[str, list] = {name: [] for name in ENTITY.fieldNames()}
    strings: list[str] = []
    granularity, lat_offset, lon_offset, groups = 100, 0, 0, []
    for number, value in fields(data):
        if number == 1:
            strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat_offset = _signed(value)
        elif number == 20:
            lon_offset = _signed(value)

    def degrees(raw: np.ndarray, offset: int) -> np.ndarray:
        return (offset + granularity * raw) / 1e9

    def tags(keys: np.ndarray, values: np.ndarray) -> dict[str, str]:
        return {strings[k]: strings[v] for k, v in zip(keys.tolist(), values.tolist())}

    def add(kind: str, **row: Any) -> None:
        for name in out:
            out[name].append(kind if name == "kind" else row.get(name))

    for group in groups:
        for number, body in fields(group):
            if number in (1, 2) and "node" not in kinds or number == 3 and "way" not in kinds or number == 4 and "relation" not in kinds or number == 5:
                continue
            if number not in (1, 2, 3, 4):
                raise ValueError(f"unknown kind of entity: field {number}")
            message: dict[int, Any] = dict(fields(body))
            packed = lambda k: varints(message[k]) if k in message else np.zeros(0, np.uint64)  # noqa: E731, B023
            moved = lambda k: deltas(message[k]) if k in message else np.zeros(0, np.int64)  # noqa: E731, B023
            if number == 1:
                one = lambda k: zigzag(np.array([message.get(k, 0)], np.uint64))  # noqa: E731, B023
                add("node", id=int(one(1)[0]), lat=float(degrees(one(8), lat_offset)[0]), lon=float(degrees(one(9), lon_offset)[0]), tags=tags(packed(2), packed(3)))
            elif number == 2:
                ids = moved(1)
                n = len(ids)
                pairs, at = packed(10).astype(np.int64).tolist(), 0
                maps: list[dict[str, str]] = []
                for _ in range(n):
                    found: dict[str, str] = {}
                    while at < len(pairs) and pairs[at]:
                        found[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    maps.append(found)
                out["kind"] += ["node"] * n
                out["id"] += ids.tolist()
                out["lat"] += degrees(moved(8), lat_offset).tolist()
                out["lon"] += degrees(moved(9), lon_offset).tolist()
                out["tags"] += maps
                out["node_ids"] += [None] * n
                out["members"] += [None] * n
            elif number == 3:
                add("way", id=_signed(message[1]), tags=tags(packed(2), packed(3)), node_ids=moved(8).tolist())
            else:
                members = [{"type": t, "id": i, "role": strings[r]} for r, i, t in zip(packed(8).tolist(), moved(9).tolist(), packed(10).tolist())]
                add("relation", id=_signed(message[1]), tags=tags(packed(2), packed(3)), members=members)
    return out


ARROW = pa.schema(
    [
        ("kind", pa.string()),
        ("id", pa.int64()),
        ("lat", pa.float64()),
        ("lon", pa.float64()),
        ("tags", pa.map_(pa.string(), pa.string())),
        ("node_ids", pa.list_(pa.int64())),
        ("members", pa.list_(pa.struct([("type", pa.int32()), ("id", pa.int64()), ("role", pa.string())]))),
    ]
)


class Blocks(InputPartition):
    def __init__(self, path: str, ranges: list[tuple[int, int]]) -> None:
        self.path, self.ranges = path, ranges


class PbfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = files.listed(options["path"], "*.pbf")
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.kinds = frozenset(options.get("kinds", ",".join(KINDS)).split(","))

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds &= {*f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            run: list[tuple[int, int]] = []
            for at, size, kind in blobs(path):
                if kind == "OSMHeader":
                    with files.opened(path) as f:
                        f.seek(at)
                        check_header(inflate(f.read(size)))
                elif kind == "OSMData":
                    run.append((at, size))
                    if sum(s for _, s in run) >= self.split:
                        out.append(Blocks(path, run))
                        run = []
            if run:
                out.append(Blocks(path, run))
        return out or [Blocks("", [])]  # Spark wants one at least

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.ranges:
            return
        with files.opened(partition.path) as f:
            for at, size in partition.ranges:
                f.seek(at)
                columns = decode(inflate(f.read(size)), self.kinds)
                if columns["id"]:
                    arrays = [pa.array([list(t.items()) for t in columns[x.name]] if x.name == "tags" else columns[x.name], x.type) for x in ARROW]
                    yield pa.RecordBatch.from_arrays(arrays, schema=ARROW)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self):
        return ENTITY

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options)


def read_entities(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS, split_bytes: int = 64 << 20) -> DataFrame:
    return spark.read.format("osmpbf").option("kinds", ",".join(kinds)).option("splitBytes", str(split_bytes)).load(path)


def split_kinds(entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations."""
    nodes, ways, relations = (entities.where(F.col("kind") == k) for k in KINDS)
    return nodes.select("id", "lat", "lon", "tags"), ways.select("id", "tags", "node_ids"), relations.select("id", "tags", F.coalesce("members", F.array()).alias("members"))


def read_kinds(spark: SparkSession, path: str, **options: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations; the file is decoded once, into a table in the shared folder with a part for each kind."""
    return split_kinds(stored(read_entities(spark, path, **options), "kind"))
