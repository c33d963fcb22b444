"""Elements of large XML files as text rows, in parallel; from_xml then parses them in the JVM.

Spark's own XML source reads a file in one task. This one cuts plain files into byte ranges: a task takes the elements that
begin in its range and reads beyond its end to finish the last. Compressed files are one partition each, but for multistream
bz2 with its index, where each run of streams is one. An element that the file cuts off is dropped, and what came before
stays. Elements of the same name don't nest in the formats that are read, and `<` is escaped in their texts. An empty file
has no elements, as an empty folder.

Options: path (a file, a folder, or a path with wildcards in its last part), rowTag, splitBytes, compression (auto, none,
gzip, bz2), index (of a multistream file). Paths must be open to driver and executors.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartoloom.sources import files

BLOCK = 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, codec: str) -> None:
        self.path, self.start, self.end, self.codec = path, start, end, codec


def codec_of(path: str, forced: str = "auto") -> str:
    if forced != "auto":
        return forced
    return "bz2" if path.endswith(".bz2") else "gzip" if path.endswith(".gz") else "none"


def opened(path: str, codec: str) -> BinaryIO:
    plain = files.opened(path)
    return gzip.GzipFile(fileobj=plain) if codec == "gzip" else bz2.BZ2File(plain) if codec == "bz2" else plain


def element_lists(f: BinaryIO, tag: str, start: int = 0, end: int | None = None) -> Iterator[list[bytes]]:
    """The elements whose `<` is at start or later and before end, counted from where f begins, block by block.

    The pattern takes whole elements, and of one that the block cuts off only the head. ">" is &gt; in the formats' values.
    """
    name = re.escape(tag.encode())
    one = re.compile(rb"<" + name + rb"(?=[\s/>])(?:[^>]*(?:(?<=/)>|(?<!/)>.*?</" + name + rb">))?", re.DOTALL)
    bare, keep = len(tag) + 1, len(tag) + 2
    f.seek(start)
    buffer, base = b"", start
    while more := f.read(max(BLOCK, len(buffer))):  # twice as much where an element is longer than what is there
        buffer += more
        found = one.findall(buffer)
        whole = next((k for k, x in enumerate(found) if len(x) == bare), len(found))
        cut = whole < len(found)
        rest = max(0, len(buffer) - keep)
        if cut or end is not None and base + len(buffer) > end:
            starts = [m.start() for m in one.finditer(buffer)]
            inside = len(starts) if end is None else sum(base + s < end for s in starts)
            if inside <= whole and (inside < len(found) or end is not None and base + rest >= end):
                yield found[:inside]
                return
            rest = starts[whole] if cut else rest
        yield found[:whole]
        base, buffer = base + rest, buffer[rest:]


def elements(f: BinaryIO, tag: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    for found in element_lists(f, tag, start, end):
        yield from found


def streams(path: str, start: int, end: int | None) -> bytes:
    """The text of the bz2 streams from one offset to another."""
    with files.opened(path) as f:
        f.seek(start)
        return bz2.decompress(f.read() if end is None else f.read(end - start))


def stream_offsets(index: str) -> list[int]:
    """The distinct offsets of an index of rows offset:id:title."""
    with opened(index, codec_of(index)) as f:
        return sorted({int(line.split(b":", 1)[0]) for line in f if line.strip()})


def texts(rows: list[bytes]) -> pa.RecordBatch:
    """The rows as text; bytes that aren't UTF-8 are replaced."""
    try:
        column = pa.array(rows, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        column = pa.array([row.decode("utf-8", "replace") for row in rows], pa.string())
    return pa.RecordBatch.from_arrays([column], ["xml"])


class XmlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.tag, self.index = low["path"], low["rowtag"], low.get("index")
        self.split, self.forced = int(low.get("splitbytes", 64 << 20)), low.get("compression", "auto")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files.listed(self.path):
            if self.index:
                offsets = stream_offsets(self.index)
                runs = [o for k, o in enumerate(offsets) if k == 0 or o // self.split != offsets[k - 1] // self.split]
                out += [Range(path, a, b, "multi") for a, b in zip(runs, [*runs[1:], None])]
            elif (codec := codec_of(path, self.forced)) == "none":
                out += [Range(path, a, a + self.split, codec) for a in range(0, files.size(path), self.split)]
            else:
                out.append(Range(path, 0, None, codec))
        return out or [Range("", 0, 0, "empty")]  # Spark wants one at least

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.codec == "empty":
            return
        whole = partition.codec == "multi"
        f = io.BytesIO(streams(partition.path, partition.start, partition.end)) if whole else opened(partition.path, partition.codec)
        start, end = (0, None) if whole else (partition.start, partition.end)
        try:
            for found in element_lists(f, self.tag, start, end):
                if found:
                    yield texts(found)
        except EOFError:
            pass  # a compressed file that is cut off: what could be read stays
        finally:
            f.close()


class XmlRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xmlrecords"

    def schema(self):
        return "xml string"

    def reader(self, schema) -> XmlReader:
        return XmlReader(self.options)
