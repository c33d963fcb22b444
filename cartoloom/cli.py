"""Command line: python -m cartoloom.cli TOOL ... with the tools extract, osm, wiki-points, wiki-tokens and map.

An input of - is standard input, for every tool: it is written to a file in the shared folder first, which is deleted at
the end. Long outputs report their progress to standard error.
"""

from __future__ import annotations

import argparse
import contextlib
import os
import shutil
import sys
import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from cartoloom.checkpoint import shared_dir
from cartoloom.session import session
from cartoloom.sinks import lines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cartoloom")
    tools = top.add_subparsers(dest="tool", required=True)

    extract = tools.add_parser("extract", help="binary extract to JSON lines")
    extract.add_argument("--tags", help="conditions such as amenity~school,building+name; without it everything passes")
    extract.add_argument("--waynodes", action="store_true")
    extract.add_argument("--node-features", action="store_true")
    extract.add_argument("input")
    extract.add_argument("output", nargs="?", default="-")

    osm = tools.add_parser("osm", help="XML extract to GeoJSON points")
    wiki = tools.add_parser("wiki-points", help="encyclopedia dump to GeoJSON points")
    tokens = tools.add_parser("wiki-tokens", help="encyclopedia dump to tokens")
    for tool in (osm, wiki, tokens):
        tool.add_argument("--compression", default="auto", choices=["auto", "none", "gzip", "bz2"])
        tool.add_argument("--strict", action="store_true", help="one JSON array")
    osm.add_argument("input", nargs="?", default="-")
    osm.add_argument("output", nargs="?", default="-")
    for tool in (wiki, tokens):
        tool.add_argument("--workers", type=int, default=8, help="local tasks at once")
        tool.add_argument("--cpus", type=int, help="the same as --workers")
        tool.add_argument("--errors", help="folder for pages that could not be read")
        tool.add_argument("input", nargs="+", help="dump, or index and multistream dump")
    tokens.add_argument("--limit", type=int, default=100_000)

    maps = tools.add_parser("map", help="line GeoJSON to map files")
    maps.add_argument("--outFile", default="default_map")
    maps.add_argument("--limit", type=int, default=-1)
    maps.add_argument("--points", action="store_true", help="unnamed points only")
    maps.add_argument("--tags", action="store_true", help="named points only")
    maps.add_argument("--verbose", action="store_true")
    maps.add_argument("input", nargs="?", default="-")
    return top


@contextlib.contextmanager
def readable(spark: SparkSession, paths: list[str]) -> Iterator[list[str]]:
    """The paths, with a file in place of standard input. It is read here, in the driver: a worker's would be another."""
    if "-" not in paths:
        yield paths
        return
    folder = urlparse(shared_dir(spark))
    if folder.scheme not in ("", "file"):
        raise RuntimeError("for standard input, spark.checkpoint.dir must be a folder with a path on every machine")
    os.makedirs(folder.path, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=folder.path, prefix="input-") as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
        f.flush()
        yield [f.name if p == "-" else p for p in paths]


def main(argv: list[str] | None = None) -> int:
    from cartoloom.plans import extracts, maps, pages

    args = parser().parse_args(argv)
    spark = session(master=f"local[{getattr(args, 'cpus', None) or getattr(args, 'workers', '*')}]" if hasattr(args, "workers") else None)

    rate = lines.Rate(sys.stderr)

    def put(rows, strict: bool = False, output: str = "-") -> None:
        lines.write_to(rows, sys.stdout, strict, rate) if output == "-" else lines.write_single(rows, output, strict, rate=rate)

    several = isinstance(args.input, list)
    with readable(spark, args.input if several else [args.input]) as paths:
        path, index = paths[-1], paths[0] if len(paths) == 2 else None
        if args.tool == "extract":
            put(extracts.extract_lines(spark, path, args.tags, args.waynodes, args.node_features), output=args.output)
        elif args.tool == "osm":
            put(extracts.xml_point_lines(spark, path, args.compression), args.strict, args.output)
        elif args.tool == "map":
            errors = maps.write_map(spark, path, args.outFile, args.limit, args.points, args.tags)
            if args.verbose:
                for row in errors.toLocalIterator():
                    print(f"{row.reason}: {row.line}", file=sys.stderr)
        elif args.tool == "wiki-points":
            rows, errors = pages.page_point_lines(spark, path, index, args.compression)
            put(rows, args.strict)
            if args.errors:
                errors.write.mode("overwrite").parquet(args.errors)
        else:
            put(pages.page_token_lines(spark, path, index, args.compression, args.limit), args.strict)
    rate.end()
    return 0


if __name__ == "__main__":
    sys.exit(main())
