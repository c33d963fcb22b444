"""Files that Python sources read: local paths, or URIs of any file system that Arrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import fnmatch
import os
from typing import BinaryIO

from pyarrow import fs


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _uri(path: str, inner: str) -> str:
    """The form of path for a file that the file system calls inner."""
    return path.split("://", 1)[0] + "://" + inner if "://" in path else inner


def listed(path: str, pattern: str = "*") -> list[str]:
    """The file, the files in a folder that meet the pattern, or those that a path with wildcards in its last part names."""
    folder, name = path.rpartition("/")[::2]
    if any(c in name for c in "*?["):
        path, pattern = folder or ".", name
    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(_uri(path, x.path) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern))


def size(path: str) -> int:
    system, inner = _system(path)
    return system.get_file_info(inner).size


def opened(path: str) -> BinaryIO:
    """The file as it is stored, for reading and seeking."""
    system, inner = _system(path)
    return open(inner, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
