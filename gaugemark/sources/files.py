"""Files read by byte range from Python data sources: local, or on any store that Arrow's file systems know (s3, gs, hdfs)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: Files whose directories (headers) are read at once while a query is planned.
PLANNERS = 16


@dataclass
class Piece(InputPartition):
    """Bytes of a file that one task reads."""

    path: str
    offset: int = 0
    length: int = 0
    what: tuple = ()


def opened(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(paths: str, pattern: str) -> list[str]:
    """Paths of files: each comma-separated path is a file, or a folder whose files match ``pattern``, sorted."""
    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        system, inner = _system(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            out.append(path)
            continue
        start = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        out += sorted(start + f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and fnmatch(f.base_name.lower(), pattern))
    return out


def planned(paths: list[str], pieces: Callable[[str], list[Piece]]) -> list[Piece]:
    """The pieces of all files, their headers read side by side."""
    with ThreadPoolExecutor(PLANNERS) as pool:
        return [piece for of in pool.map(pieces, paths) for piece in of]


def read_at(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    out = f.read(length)
    if len(out) != length:
        raise ValueError(f"file ends at {offset + len(out)}, {length} bytes were expected at {offset}")
    return out


def slices(n: int, most: int = 1 << 16) -> Iterator[slice]:
    """Cut ``n`` rows into batches."""
    for a in range(0, n, most):
        yield slice(a, min(n, a + most))
