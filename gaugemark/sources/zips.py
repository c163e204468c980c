"""Members of zip archives as texts: a Spark data source with one task for each member.

Planning reads an archive's central directory only; a task reads its member's bytes and inflates them piece by piece. With a
choice of stations, a member is inflated up to its ninth line, which tells its station, and no further if that is not
asked for: its text then is this head, so that parsers and counts of skipped files see what it is.
"""

from __future__ import annotations

import unicodedata
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader

from .files import Piece, listed, opened, planned, read_at

SCHEMA = "path string, text string"
HEAD_LINES, CHUNK_BYTES = 9, 1 << 16


def members(path: str) -> list[Piece]:
    """Places of the archive's CSV members, by name."""
    with opened(path) as f, zipfile.ZipFile(f) as z:
        infos = sorted((x for x in z.infolist() if x.filename.upper().endswith(".CSV")), key=lambda x: x.filename)
    return [Piece(path, x.header_offset, x.compress_size, (x.filename, x.compress_type, x.flag_bits, x.CRC)) for x in infos]


def inflated(piece: Piece, f) -> Iterator[bytes]:
    """A member's bytes, in pieces; at the end its checksum must fit."""
    name, method, flags, crc = piece.what
    if flags & 1 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{piece.path}/{name}: encrypted, or compressed by method {method}, which is not understood")
    head = read_at(f, piece.offset, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"{piece.path}/{name}: no member at octet {piece.offset}")
    at = piece.offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    inflater, seen = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None, 0
    for a in range(0, piece.length, CHUNK_BYTES):
        data = read_at(f, at + a, min(CHUNK_BYTES, piece.length - a))
        while data:
            out = inflater.decompress(data, CHUNK_BYTES) if inflater else data
            data = inflater.unconsumed_tail if inflater else b""
            seen = zlib.crc32(out, seen)
            if out:
                yield out
    if inflater and (out := inflater.flush()):
        seen = zlib.crc32(out, seen)
        yield out
    if seen != crc:
        raise ValueError(f"{piece.path}/{name}: the checksum does not fit")


def station_of(head: str) -> str | None:
    """The station code of a file's first lines."""
    for line in head.splitlines()[: HEAD_LINES - 1]:
        plain = unicodedata.normalize("NFD", line.upper()).encode("ascii", "ignore").decode()
        if plain.startswith("CODIGO (WMO)") and ";" in line:
            return line.split(";", 1)[1].strip()
    return None


def text_of(piece: Piece, f, encoding: str, stations: frozenset[str] | None) -> str:
    """The member's text, or its head if its station is not among ``stations``."""
    held, chosen = bytearray(), stations is None
    for out in inflated(piece, f):
        held += out
        if not chosen and held.count(b"\n") >= HEAD_LINES:
            head = b"\n".join(bytes(held).split(b"\n", HEAD_LINES)[:HEAD_LINES]).decode(encoding)
            if station_of(head) not in stations:
                return head
            chosen = True
    return held.decode(encoding)


class ZipReader(DataSourceReader):
    def __init__(self, paths: str, encoding: str, stations: frozenset[str] | None):
        self.paths, self.encoding, self.stations = paths, encoding, stations

    def partitions(self) -> list[Piece]:
        return planned(listed(self.paths, "*.zip"), members)

    def read(self, piece: Piece) -> Iterator[tuple[str, str]]:
        if piece is not None:  # None: no members
            with opened(piece.path) as f:
                yield f"{piece.path}/{piece.what[0]}", text_of(piece, f, self.encoding, self.stations)


class ZipSource(DataSource):
    """Format ``zip_texts``: ``load(path)`` of archives or folders; options ``encoding`` and ``stations`` (comma-separated codes)."""

    @classmethod
    def name(cls) -> str:
        return "zip_texts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        stations = self.options.get("stations")
        return ZipReader(self.options["path"], self.options.get("encoding", "ISO-8859-1"), None if stations is None else frozenset(filter(None, stations.split(","))))
