"""GRIB2 messages as rows of gridded fields: a Spark data source with one task for each message.

    fields = grib.read_fields(spark, "s3://bucket/run.grib2")

Planning reads the 16 bytes in front of each message and skips by its length; a task reads its message by byte range and
unpacks it with numpy. Messages may hold several fields (repeated sections). Understood are regular latitude/longitude
grids (3.0), instantaneous and accumulated products (4.0, 4.1, 4.8, 4.11), simple packing (5.0), complex packing with and
without spatial differencing (5.2, 5.3), plain floats (5.4) and bitmaps; other templates raise by name. The rules
are those of the WMO Manual on Codes, FM 92 GRIB edition 2.

Rows: (path, message, field, short_name, units, init_time, valid_time, lead_hours, step_hours, j, i, lat, lon, value). Lines are numbered as
the grid is stored, from its first point; a node without a value is null. ``lead_hours`` is the end of an accumulation,
``step_hours`` its length. Fields that are not known by name have one of their numbers, and null units.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.contracts import ContractError
from ..workers import ship
from .files import Piece, listed, opened, planned, read_at, slices

SCHEMA = "path string, message int, field int, short_name string, units string, init_time timestamp, valid_time timestamp, lead_hours int, step_hours int, j int, i int, lat double, lon double, value double"
# Fixed values: (discipline, category, number, surface, level) -> short name and units.
NAMES = {
    (0, 0, 0, 103, 2.0): ("2t", "K"),
    (0, 0, 6, 103, 2.0): ("2d", "K"),
    (0, 2, 2, 103, 10.0): ("10u", "m s-1"),
    (0, 2, 3, 103, 10.0): ("10v", "m s-1"),
    (0, 1, 8, 1, 0.0): ("tp", "kg m-2"),
    (0, 1, 193, 1, 0.0): ("tp", "m"),
    (0, 3, 5, 1, 0.0): ("orog", "gpm"),
}
#: Unit of time range -> hours.
HOURS = {0: 1 / 60, 1: 1, 2: 24, 10: 3, 11: 6, 12: 12, 13: 1 / 3600}


@dataclass
class Field:
    """A decoded field; ``values`` as stored lines (nj x ni), NaN where there is none."""

    short_name: str
    units: str | None
    init_time: dt.datetime
    lead_hours: int
    step_hours: int
    lats: np.ndarray
    lons: np.ndarray
    values: np.ndarray | None


def signed(data: bytes) -> int:
    """Sign and magnitude: the first bit is the sign."""
    n = int.from_bytes(data, "big")
    top = 1 << (8 * len(data) - 1)
    return top - n if n & top else n


def unpacked(data: bytes, widths: np.ndarray, start: int = 0) -> np.ndarray:
    """Unsigned numbers of the given bit widths (0 to 32), one behind the other from bit ``start`` on."""
    widths = widths.astype(np.int64)
    if widths.max(initial=0) > 32:
        raise ContractError("packed numbers of more than 32 bits")
    ends = start + np.cumsum(widths)
    if len(ends) and ends[-1] > 8 * len(data):
        raise ContractError("a data section is shorter than its numbers")
    first = ends - widths
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    at, out = first >> 3, np.zeros(len(widths), np.uint64)
    for k in range(5):
        out = out << np.uint64(8) | raw[at + k].astype(np.uint64)
    shift = (40 - (first & 7) - widths).astype(np.uint64)
    return (out >> shift & ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _same(width: int, n: int) -> np.ndarray:
    return np.full(n, width, np.int64)


def _grid(s: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    template = int.from_bytes(s[12:14], "big")
    if template != 0:
        raise ContractError(f"grid template 3.{template} is not understood")
    ni, nj, basic, parts = struct.unpack(">IIII", s[30:46])
    unit = 1e-6 if basic in (0, 0xFFFFFFFF) or parts in (0, 0xFFFFFFFF) else basic / parts
    la1, lo1, la2, lo2 = (signed(s[a : a + 4]) * unit for a in (46, 50, 55, 59))
    mode = s[71]
    east = (lo1 - lo2 if mode & 0x80 else lo2 - lo1) % 360  # an axis may cross the longitude where numbers start anew
    lons = lo1 + np.linspace(0, east, ni) * (-1 if mode & 0x80 else 1)
    return np.round(np.linspace(la1, la2, nj), 6), np.round(lons, 6), mode


def _product(s: bytes, discipline: int) -> tuple[str, str | None, int, int]:
    template = int.from_bytes(s[7:9], "big")
    if template not in (0, 1, 8, 11):
        raise ContractError(f"product template 4.{template} is not understood")
    level = signed(s[24:28]) / 10.0 ** signed(s[23:24]) if s[24:28] != b"\xff" * 4 else 0.0
    key = (discipline, s[9], s[10], s[22], level)
    lead = _hours(s[17], signed(s[18:22]))
    step = 0
    if template in (8, 11):
        at = 34 if template == 8 else 37
        step = _hours(s[at + 14], int.from_bytes(s[at + 15 : at + 19], "big"))
    name, units = NAMES.get(key, ("{}.{}.{}@{}:{:g}".format(*key), None))
    return name, units, lead + step, step


def _hours(unit: int, n: int) -> int:
    if unit not in HOURS or not (n * HOURS[unit]).is_integer() and HOURS[unit] < 1:
        raise ContractError(f"{n} units of time {unit} are no whole hours")
    return int(n * HOURS[unit])


def _numbers(rep: bytes, data: bytes) -> np.ndarray:
    """The field's values in the order of the section, NaN for those marked as missing."""
    n, template = struct.unpack(">IH", rep[5:11])
    if template == 4:
        kind = {1: ">f4", 2: ">f8"}.get(rep[11])
        if kind is None:
            raise ContractError(f"floats of precision {rep[11]} are not understood")
        return np.frombuffer(data, kind, n).astype(float)
    if template not in (0, 2, 3):
        raise ContractError(f"data template 5.{template} is not understood")
    reference, bits = struct.unpack(">f", rep[11:15])[0], rep[19]
    binary, decimal = signed(rep[15:17]), signed(rep[17:19])
    whole = unpacked(data, _same(bits, n)).astype(float) if template == 0 else _complex(rep, data, n, bits, template == 3)
    return (reference + whole * 2.0**binary) / 10.0**decimal


def _complex(rep: bytes, data: bytes, n: int, bits: int, differenced: bool) -> np.ndarray:
    missing = rep[22]
    groups, least_width, width_bits, least_length, factor, last, length_bits = struct.unpack(">IBBIBIB", rep[31:47])
    order, octets = (rep[47], rep[48]) if differenced else (0, 0)
    if order not in (0, 1, 2):
        raise ContractError(f"differences of order {order} are not understood")
    heads = [signed(data[k * octets : (k + 1) * octets]) for k in range(order + 1)] if order else []
    at = 8 * octets * len(heads)
    tables = []
    for width in (bits, width_bits, length_bits):
        tables.append(unpacked(data, _same(width, groups), at))
        at = -(-(at + width * groups) // 8) * 8  # each table ends with a whole octet
    bases, widths, lengths = tables[0], tables[1] + least_width, tables[2] * factor + least_length
    if groups:
        lengths[-1] = last
    if lengths.sum() != n:
        raise ContractError(f"groups hold {lengths.sum()} values, the section {n}")
    each = np.repeat(widths, lengths)
    packed = unpacked(data, each, at)
    whole = packed + np.repeat(bases, lengths)
    gone = np.zeros(n, bool)
    if missing:  # the largest numbers of a width mark what is missing; of groups without bits, those of the base
        for less in range(1, missing + 1):
            of_base = (np.repeat(bases, lengths) == (1 << bits) - less) & (bits > 0)
            gone |= np.where(each > 0, packed == (np.int64(1) << each) - less, of_base)
    present = whole[~gone]
    if order and len(present):
        present = present + heads[-1]
        present[:order] = heads[:order][: len(present)]
        if order == 2 and len(present) > 1:
            present[1] -= present[0]
            present[1:] = np.cumsum(present[1:])
        present = np.cumsum(present)
    out = np.full(n, np.nan)
    out[~gone] = present
    return out


def decoded(message: bytes, values: bool = True) -> Iterator[Field]:
    """The fields of one message. Sections 2 to 7 may come again; what does not come again stays as it was."""
    if message[:4] != b"GRIB" or message[7] != 2:
        raise ContractError("no GRIB2 message")
    if message[-4:] != b"7777":
        raise ContractError("a GRIB2 message without its end")
    at, held, mask = 16, {}, None
    while message[at : at + 4] != b"7777":
        length = int.from_bytes(message[at : at + 4], "big")
        if length < 5 or at + length > len(message) - 4:
            raise ContractError(f"a section of {length} octets does not fit its message")
        section = message[at : at + length]
        number = section[4]
        held[number] = section
        at += length
        if number == 6 and section[5] != 254:
            mask = None if section[5] == 255 else np.unpackbits(np.frombuffer(section[6:], np.uint8)).astype(bool)
            if section[5] not in (0, 255):
                raise ContractError(f"bitmap {section[5]} is defined elsewhere")
        if number != 7:
            continue
        name, units, lead, step = _product(held[4], message[6])
        year, *rest = struct.unpack(">HBBBBB", held[1][12:19])
        lats, lons, mode = _grid(held[3])
        grid = None
        if values:
            flat = np.full(len(lats) * len(lons), np.nan)
            found = _numbers(held[5], section[5:])
            if mask is None:
                flat[:] = found
            else:
                flat[np.flatnonzero(mask[: len(flat)])] = found
            grid = flat.reshape(len(lons), len(lats)).T if mode & 0x20 else flat.reshape(len(lats), len(lons))
            if mode & 0x10:  # every other line runs backwards
                grid = grid.copy()
                (grid.T if mode & 0x20 else grid)[1::2] = (grid.T if mode & 0x20 else grid)[1::2, ::-1]
        yield Field(name, units, dt.datetime(year, *rest, tzinfo=dt.UTC), lead, step, lats, lons, grid)


def messages(path: str) -> list[Piece]:
    """Places of a file's messages, from the octets in front of each."""
    out = []
    with opened(path) as f:
        size, at = f.size(), 0
        while at < size:
            head = read_at(f, at, min(16, size - at))
            if len(head) < 16 or head[:4] != b"GRIB":
                raise ContractError(f"{path}: no GRIB message at octet {at}")
            length = int.from_bytes(head[8:16], "big")
            if head[7] != 2 or length < 20:
                raise ContractError(f"{path}: GRIB edition {head[7]} at octet {at} is not understood")
            out.append(Piece(path, at, length, (len(out),)))
            at += length
    return out


class GribReader(DataSourceReader):
    def __init__(self, paths: str, values: bool):
        self.paths, self.values = paths, values

    def partitions(self) -> list[Piece]:
        return planned(listed(self.paths, "*.gr*b*"), messages)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is None:  # no messages
            return
        with opened(piece.path) as f:
            message = read_at(f, piece.offset, piece.length)
        for nth, field in enumerate(decoded(message, self.values)):
            yield from batches(field, piece.path, piece.what[0], nth)


def batches(field: Field, path: str, message: int, nth: int) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA; a field without values gives one row that says what it is."""
    nj, ni = len(field.lats), len(field.lons)
    valid = field.init_time + dt.timedelta(hours=field.lead_hours)
    time = pa.timestamp("us", tz="UTC")
    for part in slices(nj * ni) if field.values is not None else [slice(0, 1)]:
        n = part.stop - part.start
        j, i = np.divmod(np.arange(part.start, part.stop, dtype=np.int32), np.int32(ni))
        same = [pa.array([x] * n, t) for x, t in ((path, pa.string()), (message, pa.int32()), (nth, pa.int32()), (field.short_name, pa.string()), (field.units, pa.string()), (field.init_time, time), (valid, time), (field.lead_hours, pa.int32()), (field.step_hours, pa.int32()))]
        if field.values is None:
            own = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())]
        else:
            own = [pa.array(j), pa.array(i), pa.array(field.lats[j]), pa.array(field.lons[i]), pa.array(field.values.reshape(-1)[part], from_pandas=True)]
        yield pa.record_batch(same + own, names=[c.split()[0] for c in SCHEMA.split(", ")])


class GribSource(DataSource):
    """Format ``grib2``: ``load(path)`` of files or folders, comma-separated; option ``values=false`` gives a row a field."""

    @classmethod
    def name(cls) -> str:
        return "grib2"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GribReader:
        return GribReader(self.options["path"], self.options.get("values", "true").lower() != "false")


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(GribSource)
    return spark.read.format("grib2").options(**options).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each field, without values and nodes."""
    return _load(spark, path, values="false").drop("j", "i", "lat", "lon", "value")


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """All nodes of all fields. Before that the headers are read: a field that stands twice in the files raises."""
    twice = headers(spark, path).groupBy("init_time", "lead_hours", "step_hours", "short_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ContractError(f"duplicate field in a set of messages: {twice.asDict()}")
    return _load(spark, path)
