"""Forecast runs kept as one file each, read selectively: a Spark data source with one task for each run and lead.

    rows = runs.read_runs(spark, "s3://bucket/runs", leads=[24, 48])

A file holds all leads of a run, ``variable(time, latitude, longitude)``, in the netCDF classic formats (CDF-1, CDF-2, CDF-5, with or
without a record dimension; runs in HDF5 containers need a conversion such as ``nccopy -k cdf5``). Planning reads each file's
header and its short axes, checks units and time axis, and makes a task for each lead that is asked for; a task reads one
byte range a variable. Leads and fields are chosen by ``leads`` and ``names``, or by pushed filters on ``lead_hours``, ``init_time``
and ``short_name``; what is not asked for is not read.

Rows: (path, short_name, units, init_time, valid_time, lead_hours, j, i, lat, lon, value); fill values and NaN are null.
"""

from __future__ import annotations

import datetime as dt
import operator
import re
import struct
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from ..functions.contracts import ContractError
from ..workers import ship
from .files import Piece, listed, opened, planned, read_at, slices

SCHEMA = "path string, short_name string, units string, init_time timestamp, valid_time timestamp, lead_hours int, j int, i int, lat double, lon double, value double"
STEP_HOURS, MOST_HOURS = 6, 240
# Variables of a run -> short name and the units that they must have.
VARIABLES = {"t2": ("2t", "K"), "u10": ("10u", "m s-1"), "v10": ("10v", "m s-1"), "apcp": ("tp", "m")}
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_STAMP = re.compile(r"(\d{10})(?=_f|\.nc|\D*$)")


@dataclass
class Variable:
    """Where a variable stands in its file; ``stride`` is the distance of its first dimension's entries."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    stride: int
    attributes: Mapping = field(default_factory=dict)

    @property
    def entry_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.kind).itemsize

    def entry(self, f, n: int) -> np.ndarray:
        """One entry of the first dimension, as doubles with NaN where nothing is."""
        raw = np.frombuffer(read_at(f, self.begin + n * self.stride, self.entry_bytes), self.kind).reshape(self.shape[1:])
        return self._real(raw)

    def whole(self, f) -> np.ndarray:
        if self.stride != self.entry_bytes:
            return np.stack([self.entry(f, n) for n in range(self.shape[0])])
        return self._real(np.frombuffer(read_at(f, self.begin, self.shape[0] * self.entry_bytes), self.kind).reshape(self.shape))

    def _real(self, raw: np.ndarray) -> np.ndarray:
        out = raw.astype(float)
        for name in ("_FillValue", "missing_value"):
            if name in self.attributes:
                out[raw == self.attributes[name]] = np.nan
        return out * self.attributes.get("scale_factor", 1.0) + self.attributes.get("add_offset", 0.0)


class _Header:
    """Reads a header's fields one behind the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        self.long = data[3] == 5
        self.far = data[3] in (2, 5)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return int.from_bytes(self.take(8 if self.long else 4), "big")

    def kind(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def list(self, tag: int, item) -> list:
        found, n = self.kind(), self.number()
        if found not in (0, tag) or found == 0 and n:
            raise ContractError(f"a header list {found} where {tag} should be")
        return [item() for _ in range(n)]

    def attribute(self) -> tuple:
        name, kind, n = self.name(), self.kind(), self.number()
        if kind not in _TYPES:
            raise ContractError(f"type {kind} is not understood")
        data = np.frombuffer(self.padded(n * np.dtype(_TYPES[kind]).itemsize), _TYPES[kind])
        return name, data.tobytes().decode().rstrip("\0") if kind == 2 else data[0].item() if n == 1 else data.tolist()

    def variable(self) -> tuple:
        name, dims = self.name(), [self.number() for _ in range(self.number())]
        attributes = dict(self.list(12, self.attribute))
        kind, size, begin = self.kind(), self.number(), int.from_bytes(self.take(8 if self.far else 4), "big")
        if kind not in _TYPES:
            raise ContractError(f"type {kind} of {name} is not understood")
        return name, dims, attributes, _TYPES[kind], size, begin


def variables(f, path: str, first: int = 1 << 16) -> dict[str, Variable]:
    """A file's variables from its header, which is read in growing pieces."""
    size, n = f.size(), first
    while True:
        data = read_at(f, 0, min(n, size))
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ContractError(f"{path}: no netCDF file of a classic format")
        try:
            return _variables(_Header(data))
        except EOFError:
            if n >= size:
                raise ContractError(f"{path}: the header is cut off") from None
            n *= 4


def _variables(h: _Header) -> dict[str, Variable]:
    records = h.number()
    dims = h.list(10, lambda: (h.name(), h.number()))
    h.list(12, h.attribute)
    found = h.list(11, h.variable)
    record = {i for i, (_, n) in enumerate(dims) if n == 0}
    recorded = [(k, d, s) for _, d, _, k, s, _ in found if d and d[0] in record]
    between = sum(s for *_, s in recorded)
    if len(recorded) == 1:  # a single record variable is not padded
        kind, d, _ = recorded[0]
        between = int(np.prod([dims[x][1] for x in d[1:]], dtype=np.int64)) * np.dtype(kind).itemsize
    out = {}
    for name, d, attributes, kind, _, begin in found:
        is_record = bool(d) and d[0] in record
        shape = tuple(records if x in record else dims[x][1] for x in d) or (1,)
        v = Variable(tuple(dims[x][0] for x in d), shape, kind, begin, 0, attributes)
        v.stride = between if is_record else v.entry_bytes
        out[name] = v
    return out


@dataclass
class Run:
    """A run's file: its variables, checked against VARIABLES, and its start from the name."""

    path: str
    init_time: dt.datetime
    variables: dict[str, Variable]
    times: np.ndarray

    @classmethod
    def of(cls, f, path: str) -> Run:
        stamp = _STAMP.search(path.rsplit("/", 1)[-1])
        if not stamp:
            raise ContractError(f"{path}: no start of the run (yyyymmddhh) in the name")
        init = dt.datetime.strptime(stamp[1], "%Y%m%d%H").replace(tzinfo=dt.UTC)
        found = variables(f, path)
        if gone := [n for n in (*VARIABLES, "time", "latitude", "longitude") if n not in found]:
            raise ContractError(f"{path}: no variables {gone}")
        for name, (_, units) in VARIABLES.items():
            have = found[name].attributes.get("units")
            if have != units:
                raise ContractError(f"{path}: {name} has units {have!r}, expected {units!r}")
            if found[name].dims != ("time", "latitude", "longitude"):
                raise ContractError(f"{path}: {name} has dimensions {found[name].dims}")
        return cls(path, init, found, found["time"].whole(f))

    def leads(self) -> list[int]:
        return [n * STEP_HOURS for n in range(min(len(self.times), MOST_HOURS // STEP_HOURS + 1))]

    def place(self, lead: int) -> int:
        """The lead's place on the time axis, which must hold seconds of the epoch, a step apart."""
        if lead % STEP_HOURS or not 0 <= lead <= MOST_HOURS or lead // STEP_HOURS >= len(self.times):
            raise ContractError(f"{self.path}: no lead of {lead} hours")
        at, want = lead // STEP_HOURS, self.init_time.timestamp() + lead * 3600
        if self.times[at] != want:
            raise ContractError(f"{self.path}: the time axis has {self.times[at]:.0f} at +{lead} h, its start implies {want:.0f}")
        return at


class Asked:
    """What the filters leave: leads, starts and names."""

    TESTS = {"EqualTo": operator.eq, "In": lambda x, y: x in y, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le}

    def __init__(self, leads: Iterable[int] | None = None, names: Iterable[str] | None = None):
        self.leads, self.tests = None if leads is None else sorted(set(leads)), []
        self.names = [n for n, _ in VARIABLES.values()] if names is None else list(names)

    def push(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Keep the filters that choose whole pieces; give the others back."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("lead_hours", "init_time", "short_name") and type(f).__name__ in self.TESTS:
                self.tests.append((column, type(f).__name__, f.value))
            elif not (isinstance(f, D.IsNotNull) and column in ("lead_hours", "init_time", "short_name")):
                yield f

    def keeps(self, column: str, x) -> bool:
        return all(self.TESTS[kind](x, _utc(y)) for c, kind, y in self.tests if c == column)


def _utc(x):
    if isinstance(x, (tuple, list)):
        return [_utc(y) for y in x]
    return x.replace(tzinfo=dt.UTC) if isinstance(x, dt.datetime) and x.tzinfo is None else x


class RunReader(D.DataSourceReader):
    def __init__(self, paths: str, asked: Asked):
        self.paths, self.asked = paths, asked

    def partitions(self) -> list[Piece]:
        return planned(listed(self.paths, "*.nc"), self._pieces)

    def _pieces(self, path: str) -> list[Piece]:
        with opened(path) as f:
            run = Run.of(f, path)
        if not self.asked.keeps("init_time", run.init_time):
            return []
        leads = run.leads() if self.asked.leads is None else self.asked.leads
        return [Piece(path, run.place(k), 0, (k,)) for k in leads if self.asked.keeps("lead_hours", k)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is None:  # nothing is asked for
            return
        (lead,) = piece.what
        with opened(piece.path) as f:
            run = Run.of(f, piece.path)
            at = run.place(lead)
            lats, lons = (run.variables[n].whole(f) for n in ("latitude", "longitude"))
            for name, (short, units) in VARIABLES.items():
                if short in self.asked.names and self.asked.keeps("short_name", short):
                    yield from _rows(piece.path, short, units, run.init_time, lead, lats, lons, run.variables[name].entry(f, at))


class FilteredRunReader(RunReader):
    """Spark refuses readers that take filters unless the session pushes them."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        return list(self.asked.push(filters))


def _rows(path: str, short: str, units: str, init: dt.datetime, lead: int, lats: np.ndarray, lons: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    valid, time = init + dt.timedelta(hours=lead), pa.timestamp("us", tz="UTC")
    for part in slices(values.size):
        n = part.stop - part.start
        j, i = np.divmod(np.arange(part.start, part.stop, dtype=np.int32), np.int32(len(lons)))
        same = [pa.array([x] * n, t) for x, t in ((path, pa.string()), (short, pa.string()), (units, pa.string()), (init, time), (valid, time), (lead, pa.int32()))]
        own = [pa.array(j), pa.array(i), pa.array(lats[j]), pa.array(lons[i]), pa.array(values.reshape(-1)[part], from_pandas=True)]
        yield pa.record_batch(same + own, names=[c.split()[0] for c in SCHEMA.split(", ")])


class RunSource(D.DataSource):
    """Format ``forecast_run``: ``load(path)`` of files or folders; options ``leads`` and ``names``, comma-separated, and ``filters`` where filters are pushed."""

    @classmethod
    def name(cls) -> str:
        return "forecast_run"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunReader:
        split = lambda key, of: [of(x) for x in self.options[key].split(",") if x] if key in self.options else None
        kind = FilteredRunReader if self.options.get("filters") == "true" else RunReader
        return kind(self.options["path"], Asked(split("leads", int), split("names", str)))


def read_runs(spark: SparkSession, path: str, leads: Sequence[int] | None = None, names: Sequence[str] | None = None, push_filters: bool = False) -> DataFrame:
    """The fields ``names`` (all) of every run at ``leads`` (all). A lead that a run does not have raises.

    With ``push_filters`` (and the session's setting) filters choose the tasks too. Spark 4.1 keeps the filters of a Python source
    with the loaded table, so that a result must stand under one filter: do not join or unite two selections of it.
    """
    ship(spark)
    spark.dataSource.register(RunSource)
    options = {k: ",".join(map(str, v)) for k, v in (("leads", leads), ("names", names)) if v is not None}
    on = push_filters and spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    return spark.read.format("forecast_run").options(**options, filters=str(on).lower()).load(path)
