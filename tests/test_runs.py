"""Runs of a forecast model in netCDF classic files that the tests write: only the asked leads are read."""

import datetime as dt
import struct

import numpy as np
import pytest

from gaugemark.functions.contracts import ContractError
from gaugemark.sources import fields, runs

KIND = {"f4": 5, "f8": 6, "i2": 3, "i4": 4, "i8": 10}
UNITS = {"t2": "K", "u10": "m s-1", "v10": "m s-1", "apcp": "m"}
LATS, LONS, LEADS = np.array([90.0, 45.0, 0.0]), np.array([0.0, 90.0, 180.0, 270.0, 300.0]), range(0, 61, 6)
INIT = dt.datetime(2025, 8, 1, 0, tzinfo=dt.UTC)


def classic(path, dims, variables, version=2, record=None):
    """A netCDF classic file; variables: name -> (dims, kind, attributes, array)."""
    wide = version == 5
    num = lambda n: struct.pack(">Q" if wide else ">I", n)
    pad = lambda b: b + bytes(-len(b) % 4)
    name = lambda s: num(len(s.encode())) + pad(s.encode())
    names = list(dims)

    def attribute(k, v):
        if isinstance(v, str):
            return name(k) + struct.pack(">I", 2) + num(len(v)) + pad(v.encode())
        a = np.atleast_1d(v)
        kind = {"f": "f8" if a.dtype.itemsize == 8 else "f4", "i": f"i{a.dtype.itemsize}"}[a.dtype.kind]
        return name(k) + struct.pack(">I", KIND[kind]) + num(len(a)) + pad(a.astype(">" + kind).tobytes())

    some = lambda tag, items: struct.pack(">I", tag if items else 0) + num(len(items)) + b"".join(items)

    def header(begins):
        out = []
        for n, (d, kind, attributes, a) in variables.items():
            size = (a[0].nbytes if d[:1] == (record,) else a.nbytes) // a.itemsize * int(kind[1])
            out.append(name(n) + num(len(d)) + b"".join(num(names.index(x)) for x in d) + some(12, [attribute(*x) for x in attributes.items()]) + struct.pack(">I", KIND[kind]) + num(size + -size % 4) + struct.pack(">I" if version == 1 else ">Q", begins[n]))
        top = b"CDF" + bytes([version]) + num(dims[record] if record else 0)
        return top + some(10, [name(n) + num(0 if n == record else k) for n, k in dims.items()]) + some(12, [attribute("title", "run")]) + some(11, out)

    at, begins = len(header(dict.fromkeys(variables, 0))), {}
    data = {n: a.astype(">" + kind) for n, (_, kind, _, a) in variables.items()}
    fixed = [n for n, v in variables.items() if v[0][:1] != (record,)]
    recorded = [n for n in variables if n not in fixed]
    body = b""
    for n in fixed:
        begins[n] = at + len(body)
        body += pad(data[n].tobytes())
    start = len(body)
    for n in recorded:
        begins[n] = at + start
        start += len(pad(data[n][:1].tobytes())) if len(recorded) > 1 else 0
    for k in range(dims[record] if record else 0):
        body += b"".join(pad(data[n][k : k + 1].tobytes()) if len(recorded) > 1 else data[n][k : k + 1].tobytes() for n in recorded)
    path.write_bytes(header(begins) + body)


def run_file(folder, init=INIT, version=2, record=None, units=UNITS, late=0, seed=0, packed=False):
    r = np.random.default_rng(seed)
    planes = {n: np.round(r.uniform(0, 30, (len(LEADS), 3, 5)), 2) for n in UNITS}
    planes["t2"][2, 1, 1] = np.nan
    times = np.array([init.timestamp() + 3600 * k + (late if k >= 12 else 0) for k in LEADS])
    v = {"time": (("time",), "f8", {}, times), "latitude": (("latitude",), "f4", {}, LATS), "longitude": (("longitude",), "f8", {}, LONS)}
    for n, p in planes.items():
        stored = np.where(np.isnan(p), -9999, np.round(p * 100)).astype("i2") if packed else np.where(np.isnan(p), -1e30, p)
        more = {"_FillValue": np.int16(-9999), "scale_factor": 0.01} if packed else {"_FillValue": np.float64(-1e30)}
        v[n] = (("time", "latitude", "longitude"), "i2" if packed else "f8", {"units": units[n], **more}, stored)
    path = folder / f"RUN_v1_{init:%Y%m%d%H}_f000_f240_06.nc"
    classic(path, {"time": len(LEADS), "latitude": 3, "longitude": 5, "other": 7}, v, version, record)
    return path, planes


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("record", [None, "time"])
@pytest.mark.parametrize("packed", [False, True])
def test_variables_of_all_classic_formats(tmp_path, version, record, packed):
    path, planes = run_file(tmp_path, version=version, record=record, packed=packed)
    with runs.opened(str(path)) as f:
        run = runs.Run.of(f, str(path))
        assert [v.shape for v in run.variables.values()] == [(11,), (3,), (5,)] + [(11, 3, 5)] * 4
        for n, p in planes.items():
            assert np.allclose(run.variables[n].whole(f), p, atol=1e-6, equal_nan=True)
            assert np.allclose(run.variables[n].entry(f, 3), p[3], atol=1e-6)
        assert runs.variables(f, str(path), first=16).keys() == run.variables.keys()
    assert run.init_time == INIT and run.leads() == list(LEADS) and run.place(24) == 4


def test_a_single_record_variable_is_not_padded(tmp_path):
    a = np.arange(15, dtype="i2").reshape(5, 3)
    classic(tmp_path / "x.nc", {"t": 5, "x": 3}, {"v": (("t", "x"), "i2", {}, a)}, 1, "t")
    with runs.opened(str(tmp_path / "x.nc")) as f:
        assert runs.variables(f, "x")["v"].whole(f).tolist() == a.tolist()


def rows_of(df):
    return {(r["init_time"], r["short_name"], r["lead_hours"], r["j"], r["i"]): r["value"] for r in df.collect()}


def test_only_asked_leads_are_read(spark, tmp_path):
    later = INIT + dt.timedelta(hours=12)
    made = {t: run_file(tmp_path, t, record="time", seed=k)[1] for k, t in enumerate((INIT, later))}
    df = runs.read_runs(spark, str(tmp_path), leads=[12, 24])
    assert df.rdd.getNumPartitions() == 4
    got = rows_of(df)
    assert len(got) == 2 * 2 * 4 * 15
    names = {short: n for n, (short, _) in runs.VARIABLES.items()}
    for (init, short, lead, j, i), x in got.items():
        want = made[init.replace(tzinfo=dt.UTC)][names[short]][lead // 6, j, i]
        assert x is None and np.isnan(want) or x == pytest.approx(want)
    assert got[INIT.replace(tzinfo=None), "2t", 12, 1, 1] is None
    assert {(r["lat"], r["lon"]) for r in df.select("lat", "lon").distinct().collect()} == {(a, b) for a in LATS for b in LONS}
    assert runs.read_runs(spark, str(tmp_path), leads=[], names=["tp"]).count() == 0
    assert runs.read_runs(spark, str(tmp_path)).rdd.getNumPartitions() == 22
    fields.check_units(df), fields.check_leads(df)


def test_filters_choose_tasks(spark, tmp_path):
    for k, t in enumerate((INIT, INIT + dt.timedelta(hours=12))):
        run_file(tmp_path, t, seed=k)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for text, tasks, rows in (("lead_hours = 24", 2, 120), ("lead_hours in (6, 12, 18) and short_name = 'tp'", 6, 90), ("lead_hours > 48 and lead_hours <= 60 and value > -1", 4, 240), ("init_time = timestamp'2025-08-01 12:00:00' and lead_hours < 12", 2, 120), ("lead_hours = 7", 1, 0)):
            asked = runs.read_runs(spark, str(tmp_path), push_filters=True).where(text)
            assert (asked.rdd.getNumPartitions(), asked.count()) == (tasks, rows), text
        df = runs.read_runs(spark, str(tmp_path))  # nothing is pushed into it: selections may meet
        assert df.where("lead_hours = 24").union(df.where("lead_hours in (12, 30)")).count() == 360
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert runs.read_runs(spark, str(tmp_path)).where("lead_hours = 24").count() == 120


def test_bytes_of_other_leads_are_not_touched(tmp_path, monkeypatch):
    path, _ = run_file(tmp_path)
    read = []
    monkeypatch.setattr(runs, "read_at", lambda f, at, n, real=runs.read_at: read.append((at, n)) or real(f, at, n))
    reader = runs.RunReader(str(path), runs.Asked([24], ["2t", "tp"]))
    (piece,) = reader.partitions()
    read.clear()
    rows = sum(b.num_rows for b in reader.read(piece))
    planes = [n for at, n in read if n == 15 * 8]
    assert rows == 30 and len(planes) == 2 and sum(n for at, n in read if at) < 2 * 15 * 8 + 8 * (11 + 3 + 5) + 1


def test_wrong_units_times_names_and_files_raise(spark, tmp_path):
    def fails(text, **options):
        folder = tmp_path / text.replace(" ", "_")
        folder.mkdir()
        path, _ = run_file(folder, **options)
        with pytest.raises(Exception, match=text):
            runs.read_runs(spark, str(folder), leads=[0, 24]).collect()
        return path

    path = fails("units 'mm'", units=UNITS | {"apcp": "mm"})
    fails("the time axis has", late=60)
    good, _ = run_file(tmp_path)
    for leads in ([7], [-6], [66], [246]):
        with pytest.raises(Exception, match="no lead of"):
            runs.read_runs(spark, str(good), leads=leads).collect()
    (tmp_path / "bad").mkdir()
    for name, data, text in (("RUN_2025080100_f.nc", b"HDF" + bytes(99), "no netCDF file"), ("RUN_2025080100_f.nc", good.read_bytes()[:100], "cut off"), ("nodate.nc", path.read_bytes(), "no start of the run")):
        (tmp_path / "bad" / name).write_bytes(data)
        with pytest.raises(ContractError, match=text), runs.opened(str(tmp_path / "bad" / name)) as f:
            runs.Run.of(f, name)
