"""GRIB2 messages that the tests write are read back: packings, scan modes, bitmaps, several fields, errors."""

import datetime as dt

import numpy as np
import pytest

import grib_writer as G
from gaugemark.functions.contracts import ContractError
from gaugemark.operators import geo, matching
from gaugemark.sources import grib

LATS, LONS = np.array([10.0, 9.5, 9.0, 8.5]), np.array([350.0, 355.0, 360.0, 365.0, 370.0])


def values(seed, n=20, low=250.0, high=310.0):
    return np.round(np.random.default_rng(seed).uniform(low, high, n), 2)


def one(message):
    (out,) = grib.decoded(message)
    return out


@pytest.mark.parametrize("rep", [G.simple, lambda v: G.simple(v, 1, 3), lambda v: G.simple(v, -1), G.complex_, lambda v: G.complex_(v, order=1), lambda v: G.complex_(v, order=2), lambda v: G.complex_(v, order=2, group=3), G.floats, lambda v: G.floats(v, 2)])
@pytest.mark.parametrize("kind", ["rough", "smooth", "equal", "negative"])
def test_packings_round_trip(rep, kind):
    v = {"rough": values(1), "smooth": np.round(270 + np.cumsum(np.linspace(0, 2, 20)), 2), "equal": np.full(20, 273.15), "negative": np.round(np.linspace(-40, 12.5, 20), 2)}[kind]
    head, data = rep(v)
    f = one(G.message(G.field("2t", 6, (head, data), LATS, LONS)))
    decimal = grib.signed(head[12:14]) if head[4:6] != b"\0\4" else None
    step = 1e-5 * np.abs(v).max() if decimal is None else 0.5 * 2.0 ** grib.signed(head[10:12]) / 10.0**decimal
    assert np.abs(f.values.reshape(-1) - v).max() <= step + 1e-4
    assert (f.short_name, f.units, f.lead_hours, f.step_hours, f.init_time) == ("2t", "K", 6, 0, dt.datetime(2024, 3, 1, 12, tzinfo=dt.UTC))
    assert f.lats.tolist() == LATS.tolist() and f.lons.tolist() == LONS.tolist()


@pytest.mark.parametrize("order", [0, 1, 2])
@pytest.mark.parametrize("missing", [1, 2])
def test_missing_values_of_complex_packing(order, missing):
    r = np.random.default_rng(order)
    v = values(2, 200)
    v[r.random(200) < 0.3] = np.nan
    v[40:61] = np.nan  # whole groups
    if missing == 2:
        v[r.random(200) < 0.1] = np.inf
    f = one(G.message(G.field("2t", 6, G.complex_(v, order=order, missing=missing), np.linspace(0, 9, 10), np.linspace(0, 19, 20))))
    want = np.where(np.isfinite(v), v, np.nan)
    assert np.allclose(f.values.reshape(-1), want, atol=0.006, equal_nan=True)


@pytest.mark.parametrize("seed", range(30))
def test_random_fields_of_all_packings(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 60))
    v = np.round(np.cumsum(r.normal(0, r.choice([0.01, 1, 300]), n)), 2)
    for rep in (G.simple(v), G.complex_(v, group=int(r.integers(2, 9))), G.complex_(v, order=1, group=4), G.complex_(v, order=2, group=5) if n > 2 else G.simple(v)):
        f = one(G.message(G.field("2t", 6, rep, np.zeros(1), np.arange(n))))
        assert np.allclose(f.values.reshape(-1), v, atol=0.01 + 1e-6 * np.abs(v).max())


@pytest.mark.parametrize("mode", [0x00, 0x40, 0x80, 0x20, 0x10, 0x30])
def test_scan_modes(mode):
    lats, lons = (LATS[::-1] if mode & 0x40 else LATS), (LONS[::-1] if mode & 0x80 else LONS)
    plane = np.add.outer(lats * 10, lons)  # what each node must hold
    stored = plane.T if mode & 0x20 else plane
    stored = stored.copy()
    if mode & 0x10:
        stored[1::2] = stored[1::2, ::-1]
    f = one(G.message(G.field("2t", 6, G.simple(stored.reshape(-1)), lats, lons, mode)))
    assert f.lats.tolist() == lats.tolist() and f.lons.tolist() == lons.tolist()
    assert np.allclose(f.values, plane, atol=0.006)


def test_bitmaps_several_fields_and_accumulations():
    mask = np.arange(20) % 3 > 0
    u, v = values(3, 14 - 1, -20, 20), values(4, 14 - 1, -20, 20)
    assert mask.sum() == 13
    m = G.message(G.field("10u", 9, G.simple(u), LATS, LONS, mask=mask), G.field("10v", 9, G.simple(v), LATS, LONS, same_mask=True, with_grid=False), G.field("tp", 12, G.simple(values(5)), LATS, LONS, step=6, with_grid=False))
    a, b, c = grib.decoded(m)
    for f, want in ((a, u), (b, v)):
        assert np.allclose(f.values.reshape(-1)[mask], want, atol=0.006) and np.isnan(f.values.reshape(-1)[~mask]).all()
    assert (c.short_name, c.units, c.lead_hours, c.step_hours) == ("tp", "kg m-2", 12, 6) and not np.isnan(c.values).any()
    members = one(G.message(G.field("tp_m", 24, G.floats(values(6)), LATS, LONS, step=24, ensemble=True)))
    assert (members.short_name, members.units, members.lead_hours, members.step_hours) == ("tp", "m", 24, 24)
    days = one(G.message(G.field("2t", 2, G.floats(values(6)), LATS, LONS, unit=2)))
    assert days.lead_hours == 48
    odd = one(G.message(G.field("odd", 3, G.floats(values(6)), LATS, LONS), discipline=2))
    assert (odd.short_name, odd.units) == ("2.7.9@105:3", None)


def test_what_is_not_understood_raises():
    good = G.message(G.field("2t", 6, G.simple(values(1)), LATS, LONS))
    bad = {"no GRIB2": b"XXXX" + good[4:], "without its end": good[:-1], "data template 5.40": G.message(G.field("2t", 6, (good[0:4] + b"\0\x28" + bytes(20), b""), LATS, LONS))}
    bad["data section is shorter"] = G.message(G.field("2t", 6, (G.simple(values(1))[0], b"\1"), LATS, LONS))
    bad["does not fit"] = good[:16] + b"\xff" * 4 + good[20:]
    bad["no whole hours"] = G.message(G.field("2t", 90, G.simple(values(1)), LATS, LONS, unit=0))
    for text, message in bad.items():
        with pytest.raises(ContractError, match=text):
            list(grib.decoded(message))


def test_source_reads_a_task_a_message(spark, tmp_path):
    names, leads = ("2t", "10u", "10v", "tp"), (6, 12)
    data = {(n, k): values(hash((n, k)) % 1000, 20, 0, 30) for n in names for k in leads}
    for k in leads:
        (tmp_path / f"run_{k}.grib2").write_bytes(b"".join(G.message(G.field(n, k, G.complex_(data[n, k], order=2) if n == "2t" else G.simple(data[n, k]), LATS, LONS, step=6 if n == "tp" else 0)) for n in names))
    (tmp_path / "notes.txt").write_text("no fields")
    df = grib.read_fields(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 8
    rows = df.collect()
    assert len(rows) == 8 * 20
    for r in rows:
        assert (r["lat"], r["lon"]) == (LATS[r["j"]], LONS[r["i"]])
        assert r["value"] == pytest.approx(data[r["short_name"], r["lead_hours"]][r["j"] * 5 + r["i"]], abs=0.006)
        assert (r["valid_time"] - r["init_time"]).total_seconds() == 3600 * r["lead_hours"]
    heads = grib.headers(spark, f"{tmp_path}/run_6.grib2,file://{tmp_path}/run_12.grib2")
    assert sorted((r["short_name"], r["lead_hours"], r["message"]) for r in heads.collect()) == sorted((n, k, m) for m, n in enumerate(names) for k in leads)


def test_duplicate_fields_and_damaged_files_raise(spark, tmp_path):
    m = G.message(G.field("2t", 6, G.simple(values(1)), LATS, LONS))
    (tmp_path / "a.grib2").write_bytes(m)
    (tmp_path / "b.grb2").write_bytes(G.message(G.field("2t", 12, G.simple(values(1)), LATS, LONS)) + m)
    with pytest.raises(ContractError, match="duplicate field"):
        grib.read_fields(spark, str(tmp_path))
    assert grib.read_fields(spark, f"{tmp_path}/b.grb2").count() == 40
    (tmp_path / "c.grib2").write_bytes(m + b"junk")
    for path, text in ((f"{tmp_path}/c.grib2", "no GRIB message at octet"), (f"{tmp_path}/none", "none")):
        with pytest.raises(Exception, match=text):
            grib.headers(spark, path).collect()


def test_decoded_fields_reach_stations(spark, tmp_path):
    """From messages to points: bilinear temperature and wind, rain at the nearest node."""
    plane = np.add.outer(LATS, LONS / 10)
    fields = [G.field(n, 6, G.floats(plane.reshape(-1), 2), LATS, LONS, step=6 if n == "tp" else 0) for n in ("2t", "10u", "10v", "tp")]
    (tmp_path / "run.grib2").write_bytes(b"".join(map(G.message, fields)))
    df = grib.read_fields(spark, f"{tmp_path}/run.grib2").selectExpr("'gfs' AS model", "*")
    at = spark.createDataFrame([("west", 9.25, -7.5), ("east", 8.5, 6.0)], "station_id string, lat double, lon double")
    nodes = df.where("short_name = '2t'").select("j", "i", "lat", "lon")
    points = matching.instantaneous_points(df, geo.grid_weights(at, nodes))
    got = {(r["station_id"], r["variable"]): r["value"] for r in points.collect()}
    assert got["west", "t2m"] == pytest.approx(9.25 + 35.25) and got["east", "t2m"] == pytest.approx(8.5 + 36.6)
    assert got["west", "wind10m"] == pytest.approx(np.sqrt(2) * 44.5)
    rain = {r["station_id"]: r["value"] for r in matching.precip_points(df, geo.nearest_nodes(at, nodes)).collect()}
    assert rain == {"west": pytest.approx(9.5 + 35.0), "east": pytest.approx(8.5 + 36.5)}
