"""Hand-computed values of the domain operators."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugemark.functions import contracts as C
from gaugemark.functions import geo as G
from gaugemark.functions import student
from gaugemark.operators import bootstrap, geo, matching, metrics, qc, strata, tests
from gaugemark.sources import gridindex, indices, observations, sinks, stations

T0 = dt.datetime(2025, 8, 1)
H = dt.timedelta(hours=1)


def obs(spark, values, variable="t2m", station="A", step=H, flags=0):
    rows = [(station, variable, T0 + i * step, v, flags) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, variable string, valid_time timestamp, value double, qc_flags int")


def flags(df):
    return [r["qc_flags"] for r in df.orderBy("station_id", "valid_time").collect()]


# -- contracts


def test_validate_names_every_problem(spark):
    good = spark.createDataFrame([], C.OBS)
    assert C.validate(good, C.OBS, "obs") is good
    with pytest.raises(C.ContractError, match="missing column 'value'.*unexpected column 'x'"):
        C.validate(good.drop("value").withColumn("x", F.lit(1)), C.OBS, "obs")
    with pytest.raises(C.ContractError, match="double"):
        C.validate(good.withColumn("value", F.lit("a")), C.OBS, "obs")
    with pytest.raises(C.ContractError):
        C.require_non_null(obs(spark, [1.0, None]), ["value"], "obs")


def test_reconcile():
    assert C.reconcile("s", 1000, 870, {"a": 130})["rows_out"] == 870
    for args in ((1000, 990, {}), (10, 10, {"a": 5}), (-1, 0, {})):
        with pytest.raises(C.ReconciliationError):
            C.reconcile("s", *args)


def test_bits_and_units(spark):
    r = spark.range(1).select(C.describe(F.lit(9)).alias("d"), C.is_clean(F.lit(32), 31).alias("c"), C.c_to_k(F.lit(25.0)).alias("k"), C.m_to_mm(F.lit(0.0123)).alias("m"), C.wind_speed(F.lit(3.0), F.lit(4.0)).alias("w"), C.scaled_tenths(F.lit(215)).alias("s"), C.scaled_tenths(F.lit(-9999)).alias("n")).first()
    assert r["d"] == ["RANGE", "SPATIAL"] and r["c"] and r["k"] == 298.15 and abs(r["m"] - 12.3) < 1e-9 and r["w"] == 5 and r["s"] == 21.5 and r["n"] is None


# -- quality checks


def test_range(spark):
    rows = [("A", "t2m", T0, 400.0, 0), ("A", "wind10m", T0, -5.0, 0), ("A", "precip_1h", T0, 250.0, 0), ("B", "t2m", T0, 298.15, 0), ("C", "t2m", T0, None, 0)]
    df = spark.createDataFrame(rows, "station_id string, variable string, valid_time timestamp, value double, qc_flags int")
    assert sorted(flags(qc.range_check(df))) == [0, 0, 1, 1, 1]


def test_step(spark):
    assert flags(qc.step_check(obs(spark, [290.0, 300.0]))) == [0, 2]
    assert flags(qc.step_check(obs(spark, [290.0, 300.0], step=6 * H))) == [0, 0]


def test_persistence(spark):
    run = lambda *a, **k: flags(qc.persistence_check(obs(spark, *a, **k)))
    assert run([290.0] * 7) == [4] * 7 and run([290.0] * 5) == [0] * 5
    assert run([0.3] * 8, "wind10m") == [0] * 8 and run([0.0] * 48, "precip_1h") == [0] * 48
    assert run([None] * 8) == [0] * 8 and run([290.0] * 3 + [None] + [290.0] * 3) == [0] * 7
    gap = obs(spark, [290.0] * 3).unionByName(obs(spark, [290.0] * 4).withColumn("valid_time", F.col("valid_time") + F.expr("INTERVAL 5 HOURS")))
    assert flags(qc.persistence_check(gap)) == [0] * 7


def test_spatial(spark):
    pairs = spark.createDataFrame([("X", f"N{i}") for i in range(5)], "station_id string, neighbor_id string")
    for value, near, want in ((296.0, 5, 0), (313.0, 5, 8), (313.0, 2, 0)):
        df = obs(spark, [value], station="X")
        for i in range(near):
            df = df.unionByName(obs(spark, [293.0], station=f"N{i}"))
        assert flags(qc.spatial_check(df, pairs))[-1] == want


def test_metadata_duplicate_and_conflicts(spark):
    places = spark.createDataFrame([("A", "inmet", 1.0, 1.0, 100.0, 250.0, None), ("B", "isd", 1.0, None, 1.0, 1.0, "A"), ("D", "isd", 1.0, 1.0, 1.0, None, "A")], "station_id string, network string, lat double, lon double, elev_station double, elev_dem double, cross_ref string")
    df = obs(spark, [290.0], station="A").unionByName(obs(spark, [290.04], station="B")).unionByName(obs(spark, [291.0], station="D")).unionByName(obs(spark, [1.0], station="U"))
    assert flags(qc.metadata_check(df, places)) == [16, 16, 0, 0]
    assert flags(qc.duplicate_check(df, places)) == [0, 32, 0, 0]
    assert qc.unique_obs(df.unionByName(df)).count() == 4
    with pytest.raises(C.ContractError):
        qc.unique_obs(df.unionByName(df.withColumn("value", F.col("value") + 1)))
    assert qc.run_qc(df.drop("qc_flags"), places).count() == 4


# -- geography


def test_distances(spark):
    r = spark.range(1).select(G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"), G.cell(F.lit(-30.1)).alias("c"), G.tile(F.lit(-15.5), F.lit(-47.2)).alias("t")).first()
    assert abs(r["d"] - 111.195) < 0.01 and r["c"] == -121 and r["t"] == "S16_W048"


@settings(max_examples=8, deadline=None)
@given(seed=st.integers(0, 10**6), km=st.sampled_from([40.0, 300.0, 2500.0]))
def test_near_pairs_equal_brute_force(spark, seed, km):
    r = np.random.default_rng(seed)
    rows = [(str(i), float(np.degrees(np.arcsin(r.uniform(-1, 1)))) if km > 100 else float(r.uniform(-31, -29)), float(r.uniform(-180, 180)) if km > 100 else float(r.choice([179.8, -179.9, 0.1]) + r.uniform(-0.3, 0.3))) for i in range(120)]
    df = spark.createDataFrame(rows, "station_id string, lat double, lon double")

    def dist(a, b):
        la, lb, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2)))

    want = {(a[0], b[0]) for a in rows for b in rows if dist(a, b) <= km}
    got = [(x["id_l"], x["id_r"]) for x in geo.near_pairs(df, df, km).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_density_weights(spark):
    rows = [(f"c{i}", -30.0, -51 + 0.0002 * i) for i in range(5)] + [("lone", -35.0, -51.0)]
    got = {x["station_id"]: x["weight"] for x in geo.density_weights(spark.createDataFrame(rows, "station_id string, lat double, lon double")).collect()}
    assert abs(got["lone"] - 3) < 1e-3 and abs(got["c0"] - 0.6) < 1e-3
    with pytest.raises(ValueError):
        geo.density_weights(spark.createDataFrame([*rows, rows[0]], "station_id string, lat double, lon double"))


def test_bilinear_and_nearest(spark):
    field = [(0, 0, 0.0, 0.0, 1.0), (0, 1, 0.0, 1.0, 2.0), (1, 0, 1.0, 0.0, 3.0), (1, 1, 1.0, 1.0, 4.0)]
    at = spark.createDataFrame([("m", 0.5, 0.5), ("q", 0.25, 0.75), ("n", 1.0, 0.0), ("out", 2.0, 0.5)], "station_id string, lat double, lon double")
    for flip in (False, True):
        grid = spark.createDataFrame([(1 - j if flip else j, i, la, lo, v) for j, i, la, lo, v in field], "j int, i int, lat double, lon double, value double")
        got = {x["station_id"]: x["value"] for x in geo.bilinear(geo.grid_weights(at, grid, outside="drop"), grid, []).collect()}
        assert got == {"m": 2.5, "q": 2.25, "n": 3.0}
    assert {(x["station_id"], x["j"], x["i"]) for x in geo.nearest_nodes(at, grid, outside="drop").collect()} >= {("m", 0, 0), ("n", 0, 0)}


# -- matching


def test_rain_accumulation(spark):
    def run(model, leads):
        rows = [(model, "A", T0, k, v) for k, v in leads.items()]
        out = matching.precip_24h_forecast(spark.createDataFrame(rows, "model string, station_id string, init_time timestamp, lead_hours int, value double"))
        return {x["lead_hours"]: x["precip_24h"] for x in out.collect()}

    assert run("hres", {24: 12.3, 48: 20.3}) == {24: 12.3, 48: pytest.approx(8.0)}
    assert run("gfs", {30: 1.0, 36: 2.0, 42: 0.5, 48: 1.5})[48] == 5.0
    assert run("gfs", {30: 1.0, 42: 0.5, 48: 1.5})[48] is None and run("hres", {48: 2.0})[48] is None
    every_three = {k: 10.0 if k % 6 else 1.0 for k in range(3, 28, 3)} | {24: 57.0}
    assert run("gfs", every_three)[24] == 1.0 * 3 + 57.0 and run("gfs", every_three)[27] == 40.0
    assert run("graphcast", {k: 5.0 for k in (9, 15, 21, 24)})[24] is None and run("gfs", {k: 5.0 for k in (9, 15, 21, 27)})[27] == 20.0
    assert run("aifs", {24: 5.0, 48: 4.8})[48] == pytest.approx(-0.2) and run("hres", {18: 1.0})[18] is None


def test_rain_observation(spark):
    one = obs(spark, [1.0] * 24, "precip_1h")
    last = lambda df: matching.precip_24h_obs(df).orderBy(F.desc("valid_time")).first()
    assert last(one)["obs"] == 24
    marked = one.withColumn("qc_flags", F.when(F.col("valid_time") < T0 + 2 * H, F.lit(65)).otherwise(0))
    assert (last(marked)["obs"], last(marked)["n_clean_hours"], last(marked)["qc_flags"]) == (22, 22, 1)
    assert last(obs(spark, [1.0] * 20, "precip_1h")) is None


def test_elevation(spark):
    adj = lambda v, x, dz: spark.range(1).select(matching.elevation_adjusted(F.lit(v), F.lit(x), F.lit(dz).cast("double")).alias("y")).first()["y"]
    assert adj("t2m", 290.0, -400.0) == pytest.approx(292.6) and adj("wind10m", 5.0, -400.0) == 5 and adj("wind10m", 5.0, 300.0) == pytest.approx(7.0)
    assert adj("wind10m", 1.0, 2000.0) == pytest.approx(3.0) and adj("wind10m", 5.0, None) is None and adj("precip_24h", 1.0, 1.0) is None


def test_fact_reconciles(spark):
    places = spark.createDataFrame([("A", 800.0), ("B", 10.0)], "station_id string, elev_station double")
    vt = T0 + 24 * H
    point = lambda s, var, v, elev: (s, "gfs", var, T0, vt, 24, v, "bilinear", -30.0, -51.0, elev, "x")
    rows = [point("A", "t2m", 290.0, 1200.0), point("A", "wind10m", 5.0, 1200.0), point("A", "precip_24h", 3.0, 1200.0), point("B", "t2m", 290.0, 900.0), point("A", "t2m", 291.0, None)]
    points = spark.createDataFrame(rows, C.FORECAST_POINTS)
    seen = spark.createDataFrame([("A", "t2m", vt, 291.0, 0), ("A", "wind10m", vt, 4.0, 0), ("B", "t2m", vt, 288.0, 0)], "station_id string, variable string, valid_time timestamp, value double, qc_flags int")
    tagged = matching.tagged_pairs(points, seen, places)
    assert matching.check_fact(tagged) == {"stage": "fact", "rows_in": 5, "rows_out": 3, "dropped": {"obs_missing_or_incomplete": 1, "delta_z_exceeded": 1}}
    fact = {(r["variable"], r["delta_z"]): r for r in matching.build_fact(points, seen, places, "v").collect()}
    assert fact["t2m", -400.0]["fcst_elev_adj"] == pytest.approx(292.6) and fact["t2m", None]["fcst_elev_adj"] is None and len(fact) == 3


def test_floor_and_views(spark):
    rows = [(s, "t2m", T0 + i * H, v) for i, (a, b) in enumerate([(1.0, 3.0), (2.0, 2.0), (0.0, 4.0)]) for s, v in (("A", a), ("B", b))] + [("C", "t2m", T0, 10.0)]
    seen = spark.createDataFrame(rows, "station_id string, variable string, valid_time timestamp, value double")
    places = spark.createDataFrame([("A", -30.1, -51.1), ("B", -30.2, -51.2), ("C", -12.1, -45.1)], "station_id string, lat double, lon double")
    (r,) = matching.repr_floor(seen, places).collect()
    assert (r["floor_var"], r["n_stations"], r["n_times"]) == (2.0, 2, 3)
    fact = spark.createDataFrame([(m, s, "t2m", T0, T0, f) for m, s, f in (("aifs", "A", 0), ("gfs", "A", 0), ("aifs", "B", 0), ("gfs", "B", 0), ("gfs", "C", 0), ("aifs", "D", 1), ("gfs", "D", 0))], "model string, station_id string, variable string, init_time timestamp, valid_time timestamp, qc_flags int")
    assert matching.matched_view(fact, ["gfs", "aifs"]).count() == 4 and matching.matched_view(fact, ["gfs", "aifs"], 32).count() == 6
    assert matching.all_comparisons(["b", "a", "c"]) == [("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]
    with pytest.raises(ValueError):
        matching.comparison_id(["gfs"])


# -- metrics


def pairs(spark, rows, schema="fcst double, obs double, station_id string, day date"):
    return spark.createDataFrame(rows, schema)


def test_errors_and_variance_ratio(spark):
    r = metrics.error_stats(pairs(spark, [(1.0, 2.0, "A", T0), (2.0, 2.0, "A", T0), (3.0, 1.0, "A", T0)]), []).first()
    assert r["mae"] == 1 and r["bias"] == pytest.approx(1 / 3) and r["rmse"] == pytest.approx(math.sqrt(5 / 3))
    rows = [(0.5 * x, float(x), s, T0) for s in "AB" for x in range(10)] + [(float(x), 5.0, "flat", T0) for x in range(5)]
    assert metrics.variance_ratio(pairs(spark, rows), []).first()["variance_ratio"] == pytest.approx(0.5)
    assert math.isnan(metrics.variance_ratio(pairs(spark, rows[-5:]), []).first()["variance_ratio"])


def test_percentile_bins(spark):
    df = spark.createDataFrame([(v, "A", "t2m") for v in (1.0, 2.0, 2.0, 3.0, None)], "obs double, station_id string, variable string")
    assert [r["obs_pct"] for r in strata.with_obs_percentile(df.where("obs is not null")).orderBy("obs").collect()] == [25, 62.5, 62.5, 100]
    bins = spark.createDataFrame([(100.0,), (10.0,), (9.9,)], "p double").select(metrics.percentile_bin(F.col("p")).alias("b")).collect()
    assert [b["b"] for b in bins] == ["99-100", "10-20", "0-10"]
    out = {r["bin"]: r for r in metrics.bias_by_bin(spark.createDataFrame([(2.0, 1.0, 5.0), (1.0, 2.0, 99.5)], "fcst double, obs double, obs_pct double")).collect()}
    assert len(out) == 11 and out["0-10"]["bias"] == 1 and out["99-100"]["bias"] == -1 and out["20-30"]["bias"] is None and out["20-30"]["n_pairs"] == 0


def test_seeps(spark):
    rows = [(f, o, 0.5, 5.0) for f in (0.0, 1.0, 10.0) for o in (0.0, 1.0, 10.0)]
    schema = "fcst double, obs double, p1 double, wet_threshold double"
    assert metrics.seeps(spark.createDataFrame(rows, schema)).first()["seeps"] == pytest.approx(11.2 / 9)
    assert metrics.seeps(spark.createDataFrame([(1.0, 0.0, 0.4, 5.0)], schema)).first()["seeps"] == pytest.approx(1.25)
    assert math.isnan(metrics.seeps(spark.createDataFrame([(1.0, 0.0, 0.95, 5.0)], schema)).first()["seeps"])
    assert metrics.seeps(spark.createDataFrame([(0.25, 0.25, 0.5, 0.25)], schema)).first()["seeps"] == pytest.approx(0.5 * 4 / 0.5)


def test_wet_stats_and_climatology(spark):
    totals = [0.0, 0.1, 1.0, 2.0, 4.0, 10.0]
    rows = [("A", "precip_1h", T0 + dt.timedelta(days=d, hours=h), t if h == 0 else 0.0) for d, t in enumerate(totals) for h in range(24)] + [("A", "precip_1h", T0 + dt.timedelta(days=9, hours=h), 50.0) for h in range(3)]
    r = metrics.wet_stats(spark.createDataFrame(rows, "station_id string, variable string, valid_time timestamp, value double"), min_days=5).first()
    assert (r["p1_dry_fraction"], r["wet_threshold"], r["n_days"], r["n_wet_days"]) == (pytest.approx(1 / 3), pytest.approx(4.0), 6, 4)
    w = metrics.window_weights(5)
    assert w[0] == w[-1] == 0 and sum(w) == pytest.approx(5)
    for bad in (4, 1, 367):
        with pytest.raises(ValueError):
            metrics.window_weights(bad)
    december = [("A", "t2m", dt.datetime(2023, 12, d, 12), 300.0) for d in range(20, 32)]
    clim = metrics.climatology(spark.createDataFrame(december, "station_id string, variable string, valid_time timestamp, value double"), 21, min_samples=1)
    days = {x["dayofyear"]: x["clim_mean"] for x in clim.collect()}
    assert days[1] == pytest.approx(300) and days[366] == pytest.approx(300) and 100 not in days


def test_strata(spark):
    df = spark.createDataFrame([(dt.datetime(2025, m, 1),) for m in (7, 8, 9, 10, 11)], "valid_time timestamp")
    oni = spark.createDataFrame([(2025, 7, 0.5), (2025, 8, -0.5), (2025, 9, 0.49), (2025, 10, -0.49)], "year int, month int, oni double")
    assert [r["enso"] for r in strata.with_enso(df, oni).orderBy("valid_time").collect()] == ["el_nino", "la_nina", "neutral", "neutral", None]
    rmm = spark.createDataFrame([(dt.date(2025, 7, 1), 3, 1.0), (dt.date(2025, 8, 1), 8, 0.99)], "date date, phase int, amplitude double")
    assert [r["mjo"] for r in strata.with_mjo(df, rmm).orderBy("valid_time").collect()] == ["3", "inactive", None, None, None]


# -- statistics


def test_t_tests():
    x = [1, 2, 4, 3, 5]
    assert tests.ttest(x, "iid")["p_raw"] == pytest.approx(0.0132355996, abs=1e-9)
    ar2, hac = tests.ttest(x, "ar2"), tests.ttest(x, "hac")
    assert ar2["p_raw"] == pytest.approx(0.0178932420, abs=1e-9) and 5 / ar2["n_eff"] == pytest.approx(9702 / 8100)
    assert hac["p_raw"] == pytest.approx(0.2499289, abs=1e-6) and hac["n_eff"] == 2
    assert tests.ttest([0, 0, 0], "iid")["p_raw"] == 1 and tests.ttest([2, 2, 2], "iid")["p_raw"] == 0
    for bad in ([1.0], [1.0, math.nan], [[1.0, 2.0]]):
        with pytest.raises(ValueError):
            tests.ttest(bad)
    assert student.two_sided_p(student.quantile(0.975, 7), 7) == pytest.approx(0.05)


def test_false_discovery(spark):
    def adjust(ps):
        t = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "family_id string, test_id int, p_raw double")
        return [r["p_adj"] for r in tests.benjamini_hochberg(t).orderBy("test_id").collect()]

    assert adjust([0.005, 0.01, 0.03, 0.04]) == pytest.approx([0.02, 0.02, 0.04, 0.04])
    assert adjust([0.01, 0.02, 0.021]) == pytest.approx([0.021] * 3)
    for bad in (None, 1.5, math.nan, -0.1):
        with pytest.raises(Exception, match="missing or outside"):
            adjust([0.01, bad, 0.04])
    with pytest.raises(ValueError):
        tests.check_p(spark.createDataFrame([(1.5,)], "p_raw double"))


def test_block_length():
    r = np.random.default_rng(0)
    noise = r.normal(size=500)
    ar = np.zeros(500)
    for i in range(1, 500):
        ar[i] = 0.7 * ar[i - 1] + noise[i]
    assert student.block_length(np.ones(50)) == student.block_length([1.0, 2.0]) == 1
    assert student.block_length(noise) <= 3 < student.block_length(ar)
    assert student.clamped_block_length(noise) >= 2


def daily_frame(spark, x, rows=1):
    data = [(float(v), 0.0, "A", (T0 + dt.timedelta(days=i)).date()) for i, v in enumerate(x) for _ in range(rows)]
    return pairs(spark, data)


def test_bootstrap_moves_whole_days(spark):
    x = list(range(10))
    r = bootstrap.block_bootstrap(daily_frame(spark, x, 3), [], ["bias", "mae"], n_boot=50, block_len=50).collect()
    assert all(v["ci_low"] == v["ci_high"] == v["estimate"] == 4.5 and v["block_len_days"] == 10 and v["n_pairs"] == 30 for v in r)
    one = [bootstrap.block_bootstrap(daily_frame(spark, x), [], ["bias"], n_boot=50, block_len=2, seed=s).first() for s in (1, 1, 2)]
    assert one[0] == one[1] != one[2]
    times = bootstrap.multiplicities(11, 4, 20, 0)
    assert (times.sum(axis=1) == 11).all()
    for bad in (dict(n_boot=0), dict(alpha=1.0), dict(block_len=0), dict(day="nope")):
        with pytest.raises(ValueError):
            bootstrap.block_bootstrap(daily_frame(spark, x), [], ["bias"], **bad)


def test_bootstrap_equals_resampled_rows(spark):
    """The multiplicity form gives what gathering the resampled rows gives."""
    r = np.random.default_rng(3)
    rows = [(float(r.normal()), float(r.normal()), s, (T0 + dt.timedelta(days=d)).date()) for d in range(12) for s in "ABC" for _ in range(r.integers(1, 4))]
    df = pairs(spark, rows)
    got = bootstrap.block_bootstrap(df, [], ["rmse"], n_boot=40, block_len=3, seed=5).first()
    ratio = bootstrap.variance_ratio_bootstrap(df, [], n_boot=40, block_len=3, seed=5).first()
    days = sorted({x[3] for x in rows})
    rmse, ratios = [], []
    for m in bootstrap.multiplicities(12, 3, 40, 5):
        drawn = [x for x in rows for _ in range(int(m[days.index(x[3])]))]
        rmse.append(math.sqrt(np.mean([(x[0] - x[1]) ** 2 for x in drawn])))
        each = []
        for s in "ABC":
            f, o = [x[0] for x in drawn if x[2] == s], [x[1] for x in drawn if x[2] == s]
            if len(o) > 1 and min(o) < max(o):
                each.append(np.std(f, ddof=1) / np.std(o, ddof=1))
        ratios.append(np.median(each))
    assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.quantile(rmse, [0.025, 0.975])))
    assert (ratio["ci_low"], ratio["ci_high"]) == pytest.approx(tuple(np.quantile(ratios, [0.025, 0.975])))


def test_coverage_of_blocks():
    r = np.random.default_rng(1)
    hits = {1: 0, 12: 0}
    for _ in range(200):
        x = np.zeros(180)
        for i in range(1, 180):
            x[i] = 0.5 * x[i - 1] + r.normal()
        for length in hits:
            means = bootstrap.multiplicities(180, length, 200, int(r.integers(1 << 30))) @ x / 180
            low, high = np.quantile(means, [0.025, 0.975])
            hits[length] += low <= 0 <= high
    assert hits[1] / 200 < 0.85 < hits[12] / 200 and hits[12] > hits[1] + 10


def test_decomposition(spark):
    rows = [(1.0, 0.0, "A", (T0 + dt.timedelta(days=d)).date(), 0.25) for d in range(8)]
    schema = "fcst double, obs double, station_id string, day date, repr_floor double"
    out = {r["metric"]: r for r in bootstrap.decomposition_bootstrap(pairs(spark, rows, schema), [], n_boot=20).collect()}
    assert [out[k]["estimate"] for k in ("mse_total", "repr_floor_mean", "mse_model_est")] == [1, 0.25, 0.75] and out["mse_model_est"]["clipped_frac"] == 0
    low = bootstrap.decomposition_bootstrap(pairs(spark, [(0.5, *r[1:4], 2.0) for r in rows], schema), [], n_boot=20).where("metric = 'mse_model_est'").first()
    assert low["estimate"] == 0 and low["clipped_frac"] == 1
    assert bootstrap.decomposition_bootstrap(pairs(spark, [(*r[:4], None) for r in rows], schema), []).count() == 0


# -- sources


def test_station_file(spark):
    head = "\n".join(["REGIÃO:;S", "UF:;RS", "ESTACAO:;X", "CODIGO (WMO):;A801", "LATITUDE:;-30,05", "LONGITUDE:;-51,1", "ALTITUDE:;41,1", "DATA:;x"])
    titles = "Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);VENTO, VELOCIDADE HORARIA (m/s);"
    lines = ["2025/08/01;0000 UTC;,8;25,0;3,2;", "2025/08/01;0130 UTC;-9999;20,5;;", "bad;0200 UTC;1;2;3;", ""]
    files = spark.createDataFrame([("f", "\n".join([head, titles, *lines]))], "path string, text string")
    tagged = observations.parse_station_files(files)
    assert observations.check(tagged, "bulk") == {"stage": "bulk", "rows_in": 9, "rows_out": 4, "dropped": {"bad_timestamp": 3, "value_missing": 2}}
    rows = {(r["variable"], r["valid_time"].hour): r["value"] for r in observations.emitted(tagged, "v").collect()}
    assert rows == {("precip_1h", 0): 0.8, ("t2m", 0): 298.15, ("wind10m", 0): 3.2, ("t2m", 1): pytest.approx(293.65)}
    for bad in (files.withColumn("text", F.replace("text", F.lit("CODIGO"), F.lit("X"))), files.withColumn("text", F.replace("text", F.lit("Data;"), F.lit("Dat;")))):
        with pytest.raises(Exception, match="no station code|no header"):
            observations.parse_station_files(bad).collect()


def test_zip_of_station_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.CSV", "café".encode("latin-1"))
        z.writestr("skip.txt", "no")
    assert [r["text"] for r in observations.read_zip_texts(spark, str(tmp_path / "a.zip")).collect()] == ["café"]


def test_api_and_isd(spark):
    records = spark.createDataFrame([("s", '{"DT_MEDICAO":"2025-08-01","HR_MEDICAO":"0300","TEM_INS":"20.0","VEN_VEL":null,"CHUVA":""}'), ("s", '{"DT_MEDICAO":"x","HR_MEDICAO":"0300","TEM_INS":"1"}'), ("s", '{"DT_MEDICAO":"2025-08-01","HR_MEDICAO":"0400","TEM_INS":"abc","VEN_VEL":"2","CHUVA":"0"}')], "station_id string, json string")
    assert observations.check(observations.parse_api_records(records), "api")["dropped"] == {"bad_timestamp": 3, "value_missing": 2, "value_unparseable": 1}
    lines = spark.createDataFrame([("s", "2025 08 01 00 215 0 0 0 31 0 -1 0"), ("s", "2025 08 01 01 -9999 0 0 0 31 0 5 0"), ("s", "2025 13 01 01 1 0 0 0 31 0 5 0"), ("s", "1 2"), ("s", " ")], "station_id string, line string")
    tagged = observations.parse_isd_lite(lines)
    assert observations.check(tagged, "isd") == {"stage": "isd", "rows_in": 12, "rows_out": 5, "dropped": {"value_missing": 1, "bad_timestamp": 3, "malformed_line": 3}}
    rows = [(r["variable"], r["value"], r["source_qc_raw"]) for r in observations.emitted(tagged, "v").orderBy("valid_time", "variable").collect()]
    assert rows == [("precip_1h", 0.0, "T"), ("t2m", pytest.approx(294.65), None), ("wind10m", 3.1, None), ("precip_1h", 0.5, None), ("wind10m", 3.1, None)]


def test_inventories(spark):
    raw = spark.createDataFrame([("123", "99999", "POA", "BR", "-30.0", "-51.2", "+0003.0", "19500101", "20251231"), ("124", "99999", "OLD", "BR", "-30.0", "-51.2", "-0999.0", "19500101", "20000101"), ("125", "99999", "X", "US", "1", "1", "1", "1", "20251231"), ("126", "99999", "Z", "BR", "0", "0", "1", "1", "20251231"), ("127", "99999", "H", "BR", " -1.5", "-2", "9999.9", "1", "20251231")], "USAF string, WBAN string, `STATION NAME` string, CTRY string, LAT string, LON string, `ELEV(M)` string, BEGIN string, END string")
    tagged = stations.tag_isd_history(raw)
    assert {r["USAF"]: r["drop_reason"] for r in tagged.collect()} == {"123": None, "124": "end_before_min", "125": "not_country", "126": "invalid_coords", "127": None}
    inmet = spark.createDataFrame([("A1", "N", "RS", "-30,5", "-51", None, None, "Operante"), ("A2", " ", "RS", "x", "-51", "10", None, "Desativada"), ("A3", "M", "RS", "1", "-51", "10", "2020-01-01T00", "Operante")], "CD_ESTACAO string, DC_NOME string, SG_ESTADO string, VL_LATITUDE string, VL_LONGITUDE string, VL_ALTITUDE string, DT_FIM_OPERACAO string, CD_SITUACAO string")
    out = stations.check_final(stations.to_canonical(inmet, tagged.where("drop_reason is null"), "v", "2025-07-01"))
    rows = {r["station_id"]: r for r in out.collect()}
    assert [rows[f"inmet:A{i}"]["status"] for i in (1, 2, 3)] == ["included", "excluded", "excluded"] and rows["inmet:A1"]["lat"] == -30.5 and rows["inmet:A2"]["lat"] is None
    assert rows["isd:123-99999"]["elev_station"] == 3 and rows["isd:127-99999"]["elev_station"] is None
    with pytest.raises(C.ContractError):
        stations.check_final(out.unionByName(out))


def test_koppen_vote(spark):
    raster = spark.createDataFrame([(60, 129, 0), (61, 129, 14), (59, 129, 14), (60, 130, 3), (61, 130, 3), (10, 10, 0), (20, 20, 5)], "row long, col long, code int")
    at = spark.createDataFrame([("coast", -29.5, -50.5), ("sea", -79.5, -169.5), ("land", -69.5, -159.5), ("none", 50.0, 50.0)], "station_id string, lat double, lon double")
    assert {r["station_id"]: r["koppen"] for r in stations.koppen_lookup(at, raster, 1.0).collect()} == {"coast": "Aw", "sea": None, "land": "BWk", "none": None}


def test_indices(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    assert [(r["year"], r["month"], r["oni"]) for r in indices.parse_oni(lines("SEAS YR TOTAL ANOM", "NDJ 2023 28.5 1.9", "DJF 2024 27 x")).where("drop_reason is null").collect()] == [(2023, 12, 1.9)]
    out = indices.parse_rmm(lines("header", "2025 7 1 1.0 -0.5 3 1.1 x", "2025 7 2 1.E36 1.E36 999 1.E36 x", "2025 2 30 1 1 3 1.1 x")).collect()
    assert sorted(str(r["drop_reason"]) for r in out) == ["None", "bad_date", "missing_value"]


def test_grid_indexes(spark):
    lines = ["1:0:d=2025:PRMSL:mean sea level:24 hour fcst:", "2:100:d=2025:TMP:2 m above ground:24 hour fcst:", "3:300:d=2025:UGRD:10 m above ground:24 hour fcst:", "4:400:d=2025:APCP:surface:0-24 hour acc fcst:", "5:500:d=2025:APCP:surface:18-24 hour acc fcst:", "6:650:d=2025:APCP:surface:18-24 hour acc fcst:", "7:900:d=2025:VGRD:10 m above ground:24 hour fcst:"]
    e = gridindex.parse_gfs_index(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string"))
    wanted = gridindex.select_gfs(e)
    assert wanted.count() == 5
    picked = gridindex.pick_apcp(wanted, 24)
    assert sorted(r["start"] for r in picked.collect()) == [100, 300, 500, 900]
    with pytest.raises(Exception, match="six-hour"):
        gridindex.pick_apcp(wanted, 30).collect()
    assert sorted((r["start"], r["stop"]) for r in gridindex.coalesce_ranges(picked).collect()) == [(100, 400), (500, 650), (900, None)]
    assert sorted((r["start"], r["stop"]) for r in gridindex.coalesce_ranges(picked, 300).collect()) == [(100, None)]
    j = gridindex.parse_ecmwf_index(spark.createDataFrame([("f", 0, '{"param":"2t","levtype":"sfc","step":"24","_offset":10,"_length":5}'), ("f", 1, '{"param":"2t","step":"48","_offset":15,"_length":5}')], "file string, line_no int, line string"))
    assert [(r["start"], r["stop"]) for r in gridindex.select_ecmwf(j, 24).collect()] == [(10, 15)]
    urls = spark.range(1).select(gridindex.gfs_url(F.lit(T0), F.lit(6)).alias("g"), gridindex.ecmwf_url(F.lit(T0), F.lit(6), "aifs").alias("e"), gridindex.http_range(F.lit(5), F.lit(9)).alias("r")).first()
    assert urls["g"].endswith("gfs.20250801/00/atmos/gfs.t00z.pgrb2.0p25.f006") and urls["e"].endswith("20250801/00z/aifs-single/0p25/oper/20250801000000-6h-oper-fc.grib2") and urls["r"] == "bytes=5-8"
    with pytest.raises(ValueError):
        gridindex.ecmwf_url(F.lit(T0), F.lit(6), "nope")


def test_sinks(spark, tmp_path):
    df = obs(spark, [1.0, 2.0])
    sinks.write_table(sinks.with_table_metadata(df, schema_version="1"), str(tmp_path / "t"), ["station_id"], ["valid_time"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 2 and back.schema["value"].metadata == {"schema_version": "1"}
    (tmp_path / "x.bin").write_bytes(b"abc")
    files = sinks.file_entries(spark.read.format("binaryFile").load(str(tmp_path / "x.bin")), "s")
    assert files.first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    both = sinks.append_manifest(files, files.withColumn("status", F.lit("pruned")))
    assert both.count() == 1
    urls = files.select("url").unionByName(spark.createDataFrame([("new",)], "url string"))
    assert [r["url"] for r in sinks.to_fetch(urls, files).collect()] == ["new"]
    assert sinks.markdown(spark.createDataFrame([(1, None)], "a int, b int")) == "| a | b |\n| - | - |\n| 1 |  |"


def test_streaming_rain(spark, tmp_path):
    from gaugemark.streaming import rolling

    obs(spark, [1.0] * 72, "precip_1h").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = rolling.stream_precip_24h(rolling.stream_range_check(stream)).writeStream.format("memory").queryName("rain").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r["valid_time"]: r["obs"] for r in matching.precip_24h_obs(obs(spark, [1.0] * 72, "precip_1h")).collect()}
    got = {r["valid_time"]: r["obs"] for r in spark.sql("SELECT * FROM rain").collect()}
    assert len(got) > 20 and all(batch[t] == v for t, v in got.items() if t in batch)


def test_registry_results(spark, sf_dir):
    from gaugemark.plans import registry
    from gaugemark.plans.queries import QUERIES

    out = QUERIES["results_table"](spark, sf_dir)
    assert C.validate(out, C.RESULTS, "results") is out
    assert out.where("estimate is not null and (ci_low is null or ci_high is null)").count() == 0
    rows = QUERIES["results_paired"](spark, sf_dir).collect()
    assert len(rows) == 3 * 3 * 7 and all(r["n_family"] == 63 and r["p_adj"] >= r["p_raw"] for r in rows)
    fact = spark.createDataFrame([("t2m", 1.0, 2.0, T0), ("t2m", 1.0, None, T0), ("wind10m", 3.0, 4.0, T0)], "variable string, fcst_raw double, fcst_elev_adj double, valid_time timestamp")
    assert sorted(r["fcst"] for r in registry.inputs(fact, "mae").collect()) == [1, 2, 4]
    assert sorted(r["fcst"] for r in registry.inputs(fact, "variance_ratio").collect()) == [1, 1, 3]
