"""Errors, edges and the pieces around the statistics: registry, views, versions, tiles, workers."""

import datetime as dt
import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugemark.functions import contracts as C
from gaugemark.functions import student
from gaugemark.operators import bootstrap, geo, matching, qc, strata
from gaugemark.plans import adapters as A
from gaugemark.plans import registry
from gaugemark.sources import gridindex, sinks, stations

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PAIRS = "model string, station_id string, variable string, lead_hours int, day date, fcst double, obs double"
DAY = dt.date(2024, 1, 1)


def series(n=40, stations_=3, seed=1):
    r = np.random.default_rng(seed)
    return [("gfs", f"s{k}", "t2m", 24, DAY + dt.timedelta(days=i), float(o + r.normal()), float(o)) for i in range(n) for k in range(stations_) for o in [r.normal() * 3]]


def test_no_rows_to_draw_from_raise(spark):
    empty = spark.createDataFrame([], PAIRS + ", repr_floor double")
    for run in (lambda: bootstrap.block_bootstrap(empty, ["model"], ["bias"]), lambda: bootstrap.decomposition_bootstrap(empty, ["model"]), lambda: bootstrap.variance_ratio_bootstrap(empty, ["model"])):
        with pytest.raises(ValueError, match="no rows"):
            run()


def test_masked_seeps_raises_and_counts_unmasked_pairs(spark):
    rows = [("gfs", DAY + dt.timedelta(days=i), float(i % 9), float(i % 7), p1, 4.0) for i in range(30) for p1 in (0.5, 0.99)]
    df = spark.createDataFrame(rows, "model string, day date, fcst double, obs double, p1 double, wet_threshold double")
    got = bootstrap.block_bootstrap(df, ["model"], ["seeps"], n_boot=50).first()
    assert got["n_pairs"] == 30 and got["ci_low"] <= got["estimate"] <= got["ci_high"]
    with pytest.raises(Exception, match="masked"):
        bootstrap.block_bootstrap(df.where("p1 > 0.9"), ["model"], ["seeps"], n_boot=50).collect()


def brute_ratio(rows, starts, length):
    """Variance ratio of resampled days, row by row."""
    days = sorted({r[4] for r in rows})
    at = np.concatenate([np.arange(s, s + length) for s in starts])[: len(days)]
    out = []
    for station in sorted({r[1] for r in rows}):
        by_day = {}
        for r in rows:
            if r[1] == station:
                by_day.setdefault(r[4], []).append(r[5:7])
        drawn = [x for i in at for x in by_day.get(days[i], [])]
        f, o = zip(*drawn, strict=True)
        if len(set(o)) > 1:
            out.append(np.std(f, ddof=1) / np.std(o, ddof=1))
    return float(np.median(out))


@pytest.mark.parametrize("block_len", [5, None])
def test_variance_ratio_equals_resampled_rows(spark, block_len):
    rows = [r for i, r in enumerate(series()) if i % 7]
    got = bootstrap.variance_ratio_bootstrap(spark.createDataFrame(rows, PAIRS), ["model"], n_boot=60, block_len=block_len, seed=3).first()
    n = 40
    errors = {}
    for r in rows:
        errors.setdefault(r[4], []).append(r[5] - r[6])
    length = block_len or student.clamped_block_length(np.array([np.mean(errors[d]) for d in sorted(errors)]))
    starts = np.random.default_rng(3).integers(0, n - length + 1, size=(60, -(-n // length)))
    draws = [brute_ratio(rows, s, length) for s in starts]
    assert got["estimate"] == pytest.approx(brute_ratio(rows, [0], n), abs=1e-9)
    assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=1e-9)
    assert (got["n_pairs"], got["n_days"], got["block_len_days"], got["alpha"]) == (len(rows), n, length, 0.05)


def test_every_registered_metric_is_computed(spark):
    rows = [(*r, 0.2 if i % 4 else None) for i, r in enumerate(series(120))]
    df = strata.with_season(strata.with_obs_percentile(spark.createDataFrame(rows, PAIRS + ", repr_floor double")), "day")
    out = registry.metric_rows(df, list(registry.METRICS), "v", ["season"], n_boot=40)
    assert C.validate(out, C.RESULTS, "results") is out
    got = out.collect()
    assert {x["metric"] for x in got} == set(registry.METRICS)
    assert all(x["ci_low"] is not None and x["ci_low"] <= x["ci_high"] and x["n_stations"] == 3 and x["n_boot"] == 40 for x in got)
    assert {x["stratum_type"] for x in got if x["metric"] == "variance_ratio"} == {"global", "season"}
    assert registry.ratio_by_lead(out).count() == 1 and registry.bias_by_percentile(out.where("n_pairs > 0")).where("middle between 0 and 100").count() == len([x for x in got if x["metric"] == "bias_by_percentile"])
    few = registry.metric_rows(df.where("station_id = 's0' and day < '2024-02-15'"), ["variance_ratio", "bias"], "v", n_boot=20).collect()
    assert {x["metric"] for x in few} == {"bias"}  # few pairs give no ratio
    with pytest.raises(ValueError, match="crps"):
        registry.metric_rows(df, ["crps"], "v")


def test_empty_bins_stay(spark):
    rows = [("gfs", DAY + dt.timedelta(days=i), 1.0, 0.0, 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "model string, day date, fcst double, obs double, obs_pct double")
    got = {x["bin"]: (x["n_pairs"], x["estimate"]) for x in bootstrap.bias_by_bin_bootstrap(df, ["model"], n_boot=20).collect()}
    assert len(got) == 11 and got["0-10"] == (20, 1.0) and all(v == (0, None) for k, v in got.items() if k != "0-10")


def slow_block_length(x):
    """The published rule, lag by lag."""
    n = len(x)
    d = x - x.mean()
    acv = lambda k: float((d[: n - k] * d[k:]).sum()) / n
    run = max(5, int(np.ceil(np.sqrt(np.log10(n)))))
    most = int(np.ceil(np.sqrt(n))) + run
    limit = 2 * np.sqrt(np.log10(n) / n)
    m = next((m for m in range(most + 1) if m + run <= min(2 * most, n - 1) and all(abs(acv(m + k) / acv(0)) <= limit for k in range(1, run + 1))), most)
    width = min(2 * m, n - 1)
    if not width:
        return 1.0
    w = lambda t: 1.0 if abs(t) <= 0.5 else 2 * (1 - abs(t))
    g = sum(w(k / width) * abs(k) * acv(abs(k)) for k in range(-width, width + 1))
    s = sum(w(k / width) * acv(abs(k)) for k in range(-width, width + 1))
    b = (2 * g * g / (4 / 3 * s * s)) ** (1 / 3) * n ** (1 / 3)
    return min(max(b, 1.0), np.ceil(min(3 * np.sqrt(n), n / 3)))


@pytest.mark.parametrize("phi", [0.0, 0.5, 0.9, -0.6])
@pytest.mark.parametrize("n", [4, 9, 30, 200, 1000])
def test_block_length_follows_the_published_rule(n, phi):
    r = np.random.default_rng(n)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + r.normal()
    assert student.block_length(x) == pytest.approx(slow_block_length(x), rel=1e-9)
    assert student.block_length(np.ones(n)) == 1.0


def test_points_outside_the_grid(spark):
    grid = spark.createDataFrame([(j, i, float(j), float(i), 1.0) for j in range(3) for i in range(3)], "j int, i int, lat double, lon double, value double")
    at = spark.createDataFrame([("in", 0.5, 1.5), ("edge", 2.0, 2.0), ("out", 2.5, 1.0), ("far", -7.0, 1.4)], "station_id string, lat double, lon double")
    assert {x["station_id"] for x in geo.grid_weights(at, grid, outside="drop").collect()} == {"in", "edge"}
    for f in (geo.grid_weights, geo.nearest_nodes):
        with pytest.raises(Exception, match="outside the grid"):
            f(at, grid).collect()
    assert geo.grid_weights(at.where("station_id in ('in', 'edge')"), grid).count() == 5
    assert {tuple(x) for x in geo.nearest_nodes(at, grid, outside="drop").collect()} == {("in", 0, 1), ("edge", 2, 2)}


@pytest.mark.parametrize("first,last,inside,out", [(-20, 20, {-5.0: 15.0, 0.25: 20.25, -20.0: 0.0, 20.0: 40.0, 355.0: 15.0}, (100.0, -21.0, 20.5, 180.0)), (0, 359, {-5.0: 355.0, 0.0: 0.0, -51.5: 308.5, 359.0: 359.0, 180.0: 180.0}, (359.5, -0.5)), (300, 310, {-55.0: 5.0, 305.5: 5.5}, (-49.0, 10.0))])
def test_grids_keep_their_own_longitudes(spark, first, last, inside, out):
    grid = spark.createDataFrame([(j, i, float(j), float(x), float(i)) for j in range(2) for i, x in enumerate(range(first, last + 1))], "j int, i int, lat double, lon double, value double")
    at = spark.createDataFrame([(f"{x}", 0.5, x) for x in (*inside, *out)], "station_id string, lat double, lon double")
    got = {float(x["station_id"]): x["value"] for x in geo.bilinear(geo.grid_weights(at, grid, outside="drop"), grid, []).collect()}
    assert got == {x: pytest.approx(v) for x, v in inside.items()}
    nodes = {float(x["station_id"]): x["i"] for x in geo.nearest_nodes(at, grid, outside="drop").collect()}
    assert set(nodes) == set(inside) and all(abs(nodes[x] - v) <= 0.5 for x, v in inside.items())
    for x in out:
        with pytest.raises(Exception, match="outside the grid"):
            geo.nearest_nodes(at.where(f"station_id = '{x}'"), grid).collect()


def test_terrain_tiles(spark):
    tiles = spark.createDataFrame([("S25_W052", r, c, float(10 * r + c)) for r in range(10) for c in range(10)], "tile string, row int, col int, elevation double")
    at = spark.createDataFrame([("sw", -25.0, -52.0), ("ne", -24.001, -51.001), ("mid", -24.45, -51.55), ("none", -20.5, -51.5), ("null", None, -51.5)], "station_id string, lat double, lon double")
    got = {x["station_id"]: (x["tile"], x["elev_dem"]) for x in stations.dem_lookup(at, tiles, 10).collect()}
    assert got == {"sw": ("S25_W052", 90.0), "ne": ("S25_W052", 9.0), "mid": ("S25_W052", 44.0), "none": ("S21_W052", None)}


def test_leads_that_lack(spark):
    present = spark.createDataFrame([("gfs", DAY, 6, 10), ("gfs", DAY, 12, 20), ("gfs", DAY, 12, 20), ("gfs", DAY, 99, 1)], "source string, init_time date, lead_hours int, bytes long")
    runs = spark.createDataFrame([("gfs", DAY), ("gfs", DAY + dt.timedelta(days=1)), ("hres", DAY)], "source string, init_time date")
    got = {(x["source"], x["init_time"].day): (x["n_leads"], x["missing"], x["bytes"], x["complete"]) for x in gridindex.lead_completeness(present, runs, [6, 12]).collect()}
    assert got == {("gfs", 1): (2, [], 50, True), ("gfs", 2): (0, [6, 12], 0, False), ("hres", 1): (0, [6, 12], 0, False)}


def test_views_versions_and_markdown(spark, tmp_path):
    view = A.monthly_pairs(spark, "/root/testdata/sf0.001").select("model", "station_id", "variable", "valid_time")
    text = sinks.write_view(view, str(tmp_path), ["station_id", "valid_time"], made_by="test")
    assert json.loads(text)["rows"] == view.count() == spark.read.parquet(f"{tmp_path}/view").count()
    assert spark.read.text(f"{tmp_path}/manifest").first()["value"] == text
    files = spark.createDataFrame([("ab" * 32,), ("cd" * 32,)], "sha256 string")
    assert sinks.ingest_version(files, "1") == sinks.ingest_version(files.orderBy(F.desc("sha256")), "1") != sinks.ingest_version(files.limit(1), "1")
    with pytest.raises(ValueError, match="more than 3 rows"):
        sinks.markdown(spark.range(4), most=3)
    assert sinks.markdown(spark.range(300)).count("\n") == 301


def test_qc_run_reconciles(spark):
    obs = A.obs_hourly(spark, "/root/testdata/sf0.001")
    names = obs.select("station_id").distinct().withColumns({"lat": F.lit(-30.0), "lon": F.lit(-51.0), "elev_station": F.lit(1.0), "elev_dem": F.lit(1.0), "network": F.lit("inmet"), "cross_ref": F.lit(None).cast("string")})
    done = qc.check_qc(obs, qc.run_qc(obs, names))
    assert done["rows_in"] == done["rows_out"] == obs.count() and set(done["flags"]) == {"t2m", "wind10m", "precip_1h"}
    with pytest.raises(C.ReconciliationError):
        qc.check_qc(obs, qc.run_qc(obs, names.union(names)))  # repeated stations repeat rows


def test_python_workers_find_the_package_anywhere(tmp_path):
    """A driver that was started elsewhere and finds the package by its own path only."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import datetime as dt
from pyspark.sql import SparkSession
from gaugemark.operators import bootstrap, tests
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = [("m", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 5), 1.0) for i in range(30)]
df = spark.createDataFrame(rows, "model string, day date, fcst double, obs double")
print("ROWS", bootstrap.block_bootstrap(df, ["model"], ["bias"], n_boot=20).count(), tests.ttest_by(df.selectExpr("model", "day", "fcst - obs AS error"), ["model"]).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 1 1" in out.stdout, out.stderr[-2000:]


def test_field_checks(spark):
    from gaugemark.sources import fields

    t0 = dt.datetime(2024, 1, 1)
    row = lambda name, units, lead, j, shift=0: ("gfs", t0, lead, name, units, t0 + dt.timedelta(hours=lead + shift), j, 0)
    make = lambda *rows: spark.createDataFrame(rows, "model string, init_time timestamp, lead_hours int, short_name string, units string, valid_time timestamp, j int, i int")
    good = make(row("2t", "K", 6, 0), row("2t", "K", 6, 1), row("tp", "kg m-2", 12, 0), row("z", "anything", 0, 0))
    assert fields.check_leads(fields.check_unique(fields.check_units(good))) is good
    for check, bad in ((fields.check_units, row("2t", "C", 6, 0)), (fields.check_unique, row("2t", "K", 6, 1)), (fields.check_leads, row("2t", "K", 7, 0)), (fields.check_leads, row("2t", "K", 246, 0)), (fields.check_leads, row("2t", "K", 6, 5, 1))):
        with pytest.raises(C.ContractError):
            check(make(row("2t", "K", 6, 1), bad))


def test_skipped_station_files_are_counted(spark):
    from gaugemark.sources import observations

    head = ["REGIAO:;", "UF:;", "ESTACAO:;", "CODIGO (WMO):;{}", "LATITUDE:;0", "LONGITUDE:;0", "ALTITUDE:;0", "DATA DE FUNDACAO:;", "Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);VENTO, VELOCIDADE HORARIA (m/s);", "2024/01/01;0000 UTC;0,2;21,5;3;"]
    files = spark.createDataFrame([(f"f{i}", "\r\n".join(head).format(c)) for i, c in enumerate(("A1", "A2", "A3"))], "path string, text string")
    assert tuple(observations.file_counts(files).first()) == (3, 0)
    assert tuple(observations.file_counts(files, ["A2"]).first()) == (1, 2)
    assert {r["station_id"] for r in observations.parse_station_files(files, ["A2"]).collect()} == {"inmet:A2"}


def test_all_comparisons_at_once_are_those_of_each(spark):
    r = np.random.default_rng(3)
    at = lambda k: dt.datetime(2024, 1, 1 + k % 5)
    rows = [(m, f"s{k}", "t2m", at(k), at(k), float(r.normal()), int(r.choice([0, 0, 0, 0, 0, 1, 2]))) for k in range(90) for m in "abcd" if r.random() < 0.8]
    fact = spark.createDataFrame(rows, "model string, station_id string, variable string, init_time timestamp, valid_time timestamp, obs double, qc_flags int")
    for mask in (None, 1):
        got = sorted(map(tuple, matching.matched_views(fact, "abcd", mask).collect()))
        want = sorted(tuple(x) for c in matching.all_comparisons("abcd") for x in matching.matched_view(fact, c, mask).collect())
        assert got == want and len({x[0] for x in got}) == 7
    plan = matching.matched_views(fact, "abcd")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_paired_rows_of_a_view_are_those_of_each_pair(spark):
    """The daily matrix gives the tests that pairs give one by one, from one scan."""
    from gaugemark.operators import tests

    r = np.random.default_rng(8)
    rows = [(m, f"s{k}", "t2m", 24, DAY + dt.timedelta(days=i), float(r.normal(b, 1)), 0.0) for i in range(30) for m, b in (("a", 0.0), ("b", 0.5), ("c", 0.1)) for k in range(2) if (m, i) not in (("a", 3), ("c", 7))]
    view = spark.createDataFrame(rows, PAIRS)
    got = {(x["metric"], x["model"]): x for x in registry.paired_rows(view, ["c", "a", "b"], "v").collect()}
    assert len(got) == 9 and {x["n_family"] for x in got.values()} == {9}
    for metric, f in (("mae", F.abs), ("rmse", lambda e: e * e), ("bias", lambda e: e)):
        daily = view.groupBy("model", "variable", "lead_hours", "day").agg(F.avg(f(F.col("fcst") - F.col("obs"))).alias("error"))
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            want, have = tests.paired_test(daily, a, b, ["variable", "lead_hours"]).first(), got[metric, f"{a}-{b}"]
            assert (have["comparison_id"], have["n_days"]) == (want["comparison_id"], want["n_days"])
            assert [have[c] for c in ("estimate", "ci_low", "ci_high", "p_raw")] == pytest.approx([want[c] for c in ("estimate", "ci_low", "ci_high", "p_raw")])
    assert got["mae", "a-c"]["n_days"] == 28


def test_paired_rows_scan_their_view_once(spark, sf_dir):
    plan = registry.paired_rows(A.pairs(spark, sf_dir), ["A", "N", "R"], "v")._jdf.queryExecution().executedPlan().toString()
    assert len({line.split("Location")[0] for line in plan.splitlines() if "FileScan parquet" in line}) >= 1
    tests_of = plan.count("FlatMapGroupsInPandas")
    assert plan.count("FileScan parquet") == tests_of  # every branch that ranks the tests repeats the one scan, and exchanges are reused


def test_a_fact_is_reconciled_by_the_job_that_writes_it(spark, sf_dir, tmp_path):
    args = A.forecast_points(spark, sf_dir), A.obs_qc(spark, sf_dir), A.event_stations(spark, sf_dir)
    fact, seen = matching.build_fact_watched(*args, "1", min_clean_hours=12)
    fact.write.parquet(f"{tmp_path}/fact")
    record = C.reconciled("fact", seen)
    assert record == matching.check_fact(matching.tagged_pairs(*args, min_clean_hours=12)) and all(record["dropped"].values())
    assert record["rows_out"] == spark.read.parquet(f"{tmp_path}/fact").count() == matching.build_fact(*args, "1", min_clean_hours=12).count()
    tagged = spark.createDataFrame([("other",), (None,)], "drop_reason string")
    odd, seen = C.watched(tagged, ["known"])
    odd.count()
    with pytest.raises(C.ReconciliationError):
        C.reconciled("odd", seen)
