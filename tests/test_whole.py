"""Queries over all rows of larger tables, against their SQL or brute force."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugemark.functions import student
from gaugemark.plans import adapters as A
from gaugemark.plans import registry
from gaugemark.plans.queries import ORACLES, QUERIES
from gaugemark.sources import gridindex

SF = "/root/testdata/sf0.01"  # 1,500 customers, 15,000 orders
STATIONS = "knn_neighbors geo_dedupe grid_cells density_weights station_curation qc_metadata qc_duplicate koppen_join regime_grouping_sets attach_floor grid_bilinear grid_nearest".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "customer orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def equals_sql(spark, duck, name):
    """The query's rows, equal to its SQL's."""
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(r) for r in out.select(columns).collect()), key=str)
    rel = duck.sql(ORACLES[name])
    assert got == sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=str)
    return got


@pytest.mark.parametrize("name", STATIONS)
def test_all_customers_are_stations(spark, duck, name):
    equals_sql(spark, duck, name)


@pytest.mark.parametrize("name", ["bh_fdr", "idx_ranges", "coalesce_ranges"])
def test_all_orders_are_read(spark, duck, name):
    rows = equals_sql(spark, duck, name)
    assert len(rows) == 15000 or name == "coalesce_ranges"


def test_paired_results_cover_every_lead(spark):
    rows = QUERIES["results_paired"](spark, SF).collect()
    want = {(m, f"{a}-{b}", 24 * k) for m in ("mae", "rmse", "bias") for a, b in ("AN", "AR", "NR") for k in range(1, 8)}
    assert {(r["metric"], r["model"], r["lead_hours"]) for r in rows} == want and len(rows) == len(want) and all(r["n_family"] == len(want) for r in rows)
    rows = registry.paired_rows(A.pairs(spark, SF), ["A", "N", "R"], "test").collect()  # the query rounds
    ranked, p_adj = sorted(rows, key=lambda r: r["p_raw"]), 1.0
    for k in range(len(ranked), 0, -1):
        p_adj = min(p_adj, ranked[k - 1]["p_raw"] * len(ranked) / k)
        assert abs(ranked[k - 1]["p_adj"] - p_adj) < 1e-12


def test_all_events_and_orders_count(spark, duck):
    days = equals_sql(spark, duck, "source_coverage")
    assert sum(r[3] for r in days) == duck.sql("SELECT count(*) FROM (SELECT DISTINCT event_type, ts::DATE FROM events WHERE ts >= '2023-12-15' AND ts < '2024-02-01')").fetchall()[0][0]  # columns by name: cell, expected, month, present
    rain = equals_sql(spark, duck, "precip24_fcst")
    assert {r[1] for r in rain} == set(range(3, 123, 3))  # every lead, also those of orders divisible by five


def test_gaps_of_days(spark):
    day = lambda m, d: dt.date(2024, m, d)
    present = spark.createDataFrame([("a", day(1, 30)), ("a", day(1, 31)), ("a", day(1, 31)), ("b", day(1, 31)), ("b", day(2, 1))], "source string, day date")
    days = spark.createDataFrame([(day(1, 30),), (day(1, 31),), (day(2, 1),)], "day date")
    got = {(r["source"], r["month"]): (r["expected"], r["present"], r["cell"]) for r in gridindex.month_coverage(present, days).collect()}
    assert got == {("a", "2024-01"): (2, 2, "complete"), ("a", "2024-02"): (1, 0, "absent"), ("b", "2024-01"): (2, 1, "partial"), ("b", "2024-02"): (1, 1, "complete")}


def test_holes_in_leads(spark, tmp_path):
    """Orders 0..39 of one station and run, a lead every three hours, without the one of lead 60."""
    rows = ", ".join(f"({k}, {28 + model}, {1000.0 * (k + 1)}, TIMESTAMP '2024-01-05')" for k in range(40) if k != 19 for model in (0, 1))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(o_orderkey, o_custkey, o_totalprice, o_orderdate)) TO '{tmp_path}/orders.parquet'")
    got = {(r["model"], r["lead_hours"]): r["precip_24h"] for r in QUERIES["precip24_fcst"](spark, str(tmp_path)).collect()}
    leads = [k for k in range(3, 123, 3) if k != 60]
    step = {k: k / 3 for k in leads}  # the value at each lead
    want = {("aifs", k): (None if k < 24 or k - 24 == 60 else step[k] - (step[k - 24] if k > 24 else 0)) for k in leads}
    want |= {("gfs", k): (None if k < 24 or 60 in range(k - 18, k + 1, 6) else sum(step[x] for x in range(k - 18, k + 1, 6))) for k in leads}
    assert got == want


@pytest.mark.parametrize("name", "boot_metrics boot_decomposition boot_seeps boot_variance_ratio boot_bias_by_bin".split())
def test_bootstraps_draw_a_thousand_times(spark, name):
    assert {r["n_boot"] for r in QUERIES[name](spark, "/root/testdata/sf0.001").select("n_boot").distinct().collect()} == {1000}


def test_bias_bootstrap_equals_a_thousand_draws(spark, duck):
    equals_sql(spark, duck, "boot_bias_ci")


def test_results_table_equals_a_thousand_draws(spark):
    """Limits of one group against days resampled one draw at a time."""
    rows = [r for r in QUERIES["results_table"](spark, SF).collect() if (r["metric"], r["model"], r["lead_hours"], r["stratum_type"]) == ("bias", "A", 24, "global")]
    days = A.pairs(spark, SF).where("model = 'A' and lead_hours = 24").groupBy("day").agg(F.sum(F.col("fcst") - F.col("obs")).alias("e"), F.count(F.lit(1)).alias("n")).orderBy("day").toPandas()
    n = len(days)
    length = min(n, student.clamped_block_length((days["e"] / days["n"]).to_numpy(float)))
    starts = np.random.default_rng(0).integers(0, n - length + 1, size=(1000, -(-n // length)))
    draws = []
    for first in starts:
        at = np.concatenate([np.arange(s, s + length) for s in first])[:n]
        draws.append(days["e"].to_numpy()[at].sum() / days["n"].to_numpy()[at].sum())
    assert len(rows) == 1
    assert (rows[0]["ci_low"], rows[0]["ci_high"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=1e-9)
