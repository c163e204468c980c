"""The bootstrapped variance ratio: one shuffle by station, stations cut anywhere by batches, several rows a day."""

import datetime as dt

import numpy as np
import pytest

from gaugemark.operators import bootstrap

SCHEMA = "model string, station_id string, day date, fcst double, obs double"


def series():
    """Two models, five stations (one constant, one unknown by name), 30 days with holes, one to three rows a day."""
    r = np.random.default_rng(11)
    out = []
    for model, days in (("a", 30), ("b", 21)):
        for station in ("s0", "s1", "s2", "flat", None):
            for i in range(days):
                for _ in range(int(r.integers(0, 4))):
                    out.append((model, station, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(r.normal(3, 2)), 5.0 if station == "flat" else float(r.normal(3, 1))))
    return out


def brute(rows, at):
    """Median over stations of the ratio on the days drawn."""
    days = sorted({r[2] for r in rows})
    out = []
    for s in {r[1] for r in rows}:
        of = {}
        for r in rows:
            if r[1] == s:
                of.setdefault(r[2], []).append(r[3:])
        drawn = [x for i in at for x in of.get(days[i], [])]
        f, o = zip(*drawn, strict=True)
        if len(set(o)) > 1:
            out.append(np.std(f, ddof=1) / np.std(o, ddof=1))
    return np.median(out)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_batches_cut_stations_anywhere(spark, batch):
    rows = series()
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, batch)
    try:
        out = {x["model"]: x for x in bootstrap.variance_ratio_bootstrap(spark.createDataFrame(rows, SCHEMA), ["model"], n_boot=50, block_len=4, seed=2).collect()}
    finally:
        spark.conf.set(setting, before)
    assert set(out) == {"a", "b"}
    for model, got in out.items():
        own = [r for r in rows if r[0] == model]
        n = len({r[2] for r in own})
        starts = np.random.default_rng(2).integers(0, n - 4 + 1, size=(50, -(-n // 4)))
        draws = [brute(own, (s[:, None] + np.arange(4)).ravel()[:n]) for s in starts]
        assert got["estimate"] == pytest.approx(brute(own, range(n)), abs=1e-9)
        assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=1e-9)
        assert (got["n_pairs"], got["n_days"], got["block_len_days"], got["n_boot"]) == (len(own), n, 4, 50)


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame(series(), SCHEMA)
    plan = bootstrap.variance_ratio_bootstrap(df, ["model"], n_boot=20)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "station_id" in line]
    assert len(moved) == 1 and "SortMergeJoin" not in plan


def test_without_groups(spark):
    rows = [r for r in series() if r[0] == "a"]
    got = bootstrap.variance_ratio_bootstrap(spark.createDataFrame(rows, SCHEMA), [], n_boot=20, block_len=3).first()
    assert got["estimate"] == pytest.approx(brute(rows, range(len({r[2] for r in rows}))), abs=1e-9)
