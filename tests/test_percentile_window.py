"""Percentiles of observations: one sort serves ranks, ties and sizes."""

import re

from gaugemark.operators import metrics, strata

SCHEMA = "model string, station_id string, variable string, fcst double, obs double"


def test_ties_nulls_and_sizes(spark):
    values = [("s", 2.0), ("s", 1.0), ("s", 2.0), ("s", None), ("s", float("nan")), ("t", None), ("u", 7.0), (None, 3.0), (None, 3.0)]
    df = spark.createDataFrame([("m", s, "t2m", 0.0, v) for s, v in values], SCHEMA)
    got = sorted(((str(x["station_id"]), str(x["obs"]), x["obs_pct"]) for x in strata.with_obs_percentile(df).collect()), key=str)
    want = [("s", "1.0", 1 / 5 * 100), ("s", "2.0", 2.5 / 5 * 100), ("s", "2.0", 2.5 / 5 * 100), ("s", "nan", 4 / 5 * 100), ("s", "None", None), ("t", "None", None), ("u", "7.0", 100.0), ("None", "3.0", 75.0), ("None", "3.0", 75.0)]
    assert got == sorted(want, key=str)


def test_rows_are_sorted_once(spark):
    df = spark.createDataFrame([("m", f"s{i % 3}", "t2m", 0.0, float(i % 5)) for i in range(60)], SCHEMA)
    for out in (strata.with_obs_percentile(df), metrics.bias_by_bin(strata.with_obs_percentile(df), ["model"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bWindow \[", plan)) == 1 and len(re.findall(r"\bSort \[station_id", plan)) == 1
