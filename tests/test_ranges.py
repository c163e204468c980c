"""Ranks by ranges: equal to windows and to the definition, and no range much larger than the others."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugemark.operators import strata, tests
from gaugemark.operators.ranges import ranked, value_counts


def adjusted(p, q):
    """The step-up rule by definition."""
    order = np.argsort(p, kind="stable")
    step = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(step[::-1])[::-1], 1)
    return out, out <= q


def numbers(seed, n):
    """Very small and usual values, and one that a third of all tests have."""
    r = np.random.default_rng(seed)
    return np.where(r.random(n) < 1 / 3, 1.0, np.where(r.random(n) < 0.5, 10.0 ** -r.uniform(0, 40, n), np.round(r.random(n), 3)))


@pytest.mark.parametrize("ranges", [None, 1, 2, 3, 64])
def test_false_discovery_of_families_of_all_sizes(spark, ranges):
    rows, want = [], {}
    for f, n in (("one", 1), ("few", 7), ("many", 3000), (None, 40)):
        p = numbers(n, n)
        for i, (x, a, b) in enumerate(zip(p, *adjusted(p, 0.1), strict=True)):
            rows.append((f, i, float(x), "extra"))
            want[f, i] = (n, pytest.approx(a, rel=1e-12), b)
    df = spark.createDataFrame(rows, "family_id string, test_id int, p_raw double, n string").repartition(3)
    out = tests.benjamini_hochberg(df, 0.1, ranges=ranges)
    assert out.columns == ["family_id", "test_id", "p_raw", "n", "n_family", "p_adj", "reject"]
    got = {(r["family_id"], r["test_id"]): (r["n_family"], r["p_adj"], r["reject"]) for r in out.collect()}
    assert got == want
    assert tests.benjamini_hochberg(df.limit(0), ranges=ranges).collect() == []


def test_a_large_family_is_dealt_evenly(spark):
    p = numbers(1, 300_000)
    df = spark.createDataFrame(pd.DataFrame({"family_id": "f", "p_raw": p})).repartition(8)
    counts = value_counts(df, ["family_id"], "p_raw")
    out = ranked(counts, ["family_id"], "p_raw", 64)
    sizes = sorted(r["count"] for r in out.groupBy("range").count().collect())
    assert len(sizes) >= 60 and sizes[-1] <= 3 * sizes[len(sizes) // 2] and sum(sizes) == len(np.unique(p))
    got = np.sort([r["p_adj"] for r in tests.benjamini_hochberg(df, ranges=64).select("p_adj").collect()])
    assert np.allclose(got, np.sort(adjusted(p, 0.05)[0]), rtol=1e-12)


def test_no_window_holds_a_family(spark):
    df = spark.createDataFrame([("f", 0.1)], "family_id string, p_raw double")
    plan = tests.benjamini_hochberg(df, ranges=64)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for w in windows:  # over rows of one range, or over one row a range
        assert ", range#" in w[w.index("windowspecdefinition") :].split("specifiedwindowframe")[0] or "_m#" in w or "_least#" in w


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_percentiles_by_ranges_equal_the_window(spark, ranges):
    r = np.random.default_rng(2)
    values = [None if x < 0.1 else float(np.round(x * 20)) for x in r.random(500)]
    rows = [(f"s{i % 3}" if i % 7 else None, "t2m", v, i) for i, v in enumerate(values)] + [("alone", "t2m", 1.0, -1), ("none", "t2m", None, -2)]
    df = spark.createDataFrame(rows, "station_id string, variable string, obs double, n int").repartition(3)
    key = lambda d: sorted(((x["n"], x["obs"], x["obs_pct"]) for x in d.collect()), key=str)
    out = strata.with_obs_percentile(df, ranges=ranges)
    assert out.columns == [*df.columns, "obs_pct"]
    assert [(a, b, c if c is None else pytest.approx(c)) for a, b, c in key(strata.with_obs_percentile(df))] == key(out)


def test_ranks_add_up_over_ranges(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [5] * 10 + [1, 2, 3, 3, 9]], "g string, v double")
    got = {r["v"]: (r["below"], r["n"], r["total"]) for r in ranked(value_counts(df, ["g"], "v"), ["g"], "v", 4).collect()}
    assert got == {1.0: (0, 1, 15), 2.0: (1, 1, 15), 3.0: (2, 2, 15), 5.0: (4, 10, 15), 9.0: (14, 1, 15)}
    assert ranked(value_counts(df.where(F.lit(False)), ["g"], "v"), ["g"], "v").collect() == []
