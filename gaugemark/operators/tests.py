"""t-tests on daily series and control of the false discovery rate."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.student import quantile, two_sided_p
from ..workers import ship
from .ranges import ranked

METHODS = ("iid", "ar2", "hac")


def _checked(x, least: int) -> np.ndarray:
    x = np.asarray(x, float)
    if x.ndim != 1 or len(x) < least or not np.isfinite(x).all():
        raise ValueError(f"needs one dimension, {least} values or more, all finite")
    return x


def ttest(series, method: str = "hac", alpha: float = 0.05, v0: float = 0.4) -> dict:
    """Mean, standard error, interval and two-sided p of one daily series.

    iid: independent days. ar2: the error grows by an AR(2) fit, n - 1 degrees stay. hac: long-run
    variance from the lowest cosine coefficients, as many degrees as coefficients.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    x = _checked(series, 3 if method == "ar2" else 2)
    n, mean = len(x), float(x.mean())
    dev = x - mean
    var = float(dev @ dev) / (n - 1)
    stderr, dof, n_eff = math.sqrt(var / n), n - 1, float(n)
    if method == "ar2":
        r1, r2 = (float((dev[k:] * dev[:-k]).mean() / var) if var else 0.0 for k in (1, 2))
        if abs(r1) == 1:
            raise ValueError("degenerate AR(2) fit")
        p1, p2 = r1 * (1 - r2) / (1 - r1**2), (r2 - r1**2) / (1 - r1**2)
        k2 = (1 - r1 * p1 - r2 * p2) / (1 - p1 - p2) ** 2
        stderr, n_eff = stderr * math.sqrt(k2), n / k2 if k2 > 0 else float(n)
    elif method == "hac":
        dof = max(1, min(int(v0 * n ** (2 / 3)), n - 1))
        basis = np.cos(np.pi * np.arange(1, dof + 1)[:, None] * (2 * np.arange(n) + 1) / (2 * n)) * math.sqrt(2 / n)
        stderr, n_eff = math.sqrt(float(((basis @ dev) ** 2).mean()) / n), float(dof + 1)
    half = quantile(1 - alpha / 2, dof) * stderr
    p = two_sided_p(mean / stderr, dof) if stderr > 0 else float(mean == 0)
    return {"estimate": mean, "stderr": stderr, "ci_low": mean - half, "ci_high": mean + half, "p_raw": p, "dof": dof, "n_days": n, "n_eff": n_eff, "method": method}


_FIELDS = "estimate double, stderr double, ci_low double, ci_high double, p_raw double, dof int, n_days int, n_eff double, method string"


def ttest_by(daily: DataFrame, by: Sequence[str], method: str = "hac", value: str = "error", day: str = "day", alpha: float = 0.05) -> DataFrame:
    """A test for every group's series of one value a day; groups hold the calendar's days at most."""
    ship(daily.sparkSession)
    schema = T.StructType([*(daily.schema[b] for b in by), *T._parse_datatype_string(_FIELDS).fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = ttest(pdf.sort_values(day)[value].to_numpy(), method, alpha)
        return pd.DataFrame([[*(pdf[b].iloc[0] for b in by), *row.values()]], columns=schema.names)

    return daily.select(*by, day, value).groupBy(*by).applyInPandas(run, schema)


def paired_difference(daily: DataFrame, a: str, b: str, by: Sequence[str], day: str = "day", value: str = "error") -> DataFrame:
    """Daily series of model a less model b over the days that both have."""
    of = lambda m, to: daily.where(F.col("model") == m).select(*by, day, F.col(value).alias(to))
    return of(a, "x").join(of(b, "y"), [*by, day]).select(*by, day, (F.col("x") - F.col("y")).alias(value))


def paired_test(daily: DataFrame, a: str, b: str, by: Sequence[str], method: str = "hac", value: str = "error", day: str = "day") -> DataFrame:
    out = ttest_by(paired_difference(daily, a, b, by, day, value), by, method, value, day)
    return out.withColumn("method", F.concat(F.lit("paired_"), F.col("method"))).withColumn("comparison_id", F.lit("+".join(sorted((a, b)))))


def daily_matrix(view: DataFrame, models: Sequence[str], scores: Mapping[str, Callable[[Column], Column]], by: Sequence[str], day: str = "day") -> DataFrame:
    """(by, day, models): for each day an array with each model's mean scores as a struct, in the order of ``models``; null where it has none.

    ``scores``: name -> function of the error. One scan and two aggregates, whatever the number of models, pairs and scores.
    """
    e = F.col("fcst") - F.col("obs")
    daily = view.where(F.col("model").isin(*models)).groupBy(*by, day, "model").agg(*(F.avg(f(e)).alias(n) for n, f in scores.items()))
    row = F.struct(*scores)
    return daily.groupBy(*by, day).agg(F.array(*(F.max(F.when(F.col("model") == m, row)) for m in models)).alias("models"))


def paired_differences(matrix: DataFrame, models: Sequence[str], names: Sequence[str], by: Sequence[str], day: str = "day") -> DataFrame:
    """(by, metric, a, b, day, error): the daily series of every two models' differences in every score, over the days that both have."""
    place = {m: F.lit(i) for i, m in enumerate(models)}
    each = [F.struct(F.lit(n).alias("metric"), F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col("models")[place[a]][n] - F.col("models")[place[b]][n]).alias("error")) for n in names for a, b in combinations(models, 2)]
    return matrix.select(*by, day, F.explode(F.array(*each)).alias("x")).where("x.error is not null").select(*by, "x.metric", "x.a", "x.b", day, "x.error")


def benjamini_hochberg(tests: DataFrame, q: float = 0.05, family: str = "family_id", p: str = "p_raw", ranges: int | None = None) -> DataFrame:
    """``tests`` with p_adj, reject and n_family, adjusted within each family.

    A p that is missing or outside 0..1 raises when the result is computed; ``check_p`` tells sooner. Tests of one p share
    their p_adj, so only the distinct values of a family are ranked: in one window by default, as the tests of a registry
    are few; with ``ranges`` in so many ranges, for families of any size, which no task holds then. Both give the same.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be within 0 and 1")
    value = F.col(p).cast("double")
    sound = F.when(value.between(0, 1), value).otherwise(F.raise_error(F.concat(F.lit("p-value missing or outside 0..1: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("double"))
    keyed = tests.select(F.col(family).alias("_family"), sound.alias("_p"))
    counts = keyed.groupBy("_family", "_p").agg(F.count(F.lit(1)).alias("n"))
    if ranges is None:
        order = W.partitionBy("_family").orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)
        falling = W.partitionBy("_family").orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
        ready = counts.withColumns({"_upto": F.sum("n").over(order), "n_family": F.sum("n").over(W.partitionBy("_family"))})
        ready = ready.withColumn("p_adj", F.least(F.lit(1.0), F.min(F.col("_p") * F.col("n_family") / F.col("_upto")).over(falling)))
        return _with_adjusted(tests, ready.select("_family", "_p", "n_family", "p_adj"), q, family, value)
    steps = ranked(counts, ["_family"], "_p", ranges)
    steps = steps.withColumn("_step", F.col("_p") * F.col("total") / (F.col("below") + F.col("n")))
    later = W.partitionBy("_f").orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, -1)
    least = steps.groupBy(F.col("_family").alias("_f"), F.col("range").alias("_r")).agg(F.min("_step").alias("_least"))
    least = least.select("_f", "_r", F.min("_least").over(later).alias("_later"))
    above = W.partitionBy("_family", "range").orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.withColumn("_own", F.min("_step").over(above))
    steps = steps.join(least, F.col("_family").eqNullSafe(F.col("_f")) & (F.col("range") == F.col("_r")))
    adjusted = steps.select("_family", "_p", F.col("total").alias("n_family"), F.least(F.lit(1.0), "_own", "_later").alias("p_adj"))
    return _with_adjusted(tests, adjusted, q, family, value)


def _with_adjusted(tests: DataFrame, adjusted: DataFrame, q: float, family: str, value: Column) -> DataFrame:
    joined = tests.join(adjusted, F.col(family).eqNullSafe(F.col("_family")) & (value == F.col("_p")))
    return joined.withColumn("reject", F.col("p_adj") <= q).select(*tests.columns, "n_family", "p_adj", "reject")


def check_p(tests: DataFrame, p: str = "p_raw") -> DataFrame:
    bad = tests.agg(F.count_if(F.col(p).isNull() | F.isnan(p) | ~F.col(p).between(0, 1)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} p-values are missing or outside 0..1")
    return tests
