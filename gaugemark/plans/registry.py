"""Registered metrics and test families, and the results table that they give.

Results are rows of the RESULTS contract: an estimate never stands without its interval, paired tests
give p_raw, and p_adj controls the false discovery rate over the whole family of a run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..operators import bootstrap, matching, metrics, tests

VERSION = "1"
DEFAULTS = {"alpha": 0.05, "n_boot": 1000, "block_clamp": (2, 30), "q": 0.05}
_ALL = ("t2m", "wind10m", "precip_24h")
_REGIMES = ("season", "koppen_l1", "enso", "mjo")
#: name -> (forecast input, variables, strata); ``adjusted`` takes the elevation-adjusted value where there is one.
METRICS = {
    "mae": ("adjusted", _ALL, ("global", *_REGIMES)),
    "rmse": ("adjusted", _ALL, ("global", *_REGIMES)),
    "bias": ("adjusted", _ALL, ("global", *_REGIMES)),
    "mse_total": ("adjusted", _ALL, ("global",)),
    "repr_floor_mean": ("adjusted", _ALL, ("global",)),
    "mse_model_est": ("adjusted", _ALL, ("global",)),
    "variance_ratio": ("raw", _ALL, ("global", "season")),
    "bias_by_percentile": ("adjusted", ("t2m", "precip_24h"), ("obs_percentile_bin",)),
}
#: Registered for ensembles, not computed.
NOT_COMPUTED = ("crps", "brier", "reliability")
FAMILIES = {"headline": ("mae", "rmse", "bias"), "signature": ("variance_ratio", "bias_by_percentile"), "regimes": ("mae",)}
_DAILY = {"mae": lambda e: F.abs(e), "rmse": lambda e: e * e, "bias": lambda e: e}


def _results(df: DataFrame, ingest_version: str, **fixed) -> DataFrame:
    """``df`` in the RESULTS contract; columns that it lacks are null or ``fixed``."""
    fixed |= {"registry_version": VERSION, "ingest_version": ingest_version}
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(fixed.get(f.name))).cast(f.dataType).alias(f.name) for f in C.RESULTS]
    return C.validate(df.select(*columns), C.RESULTS, "results")


#: Groups with fewer pairs give no row; the variance ratio needs more.
MIN_PAIRS, MIN_PAIRS_RATIO = 30, 100
_PARTS = ("mse_total", "repr_floor_mean", "mse_model_est")


def metric_rows(df: DataFrame, names: Sequence[str], ingest_version: str, strata: Sequence[str] = (), comparison: str | None = None, min_pairs: int = MIN_PAIRS, n_boot: int = DEFAULTS["n_boot"], seed: int = 0) -> DataFrame:
    """Estimates with intervals by (model, variable, lead), over all rows and by each stratum column.

    Every registered metric has its bootstrap: means, the parts of the squared error (rows with a floor), the
    variance ratio, the bias by percentile bin (the bin is the stratum; needs ``obs_pct``). Groups below ``min_pairs``
    rows give none. The stratum columns are unpivoted, so that one pass of day sums serves all of them.
    """
    if unknown := [m for m in names if m not in METRICS]:
        raise ValueError(f"not computed here: {unknown}")
    kinds = F.array(F.struct(F.lit("global").alias("stratum_type"), F.lit("all").alias("stratum_value")), *(F.struct(F.lit(s).alias("stratum_type"), F.col(s).cast("string").alias("stratum_value")) for s in strata))
    rows = df.withColumn("_s", F.explode(kinds)).select("*", "_s.*").where("stratum_value is not null")
    group = ["model", "variable", "lead_hours"]
    by, options = [*group, "stratum_type", "stratum_value"], {"n_boot": n_boot, "alpha": DEFAULTS["alpha"], "seed": seed}

    def with_stations(out: DataFrame, of: DataFrame, least: int = min_pairs) -> DataFrame:
        stations = of.groupBy(*by).agg(F.count_distinct("station_id").alias("n_stations"))
        return _results(out.where(F.col("n_pairs") >= least).join(stations, by), ingest_version, comparison_id=comparison)

    made = []
    if means := [m for m in names if m not in (*_PARTS, "variance_ratio", "bias_by_percentile")]:
        made.append(with_stations(bootstrap.block_bootstrap(rows, by, means, **options), rows))
    if parts := [m for m in names if m in _PARTS]:
        floored = rows.where("repr_floor is not null")
        made.append(with_stations(bootstrap.decomposition_bootstrap(floored, by, **options).where(F.col("metric").isin(*parts)), floored))
    if "variance_ratio" in names:
        made.append(with_stations(bootstrap.variance_ratio_bootstrap(rows, by, **options).withColumn("metric", F.lit("variance_ratio")), rows, max(min_pairs, MIN_PAIRS_RATIO)))
    if "bias_by_percentile" in names:
        binned = df.withColumns({"stratum_type": F.lit("obs_percentile_bin"), "stratum_value": metrics.percentile_bin(F.col("obs_pct"))}).where("stratum_value is not null")
        made.append(with_stations(bootstrap.block_bootstrap(binned, by, ["bias"], **options).withColumn("metric", F.lit("bias_by_percentile")), binned))
    return reduce(DataFrame.unionByName, made)


def ratio_by_lead(results: DataFrame) -> DataFrame:
    """Figure table: the variance ratio with its interval by model, variable and lead."""
    return results.where("metric = 'variance_ratio' and stratum_type = 'global'").select("variable", "model", "lead_hours", "estimate", "ci_low", "ci_high", "n_pairs", "n_stations")


def bias_by_percentile(results: DataFrame) -> DataFrame:
    """Figure table: the bias with its interval by bin of the observed percentile, with the bin's middle for the axis."""
    ends = [F.split("stratum_value", "-")[i].try_cast("double") for i in (0, 1)]
    return results.where("metric = 'bias_by_percentile'").select("variable", "model", "lead_hours", F.col("stratum_value").alias("bin"), ((ends[0] + ends[1]) / 2).alias("middle"), "estimate", "ci_low", "ci_high", "n_pairs")


def paired_rows(view: DataFrame, models: Sequence[str], ingest_version: str, family: str = "headline", method: str = "hac") -> DataFrame:
    """Paired tests of every two models on a matched view, adjusted over the family.

    The daily series are means over the stations; a positive estimate says that the first model in the pair
    has the higher score.
    """
    models, names, by = sorted(set(models)), FAMILIES[family], ["variable", "lead_hours"]
    matching.comparison_id(models)
    matrix = tests.daily_matrix(view, models, {n: _DAILY[n] for n in names}, by)
    series = tests.paired_differences(matrix, models, names, by)
    out = tests.ttest_by(series, [*by, "metric", "a", "b"], method)
    fixed = {"method": F.concat(F.lit("paired_"), F.col("method")), "comparison_id": F.concat_ws("+", "a", "b"), "model": F.concat_ws("-", "a", "b"), "stratum_type": F.lit("global"), "stratum_value": F.lit("all"), "family_id": F.lit(family)}
    return _results(tests.benjamini_hochberg(out.withColumns(fixed), DEFAULTS["q"]), ingest_version, alpha=DEFAULTS["alpha"])


def inputs(fact: DataFrame, metric: str) -> DataFrame:
    """Fact rows of the metric's variables with ``fcst`` and ``day`` by its registered input."""
    kind, variables, _ = METRICS[metric]
    return metrics.forecast_column(fact.where(F.col("variable").isin(*variables)), _ALL if kind == "adjusted" else ())
