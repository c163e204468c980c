"""Quality checks that set bits in ``qc_flags`` and never remove a row.

All window checks partition by (station_id, variable), so Spark shuffles the table once for them. Rows
are unique by (station_id, variable, valid_time); ``conflicts`` checks that first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import contracts as C

#: Fixed values of the published calibration.
PARAMS: dict = {
    "range": {"t2m": (228.15, 323.15), "wind10m": (0.0, 60.0), "precip_1h": (0.0, 200.0)},
    "step": {"t2m": 8.0, "wind10m": 25.0},
    "persistence": {"min_repeats_hours": 6, "wind_calm_exempt_below": 0.5, "precip_zero_exempt": True},
    "spatial": {"neighbors_k": 5, "radius_km": 300.0, "max_mad_z": 5.0, "sigma_floor": {"t2m": 1.5, "wind10m": 1.5}, "exempt_variables": ("precip_1h",)},
    "metadata": {"max_elev_diff_m": 100.0},
    "duplicate": {"value_tolerance": 0.05},
    "completeness": 0.80,
}


def _series() -> W:
    return W.partitionBy("station_id", "variable").orderBy("valid_time")


def flagged(df: DataFrame, mask: Column, bit: int) -> DataFrame:
    """Set ``bit`` where the mask is true; a null mask sets nothing."""
    flags = F.col("qc_flags")
    return df.withColumn("qc_flags", F.when(F.coalesce(mask, F.lit(False)), flags.bitwiseOR(F.lit(bit))).otherwise(flags))


def _by_variable(values: Mapping[str, float]) -> Column:
    """The variable's value, null for variables that have none."""
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col("variable") == name, F.lit(float(value))).otherwise(out)
    return out


def range_check(df: DataFrame, params: Mapping = PARAMS) -> DataFrame:
    low = _by_variable({k: v[0] for k, v in params["range"].items()})
    high = _by_variable({k: v[1] for k, v in params["range"].items()})
    return flagged(df, (F.col("value") < low) | (F.col("value") > high), C.RANGE)


def step_check(df: DataFrame, params: Mapping = PARAMS) -> DataFrame:
    """The later of two readings exactly one hour apart whose difference is above the limit."""
    limit = _by_variable(params["step"])
    before, at = F.lag("value").over(_series()), F.lag("valid_time").over(_series())
    return flagged(df, (at + F.expr("INTERVAL 1 HOUR") == F.col("valid_time")) & (F.abs(F.col("value") - before) > limit), C.STEP)


def persistence_check(df: DataFrame, params: Mapping = PARAMS) -> DataFrame:
    """All members of runs of equal hourly values; nulls break runs, calm wind and dry hours are exempt."""
    p = params["persistence"]
    goes_on = (F.lag("value").over(_series()) == F.col("value")) & (F.lag("valid_time").over(_series()) + F.expr("INTERVAL 1 HOUR") == F.col("valid_time"))
    marked = df.withColumn("_start", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_start").over(_series().rowsBetween(W.unboundedPreceding, W.currentRow)))
    length = F.count(F.lit(1)).over(W.partitionBy("station_id", "variable", "_run"))
    value, variable = F.col("value"), F.col("variable")
    exempt = (variable == "wind10m") & (value < p["wind_calm_exempt_below"])
    if p["precip_zero_exempt"]:
        exempt |= (variable == "precip_1h") & (value == 0)
    out = runs.withColumn("_length", length)
    return flagged(out, (F.col("_length") >= p["min_repeats_hours"]) & value.isNotNull() & ~exempt, C.PERSISTENCE).drop("_start", "_run", "_length")


def spatial_check(df: DataFrame, neighbours: DataFrame, params: Mapping = PARAMS) -> DataFrame:
    """Deviation from the neighbours' median at the same instant, in robust sigmas, of three neighbours or more.

    ``neighbours``: (station_id, neighbor_id). The station network bounds it to k rows a station.
    """
    p = params["spatial"]
    seen = df.select(F.col("station_id").alias("neighbor_id"), "variable", "valid_time", F.col("value").alias("nb"))
    key = ["station_id", "variable", "valid_time"]
    values = neighbours.join(seen, "neighbor_id").groupBy(*key).agg(F.collect_list("nb").alias("nb"))  # k values at most
    median = lambda x: (x[F.floor((F.size(x) - 1) / 2).cast("int")] + x[F.floor(F.size(x) / 2).cast("int")]) / 2
    values = values.withColumn("nb", F.array_sort("nb")).where(F.size("nb") >= 3).withColumn("_median", median(F.col("nb")))
    values = values.withColumn("_away", F.array_sort(F.transform("nb", lambda v: F.abs(v - F.col("_median")))))
    values = values.select(*key, "_median", median(F.col("_away")).alias("_mad"))
    sigma = F.greatest(F.col("_mad") * 1.4826, F.coalesce(_by_variable(p["sigma_floor"]), F.lit(0.0))) + 1e-9
    mask = (F.abs(F.col("value") - F.col("_median")) / sigma > p["max_mad_z"]) & ~F.col("variable").isin(*p["exempt_variables"])
    return flagged(df.join(values, key, "left"), mask, C.SPATIAL).drop("_median", "_mad").select(df.columns)


def metadata_check(df: DataFrame, stations: DataFrame, params: Mapping = PARAMS) -> DataFrame:
    """Stations without a full position, or whose height is far from the terrain model's; unknown ones pass."""
    lacks = F.col("lat").isNull() | F.col("lon").isNull() | F.col("elev_station").isNull()
    far = F.abs(F.col("elev_station") - F.col("elev_dem")) > params["metadata"]["max_elev_diff_m"]
    bad = stations.select("station_id", (lacks | F.coalesce(far, F.lit(False))).alias("_bad"))
    return flagged(df.join(bad, "station_id", "left"), F.col("_bad"), C.METADATA).select(df.columns)


def duplicate_check(df: DataFrame, stations: DataFrame, params: Mapping = PARAMS, secondary: str = "isd") -> DataFrame:
    """Rows of the secondary network that repeat the reading of the station they are crossed with."""
    crossed = stations.where((F.col("network") == secondary) & F.col("cross_ref").isNotNull()).select("station_id", F.col("cross_ref").alias("_ref"))
    first = df.select(F.col("station_id").alias("_ref"), "variable", "valid_time", F.col("value").alias("_other")).groupBy("_ref", "variable", "valid_time").agg(F.min("_other").alias("_other"))  # of repeated readings the least
    joined = df.join(crossed, "station_id", "left").join(first, ["_ref", "variable", "valid_time"], "left")
    return flagged(joined, F.abs(F.col("value") - F.col("_other")) <= params["duplicate"]["value_tolerance"], C.DUPLICATE).select(df.columns)


def run_qc(obs: DataFrame, stations: DataFrame, neighbours: DataFrame | None = None, params: Mapping = PARAMS) -> DataFrame:
    """All checks; each reads values, not flags, so their order does not matter."""
    df = obs.withColumn("qc_flags", F.lit(0))
    df = persistence_check(step_check(range_check(df, params), params), params)
    if neighbours is not None:
        df = spatial_check(df, neighbours, params)
    return duplicate_check(metadata_check(df, stations, params), stations, params)


def check_qc(obs: DataFrame, flagged_: DataFrame) -> dict:
    """Reconcile a QC run: it flags rows and never drops or repeats one. With the flag counts of every variable."""
    n = obs.count()
    counts = {r["variable"]: r.asDict() for r in C.bit_counts(flagged_).collect()}  # one row a variable
    return C.reconcile("qc", n, sum(r["n"] for r in counts.values()), {}) | {"flags": counts}


def conflicts(obs: DataFrame) -> DataFrame:
    """Keys that hold more than one distinct value, with the count; exact repeats are no conflict."""
    key = ["station_id", "valid_time", "variable"]
    return obs.select(*key, "value").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def unique_obs(obs: DataFrame) -> DataFrame:
    """``obs`` without exact repeats; raises if a key has several values."""
    if not (bad := conflicts(obs)).isEmpty():
        raise C.ContractError(f"conflicting observations, such as {bad.first().asDict()}")
    return obs.dropDuplicates(["station_id", "valid_time", "variable", "value"])


def completeness(stations: DataFrame, obs_qc: DataFrame, n_hours: int) -> DataFrame:
    """Clean temperature readings of every included station, and their share of all hours."""
    clean = obs_qc.where((F.col("variable") == "t2m") & (F.col("qc_flags") == 0)).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    joined = stations.where("status = 'included'").select("station_id").join(clean, "station_id", "left")
    return joined.select("station_id", F.coalesce("n", F.lit(0)).alias("n_clean_t2m"), (F.coalesce("n", F.lit(0)) / F.lit(n_hours)).alias("completeness_t2m"))


def completeness_cut(stations: DataFrame, obs_qc: DataFrame, n_hours: int, least: float = PARAMS["completeness"]) -> DataFrame:
    """Included stations below the share become excluded, with the reason; others stay as they are."""
    low = completeness(stations, obs_qc, n_hours).where(F.col("completeness_t2m") < least).select("station_id", F.lit(True).alias("_low"))
    out = stations.join(low, "station_id", "left")
    return out.withColumns({"exclusion_reason": F.when(F.col("_low"), F.lit(f"t2m_clean_completeness_lt_{least:g}")).otherwise(F.col("exclusion_reason")), "status": F.when(F.col("_low"), F.lit("excluded")).otherwise(F.col("status"))}).select(stations.columns)
