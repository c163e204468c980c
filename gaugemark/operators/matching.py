"""Pairing of forecasts with observations, and exactly matched model comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import contracts as C
from ..functions.geo import RES, cell

LAPSE_K_PER_M, WIND_ONSET_M, WIND_PER_M, WIND_MOST = 0.0065, 100.0, 0.002, 3.0
DROPS = ("obs_missing_or_incomplete", "delta_z_exceeded")
FROM_INIT, PER_STEP_6H = ("aifs", "hres"), ("gfs", "graphcast")


def precip_24h_forecast(points: DataFrame) -> DataFrame:
    """24-hour totals by lead from accumulations (models since init) or six-hour steps; null if a part is missing.

    A total of steps is that of the leads 18, 12, 6 and 0 hours before, whatever other leads a run has.
    Input: (station_id, model, init_time, lead_hours, value), value in mm.
    """
    run = W.partitionBy("station_id", "model", "init_time").orderBy(F.col("lead_hours").cast("int"))
    lead, value = F.col("lead_hours"), F.col("value")
    before = lambda hours: F.first("value").over(run.rangeBetween(-hours, -hours))
    since_init = F.when(lead == 24, value).when(lead > 24, value - before(24))
    by_step = F.when(lead >= 24, before(18) + before(12) + before(6) + value)
    return points.withColumn("precip_24h", F.when(F.col("model").isin(*FROM_INIT), since_init).when(F.col("model").isin(*PER_STEP_6H), by_step))


def precip_mm(value, units):
    """Metres become millimetres, kg m-2 is millimetres, other units raise."""
    return F.when(units == "m", C.m_to_mm(value)).when(units.isin("kg m-2", "kg m**-2", "mm"), value).otherwise(F.raise_error(F.concat(F.lit("unknown precipitation unit "), F.coalesce(units, F.lit("null")))).cast("double"))


def precip_24h_obs(obs_qc: DataFrame, min_clean_hours: int = 22) -> DataFrame:
    """Rain of (t - 24 h, t] at each hourly row: sum of clean values, known flags of all rows, clean hours.

    One RANGE window over each station; rows with too few clean hours are left out.
    """
    hourly = obs_qc.where("variable = 'precip_1h'")
    clean = (F.col("qc_flags") == 0) & F.col("value").isNotNull()
    day = W.partitionBy("station_id").orderBy(F.unix_micros("valid_time")).rangeBetween(-(24 * 3_600_000_000 - 1), 0)
    out = hourly.withColumns({
        "obs": F.sum(F.when(clean, F.col("value"))).over(day),
        "n_clean_hours": F.count(F.when(clean, F.lit(1))).over(day).cast("int"),
        "_flags": F.coalesce(F.bit_or("qc_flags").over(day), F.lit(0)).bitwiseAND(F.lit(C.ALL_BITS)),
    })
    return out.where(F.col("n_clean_hours") >= min_clean_hours).select("station_id", "valid_time", F.lit("precip_24h").alias("variable"), "obs", F.col("_flags").alias("qc_flags"), "n_clean_hours")


def wind_factor(dz):
    """1 up to 100 m above the model's ground, then rising to 3; null for unknown heights."""
    excess = F.least(F.greatest(dz - WIND_ONSET_M, F.lit(0.0)), F.lit((WIND_MOST - 1) / WIND_PER_M))
    return F.when(dz.isNotNull(), 1 + WIND_PER_M * excess)


def elevation_adjusted(variable, value, dz):
    return F.when(variable == "t2m", value - LAPSE_K_PER_M * dz).when(variable == "wind10m", value * wind_factor(dz))


def repr_floor(obs: DataFrame, stations: DataFrame, res: float = RES) -> DataFrame:
    """Median over time of the variance among a cell's stations: (cell_lat, cell_lon, variable, floor_var, n_stations, n_times)."""
    placed = obs.where("value is not null").join(stations.where("lat is not null and lon is not null").select("station_id", cell(F.col("lat"), res).alias("cell_lat"), cell(F.col("lon"), res).alias("cell_lon")), "station_id")
    instants = placed.groupBy("cell_lat", "cell_lon", "variable", "valid_time").agg(F.var_samp("value").alias("v"), F.count_distinct("station_id").alias("n")).where("n >= 2")
    return instants.groupBy("cell_lat", "cell_lon", "variable").agg(F.median("v").alias("floor_var"), F.max("n").alias("n_stations"), F.count(F.lit(1)).alias("n_times"))


def attach_floor(df: DataFrame, floors: DataFrame, stations: DataFrame, res: float = RES) -> DataFrame:
    cells = stations.select("station_id", cell(F.col("lat"), res).alias("cell_lat"), cell(F.col("lon"), res).alias("cell_lon"))
    floors = floors.select("cell_lat", "cell_lon", "variable", F.col("floor_var").alias("repr_floor"))
    return df.drop("repr_floor").join(cells, "station_id", "left").join(floors, ["cell_lat", "cell_lon", "variable"], "left").drop("cell_lat", "cell_lon")


def tagged_pairs(points: DataFrame, obs_qc: DataFrame, stations: DataFrame, max_delta_z_m: float = 500.0, min_clean_hours: int = 22) -> DataFrame:
    """Every forecast point with its observation, height difference and drop reason (null: it stays)."""
    hourly = obs_qc.where(F.col("variable").isin("t2m", "wind10m")).select("station_id", "valid_time", "variable", F.col("value").alias("obs"), "qc_flags")
    rain = precip_24h_obs(obs_qc, min_clean_hours).drop("n_clean_hours")
    paired = points.join(hourly.unionByName(rain), ["station_id", "valid_time", "variable"], "left").join(stations.select("station_id", "elev_station"), "station_id", "left")
    dz = F.col("elev_station") - F.col("grid_elev")
    reason = F.when(F.col("obs").isNull(), F.lit("obs_missing_or_incomplete")).when(F.abs(F.col("delta_z")) > max_delta_z_m, F.lit("delta_z_exceeded"))
    return paired.withColumn("delta_z", dz).withColumn("drop_reason", reason)


def build_fact(points: DataFrame, obs_qc: DataFrame, stations: DataFrame, ingest_version: str, floors: DataFrame | None = None, max_delta_z_m: float = 500.0, min_clean_hours: int = 22) -> DataFrame:
    """The pairs that stay, in the FACT contract. Drops: ``drop_counts`` over the same ``tagged_pairs``, or ``build_fact_watched``."""
    return _fact_of(tagged_pairs(points, obs_qc, stations, max_delta_z_m, min_clean_hours), stations, ingest_version, floors)


def build_fact_watched(points: DataFrame, obs_qc: DataFrame, stations: DataFrame, ingest_version: str, floors: DataFrame | None = None, max_delta_z_m: float = 500.0, min_clean_hours: int = 22) -> tuple[DataFrame, Observation]:
    """``build_fact`` and an observation of its drops, filled by the job that writes the fact; then ``contracts.reconciled("fact", seen)``."""
    tagged, seen = C.watched(tagged_pairs(points, obs_qc, stations, max_delta_z_m, min_clean_hours), DROPS)
    return _fact_of(tagged, stations, ingest_version, floors), seen


def _fact_of(tagged: DataFrame, stations: DataFrame, ingest_version: str, floors: DataFrame | None) -> DataFrame:
    kept = tagged.where("drop_reason is null")
    kept = kept.withColumn("fcst_elev_adj", elevation_adjusted(F.col("variable"), F.col("value"), F.col("delta_z")))
    kept = attach_floor(kept, floors, stations) if floors is not None else kept.withColumn("repr_floor", F.lit(None).cast("double"))
    kept = kept.withColumnRenamed("value", "fcst_raw").withColumn("ingest_version", F.lit(ingest_version))
    return C.validate(kept.select(*(F.col(f.name).cast(f.dataType) for f in C.FACT)), C.FACT, "fact")


def drop_counts(tagged: DataFrame) -> DataFrame:
    """One row: n_in, n_out and the count of each reason, from one aggregate."""
    return tagged.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.col("drop_reason").isNull()).alias("n_out"), *(F.count_if(F.col("drop_reason") == r).alias(r) for r in DROPS))


def check_fact(tagged: DataFrame) -> dict:
    row = drop_counts(tagged).first().asDict()
    return C.reconcile("fact", row.pop("n_in"), row.pop("n_out"), row)


KEY = ("init_time", "valid_time", "station_id", "variable")


def comparison_id(models: Sequence[str]) -> str:
    if len(models) < 2 or len(set(models)) != len(models):
        raise ValueError("a comparison needs two or more different models")
    return "+".join(sorted(models))


def matched_view(fact: DataFrame, models: Sequence[str], mask: int | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``models`` whose key every one of them has under the QC mask (None: no flag at all)."""
    clean = F.col("qc_flags") == 0 if mask is None else C.is_clean(F.col("qc_flags"), mask)
    comparison = comparison_id(models)
    valid = fact.where(F.col("model").isin(*models) & clean)
    full = valid.groupBy(*key).agg(F.count_distinct("model").alias("n")).where(F.col("n") == len(models)).select(*key)
    return valid.join(full, list(key), "left_semi").withColumn("comparison_id", F.lit(comparison)).select("comparison_id", *fact.columns)


def all_comparisons(models: Sequence[str]) -> list[tuple[str, ...]]:
    """Every pair, and all models if there are more than two."""
    models = sorted(set(models))
    return [*combinations(models, 2), *([tuple(models)] if len(models) > 2 else [])]


def matched_views(fact: DataFrame, models: Sequence[str], mask: int | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """``matched_view`` of every comparison of ``models`` at once, as one table: one scan, one shuffle, whatever their number.

    A window gathers for each key the bits of the models that have it; a row goes to every comparison that its model
    takes part in and whose models all are there. A key holds a row for each model, so windows are small.
    """
    models = sorted(set(models))
    if len(models) > 62:
        raise ValueError("at most 62 models fit a mask")
    bits = {m: 1 << i for i, m in enumerate(models)}
    clean = F.col("qc_flags") == 0 if mask is None else C.is_clean(F.col("qc_flags"), mask)
    bit = F.lit(0).cast("long")
    for m, b in bits.items():
        bit = F.when(F.col("model") == m, F.lit(b).cast("long")).otherwise(bit)
    there = F.bit_or("_bit").over(W.partitionBy(*key))
    views = F.array(*(F.struct(F.lit(comparison_id(c)).alias("id"), F.lit(sum(bits[m] for m in c)).cast("long").alias("bits")) for c in all_comparisons(models)))
    fits = F.filter(views, lambda v: (v["bits"].bitwiseAND(F.col("_there")) == v["bits"]) & (v["bits"].bitwiseAND(F.col("_bit")) != 0))
    valid = fact.where(F.col("model").isin(*models) & clean).withColumn("_bit", bit).withColumn("_there", there)
    return valid.withColumn("_view", F.explode(fits)).select(F.col("_view.id").alias("comparison_id"), *fact.columns)


def instantaneous_points(grid: DataFrame, weights: DataFrame) -> DataFrame:
    """t2m and wind10m at stations: wind speed at the nodes first, then bilinear.

    ``grid``: (model, init_time, lead_hours, short_name, j, i, value) with short names 2t, 10u, 10v.
    """
    from .geo import bilinear

    keys = ["model", "init_time", "lead_hours"]
    of = lambda name, to: grid.where(F.col("short_name") == name).select(*keys, "j", "i", F.col("value").alias(to))
    t2m = of("2t", "value").withColumn("variable", F.lit("t2m"))
    wind = of("10u", "u").join(of("10v", "v"), [*keys, "j", "i"]).select(*keys, "j", "i", C.wind_speed(F.col("u"), F.col("v")).alias("value"), F.lit("wind10m").alias("variable"))
    return bilinear(weights, t2m.unionByName(wind), [*keys, "variable"])


def precip_points(grid: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rain at each station's nearest node, in mm."""
    rain = grid.where("short_name = 'tp'").join(nodes, ["j", "i"])
    return rain.select("station_id", "model", "init_time", "lead_hours", precip_mm(F.col("value"), F.col("units")).alias("value"))
