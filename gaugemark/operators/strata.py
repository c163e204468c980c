"""Strata: dimension joins that keep every row; an unknown stratum is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import ranked, value_counts


def season(time: Column) -> Column:
    month = F.month(time)
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isin(9, 10, 11), "SON")


def with_season(df: DataFrame, time: str = "valid_time") -> DataFrame:
    return df.withColumn("season", season(F.col(time)))


def with_koppen(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Class, and its first letter as level 1."""
    return df.join(stations.select("station_id", "koppen"), "station_id", "left").withColumn("koppen_l1", F.substring("koppen", 1, 1))


def with_enso(df: DataFrame, oni: DataFrame, time: str = "valid_time") -> DataFrame:
    """``oni``: (year, month, oni)."""
    index = oni.select(F.col("year").alias("_y"), F.col("month").alias("_m"), "oni")
    out = df.join(index, (F.year(time) == F.col("_y")) & (F.month(time) == F.col("_m")), "left").drop("_y", "_m")
    return out.withColumn("enso", F.when(F.col("oni") >= 0.5, "el_nino").when(F.col("oni") <= -0.5, "la_nina").when(F.col("oni").isNotNull(), "neutral"))


def with_mjo(df: DataFrame, rmm: DataFrame, time: str = "valid_time") -> DataFrame:
    """``rmm``: (date, phase, amplitude)."""
    index = rmm.select(F.col("date").alias("_d"), "phase", "amplitude")
    out = df.join(index, F.to_date(time) == F.col("_d"), "left")
    return out.withColumn("mjo", F.when(F.col("amplitude") >= 1, F.col("phase").cast("string")).when(F.col("amplitude").isNotNull(), "inactive")).drop("_d", "phase", "amplitude")


def with_obs_percentile(df: DataFrame, by: tuple[str, ...] = ("station_id", "variable"), obs: str = "obs", ranges: int | None = None) -> DataFrame:
    """Average rank over group size times 100; nulls get null but count in the size.

    One window a group by default: a station's hours are bounded by the calendar. With ``ranges``, groups of any size are
    ranked in so many ranges, with the same result.
    """
    if ranges is None:
        order = W.partitionBy(*by).orderBy(F.col(obs).asc_nulls_last())  # one order for all, so that rows are sorted once
        upto, size = F.count(F.lit(1)).over(order), F.count(F.lit(1)).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return df.withColumn("obs_pct", F.when(F.col(obs).isNotNull(), (F.rank().over(order) + upto) / 2 / size * 100))
    keys = [f"_k{i}" for i in range(len(by))]
    keyed = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(obs).alias("_obs"))
    places = ranked(value_counts(keyed, keys, "_obs"), keys, "_obs", ranges).drop("total")
    sizes = keyed.groupBy(*(F.col(k).alias(f"{k}_") for k in keys)).agg(F.count(F.lit(1)).alias("_size"))
    places = places.join(sizes, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    percent = ((F.col("below") + 1 + (F.col("n") - 1) / 2) / F.col("_size") * 100).alias("obs_pct")
    places = places.select(*keys, "_obs", percent)
    return df.join(places, [*(F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)), F.col(obs) == F.col("_obs")], "left").select(*df.columns, "obs_pct")


def with_climatology(df: DataFrame, climatology: DataFrame, time: str = "valid_time") -> DataFrame:
    """Climatology by station, variable, day of year and hour."""
    values = [c for c in climatology.columns if c.startswith("clim_")]
    if not values:
        raise ValueError("the climatology has no clim_ columns")
    clim = climatology.select("station_id", "variable", F.col("dayofyear").alias("_doy"), F.col("hour").alias("_hour"), *values)
    keyed = df.withColumns({"_doy": F.dayofyear(time), "_hour": F.hour(time)})
    return keyed.join(clim, ["station_id", "variable", "_doy", "_hour"], "left").select(*df.columns, *values)
