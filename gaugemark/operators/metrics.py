"""Error statistics, percentile bins, rain scores, climatology: grouped aggregates.

Point statistics are building blocks; what is published goes through ``bootstrap`` and has an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the observed percentile: half-open but the last, which is closed.
BIN_EDGES = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 99, 100)
DRY_MM, LEAST_P1, MOST_P1 = 0.25, 0.1, 0.85


def with_error(df: DataFrame) -> DataFrame:
    return df.withColumn("error", F.col("fcst") - F.col("obs"))


def forecast_column(df: DataFrame, adjusted: Sequence[str] = ("t2m",)) -> DataFrame:
    """``fcst``: adjusted where there is one for those variables, else raw; ``day`` is the valid day."""
    use = F.when(F.col("variable").isin(*adjusted), F.coalesce("fcst_elev_adj", "fcst_raw")).otherwise(F.col("fcst_raw"))
    return df.withColumns({"fcst": use, "day": F.to_date("valid_time")})


def error_stats(df: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """n_pairs, bias, mae and rmse of (fcst, obs); with ``weight``, weighted means."""
    e = F.col("fcst") - F.col("obs")
    mean = (lambda x: F.sum(F.col(weight) * x) / F.sum(weight)) if weight else F.avg
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), mean(e).alias("bias"), mean(F.abs(e)).alias("mae"), F.sqrt(mean(e * e)).alias("rmse"))


def variance_ratio(df: DataFrame, by: Sequence[str], station: str = "station_id") -> DataFrame:
    """Median over stations of std(fcst) / std(obs); constant or single observations are left out, none left is NaN."""
    ratio = F.when(F.min("obs") < F.max("obs"), F.stddev_samp("fcst") / F.stddev_samp("obs"))
    each = df.groupBy(*by, station).agg(ratio.alias("r"))
    return each.groupBy(*by).agg(F.coalesce(F.median("r"), F.lit(float("nan"))).alias("variance_ratio"), F.count("r").alias("n_stations"))


def percentile_bin(pct: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in zip(BIN_EDGES, BIN_EDGES[1:], strict=False):
        inside = (pct >= low) & ((pct <= high) if high == 100 else (pct < high))
        out = F.when(inside, F.lit(f"{low}-{high}")).otherwise(out)
    return out


def bias_by_bin(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bias in each percentile bin; bins without rows stay, with n 0 and null."""
    if "obs_pct" not in df.columns:
        raise ValueError("bias_by_bin needs column obs_pct")
    names = [f"{a}-{b}" for a, b in zip(BIN_EDGES, BIN_EDGES[1:], strict=False)]
    got = df.withColumn("bin", percentile_bin(F.col("obs_pct"))).where("bin is not null").groupBy(*by, "bin").agg(F.avg(F.col("fcst") - F.col("obs")).alias("bias"), F.count(F.lit(1)).alias("n_pairs"))
    bins = F.explode(F.array(*map(F.lit, names))).alias("bin")
    every = df.select(*by).distinct().select(*by, bins) if by else df.sparkSession.range(1).select(bins)
    return every.join(got, [*by, "bin"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def decomposition(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mse_total, repr_floor_mean and their non-negative difference, over rows with a floor."""
    for c in ("fcst", "obs", "repr_floor"):
        if c not in df.columns:
            raise ValueError(f"decomposition needs column {c}")
    e = F.col("fcst") - F.col("obs")
    out = df.where("repr_floor is not null").groupBy(*by).agg(F.avg(e * e).alias("mse_total"), F.avg("repr_floor").alias("repr_floor_mean"), F.count(F.lit(1)).alias("n_pairs"))
    return out.where("n_pairs > 0").withColumn("mse_model_est", F.greatest(F.col("mse_total") - F.col("repr_floor_mean"), F.lit(0.0)))


def daily_error(df: DataFrame, by: Sequence[str] = (), day: str = "day") -> DataFrame:
    return df.groupBy(*by, day).agg(F.avg(F.col("fcst") - F.col("obs")).alias("error"), F.count(F.lit(1)).alias("n_pairs"))


def wet_stats(obs: DataFrame, variable: str = "precip_1h", dry_mm: float = DRY_MM, min_hours: int = 24, min_days: int = 30) -> DataFrame:
    """Dry share and 2/3 quantile of wet days' totals for every station; null below ``min_days`` full days."""
    days = obs.where((F.col("variable") == variable) & F.col("value").isNotNull()).groupBy("station_id", F.to_date("valid_time").alias("day")).agg(F.count(F.lit(1)).alias("hours"), F.sum("value").alias("total")).where(F.col("hours") >= min_hours)
    wet = F.when(F.col("total") >= dry_mm, F.col("total"))
    out = days.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_days"), F.avg((F.col("total") < dry_mm).cast("double")).alias("p1"), F.percentile(wet, F.lit(2.0 / 3)).alias("wet"), F.count(wet).alias("n_wet_days"))
    enough = F.col("n_days") >= min_days
    return out.select("station_id", F.when(enough, F.col("p1")).alias("p1_dry_fraction"), F.when(enough, F.col("wet")).alias("wet_threshold"), "n_days", "n_wet_days")


def seeps_in_mask(least: float = LEAST_P1, most: float = MOST_P1) -> Column:
    p1 = F.col("p1")
    return F.col("fcst").isNotNull() & F.col("obs").isNotNull() & F.col("wet_threshold").isNotNull() & p1.isNotNull() & p1.between(least, most)


def seeps_penalty(dry_mm: float = DRY_MM) -> Column:
    """Penalty of forecast category against observed one. A value at both limits is dry and heavy; the order decides."""
    p1, wet = F.col("p1"), F.col("wet_threshold")
    kinds = lambda x: {"dry": x <= dry_mm, "light": (x > dry_mm) & (x < wet), "heavy": x >= wet}
    f, o = kinds(F.col("fcst")), kinds(F.col("obs"))
    cases = [("dry", "light", 1 / (1 - p1)), ("dry", "heavy", 4 / (1 - p1)), ("light", "dry", 1 / p1), ("light", "heavy", 3 / (1 - p1)), ("heavy", "dry", 1 / p1 + 3 / (2 + p1)), ("heavy", "light", 3 / (2 + p1))]
    out = F.when(F.lit(False), F.lit(0.0))
    for a, b, penalty in cases:
        out = out.when(f[a] & o[b], penalty)
    return out.otherwise(F.lit(0.0)) * 0.5


def seeps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean penalty of the rows in the mask, NaN where none is; the rows left out are counted."""
    for c in ("fcst", "obs", "p1", "wet_threshold"):
        if c not in df.columns:
            raise ValueError(f"seeps needs column {c}")
    inside = seeps_in_mask()
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(inside, seeps_penalty())), F.lit(float("nan"))).alias("seeps"), F.count_if(inside).alias("n_pairs"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_masked"))


def window_weights(days: int) -> list[float]:
    """Triangle from 0 to 0 over an odd number of days, with mean 1."""
    if days % 2 == 0 or not 3 <= days <= 365:
        raise ValueError("the window must be odd and within 3 to 365 days")
    half = days // 2
    raw = [1 - abs(i) / half for i in range(-half, half + 1)]
    return [w * days / sum(raw) for w in raw]


def climatology(obs: DataFrame, window_days: int = 61, stats: Sequence[str] = ("mean", "std"), min_samples: int = 30) -> DataFrame:
    """Weighted mean and spread of every (station, variable, day of year, hour) over a circular window of days.

    Values are summed by bin of the year first, so that the window multiplies bins (366 a station,
    variable and hour at most), not observations. Sums of squares are centred on the station's mean.
    """
    if not stats or not set(stats) <= {"mean", "std"}:
        raise ValueError("stats must name mean, std or both")
    weights, half = window_weights(window_days), window_days // 2
    offsets = F.explode(F.array(*(F.struct(F.lit(i - half).alias("off"), F.lit(w).alias("w")) for i, w in enumerate(weights) if w > 0))).alias("o")
    time = F.col("valid_time")
    base = obs.where("value is not null").select("station_id", "variable", "value", F.dayofyear(time).alias("doy"), F.hour(time).alias("hour"), F.year(time).alias("y"))
    leap = (F.col("y") % 4 == 0) & ((F.col("y") % 100 != 0) | (F.col("y") % 400 == 0))
    # The last day of a common year also stands for day 366.
    base = base.withColumn("doy", F.explode(F.when((F.col("doy") == 365) & ~leap, F.array(F.lit(365), F.lit(366))).otherwise(F.array("doy"))))
    centre = obs.where("value is not null").groupBy("station_id", "variable").agg(F.avg("value").alias("centre"))
    x = F.col("value") - F.col("centre")
    bins = base.join(centre, ["station_id", "variable"]).groupBy("station_id", "variable", "centre", "doy", "hour").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    spread = bins.select("station_id", "variable", "centre", "doy", "hour", "n", "s", "q", offsets).withColumn("dayofyear", F.pmod(F.col("doy") - 1 + F.col("o.off"), F.lit(366)) + 1)
    w = F.col("o.w")
    out = spread.groupBy("station_id", "variable", "centre", "dayofyear", "hour").agg(F.sum("n").alias("n_samples"), F.sum(w * F.col("n")).alias("sw"), F.sum(w * F.col("s")).alias("sx"), F.sum(w * F.col("q")).alias("sq"))
    enough, mean = F.col("n_samples") >= min_samples, F.col("sx") / F.col("sw")
    made = {"mean": F.when(enough, mean + F.col("centre")).alias("clim_mean"), "std": F.when(enough, F.sqrt(F.greatest(F.col("sq") / F.col("sw") - mean * mean, F.lit(0.0)))).alias("clim_std")}
    return out.select("station_id", "variable", "dayofyear", "hour", *(made[s] for s in ("mean", "std") if s in stats), "n_samples")


def daily_summary(points: DataFrame, shift_hours: int = 3) -> DataFrame:
    """By model and local day (UTC less ``shift_hours``): temperature extremes, strongest wind, rain at 00 UTC of the day."""
    local = F.to_date(F.col("valid_time") - F.make_interval(hours=F.lit(shift_hours)))
    of = lambda name: F.when(F.col("variable") == name, F.col("value"))
    temps = points.groupBy("model", local.alias("day")).agg(F.round(F.min(of("t2m")) - 273.15, 1).alias("tmin_c"), F.round(F.max(of("t2m")) - 273.15, 1).alias("tmax_c"), F.round(F.max(of("wind10m")), 1).alias("wind_max"))
    rain = points.where((F.col("variable") == "precip_24h") & (F.hour("valid_time") == 0)).select("model", F.to_date("valid_time").alias("day"), F.round("value", 1).alias("precip_24h"))
    return temps.join(rain, ["model", "day"], "left")


def regime_table(df: DataFrame, strata: Sequence[str], by: Sequence[str] = ("variable", "model"), min_pairs: int = 50) -> DataFrame:
    """Errors for every value of every stratum column in one pass of GROUPING SETS; small strata are left out."""
    sets = [[F.col(c) for c in (*by, s)] for s in strata]
    e = F.col("fcst") - F.col("obs")
    out = df.groupingSets(sets, *by, *strata).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n_pairs"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"))
    kind = F.lit(None).cast("string")
    for i, s in enumerate(strata):
        kind = F.when(F.col("gid") == sum(1 << (len(strata) - 1 - j) for j in range(len(strata)) if j != i), F.lit(s)).otherwise(kind)
    value = F.coalesce(*(F.when(F.col("stratum_type") == s, F.col(s).cast("string")) for s in strata))
    return out.withColumn("stratum_type", kind).withColumn("stratum_value", value).where((F.col("n_pairs") >= min_pairs) & F.col("stratum_value").isNotNull()).select(*by, "stratum_type", "stratum_value", "n_pairs", "bias", "mae")
