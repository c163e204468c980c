"""Streaming forms of the checks and sums that need no look ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.qc import PARAMS, range_check


def stream_range_check(obs: DataFrame, params=PARAMS) -> DataFrame:
    """RANGE flags on a stream; a row needs nothing but itself."""
    return range_check(obs.withColumn("qc_flags", F.lit(0)), params)


def stream_unique(obs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Drop exact repeats that arrive within the watermark."""
    return obs.withWatermark("valid_time", late).dropDuplicatesWithinWatermark(["station_id", "variable", "valid_time", "value"])


def stream_precip_24h(obs_qc: DataFrame, late: str = "2 hours", min_clean_hours: int = 22) -> DataFrame:
    """Rain of (t - 24 h, t] for every hour t, when the watermark has passed it.

    Spark's windows are closed on the left; a shift of one microsecond makes them closed on the right.
    """
    clean = (F.col("qc_flags") == 0) & F.col("value").isNotNull()
    rain = obs_qc.where("variable = 'precip_1h'").withColumn("at", F.col("valid_time") - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("at", late)
    sums = rain.groupBy("station_id", F.window("at", "24 hours", "1 hour").alias("w")).agg(F.sum(F.when(clean, F.col("value"))).alias("obs"), F.count(F.when(clean, 1)).alias("n_clean_hours"), F.bit_or("qc_flags").alias("qc_flags"))
    return sums.where(F.col("n_clean_hours") >= min_clean_hours).select("station_id", F.col("w.end").alias("valid_time"), F.lit("precip_24h").alias("variable"), "obs", "qc_flags", F.col("n_clean_hours").cast("int").alias("n_clean_hours"))
