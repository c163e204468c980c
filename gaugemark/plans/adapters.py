"""The driver's test tables as tables of this domain, in Spark and in DuckDB's SQL.

Both forms round to the same digits, so that results can be compared by value; a small offset keeps
means of few values off the ties of rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly observations of five stations (event types) and three variables."""
    events = _read(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t"), "value")
    mean = events.groupBy(F.col("event_type").alias("station_id"), F.col("t").alias("valid_time")).agg(F.avg("value").alias("v"))
    forms = F.explode(F.array(*(F.struct(F.lit(n).alias("variable"), x.alias("value")) for n, x in (("t2m", F.round(F.lit(270.000137) + F.col("v") / 4, 1)), ("wind10m", F.round(F.col("v") / 5 + 0.000137, 0)), ("precip_1h", F.round(F.greatest(F.col("v") - 59.999863, F.lit(0.0)), 1)))))).alias("x")
    return mean.select("station_id", "valid_time", forms).select("station_id", "x.variable", "valid_time", "x.value")


OBS = """
hourly AS (SELECT event_type AS station_id, date_trunc('hour', ts) AS valid_time, avg(value) AS v FROM events GROUP BY 1, 2),
obs AS (SELECT station_id, 't2m' AS variable, valid_time, round(270.000137::DOUBLE + v / 4, 1) AS value FROM hourly
  UNION ALL SELECT station_id, 'wind10m', valid_time, round(v / 5 + 0.000137::DOUBLE, 0) FROM hourly
  UNION ALL SELECT station_id, 'precip_1h', valid_time, round(greatest(v - 59.999863::DOUBLE, 0.0), 1) FROM hourly)"""


def obs_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs_hourly`` with RANGE flags from the hour of the day, so that clean and flagged rows mix."""
    return obs_hourly(spark, sf_dir).withColumn("qc_flags", F.when(F.hour("valid_time") == 13, F.lit(1)).otherwise(F.lit(0)))


OBS_QC = OBS + ",\nobs_qc AS (SELECT *, CASE WHEN hour(valid_time) = 13 THEN 1 ELSE 0 END AS qc_flags FROM obs)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations from all customers."""
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        k.cast("string").alias("station_id"), F.when(k % 2 == 0, "inmet").otherwise("isd").alias("network"), F.col("c_name").alias("name"),
        (F.lit(-30.0) + (k * 7919 % 400) / 100.0).alias("lat"), (F.lit(-55.0) + (k * 104729 % 500) / 100.0).alias("lon"),
        (F.col("c_acctbal") / 10).alias("elev_station"), (F.col("c_acctbal") / 10 + (k % 7) * 30 - 90).alias("elev_dem"),
        F.element_at(F.array(*map(F.lit, ("Af", "Cfa", "BSh", "Cfb", "Aw"))), (k % 5 + 1).cast("int")).alias("koppen"),
        F.lit(None).cast("string").alias("cross_ref"), F.when(k % 11 == 0, "review").otherwise("included").alias("status"), F.lit(None).cast("string").alias("exclusion_reason"),
    )


STATIONS = """
stations AS (SELECT c_custkey::VARCHAR AS station_id, CASE WHEN c_custkey % 2 = 0 THEN 'inmet' ELSE 'isd' END AS network, c_name AS name,
  -30.0::DOUBLE + (c_custkey * 7919 % 400) / 100.0::DOUBLE AS lat, -55.0::DOUBLE + (c_custkey * 104729 % 500) / 100.0::DOUBLE AS lon,
  c_acctbal / 10 AS elev_station, c_acctbal / 10 + (c_custkey % 7) * 30 - 90 AS elev_dem, ['Af', 'Cfa', 'BSh', 'Cfb', 'Aw'][c_custkey % 5 + 1] AS koppen,
  NULL::VARCHAR AS cross_ref, CASE WHEN c_custkey % 11 = 0 THEN 'review' ELSE 'included' END AS status, NULL::VARCHAR AS exclusion_reason
  FROM customer)"""

#: Great-circle distance in SQL between aliases a and b.
DISTANCE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def obs_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several stations in each of five cells."""
    events = _read(spark, sf_dir, "events")
    station = F.concat_ws(":", (F.col("user_id") % 5).cast("string"), "event_type")
    return events.groupBy(station.alias("station_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("valid_time")).agg(F.round(F.avg("value"), 3).alias("value")).withColumn("variable", F.lit("t2m"))


def multi_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = obs_multi(spark, sf_dir).select("station_id").distinct()
    return ids.select("station_id", (F.lit(-30.0) + F.substring_index("station_id", ":", 1).cast("int")).alias("lat"), F.lit(-51.1).alias("lon"))


OBS_MULTI = """
obs_multi AS (SELECT (user_id % 5)::VARCHAR || ':' || event_type AS station_id, (user_id % 5)::INT AS c, date_trunc('hour', ts) AS valid_time, round(avg(value), 3) AS value FROM events GROUP BY 1, 2, 3)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast and observation pairs of three models from line items."""
    li = _read(spark, sf_dir, "lineitem")
    flags = F.when(F.col("l_discount") > 0.08, 1).otherwise(0) + F.when(F.col("l_tax") > 0.06, 2).otherwise(0)
    return li.select(
        F.col("l_returnflag").alias("model"), F.col("l_suppkey").cast("string").alias("station_id"), F.lit("t2m").alias("variable"), F.to_date("l_shipdate").alias("day"), F.col("l_shipdate").cast("timestamp").alias("valid_time"),
        (F.col("l_linenumber") * 24).cast("int").alias("lead_hours"), (F.col("l_extendedprice") / 1000).alias("fcst"), (F.col("l_quantity") * 2).alias("obs"), flags.cast("int").alias("qc_flags"), (F.col("l_tax") + 0.5).alias("weight"),
        F.when(F.col("l_suppkey") % 3 > 0, F.col("l_discount") * 4000).alias("repr_floor"),
    )


PAIRS = """
pairs AS (SELECT l_returnflag AS model, l_suppkey::VARCHAR AS station_id, 't2m' AS variable, l_shipdate::DATE AS day, l_shipdate AS valid_time, (l_linenumber * 24)::INT AS lead_hours,
  l_extendedprice / 1000 AS fcst, l_quantity * 2 AS obs, ((l_discount > 0.08)::INT + 2 * (l_tax > 0.06)::INT)::INT AS qc_flags, l_tax + 0.5 AS weight,
  CASE WHEN l_suppkey % 3 > 0 THEN l_discount * 4000 END AS repr_floor FROM lineitem)"""


def monthly_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs averaged by month and station, unique by (model, station, month)."""
    month = F.date_trunc("month", F.col("valid_time")).alias("valid_time")
    out = pairs(spark, sf_dir).groupBy("model", "station_id", "variable", month).agg(F.round(F.avg("fcst"), 9).alias("fcst"), F.round(F.avg("obs"), 9).alias("obs"), F.bit_and("qc_flags").alias("qc_flags"))
    return out.withColumn("init_time", F.col("valid_time"))


MONTHLY = PAIRS + """,
monthly AS (SELECT model, station_id, variable, date_trunc('month', valid_time)::TIMESTAMP AS valid_time, round(avg(fcst), 9) AS fcst, round(avg(obs), 9) AS obs, bit_and(qc_flags) AS qc_flags FROM pairs GROUP BY ALL)"""


def order_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of values by order priority, for climatologies."""
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("station_id"), F.lit("t2m").alias("variable"), F.col("o_orderdate").cast("timestamp").alias("valid_time"), (F.col("o_totalprice") / 1000).alias("value"))


ORDER_OBS = "\norder_obs AS (SELECT o_orderpriority AS station_id, 't2m' AS variable, o_orderdate AS valid_time, o_totalprice / 1000 AS value FROM orders)"


def rain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hourly rain by model, station and run, with holes."""
    o = _read(spark, sf_dir, "orders")
    model = F.element_at(F.array(*map(F.lit, ("aifs", "gfs", "hres", "graphcast"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    lead = (F.col("o_orderkey") % 40 * 3 + 3).cast("int")
    return o.groupBy(model.alias("model"), (F.col("o_custkey") % 7).cast("string").alias("station_id"), F.to_date("o_orderdate").alias("init_day"), lead.alias("lead_hours")).agg(F.round(F.min("o_totalprice") / 1000, 2).alias("value")).withColumn("init_time", F.date_trunc("month", F.col("init_day").cast("timestamp"))).groupBy("model", "station_id", "init_time", "lead_hours").agg(F.min("value").alias("value"))


RAIN_POINTS = """
rain AS (SELECT ['aifs', 'gfs', 'hres', 'graphcast'][o_custkey % 4 + 1] AS model, (o_custkey % 7)::VARCHAR AS station_id, date_trunc('month', o_orderdate)::TIMESTAMP AS init_time, (o_orderkey % 40 * 3 + 3)::INT AS lead_hours, min(round(o_totalprice / 1000, 2)) AS value
  FROM orders GROUP BY 1, 2, 3, 4)"""


def forecast_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts for the hourly observations: two models, some without observations, some too far in height."""
    obs = obs_hourly(spark, sf_dir).where("variable <> 'precip_1h'").unionByName(obs_hourly(spark, sf_dir).where("variable = 'precip_1h'").withColumn("variable", F.lit("precip_24h")))
    hour = F.hour("valid_time")
    shifted = F.when(hour % 9 == 0, F.col("valid_time") + F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("valid_time"))
    each = F.explode(F.array(F.lit("gfs"), F.lit("hres"))).alias("model")
    return obs.select("station_id", each, "variable", shifted.alias("valid_time"), F.lit(24).cast("short").alias("lead_hours"), (F.col("value") + 1).alias("value"), F.lit("bilinear").alias("interp_method"), F.lit(-30.0).alias("grid_lat"), F.lit(-51.0).alias("grid_lon"), (hour * 60.0).alias("grid_elev")).withColumn("init_time", F.col("valid_time") - F.expr("INTERVAL 24 HOURS")).withColumn("ingest_version", F.lit("test"))


def event_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "events").select(F.col("event_type").alias("station_id")).distinct()
    return names.select("station_id", (F.length("station_id") * 100.0).alias("elev_station"), F.lit(-30.05).alias("lat"), F.lit(-51.05).alias("lon"))


FORECASTS = OBS_QC + """,
points AS (SELECT station_id, m.model, CASE variable WHEN 'precip_1h' THEN 'precip_24h' ELSE variable END AS variable, CASE WHEN hour(valid_time) % 9 = 0 THEN valid_time + INTERVAL 30 MINUTE ELSE valid_time END AS valid_time,
  value + 1 AS value, hour(valid_time) * 60.0::DOUBLE AS grid_elev FROM obs, (VALUES ('gfs'), ('hres')) m(model)),
places AS (SELECT DISTINCT event_type AS station_id, length(event_type) * 100.0::DOUBLE AS elev_station FROM events),
rain24 AS (SELECT * FROM (SELECT station_id, valid_time, sum(CASE WHEN qc_flags = 0 THEN value END) OVER w AS obs, count(CASE WHEN qc_flags = 0 AND value IS NOT NULL THEN 1 END) OVER w AS n_clean_hours,
  coalesce(bit_or(qc_flags) OVER w, 0) & 63 AS qc_flags FROM obs_qc WHERE variable = 'precip_1h'
  WINDOW w AS (PARTITION BY station_id ORDER BY valid_time RANGE BETWEEN INTERVAL '23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)) WHERE n_clean_hours >= 12),
tagged AS (SELECT p.*, o.obs, o.qc_flags, elev_station - grid_elev AS delta_z, CASE WHEN o.obs IS NULL THEN 'obs_missing_or_incomplete' WHEN abs(elev_station - grid_elev) > 500 THEN 'delta_z_exceeded' END AS drop_reason
  FROM points p LEFT JOIN (SELECT station_id, valid_time, variable, value AS obs, qc_flags FROM obs_qc WHERE variable <> 'precip_1h' UNION ALL SELECT station_id, valid_time, 'precip_24h', obs, qc_flags FROM rain24) o USING (station_id, valid_time, variable) LEFT JOIN places USING (station_id))"""
