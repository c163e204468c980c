"""The domain's registered queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..operators import bootstrap, geo, matching, metrics, qc, strata, tests
from ..operators.ranges import RANGES
from ..sources import gridindex, indices, observations, sinks, stations as station_sources
from . import adapters as A
from . import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Limits that the test tables' values reach.
QC = qc.PARAMS | {"range": {"t2m": (272.0, 300.0), "wind10m": (0.0, 25.0), "precip_1h": (0.0, 80.0)}, "step": {"t2m": 12.0, "wind10m": 15.0}, "persistence": {"min_repeats_hours": 4, "wind_calm_exempt_below": 3.5, "precip_zero_exempt": True}}

N_BOOT = registry.DEFAULTS["n_boot"]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ts(c: str = "valid_time"):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


_SQL_TS = "strftime(valid_time, '%Y-%m-%d %H:%M') AS valid_time"
_FLAG_COLUMNS = ["station_id", "variable", "value", "qc_flags"]
_FLAG_SQL = f"SELECT station_id, variable, {_SQL_TS}, value, CASE WHEN coalesce(bad, false) THEN {{}} ELSE 0 END::INT AS qc_flags FROM "


def _obs0(spark, sf_dir):
    return A.obs_hourly(spark, sf_dir).withColumn("qc_flags", F.lit(0))


@_query(f"WITH {A.OBS} " + _FLAG_SQL.format(1) + "(SELECT *, CASE variable WHEN 't2m' THEN value < 272 OR value > 300 WHEN 'wind10m' THEN value < 0 OR value > 25 ELSE value < 0 OR value > 80 END AS bad FROM obs)")
def qc_range(spark, sf_dir):
    return qc.range_check(_obs0(spark, sf_dir), QC).select(*_FLAG_COLUMNS, _ts())


_LAG = "lag(value) OVER w AS pv, lag(valid_time) OVER w AS pt"
_W = "WINDOW w AS (PARTITION BY station_id, variable ORDER BY valid_time)"


@_query(f"WITH {A.OBS} " + _FLAG_SQL.format(2) + f"(SELECT *, pt + INTERVAL 1 HOUR = valid_time AND abs(value - pv) > CASE variable WHEN 't2m' THEN 12 WHEN 'wind10m' THEN 15 END AS bad FROM (SELECT *, {_LAG} FROM obs {_W}))")
def qc_step(spark, sf_dir):
    return qc.step_check(_obs0(spark, sf_dir), QC).select(*_FLAG_COLUMNS, _ts())


@_query(f"""WITH {A.OBS}, s AS (SELECT *, CASE WHEN coalesce(pv = value AND pt + INTERVAL 1 HOUR = valid_time, false) THEN 0 ELSE 1 END AS st FROM (SELECT *, {_LAG} FROM obs {_W})),
r AS (SELECT *, sum(st) OVER w AS run FROM s {_W}), n AS (SELECT *, count(*) OVER (PARTITION BY station_id, variable, run) AS len FROM r)
""" + _FLAG_SQL.format(4) + "(SELECT *, len >= 4 AND value IS NOT NULL AND NOT (variable = 'wind10m' AND value < 3.5) AND NOT (variable = 'precip_1h' AND value = 0) AS bad FROM n)")
def qc_persistence(spark, sf_dir):
    return qc.persistence_check(_obs0(spark, sf_dir), QC).select(*_FLAG_COLUMNS, _ts())


_SPATIAL = QC | {"spatial": qc.PARAMS["spatial"] | {"max_mad_z": 3.0}}


@_query(f"""WITH {A.OBS}, ids AS (SELECT DISTINCT station_id FROM obs),
nb AS (SELECT o.station_id, variable, valid_time, n.value FROM (SELECT a.station_id, b.station_id AS nid FROM ids a JOIN ids b ON a.station_id <> b.station_id) o JOIN obs n ON n.station_id = o.nid),
m AS (SELECT station_id, variable, valid_time, median(value) AS med, count(value) AS n FROM nb GROUP BY 1, 2, 3),
d AS (SELECT nb.station_id, nb.variable, nb.valid_time, any_value(med) AS med, any_value(n) AS n, median(abs(value - med)) AS mad FROM nb JOIN m USING (station_id, variable, valid_time) GROUP BY 1, 2, 3)
""" + _FLAG_SQL.format(8) + "(SELECT obs.*, n >= 3 AND variable <> 'precip_1h' AND abs(value - med) / (greatest(1.4826 * mad, 1.5) + 1e-9) > 3 AS bad FROM obs LEFT JOIN d USING (station_id, variable, valid_time))")
def qc_spatial(spark, sf_dir):
    ids = A.event_stations(spark, sf_dir).select("station_id")
    others = F.broadcast(ids.withColumnRenamed("station_id", "neighbor_id"))  # the five event types
    return qc.spatial_check(_obs0(spark, sf_dir), ids.join(others, F.col("station_id") != F.col("neighbor_id")), _SPATIAL).select(*_FLAG_COLUMNS, _ts())


_STATION_OBS = "so AS (SELECT (l_partkey % 160)::VARCHAR AS station_id, 't2m' AS variable, date_trunc('day', l_shipdate)::TIMESTAMP AS valid_time, round(min(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2, 3)"


def _station_obs(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = li.groupBy((F.col("l_partkey") % 160).cast("string").alias("station_id"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("valid_time")).agg(F.round(F.min("l_quantity"), 2).alias("value"))
    return out.withColumn("variable", F.lit("t2m")).withColumn("qc_flags", F.lit(0))


@_query(f"WITH {A.STATIONS}, {_STATION_OBS} " + _FLAG_SQL.format(16) + "(SELECT so.*, stations.station_id IS NOT NULL AND (lat IS NULL OR lon IS NULL OR elev_station IS NULL OR abs(elev_station - elev_dem) > 80) AS bad FROM so LEFT JOIN stations USING (station_id))")
def qc_metadata(spark, sf_dir):
    return qc.metadata_check(_station_obs(spark, sf_dir), A.stations(spark, sf_dir), QC | {"metadata": {"max_elev_diff_m": 80.0}}).select(*_FLAG_COLUMNS, _ts())


@_query(f"WITH {A.STATIONS}, {_STATION_OBS} " + _FLAG_SQL.format(32) + "(SELECT so.*, CASE WHEN so.station_id::INT % 2 = 1 AND so.station_id IN (SELECT station_id FROM stations) THEN abs(so.value - o.value) <= 0.05 END AS bad FROM so LEFT JOIN so o ON o.station_id = (so.station_id::INT - 1)::VARCHAR AND o.valid_time = so.valid_time)")
def qc_duplicate(spark, sf_dir):
    crossed = A.stations(spark, sf_dir).withColumn("cross_ref", F.when(F.col("network") == "isd", (F.col("station_id").cast("int") - 1).cast("string")))
    return qc.duplicate_check(_station_obs(spark, sf_dir), crossed, QC).select(*_FLAG_COLUMNS, _ts())


@_query(f"""WITH {A.OBS_QC} SELECT variable, count(*) AS n, count_if(qc_flags & 1 <> 0)::BIGINT AS range, count_if(qc_flags & 2 <> 0)::BIGINT AS step, count_if(qc_flags & 4 <> 0)::BIGINT AS persistence, count_if(qc_flags & 8 <> 0)::BIGINT AS spatial,
count_if(qc_flags & 16 <> 0)::BIGINT AS metadata, count_if(qc_flags & 32 <> 0)::BIGINT AS duplicate, count_if(qc_flags = 0)::BIGINT AS clean FROM obs_qc GROUP BY 1""")
def qc_flag_counts(spark, sf_dir):
    return C.bit_counts(A.obs_qc(spark, sf_dir))


_PLACES = """places AS (SELECT DISTINCT event_type AS station_id, length(event_type) % 2 = 0 AS isd, length(event_type) > 6 AS far FROM events)"""


@_query(f"""WITH {A.OBS}, {_PLACES}, a AS (SELECT *, {_LAG} FROM obs {_W}), b AS (SELECT *, sum(CASE WHEN coalesce(pv = value AND pt + INTERVAL 1 HOUR = valid_time, false) THEN 0 ELSE 1 END) OVER w AS run FROM a {_W}),
c AS (SELECT *, count(*) OVER (PARTITION BY station_id, variable, run) AS len FROM b),
nb AS (SELECT o.station_id, variable, valid_time, n.value FROM (SELECT x.station_id, y.station_id AS nid FROM places x JOIN places y ON x.station_id <> y.station_id) o JOIN obs n ON n.station_id = o.nid),
m AS (SELECT station_id, variable, valid_time, median(value) AS med, count(value) AS n FROM nb GROUP BY 1, 2, 3),
d AS (SELECT nb.station_id, nb.variable, nb.valid_time, any_value(med) AS med, any_value(n) AS n, median(abs(value - med)) AS mad FROM nb JOIN m USING (station_id, variable, valid_time) GROUP BY 1, 2, 3),
f AS (SELECT c.variable, coalesce(CASE c.variable WHEN 't2m' THEN c.value < 272 OR c.value > 300 WHEN 'wind10m' THEN c.value < 0 OR c.value > 25 ELSE c.value < 0 OR c.value > 80 END, false) AS x1,
  coalesce(pt + INTERVAL 1 HOUR = c.valid_time AND abs(c.value - pv) > CASE c.variable WHEN 't2m' THEN 12 WHEN 'wind10m' THEN 15 END, false) AS x2,
  len >= 4 AND c.value IS NOT NULL AND NOT (c.variable = 'wind10m' AND c.value < 3.5) AND NOT (c.variable = 'precip_1h' AND c.value = 0) AS x4,
  coalesce(d.n >= 3 AND c.variable <> 'precip_1h' AND abs(c.value - med) / (greatest(1.4826 * mad, 1.5) + 1e-9) > 3, false) AS x8, far AS x16, coalesce(isd AND abs(c.value - r.value) <= 0.05, false) AS x32
  FROM c LEFT JOIN d USING (station_id, variable, valid_time) JOIN places USING (station_id) LEFT JOIN obs r ON r.station_id = 'click' AND r.variable = c.variable AND r.valid_time = c.valid_time)
SELECT variable, count(*) AS n, count_if(x1)::BIGINT AS range, count_if(x2)::BIGINT AS step, count_if(x4)::BIGINT AS persistence, count_if(x8)::BIGINT AS spatial, count_if(x16)::BIGINT AS metadata, count_if(x32)::BIGINT AS duplicate,
count_if(NOT (x1 OR x2 OR x4 OR x8 OR x16 OR x32))::BIGINT AS clean FROM f GROUP BY 1""")
def qc_run(spark, sf_dir):
    """All checks together: flags of every variable."""
    names = A.event_stations(spark, sf_dir).select("station_id")
    size = F.length("station_id")
    st = names.select("station_id", F.lit(-30.0).alias("lat"), F.lit(-51.0).alias("lon"), F.lit(100.0).alias("elev_station"), F.when(size > 6, 300.0).otherwise(100.0).alias("elev_dem"), F.when(size % 2 == 0, "isd").otherwise("inmet").alias("network"), F.when(size % 2 == 0, "click").alias("cross_ref"))
    others = F.broadcast(names.withColumnRenamed("station_id", "neighbor_id"))  # the five event types
    pairs = names.join(others, F.col("station_id") != F.col("neighbor_id"))
    return C.bit_counts(qc.run_qc(A.obs_hourly(spark, sf_dir), st, pairs, _SPATIAL))


@_query("""WITH o AS (SELECT l_orderkey % 1000 AS k, l_linenumber AS line, l_quantity AS value FROM lineitem), d AS (SELECT DISTINCT * FROM o)
SELECT k::VARCHAR AS station_id, line::VARCHAR AS variable, count(*) AS n_values FROM d GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_conflicts(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    obs = li.select((F.col("l_orderkey") % 1000).cast("string").alias("station_id"), F.lit("2024-01-01").cast("timestamp").alias("valid_time"), F.col("l_linenumber").cast("string").alias("variable"), F.col("l_quantity").alias("value"))
    return qc.conflicts(obs).select("station_id", "variable", "n_values")


@_query(f"""WITH {A.OBS_QC}, c AS (SELECT station_id, count(*) AS n FROM obs_qc WHERE variable = 't2m' AND qc_flags = 0 GROUP BY 1), s AS (SELECT DISTINCT event_type AS station_id FROM events)
SELECT station_id, coalesce(n, 0) AS n_clean_t2m, round(coalesce(n, 0) / 720.0, 6)::DOUBLE AS completeness_t2m, CASE WHEN coalesce(n, 0) / 720.0 < 0.88 THEN 'excluded' ELSE 'included' END AS status, CASE WHEN coalesce(n, 0) / 720.0 < 0.88 THEN 't2m_clean_completeness_lt_0.88' END AS exclusion_reason FROM s LEFT JOIN c USING (station_id)""")
def completeness_cut(spark, sf_dir):
    st = A.event_stations(spark, sf_dir).withColumns({"status": F.lit("included"), "exclusion_reason": F.lit(None).cast("string")})
    obs = A.obs_qc(spark, sf_dir)
    share = qc.completeness(st, obs, 720)
    return qc.completeness_cut(st, obs, 720, 0.88).join(share, "station_id").select("station_id", "n_clean_t2m", F.round("completeness_t2m", 6).alias("completeness_t2m"), "status", "exclusion_reason")


@_query(f"""WITH {A.STATIONS}, p AS (SELECT a.station_id, b.station_id AS neighbor_id, {A.DISTANCE} AS d FROM stations a JOIN stations b ON a.station_id <> b.station_id AND a.status = 'included' AND b.status = 'included'),
r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d, neighbor_id) AS k FROM p) SELECT station_id, neighbor_id, round(d, 4) AS dist_km FROM r WHERE k <= 5 AND d <= 80""")
def knn_neighbors(spark, sf_dir):
    return geo.knn_pairs(A.stations(spark, sf_dir), 5, 80.0).select("station_id", "neighbor_id", F.round("dist_km", 4).alias("dist_km"))


@_query(f"""WITH {A.STATIONS}, p AS (SELECT a.station_id AS i, b.station_id AS p, {A.DISTANCE} AS d FROM stations a JOIN stations b ON a.network = 'isd' AND b.network = 'inmet' AND a.status = 'included' AND b.status = 'included'),
c AS (SELECT * FROM p WHERE d <= 40), i AS (SELECT i, arg_min(p, (d, p)) AS dup FROM c GROUP BY 1), n AS (SELECT p, arg_min(i, (d, i)) AS ref FROM c GROUP BY 1)
SELECT station_id, CASE WHEN dup IS NOT NULL THEN 'excluded' ELSE status END AS status, CASE WHEN dup IS NOT NULL THEN 'duplicate_of:' || dup END AS exclusion_reason, coalesce(dup, ref) AS cross_ref FROM stations LEFT JOIN i ON i.i = station_id LEFT JOIN n ON n.p = station_id""")
def geo_dedupe(spark, sf_dir):
    return geo.dedupe_networks(A.stations(spark, sf_dir), 40.0).select("station_id", "status", "exclusion_reason", "cross_ref")


@_query(f"WITH {A.STATIONS}, c AS (SELECT floor(lat / 0.25)::INT AS cell_lat, floor(lon / 0.25)::INT AS cell_lon, count(*) AS n FROM stations WHERE status = 'included' GROUP BY 1, 2) SELECT *, (SELECT count(*) FROM c WHERE n >= 2) AS n_shared FROM c")
def grid_cells(spark, sf_dir):
    st = A.stations(spark, sf_dir).where("status = 'included'")
    shared = geo.shared_cells(st).withColumnRenamed("n_cells", "n_shared")
    return geo.with_cells(st).groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(shared))  # one row


@_query(f"WITH {A.STATIONS}, w AS (SELECT a.station_id, 1 / sum(exp(-pow(degrees({A.DISTANCE} / 6371.0088) / 0.75, 2))) AS w FROM stations a, stations b GROUP BY 1) SELECT station_id, round(w / avg(w) OVER (), 6) AS weight FROM w")
def density_weights(spark, sf_dir):
    return geo.density_weights(A.stations(spark, sf_dir)).select("station_id", F.round("weight", 6).alias("weight"))


@_query(f"""WITH {A.STATIONS} SELECT station_id, CASE WHEN status = 'included' AND NOT (lat BETWEEN -29 AND -27 AND lon BETWEEN -54 AND -51) THEN 'excluded' WHEN status = 'included' AND abs(elev_station - elev_dem) > 80 THEN 'review' ELSE status END AS status,
CASE WHEN status = 'included' AND NOT (lat BETWEEN -29 AND -27 AND lon BETWEEN -54 AND -51) THEN 'outside_bbox' WHEN status = 'included' AND abs(elev_station - elev_dem) > 80 THEN 'elev_diff_gt_80m' END AS exclusion_reason FROM stations""")
def station_curation(spark, sf_dir):
    return geo.review_elevation(geo.clip_bbox(A.stations(spark, sf_dir), (-29.0, -27.0), (-54.0, -51.0)), 80.0).select("station_id", "status", "exclusion_reason")


@_query(f"WITH {A.FORECASTS} SELECT station_id, {_SQL_TS}, round(obs, 4) AS obs, qc_flags, n_clean_hours::INT AS n_clean_hours FROM rain24")
def precip24_obs(spark, sf_dir):
    return matching.precip_24h_obs(A.obs_qc(spark, sf_dir), 12).select("station_id", _ts(), F.round("obs", 4).alias("obs"), "qc_flags", "n_clean_hours")


@_query(f"""WITH {A.RAIN_POINTS} SELECT r.model, r.station_id, strftime(r.init_time, '%Y-%m-%d %H:%M') AS init_time, r.lead_hours, round(CASE WHEN r.lead_hours < 24 THEN NULL WHEN r.model IN ('aifs', 'hres') THEN CASE WHEN r.lead_hours = 24 THEN r.value ELSE r.value - d.value END ELSE r.value + a.value + b.value + c.value END, 4) AS precip_24h FROM rain r
LEFT JOIN rain d ON (d.model, d.station_id, d.init_time, d.lead_hours) = (r.model, r.station_id, r.init_time, r.lead_hours - 24) LEFT JOIN rain a ON (a.model, a.station_id, a.init_time, a.lead_hours) = (r.model, r.station_id, r.init_time, r.lead_hours - 6)
LEFT JOIN rain b ON (b.model, b.station_id, b.init_time, b.lead_hours) = (r.model, r.station_id, r.init_time, r.lead_hours - 12) LEFT JOIN rain c ON (c.model, c.station_id, c.init_time, c.lead_hours) = (r.model, r.station_id, r.init_time, r.lead_hours - 18)""")
def precip24_fcst(spark, sf_dir):
    return matching.precip_24h_forecast(A.rain_points(spark, sf_dir)).select("model", "station_id", _ts("init_time"), "lead_hours", F.round("precip_24h", 4).alias("precip_24h"))


_ADJUSTED = "CASE variable WHEN 't2m' THEN value - 0.0065 * delta_z WHEN 'wind10m' THEN CASE WHEN delta_z IS NOT NULL THEN value * (1 + 0.002 * least(greatest(delta_z - 100, 0), 1000)) END END"


@_query(f"WITH {A.FORECASTS} SELECT station_id, model, variable, {_SQL_TS}, delta_z, round({_ADJUSTED}, 6) AS fcst_elev_adj FROM tagged")
def elev_adjust(spark, sf_dir):
    p = A.forecast_points(spark, sf_dir).join(A.event_stations(spark, sf_dir).select("station_id", "elev_station"), "station_id", "left").withColumn("delta_z", F.col("elev_station") - F.col("grid_elev"))
    return p.select("station_id", "model", "variable", _ts(), "delta_z", F.round(matching.elevation_adjusted(F.col("variable"), F.col("value"), F.col("delta_z")), 6).alias("fcst_elev_adj"))


@_query(f"""WITH {A.OBS_MULTI}, i AS (SELECT floor((-30.0 + c) / 0.25)::INT AS cell_lat, floor(-51.1 / 0.25)::INT AS cell_lon, valid_time, var_samp(value) AS v, count(DISTINCT station_id) AS n FROM obs_multi GROUP BY 1, 2, 3 HAVING count(DISTINCT station_id) >= 2)
SELECT cell_lat, cell_lon, 't2m' AS variable, round(median(v), 8) AS floor_var, max(n) AS n_stations, count(*) AS n_times FROM i GROUP BY 1, 2""")
def repr_floor(spark, sf_dir):
    return matching.repr_floor(A.obs_multi(spark, sf_dir), A.multi_stations(spark, sf_dir)).withColumn("floor_var", F.round("floor_var", 8))


@_query(f"""WITH {A.FORECASTS} SELECT station_id, model, variable, {_SQL_TS}, value AS fcst_raw, round({_ADJUSTED}, 6) AS fcst_elev_adj, round(obs, 4) AS obs, delta_z, qc_flags FROM tagged WHERE drop_reason IS NULL""")
def fact_build(spark, sf_dir):
    fact = matching.build_fact(A.forecast_points(spark, sf_dir), A.obs_qc(spark, sf_dir), A.event_stations(spark, sf_dir), "test", min_clean_hours=12)
    return fact.select("station_id", "model", "variable", _ts(), "fcst_raw", F.round("fcst_elev_adj", 6).alias("fcst_elev_adj"), F.round("obs", 4).alias("obs"), "delta_z", "qc_flags")


@_query(f"WITH {A.FORECASTS} SELECT count(*) AS n_in, count_if(drop_reason IS NULL)::BIGINT AS n_out, count_if(drop_reason = 'obs_missing_or_incomplete')::BIGINT AS obs_missing_or_incomplete, count_if(drop_reason = 'delta_z_exceeded')::BIGINT AS delta_z_exceeded FROM tagged")
def fact_drop_counts(spark, sf_dir):
    return matching.drop_counts(matching.tagged_pairs(A.forecast_points(spark, sf_dir), A.obs_qc(spark, sf_dir), A.event_stations(spark, sf_dir), min_clean_hours=12))


_MATCHED = """k AS (SELECT valid_time, station_id, variable FROM monthly WHERE qc_flags & 1 = 0 GROUP BY ALL HAVING count(DISTINCT model) = 3), matched AS (SELECT m.* FROM monthly m JOIN k USING (valid_time, station_id, variable) WHERE qc_flags & 1 = 0)"""


@_query(f"WITH {A.MONTHLY}, {_MATCHED} SELECT 'A+N+R' AS comparison_id, model, station_id, {_SQL_TS}, fcst, obs FROM matched")
def matched_view(spark, sf_dir):
    return matching.matched_view(A.monthly_pairs(spark, sf_dir), ["R", "A", "N"], 1).select("comparison_id", "model", "station_id", _ts(), "fcst", "obs")


@_query(f"""WITH {A.MONTHLY}, v AS (SELECT *, list(model) OVER (PARTITION BY valid_time, station_id, variable) AS there FROM monthly WHERE qc_flags & 1 = 0), c(comparison_id) AS (VALUES ('A+N'), ('A+R'), ('N+R'), ('A+N+R'))
SELECT comparison_id, model, station_id, {_SQL_TS}, fcst, obs FROM v JOIN c ON list_has_all(there, string_split(comparison_id, '+')) AND list_contains(string_split(comparison_id, '+'), model)""")
def matched_views(spark, sf_dir):
    return matching.matched_views(A.monthly_pairs(spark, sf_dir), ["R", "A", "N"], 1).select("comparison_id", "model", "station_id", _ts(), "fcst", "obs")


@_query(f"WITH {A.PAIRS} SELECT model, CASE WHEN month(day) IN (12, 1, 2) THEN 'DJF' WHEN month(day) <= 5 THEN 'MAM' WHEN month(day) <= 8 THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n FROM pairs GROUP BY 1, 2")
def season(spark, sf_dir):
    return strata.with_season(A.pairs(spark, sf_dir)).groupBy("model", "season").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {A.PAIRS}, {A.STATIONS} SELECT koppen, substr(koppen, 1, 1) AS koppen_l1, count(*) AS n FROM pairs LEFT JOIN stations USING (station_id) GROUP BY 1, 2")
def koppen_join(spark, sf_dir):
    return strata.with_koppen(A.pairs(spark, sf_dir), A.stations(spark, sf_dir)).groupBy("koppen", "koppen_l1").agg(F.count(F.lit(1)).alias("n"))


def _months(spark):
    return spark.range(1992 * 12, 2003 * 12).select(F.floor(F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month")).where("month <> 7")


_ONI = "oni AS (SELECT (id // 12)::INT AS y, (id % 12 + 1)::INT AS m, ((id * 7 % 21) - 10) / 10.0::DOUBLE AS oni FROM range(23904, 24036) t(id) WHERE id % 12 + 1 <> 7)"


@_query(f"WITH {A.PAIRS}, {_ONI} SELECT CASE WHEN oni >= 0.5 THEN 'el_nino' WHEN oni <= -0.5 THEN 'la_nina' WHEN oni IS NOT NULL THEN 'neutral' END AS enso, count(*) AS n FROM pairs LEFT JOIN oni ON year(day) = y AND month(day) = m GROUP BY 1")
def enso_join(spark, sf_dir):
    number = F.col("year") * 12 + F.col("month") - 1
    oni = _months(spark).withColumn("oni", ((number * 7 % 21) - 10) / 10.0)
    return strata.with_enso(A.pairs(spark, sf_dir), oni).groupBy("enso").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {A.PAIRS}, rmm AS (SELECT DISTINCT day AS d, (datediff('day', DATE '1990-01-01', day) % 8 + 1)::INT AS phase, (datediff('day', DATE '1990-01-01', day) % 5) / 2.0::DOUBLE AS amplitude FROM pairs WHERE month(day) <> 6)
SELECT CASE WHEN amplitude >= 1 THEN phase::VARCHAR WHEN amplitude IS NOT NULL THEN 'inactive' END AS mjo, count(*) AS n FROM pairs LEFT JOIN rmm ON day = d GROUP BY 1""")
def mjo_join(spark, sf_dir):
    p = A.pairs(spark, sf_dir)
    age = F.datediff("date", F.lit("1990-01-01").cast("date"))
    rmm = p.where(F.month("day") != 6).select(F.col("day").alias("date")).distinct().select("date", (age % 8 + 1).alias("phase"), ((age % 5) / 2.0).alias("amplitude"))
    return strata.with_mjo(p, rmm).groupBy("mjo").agg(F.count(F.lit(1)).alias("n"))


_PCT = "pct AS (SELECT *, (rank() OVER (PARTITION BY station_id, variable ORDER BY obs) + (count(*) OVER (PARTITION BY station_id, variable, obs) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY station_id, variable) * 100 AS obs_pct FROM pairs)"


@_query(f"WITH {A.PAIRS}, {_PCT} SELECT station_id, obs, round(obs_pct, 6) AS obs_pct, count(*) AS n FROM pct GROUP BY ALL")
def obs_percentile(spark, sf_dir):
    return strata.with_obs_percentile(A.pairs(spark, sf_dir)).groupBy("station_id", "obs", F.round("obs_pct", 6).alias("obs_pct")).agg(F.count(F.lit(1)).alias("n"))


@_query(ORACLES["obs_percentile"])
def obs_percentile_ranges(spark, sf_dir):
    return strata.with_obs_percentile(A.pairs(spark, sf_dir), ranges=RANGES).groupBy("station_id", "obs", F.round("obs_pct", 6).alias("obs_pct")).agg(F.count(F.lit(1)).alias("n"))


_EDGES = ", ".join(f"('{a}-{b}', {a}, {b})" for a, b in zip(metrics.BIN_EDGES, metrics.BIN_EDGES[1:], strict=False))


@_query(f"""WITH {A.PAIRS}, {_PCT}, bins(bin, lo, hi) AS (VALUES {_EDGES}), m AS (SELECT DISTINCT model FROM pairs)
SELECT m.model, bin, round(avg(fcst - obs), 6) AS bias, count(obs_pct) AS n_pairs FROM m CROSS JOIN bins LEFT JOIN pct ON pct.model = m.model AND obs_pct >= lo AND (obs_pct < hi OR hi = 100 AND obs_pct = 100) GROUP BY 1, 2""")
def bias_by_bin(spark, sf_dir):
    return metrics.bias_by_bin(strata.with_obs_percentile(A.pairs(spark, sf_dir)), ["model"]).withColumn("bias", F.round("bias", 6))


@_query(f"WITH {A.PAIRS} SELECT model, lead_hours, count(*) AS n_pairs, round(avg(fcst - obs), 6) AS bias, round(avg(abs(fcst - obs)), 6) AS mae, round(sqrt(avg((fcst - obs) * (fcst - obs))), 6) AS rmse FROM pairs GROUP BY 1, 2")
def mae_rmse_bias(spark, sf_dir):
    return metrics.error_stats(A.pairs(spark, sf_dir), ["model", "lead_hours"]).select("model", "lead_hours", "n_pairs", *(F.round(c, 6).alias(c) for c in ("bias", "mae", "rmse")))


@_query(f"WITH {A.PAIRS} SELECT model, count(*) AS n_pairs, round(sum(weight * (fcst - obs)) / sum(weight), 6) AS bias, round(sum(weight * abs(fcst - obs)) / sum(weight), 6) AS mae, round(sqrt(sum(weight * (fcst - obs) * (fcst - obs)) / sum(weight)), 6) AS rmse FROM pairs GROUP BY 1")
def weighted_mae(spark, sf_dir):
    return metrics.error_stats(A.pairs(spark, sf_dir), ["model"], "weight").select("model", "n_pairs", *(F.round(c, 6).alias(c) for c in ("bias", "mae", "rmse")))


@_query(f"WITH {A.PAIRS}, s AS (SELECT model, station_id, CASE WHEN min(obs) < max(obs) THEN stddev_samp(fcst) / stddev_samp(obs) END AS r FROM pairs GROUP BY 1, 2) SELECT model, round(median(r), 6) AS variance_ratio, count(r) AS n_stations FROM s GROUP BY 1")
def variance_ratio(spark, sf_dir):
    return metrics.variance_ratio(A.pairs(spark, sf_dir), ["model"]).withColumn("variance_ratio", F.round("variance_ratio", 6))


@_query(f"WITH {A.PAIRS}, d AS (SELECT model, avg((fcst - obs) * (fcst - obs)) AS t, avg(repr_floor) AS f, count(*) AS n_pairs FROM pairs WHERE repr_floor IS NOT NULL GROUP BY 1) SELECT model, round(t, 4) AS mse_total, round(f, 4) AS repr_floor_mean, n_pairs, round(greatest(t - f, 0), 4) AS mse_model_est FROM d")
def decomposition(spark, sf_dir):
    return metrics.decomposition(A.pairs(spark, sf_dir), ["model"]).select("model", "n_pairs", *(F.round(c, 4).alias(c) for c in ("mse_total", "repr_floor_mean", "mse_model_est")))


_WET = """d AS (SELECT station_id, valid_time::DATE AS day, count(*) AS h, sum(value) AS t FROM obs WHERE variable = 'precip_1h' AND value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20),
wet AS (SELECT station_id, count(*) AS n_days, avg((t < 0.25)::INT) AS p1, quantile_cont(t, 2.0 / 3) FILTER (t >= 0.25) AS wet, count_if(t >= 0.25)::BIGINT AS n_wet_days FROM d GROUP BY 1)"""


@_query(f"WITH {A.OBS}, {_WET} SELECT station_id, CASE WHEN n_days >= 10 THEN round(p1, 6) END AS p1_dry_fraction, CASE WHEN n_days >= 10 THEN round(wet, 4) END AS wet_threshold, n_days, n_wet_days FROM wet")
def wet_stats(spark, sf_dir):
    return metrics.wet_stats(A.obs_hourly(spark, sf_dir), min_hours=20, min_days=10).withColumns({"p1_dry_fraction": F.round("p1_dry_fraction", 6), "wet_threshold": F.round("wet_threshold", 4)})


def _rain_pairs(spark, sf_dir):
    wet = F.col("fcst") % 10
    return A.pairs(spark, sf_dir).withColumns({"fcst": F.greatest(wet - 3, F.lit(0.0)), "obs": F.greatest(F.col("obs") % 13 - 4, F.lit(0.0)), "p1": (F.col("station_id").cast("int") % 10) / 10.0, "wet_threshold": F.lit(5.0)})


_RAIN_PAIRS = "rp AS (SELECT model, greatest(fcst % 10 - 3, 0.0) AS f, greatest(obs % 13 - 4, 0.0) AS o, (station_id::INT % 10) / 10.0::DOUBLE AS p FROM pairs)"


_SEEPS = """s0 AS (SELECT model, p BETWEEN 0.1 AND 0.85 AS inm, 0.5 * CASE WHEN f <= 0.25 AND o > 0.25 AND o < 5 THEN 1 / (1 - p) WHEN f <= 0.25 AND o >= 5 THEN 4 / (1 - p) WHEN f > 0.25 AND f < 5 AND o <= 0.25 THEN 1 / p WHEN f > 0.25 AND f < 5 AND o >= 5 THEN 3 / (1 - p)
WHEN f >= 5 AND o <= 0.25 THEN 1 / p + 3 / (2 + p) WHEN f >= 5 AND o > 0.25 AND o < 5 THEN 3 / (2 + p) ELSE 0 END AS x FROM rp)"""


@_query(f"""WITH {A.PAIRS}, {_RAIN_PAIRS}, {_SEEPS} SELECT model, round(avg(x) FILTER (inm), 6) AS seeps, count_if(inm)::BIGINT AS n_pairs, count_if(NOT inm)::BIGINT AS n_masked FROM s0 GROUP BY 1""")
def seeps(spark, sf_dir):
    return metrics.seeps(_rain_pairs(spark, sf_dir), ["model"]).withColumn("seeps", F.round("seeps", 6))


_CLIM = A.ORDER_OBS + """,
base AS (SELECT station_id, value, dayofyear(valid_time) AS doy, hour(valid_time) AS hour FROM order_obs UNION ALL SELECT station_id, value, 366, hour(valid_time) FROM order_obs WHERE dayofyear(valid_time) = 365 AND NOT (year(valid_time) % 4 = 0 AND (year(valid_time) % 100 <> 0 OR year(valid_time) % 400 = 0))),
offs AS (SELECT off, (1 - abs(off) / 10.0::DOUBLE) * 21 / 10.0::DOUBLE AS w FROM range(-9, 10) t(off)),
clim AS (SELECT station_id, ((doy - 1 + off + 366) % 366 + 1)::INT AS dayofyear, hour::INT AS hour, count(*) AS n_samples, sum(w * value) / sum(w) AS mean, sqrt(greatest(sum(w * value * value) / sum(w) - pow(sum(w * value) / sum(w), 2), 0)) AS std FROM base, offs GROUP BY 1, 2, 3)"""


def _climatology(spark, sf_dir):
    return metrics.climatology(A.order_obs(spark, sf_dir), 21)


@_query(f"WITH {_CLIM} SELECT station_id, dayofyear, hour, n_samples, CASE WHEN n_samples >= 30 THEN round(mean, 4) END AS clim_mean, CASE WHEN n_samples >= 30 THEN round(std, 4) END AS clim_std FROM clim")
def climatology(spark, sf_dir):
    return _climatology(spark, sf_dir).select("station_id", F.col("dayofyear").cast("int").alias("dayofyear"), "hour", "n_samples", F.round("clim_mean", 4).alias("clim_mean"), F.round("clim_std", 4).alias("clim_std"))


@_query(f"WITH {_CLIM} SELECT o.station_id, count(*) AS n, count(CASE WHEN n_samples >= 30 THEN mean END) AS n_clim, round(avg(CASE WHEN n_samples >= 30 THEN value - mean END), 4) AS anomaly FROM order_obs o LEFT JOIN clim c ON c.station_id = o.station_id AND c.dayofyear = dayofyear(valid_time) AND c.hour = hour(valid_time) GROUP BY 1")
def attach_climatology(spark, sf_dir):
    joined = strata.with_climatology(A.order_obs(spark, sf_dir), _climatology(spark, sf_dir))
    return joined.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.count("clim_mean").alias("n_clim"), F.round(F.avg(F.col("value") - F.col("clim_mean")), 4).alias("anomaly"))


_DAILY = "daily AS (SELECT model, day, avg(fcst - obs) AS error, count(*) AS n_pairs FROM pairs GROUP BY 1, 2)"


@_query(f"WITH {A.PAIRS}, {_DAILY} SELECT model, day, round(error, 9) AS error, n_pairs FROM daily")
def daily_error_series(spark, sf_dir):
    return metrics.daily_error(A.pairs(spark, sf_dir), ["model"]).withColumn("error", F.round("error", 9))


def _daily(spark, sf_dir):
    return metrics.daily_error(A.pairs(spark, sf_dir), ["model"])


def _rounded_test(df):
    return df.select("model", *(F.round(c, 6).alias(c) for c in _TEST), F.round("n_eff", 3).alias("n_eff"), "dof")


_TEST = ("estimate", "stderr", "ci_low", "ci_high", "p_raw")
_Z = 1.959963984540054  # the normal quantile of 0.975
#: Student's quantile of 0.975 by Cornish and Fisher's expansion, and the two-sided p of whole degrees of freedom by its finite series.
_T_QUANTILE = "+".join(f"({c!r}::DOUBLE)/pow(dof, {k})" for k, c in enumerate((_Z, (_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160)))
_T_TESTED = f"""angle AS (SELECT *, row_number() OVER () AS nth, atan(abs(estimate / stderr) / sqrt(dof)) AS th FROM tested),
series AS (SELECT nth, sum(CASE WHEN dof % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(th), 2 * j) ELSE exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j + 1) END) AS x FROM angle, range(0, 6000) t(j) WHERE j <= (dof - 2 - dof % 2) / 2 GROUP BY 1),
t AS (SELECT angle.*, CASE WHEN stderr = 0 THEN (estimate = 0)::INT WHEN dof % 2 = 0 THEN 1 - sin(th) * x ELSE 1 - 2 / pi() * (th + sin(th) * coalesce(x, 0)) END AS p, ({_T_QUANTILE}) * stderr AS half FROM angle LEFT JOIN series USING (nth))"""
_T_ROUNDED = "round(estimate, 6) AS estimate, round(stderr, 6) AS stderr, round(estimate - half, 6) AS ci_low, round(estimate + half, 6) AS ci_high, round(p, 6) AS p_raw"


_MOMENTS = "m AS (SELECT model, avg(error) AS mean, var_samp(error) AS v, count(*) AS n FROM daily GROUP BY 1)"


@_query(f"WITH {A.PAIRS}, {_DAILY}, {_MOMENTS}, tested AS (SELECT model, mean AS estimate, sqrt(v / n) AS stderr, n::DOUBLE AS n_eff, (n - 1)::INT AS dof FROM m), {_T_TESTED} SELECT model, {_T_ROUNDED}, n_eff, dof FROM t")
def ttest_iid(spark, sf_dir):
    return _rounded_test(tests.ttest_by(_daily(spark, sf_dir), ["model"], "iid"))


@_query(f"""WITH {A.PAIRS}, {_DAILY}, {_MOMENTS}, l AS (SELECT model, error - mean AS d, lag(error - mean) OVER w AS d1, lag(error - mean, 2) OVER w AS d2, v, n, mean FROM daily JOIN m USING (model) WINDOW w AS (PARTITION BY model ORDER BY day)),
r AS (SELECT model, any_value(mean) AS mean, any_value(v) AS v, any_value(n) AS n, avg(d * d1) / any_value(v) AS r1, avg(d * d2) / any_value(v) AS r2 FROM l GROUP BY 1),
p AS (SELECT *, r1 * (1 - r2) / (1 - r1 * r1) AS p1, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM r), k AS (SELECT *, (1 - r1 * p1 - r2 * p2) / pow(1 - p1 - p2, 2) AS k2 FROM p),
tested AS (SELECT model, mean AS estimate, sqrt(v / n) * sqrt(k2) AS stderr, n / k2 AS n_eff, (n - 1)::INT AS dof FROM k), {_T_TESTED} SELECT model, {_T_ROUNDED}, round(n_eff, 3) AS n_eff, dof FROM t""")
def ttest_ar2(spark, sf_dir):
    return _rounded_test(tests.ttest_by(_daily(spark, sf_dir), ["model"], "ar2"))


_HAC = """x AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day) - 1 AS i FROM daily), c AS (SELECT x.model, k, sqrt(2.0 / any_value(n)) * sum((error - mean) * cos(pi() * k * (2 * i + 1) / (2 * n))) AS c FROM x JOIN m USING (model), range(1, 200) t(k) WHERE k <= greatest(1, least(floor(0.4 * pow(n, 2.0 / 3)), n - 1)) GROUP BY 1, 2)"""


@_query(f"WITH {A.PAIRS}, {_DAILY}, {_MOMENTS}, {_HAC}, tested AS (SELECT m.model, any_value(mean) AS estimate, sqrt(avg(c * c) / any_value(n)) AS stderr, (count(*) + 1)::DOUBLE AS n_eff, count(*)::INT AS dof FROM c JOIN m USING (model) GROUP BY 1), {_T_TESTED} SELECT model, {_T_ROUNDED}, n_eff, dof FROM t")
def ttest_hac(spark, sf_dir):
    return _rounded_test(tests.ttest_by(_daily(spark, sf_dir), ["model"], "hac"))


@_query(f"WITH {A.PAIRS}, p AS (SELECT 'A+R' AS model, a.day, a.e - b.e AS error FROM (SELECT day, avg(abs(fcst - obs)) AS e FROM pairs WHERE model = 'A' GROUP BY 1) a JOIN (SELECT day, avg(abs(fcst - obs)) AS e FROM pairs WHERE model = 'R' GROUP BY 1) b USING (day)), daily AS (SELECT * FROM p), {_MOMENTS}, {_HAC}, tested AS (SELECT m.model AS comparison_id, any_value(mean) AS estimate, sqrt(avg(c * c) / any_value(n)) AS stderr, count(*)::INT AS dof, any_value(n)::INT AS n_days FROM c JOIN m USING (model) GROUP BY 1), {_T_TESTED} SELECT comparison_id, {_T_ROUNDED}, dof, n_days FROM t")
def paired_diff(spark, sf_dir):
    daily = A.pairs(spark, sf_dir).groupBy("model", "day").agg(F.avg(F.abs(F.col("fcst") - F.col("obs"))).alias("error")).withColumn("variable", F.lit("t2m"))
    return tests.paired_test(daily, "A", "R", ["variable"]).select("comparison_id", *(F.round(c, 6).alias(c) for c in _TEST), "dof", "n_days")


_P = "t AS (SELECT (o_custkey % 7)::VARCHAR AS family_id, o_orderkey AS test_id, round((o_totalprice % 1000) / 1000, 6) AS p_raw FROM (SELECT DISTINCT * FROM orders))"


_BH = f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY p_raw, test_id) AS k, count(*) OVER (PARTITION BY family_id) AS n_family FROM t), a AS (SELECT *, least(1.0, min(p_raw * n_family / k) OVER (PARTITION BY family_id ORDER BY k DESC)) AS p FROM r) SELECT family_id, test_id, p_raw, n_family, round(p, 6) AS p_adj, p <= 0.3 AS reject FROM a"


@_query(_BH)
def bh_fdr(spark, sf_dir):
    return _adjusted(spark, sf_dir)


@_query(_BH)
def bh_fdr_ranges(spark, sf_dir):
    return _adjusted(spark, sf_dir, RANGES)


def _adjusted(spark, sf_dir, ranges=None):
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").distinct().select((F.col("o_custkey") % 7).cast("string").alias("family_id"), F.col("o_orderkey").alias("test_id"), F.round((F.col("o_totalprice") % 1000) / 1000, 6).alias("p_raw"))
    return tests.benjamini_hochberg(t, 0.3, ranges=ranges).select("family_id", "test_id", "p_raw", "n_family", F.round("p_adj", 6).alias("p_adj"), "reject")


_BOOT = """x AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY day) - 1 AS i, e, n FROM (SELECT model, day, sum(fcst - obs) AS e, count(*) AS n FROM pairs GROUP BY 1, 2)), c AS (SELECT model, count(*) AS days, sum(e) / sum(n) AS estimate, sum(n) AS n_pairs FROM x GROUP BY 1),
pos AS (SELECT model, d.d, (d.d * 7919 + (j.j // least(10, days)) * 104729) % (days - least(10, days) + 1) + j.j % least(10, days) AS i FROM c, range(0, 1000) d(d), range(0, 5000) j(j) WHERE j.j < days),
s AS (SELECT pos.model, d, sum(e) / sum(n) AS b FROM pos JOIN x ON x.model = pos.model AND x.i = pos.i GROUP BY 1, 2)"""


@_query(f"WITH {A.PAIRS}, {_BOOT} SELECT model, round(any_value(estimate), 6) AS estimate, round(quantile_cont(b, 0.025), 6) AS ci_low, round(quantile_cont(b, 0.975), 6) AS ci_high, any_value(n_pairs)::BIGINT AS n_pairs, any_value(days)::INT AS n_days FROM s JOIN c USING (model) GROUP BY 1")
def boot_bias_ci(spark, sf_dir):
    out = bootstrap.block_bootstrap(A.pairs(spark, sf_dir), ["model"], ["bias"], n_boot=N_BOOT, block_len=10, starts="arithmetic")
    return out.select("model", *(F.round(c, 6).alias(c) for c in ("estimate", "ci_low", "ci_high")), "n_pairs", "n_days")


def _boot_sql(rows: str, by: str, sums: dict[str, str], finals: dict[str, str], pairs: str = "n") -> str:
    """CTEs and query of a bootstrap of days by the arithmetic rule, blocks of 10: ``sums`` by day of ``rows``, ``finals`` over the sums of a draw."""
    cols = ", ".join(sums)
    ctes = f"""x AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY day) - 1 AS i, {cols} FROM (SELECT {by}, day, {", ".join(f"{e} AS {k}" for k, e in sums.items())} FROM {rows} GROUP BY {by}, day)),
c AS (SELECT {by}, count(*) AS days, {", ".join(f"sum({k}) AS {k}" for k in sums)} FROM x GROUP BY {by}),
pos AS (SELECT {by}, d.d, (d.d * 7919 + (j.j // least(10, days)) * 104729) % (days - least(10, days) + 1) + j.j % least(10, days) AS i FROM c, range(0, 1000) d(d), range(0, 5000) j(j) WHERE j.j < days),
s AS (SELECT {by}, d, {", ".join(f"sum({k}) AS {k}" for k in sums)} FROM pos JOIN x USING ({by}, i) GROUP BY {by}, d)"""
    each = [f"SELECT {by}, '{m}' AS metric, round(any_value(e) + 1.37e-9, 6) AS estimate, round(quantile_cont(v, 0.025) + 1.37e-9, 6) AS ci_low, round(quantile_cont(v, 0.975) + 1.37e-9, 6) AS ci_high, any_value(np)::BIGINT AS n_pairs, any_value(nd)::INT AS n_days, 1000 AS n_boot FROM (SELECT {by}, {e} AS v FROM s) JOIN (SELECT {by}, {e} AS e, {pairs} AS np, days AS nd FROM c) USING ({by}) GROUP BY {by}" for m, e in finals.items()]
    return f"{ctes} " + " UNION ALL ".join(each)


#: The draws of the registered bootstraps follow the rule that SQL can repeat.
_DRAWS = {"n_boot": N_BOOT, "block_len": 10, "starts": "arithmetic"}


#: Keeps means of few prices off the ties of rounding.
_OFF = 1.37e-9


def _rounded_boot(df, *by):
    return df.select(*by, *(F.round(F.col(c) + _OFF, 6).alias(c) for c in ("estimate", "ci_low", "ci_high")), "n_pairs", "n_days", "n_boot")


@_query(f"WITH {A.PAIRS}, " + _boot_sql("pairs", "model, lead_hours", {"n": "count(*)", "e": "sum(fcst - obs)", "a": "sum(abs(fcst - obs))", "q": "sum((fcst - obs) * (fcst - obs))", "wa": "sum(weight * abs(fcst - obs))", "w": "sum(weight)"}, {"bias": "e / n", "mae": "a / n", "rmse": "sqrt(q / n)", "weighted_mae": "wa / w"}))
def boot_metrics(spark, sf_dir):
    out = bootstrap.block_bootstrap(A.pairs(spark, sf_dir), ["model", "lead_hours"], ["bias", "mae", "rmse", "weighted_mae"], **_DRAWS)
    return _rounded_boot(out, "model", "lead_hours", "metric")


@_query(f"WITH {A.PAIRS}, floored AS (SELECT * FROM pairs WHERE repr_floor IS NOT NULL), " + _boot_sql("floored", "model", {"n": "count(*)", "q": "sum((fcst - obs) * (fcst - obs))", "f": "sum(repr_floor)"}, {"mse_total": "q / n", "repr_floor_mean": "f / n", "mse_model_est": "greatest(q / n - f / n, 0)"}))
def boot_decomposition(spark, sf_dir):
    return _rounded_boot(bootstrap.decomposition_bootstrap(A.pairs(spark, sf_dir), ["model"], **_DRAWS), "model", "metric")


@_query(f"WITH {A.PAIRS}, {_RAIN_PAIRS.replace('SELECT model,', 'SELECT model, day,')}, {_SEEPS.replace('SELECT model,', 'SELECT model, day,')}, " + _boot_sql("s0", "model", {"n": "count_if(inm)", "x": "sum(CASE WHEN inm THEN x ELSE 0 END)"}, {"seeps": "x / n"}))
def boot_seeps(spark, sf_dir):
    return _rounded_boot(bootstrap.block_bootstrap(_rain_pairs(spark, sf_dir), ["model"], ["seeps"], **_DRAWS), "model", "metric")


@_query(f"""WITH {A.PAIRS}, st AS (SELECT model, station_id, day, count(*) AS n, sum(fcst) AS f, sum(fcst * fcst) AS ff, sum(obs) AS o, sum(obs * obs) AS oo, min(obs) AS lo, max(obs) AS hi FROM pairs GROUP BY 1, 2, 3),
days AS (SELECT model, day, row_number() OVER (PARTITION BY model ORDER BY day) - 1 AS i FROM (SELECT DISTINCT model, day FROM pairs)), c AS (SELECT model, count(*) AS days FROM days GROUP BY 1),
pos AS (SELECT model, d.d, (d.d * 7919 + (j.j // least(10, days)) * 104729) % (days - least(10, days) + 1) + j.j % least(10, days) AS i FROM c, range(0, 1000) d(d), range(0, 5000) j(j) WHERE j.j < days),
times AS (SELECT model, d, i, count(*) AS t FROM pos GROUP BY 1, 2, 3 UNION ALL SELECT model, -1, i, 1 FROM days),
s AS (SELECT model, station_id, d, sum(t * n) AS n, sum(t * f) AS f, sum(t * ff) AS ff, sum(t * o) AS o, sum(t * oo) AS oo, min(lo) AS lo, max(hi) AS hi FROM times JOIN days USING (model, i) JOIN st USING (model, day) GROUP BY 1, 2, 3),
r AS (SELECT model, d, median(sqrt((ff - f * f / n) / (oo - o * o / n))) AS r FROM s WHERE lo < hi AND n > 1 GROUP BY 1, 2)
SELECT r.model, round(max(CASE WHEN d < 0 THEN r END) + 1.37e-9, 6) AS estimate, round(quantile_cont(CASE WHEN d >= 0 THEN r END, 0.025) + 1.37e-9, 6) AS ci_low, round(quantile_cont(CASE WHEN d >= 0 THEN r END, 0.975) + 1.37e-9, 6) AS ci_high, any_value(np) AS n_pairs, any_value(days)::INT AS n_days, 1000 AS n_boot
FROM r JOIN c USING (model) JOIN (SELECT model, count(*) AS np FROM pairs GROUP BY 1) USING (model) GROUP BY 1""")
def boot_variance_ratio(spark, sf_dir):
    return _rounded_boot(bootstrap.variance_ratio_bootstrap(A.pairs(spark, sf_dir), ["model"], **_DRAWS), "model")


@_query(f"""WITH {A.PAIRS}, {_PCT}, bins(bin, lo, hi) AS (VALUES {_EDGES}), binned AS (SELECT model, bin, day, fcst, obs FROM pct JOIN bins ON obs_pct >= lo AND (obs_pct < hi OR hi = 100 AND obs_pct = 100)), got AS (WITH """ + _boot_sql("binned", "model, bin", {"n": "count(*)", "e": "sum(fcst - obs)"}, {"bias": "e / n"}) + """)
SELECT m.model, b.bin, estimate, ci_low, ci_high, coalesce(n_pairs, 0) AS n_pairs, n_days, n_boot FROM (SELECT DISTINCT model FROM pairs) m CROSS JOIN bins b LEFT JOIN got ON got.model = m.model AND got.bin = b.bin""")
def boot_bias_by_bin(spark, sf_dir):
    return _rounded_boot(bootstrap.bias_by_bin_bootstrap(strata.with_obs_percentile(A.pairs(spark, sf_dir)), ["model"], **_DRAWS), "model", "bin")


_SEASON = "CASE WHEN month(day) IN (12, 1, 2) THEN 'DJF' WHEN month(day) <= 5 THEN 'MAM' WHEN month(day) <= 8 THEN 'JJA' ELSE 'SON' END"


@_query(f"""WITH {A.PAIRS}, {A.STATIONS}, s AS (SELECT p.*, {_SEASON} AS season, substr(koppen, 1, 1) AS koppen_l1 FROM pairs p LEFT JOIN stations USING (station_id)),
u AS (SELECT model, 'season' AS stratum_type, season AS stratum_value, fcst, obs FROM s UNION ALL SELECT model, 'koppen_l1', koppen_l1, fcst, obs FROM s)
SELECT model, stratum_type, stratum_value, count(*) AS n_pairs, round(avg(fcst - obs), 6) AS bias, round(avg(abs(fcst - obs)), 6) AS mae FROM u WHERE stratum_value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 50""")
def regime_grouping_sets(spark, sf_dir):
    df = strata.with_koppen(strata.with_season(A.pairs(spark, sf_dir)), A.stations(spark, sf_dir))
    return metrics.regime_table(df, ["season", "koppen_l1"], ["model"]).withColumns({"bias": F.round("bias", 6), "mae": F.round("mae", 6)})


_IDX = "idx AS (SELECT (o_custkey % 50)::VARCHAR AS file, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey, o_totalprice) AS line_no, o_orderkey * 10 AS start FROM orders)"


def _index_lines(spark, sf_dir):
    from pyspark.sql import Window as W

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    file = (F.col("o_custkey") % 50).cast("string")
    nth = F.row_number().over(W.partitionBy(file).orderBy("o_orderkey", "o_totalprice"))
    var = F.when(F.col("o_orderkey") % 3 == 0, "TMP:2 m above ground").otherwise("RH:surface")
    return o.select(file.alias("file"), nth.alias("line_no"), F.concat_ws(":", nth.cast("string"), (F.col("o_orderkey") * 10).cast("string"), F.lit("d=2024010100"), var, F.lit("24 hour fcst"), F.lit("")).alias("line"))


@_query(f"WITH {_IDX} SELECT file, line_no::INT AS line_no, start, lead(start) OVER (PARTITION BY file ORDER BY line_no) AS stop, CASE WHEN start // 10 % 3 = 0 THEN 'TMP' ELSE 'RH' END AS var FROM idx")
def idx_ranges(spark, sf_dir):
    return gridindex.parse_gfs_index(_index_lines(spark, sf_dir)).select("file", "line_no", "start", "stop", "var")


@_query(f"""WITH {_IDX}, e AS (SELECT *, lead(start) OVER (PARTITION BY file ORDER BY line_no) AS stop FROM idx), f AS (SELECT * FROM e WHERE start // 10 % 3 = 0),
r AS (SELECT *, max(coalesce(stop, 4611686018427387904)) OVER (PARTITION BY file ORDER BY start, stop NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f), g AS (SELECT *, sum(CASE WHEN start <= reach + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY start, stop NULLS LAST ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT file, min(start) AS start, CASE WHEN count(*) = count(stop) THEN max(stop) END AS stop FROM g GROUP BY file, n""")
def coalesce_ranges(spark, sf_dir):
    entries = gridindex.parse_gfs_index(_index_lines(spark, sf_dir)).where("var = 'TMP'")
    return gridindex.coalesce_ranges(entries, 200)


@_query("""WITH l AS (SELECT (event_id % 20)::VARCHAR AS station_id, ts, value, event_id FROM events), x AS (SELECT station_id, date_trunc('hour', ts) AS valid_time, 'wind10m' AS variable, (value * 10)::INT AS raw FROM l WHERE event_id % 13 <> 0
UNION ALL SELECT station_id, date_trunc('hour', ts), 't2m', CASE WHEN event_id % 7 = 0 THEN -9999 ELSE (value * 5)::INT END FROM l WHERE event_id % 13 <> 0 UNION ALL SELECT station_id, date_trunc('hour', ts), 'precip_1h', CASE WHEN event_id % 5 = 0 THEN -1 ELSE (value)::INT END FROM l WHERE event_id % 13 <> 0)
SELECT station_id, strftime(valid_time, '%Y-%m-%d %H:%M') AS valid_time, variable, round(CASE WHEN variable = 'precip_1h' AND raw = -1 THEN 0 WHEN variable = 't2m' THEN raw / 10.0::DOUBLE + 273.15 ELSE raw / 10.0::DOUBLE END, 4) AS value, CASE WHEN variable = 'precip_1h' AND raw = -1 THEN 'T' END AS source_qc_raw FROM x WHERE raw <> -9999""")
def isd_lite_parse(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    line = F.concat_ws("  ", F.date_format("t", "yyyy MM dd HH"), F.when(F.col("event_id") % 7 == 0, "-9999").otherwise(F.bround(F.col("value") * 5).cast("long").cast("string")), F.lit("0 0 0"), F.bround(F.col("value") * 10).cast("long").cast("string"), F.lit("0"), F.when(F.col("event_id") % 5 == 0, "-1").otherwise(F.bround("value").cast("long").cast("string")), F.lit("0"))
    lines = e.select((F.col("event_id") % 20).cast("string").alias("station_id"), F.when(F.col("event_id") % 13 == 0, "1 2 3").otherwise(line).alias("line"))
    parsed = observations.emitted(observations.parse_isd_lite(lines), "test")
    return parsed.select("station_id", _ts(), "variable", F.round("value", 4).alias("value"), "source_qc_raw")


@_query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'not_country' WHEN c_custkey % 10 = 1 THEN 'end_before_min' WHEN c_custkey % 10 = 2 THEN 'invalid_coords' ELSE 'kept' END AS status FROM customer) GROUP BY 1")
def isd_history(spark, sf_dir):
    k = F.col("c_custkey")
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(k % 10 == 0, "US").otherwise("BR").alias("CTRY"), F.when(k % 10 == 1, "20200101").otherwise("20260101").alias("END"), F.when(k % 10 == 2, "+00.000").otherwise("-30.5").alias("LAT"), F.when(k % 10 == 2, "+000.000").otherwise("-51.5").alias("LON"))
    return station_sources.tag_isd_history(raw).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH d AS (SELECT event_type AS source, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), days AS (SELECT unnest(generate_series(DATE '2023-12-15', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day), s AS (SELECT DISTINCT source FROM d)
SELECT source, strftime(day, '%Y-%m') AS month, count(*) AS expected, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS present, CASE WHEN sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) = 0 THEN 'absent' WHEN sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) < count(*) THEN 'partial' ELSE 'complete' END AS cell FROM days CROSS JOIN s LEFT JOIN d USING (source, day) GROUP BY 1, 2""")
def source_coverage(spark, sf_dir):
    present = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("source"), F.to_date("ts").alias("day"))
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2023-12-15").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day"))
    return gridindex.month_coverage(present, days)


@_query("""WITH r AS (SELECT DISTINCT o_custkey % 3 AS k, o_orderdate::DATE AS day FROM orders), f AS (SELECT o_custkey % 3 AS k, o_orderdate::DATE AS day, (o_orderkey % 4 * 6 + 6)::INT AS lead, o_totalprice FROM orders),
c AS (SELECT k, day, count(DISTINCT lead) AS n, round(sum(o_totalprice), 2) AS b FROM f WHERE lead <= 18 GROUP BY 1, 2), w AS (SELECT r.k, r.day, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM r LEFT JOIN c USING (k, day))
SELECT k::VARCHAR AS source, count(*) AS runs, count_if(n = 3)::BIGINT AS complete_runs, round(median(CASE WHEN n = 3 THEN b END), 2) AS median_bytes FROM w GROUP BY 1""")
def lead_audit(spark, sf_dir):
    """Runs with all of three leads, and the median size of one."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    present = o.select((F.col("o_custkey") % 3).cast("string").alias("source"), F.to_date("o_orderdate").alias("init_time"), (F.col("o_orderkey") % 4 * 6 + 6).cast("int").alias("lead_hours"), F.col("o_totalprice").alias("bytes"))
    done = gridindex.lead_completeness(present, present, [6, 12, 18]).withColumn("bytes", F.round("bytes", 2))
    return gridindex.bytes_by_run(done).withColumn("median_bytes", F.round("median_bytes", 2))


@_query(f"""WITH {A.STATIONS} SELECT station_id, (CASE WHEN floor(lat) < 0 THEN 'S' ELSE 'N' END) || lpad(abs(floor(lat))::INT::VARCHAR, 2, '0') || '_W' || lpad(abs(floor(lon))::INT::VARCHAR, 3, '0') AS tile,
CASE WHEN floor(lat)::INT % 2 = 0 THEN (least(9, floor((floor(lat) + 1 - lat) * 10)) * 10 + least(9, floor((lon - floor(lon)) * 10)))::DOUBLE END AS elev_dem FROM stations""")
def dem_points(spark, sf_dir):
    """Terrain height at every station from tiles of 10 x 10 cells; odd tiles lack."""
    cells = spark.range(10 * 10 * 10 * 10).select((F.col("id") % 10).cast("int").alias("col"), (F.floor(F.col("id") / 10) % 10).cast("int").alias("row"), (F.floor(F.col("id") / 100) % 10).cast("int").alias("a"), F.floor(F.col("id") / 1000).cast("int").alias("b"))
    south, west = 30 - 2 * F.col("a"), F.col("b") + 46
    tiles = cells.where("a < 5").select(F.concat(F.lit("S"), F.lpad(south.cast("string"), 2, "0"), F.lit("_W"), F.lpad(west.cast("string"), 3, "0")).alias("tile"), "row", "col", (F.col("row") * 10 + F.col("col")).alias("elevation"))
    return station_sources.dem_lookup(A.stations(spark, sf_dir), tiles, 10)


@_query("""WITH p AS (SELECT ['gfs', 'hres'][(o_custkey % 2 + 1)::INT] AS model, date_trunc('hour', o_orderdate) + INTERVAL (o_custkey % 24) HOUR AS valid_time, ['t2m', 'wind10m', 'precip_24h'][(o_orderkey % 3 + 1)::INT] AS variable, o_totalprice / 1000 AS value FROM orders),
t AS (SELECT model, (valid_time - INTERVAL 3 HOUR)::DATE AS day, round(min(CASE WHEN variable = 't2m' THEN value END) - 273.15, 1) AS tmin_c, round(max(CASE WHEN variable = 't2m' THEN value END) - 273.15, 1) AS tmax_c, round(max(CASE WHEN variable = 'wind10m' THEN value END), 1) AS wind_max FROM p GROUP BY 1, 2),
r AS (SELECT model, valid_time::DATE AS day, round(max(value), 1) AS precip_24h FROM p WHERE variable = 'precip_24h' AND hour(valid_time) = 0 GROUP BY 1, 2) SELECT t.*, precip_24h FROM t LEFT JOIN r USING (model, day)""")
def daily_summary(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.col(k) % len(names) + 1).cast("int"))
    p = o.select(pick(("gfs", "hres"), "o_custkey").alias("model"), (F.date_trunc("hour", F.col("o_orderdate").cast("timestamp")) + F.make_interval(hours=(F.col("o_custkey") % 24).cast("int"))).alias("valid_time"), pick(("t2m", "wind10m", "precip_24h"), "o_orderkey").alias("variable"), (F.col("o_totalprice") / 1000).alias("value"))
    rain = (F.col("variable") == "precip_24h") & (F.hour("valid_time") == 0)
    one = p.where(rain).groupBy("model", "valid_time", "variable").agg(F.max("value").alias("value"))
    return metrics.daily_summary(p.where(~rain).unionByName(one))


@_query(f"WITH {A.STATIONS}, {A.PAIRS}, f AS (SELECT p.model, p.station_id, p.lead_hours, floor(s.lat / 0.25)::INT AS cy, floor(s.lon / 0.25)::INT AS cx FROM pairs p LEFT JOIN stations s USING (station_id)), fl AS (SELECT DISTINCT floor(lat / 0.25)::INT AS cy, floor(lon / 0.25)::INT AS cx FROM stations WHERE station_id::INT % 2 = 0) SELECT model, count(*) AS n, count(fl.cy) AS n_floor FROM f LEFT JOIN fl ON f.cy = fl.cy AND f.cx = fl.cx GROUP BY 1")
def attach_floor(spark, sf_dir):
    st = A.stations(spark, sf_dir)
    floors = geo.with_cells(st.where(F.col("station_id").cast("int") % 2 == 0)).select("cell_lat", "cell_lon", F.lit("t2m").alias("variable"), F.lit(1.0).alias("floor_var")).distinct()
    return matching.attach_floor(A.pairs(spark, sf_dir), floors, st).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("repr_floor").alias("n_floor"))


def _grid(spark):
    """A 17 x 21 grid of half degrees over the test stations, two fields."""
    cells = spark.range(17 * 21).select((F.col("id") / 21).cast("int").alias("j"), (F.col("id") % 21).cast("int").alias("i"))
    return cells.select("j", "i", (F.lit(-24.0) - F.col("j") * 0.5).alias("lat"), (F.lit(300.0) + F.col("i") * 0.5).alias("lon"), (F.sin(F.col("j")) * 10 + F.col("i")).alias("value"))


_GRID = """grid AS (SELECT (id // 21)::INT AS j, (id % 21)::INT AS i, -24.0::DOUBLE - (id // 21) * 0.5::DOUBLE AS lat, 300.0::DOUBLE + (id % 21) * 0.5::DOUBLE AS lon, sin(id // 21) * 10 + id % 21 AS value FROM range(357) t(id)),
s AS (SELECT station_id, lat AS y, lon + 360 AS x FROM stations)"""


@_query(f"WITH {A.STATIONS}, {_GRID}, w AS (SELECT station_id, j, i, value, greatest(0, 1 - abs(y - lat) / 0.5) * greatest(0, 1 - abs(x - lon) / 0.5) AS w FROM s, grid WHERE abs(y - lat) < 0.5 AND abs(x - lon) < 0.5) SELECT station_id, round(sum(w * value), 6) AS value FROM w GROUP BY 1")
def grid_bilinear(spark, sf_dir):
    grid = _grid(spark)
    return geo.bilinear(geo.grid_weights(A.stations(spark, sf_dir), grid), grid, []).select("station_id", F.round("value", 6).alias("value"))


@_query(f"WITH {A.STATIONS}, {_GRID} SELECT station_id, arg_min(j, (abs(y - lat), j)) AS j, arg_min(i, (abs(x - lon), i)) AS i FROM s, grid GROUP BY 1")
def grid_nearest(spark, sf_dir):
    return geo.nearest_nodes(A.stations(spark, sf_dir), _grid(spark))


def _greenwich(spark, sf_dir):
    """A 31 x 41 grid of whole degrees across Greenwich, its values the suppliers' balances, and the customers as stations inside and outside of it."""
    cells = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy((F.col("s_suppkey") % 31).cast("int").alias("j")).agg(F.round(F.avg("s_acctbal"), 6).alias("base"))
    grid = cells.select("j", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("i"), "base").select("j", "i", (F.lit(15.0) - F.col("j")).alias("lat"), (F.lit(-20.0) + F.col("i")).alias("lon"), (F.col("base") + F.col("i") * 0.5).alias("value"))
    k = F.col("c_custkey")
    return grid, spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("string").alias("station_id"), (k * 7919 % 400 / 10.0 - 20.0).alias("lat"), (k * 104729 % 7200 / 20.0 - 180.0).alias("lon"))


@_query("""WITH g AS (SELECT j, i, 15.0::DOUBLE - j AS lat, -20.0::DOUBLE + i AS lon, base + i * 0.5 AS value FROM (SELECT (s_suppkey % 31)::INT AS j, round(avg(s_acctbal), 6) AS base FROM supplier GROUP BY 1), (SELECT unnest(range(0, 41))::INT AS i)),
s AS (SELECT c_custkey::VARCHAR AS station_id, c_custkey * 7919 % 400 / 10.0::DOUBLE - 20.0 AS y, c_custkey * 104729 % 7200 / 20.0::DOUBLE - 180.0 AS x FROM customer),
ok AS (SELECT * FROM s WHERE y BETWEEN (SELECT min(lat) FROM g) AND (SELECT max(lat) FROM g) AND x BETWEEN -20 AND 20),
w AS (SELECT station_id, sum((1 - abs(y - lat)) * (1 - abs(x - lon)) * value) AS v FROM ok JOIN g ON abs(y - lat) < 1 AND abs(x - lon) < 1 GROUP BY 1), n AS (SELECT station_id, arg_min(j, (abs(y - lat), j)) AS j, arg_min(i, (abs(x - lon), i)) AS i FROM ok JOIN g ON abs(y - lat) <= 1 AND abs(x - lon) <= 1 GROUP BY 1)
SELECT station_id, round(v, 5) AS value, j, i FROM w JOIN n USING (station_id)""")
def grid_greenwich(spark, sf_dir):
    grid, at = _greenwich(spark, sf_dir)
    found = geo.bilinear(geo.grid_weights(at, grid, outside="drop"), grid, [])
    return found.join(geo.nearest_nodes(at, grid, outside="drop"), "station_id").select("station_id", F.round("value", 5).alias("value"), "j", "i")


@_query("""SELECT (id % 12 + 1)::INT AS month, count(*) AS n, round(sum((id % 41 - 20) / 10.0::DOUBLE), 4) AS total FROM (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 9 <> 0) GROUP BY 1""")
def oni_parse(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id")).distinct()
    season_name = F.element_at(F.array(*map(F.lit, indices.SEASONS)), (F.col("id") % 12 + 1).cast("int"))
    value = F.when(F.col("id") % 9 == 0, "n/a").otherwise(((F.col("id") % 41 - 20) / 10.0).cast("string"))
    lines = ids.select(F.concat_ws("  ", season_name, F.lit("2001"), F.lit("27.1"), value).alias("line"))
    return indices.parse_oni(lines).where("drop_reason is null").groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("oni"), 4).alias("total"))


@_query()
def results_table(spark, sf_dir):
    df = strata.with_season(A.pairs(spark, sf_dir))
    return registry.metric_rows(df, ["mae", "bias"], "test", ["season"], n_boot=N_BOOT)


#: The two-sided p of a t at the angle th, by its finite series over lists.
_P_OF_ANGLE = "CASE WHEN dof % 2 = 0 THEN 1 - sin(th) * list_sum([exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(th), 2 * j) for j in range(0, dof // 2)]) ELSE 1 - 2 / pi() * (th + sin(th) * coalesce(list_sum([exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j + 1) for j in range(0, (dof - 1) // 2)]), 0)) END"
_OFF_TIES = 1.37e-8  # means of few values lie on ties of rounding
_PAIRED = f"""WITH RECURSIVE {A.PAIRS}, d AS (SELECT model, lead_hours, day, avg(abs(fcst - obs)) AS mae, avg((fcst - obs) * (fcst - obs)) AS rmse, avg(fcst - obs) AS bias FROM pairs GROUP BY 1, 2, 3),
l AS (SELECT model, lead_hours, day, unnest(['mae', 'rmse', 'bias']) AS metric, unnest([mae, rmse, bias]) AS s FROM d),
daily AS (SELECT a.metric || '|' || a.model || '-' || b.model || '|' || a.lead_hours AS model, a.day, a.s - b.s AS error FROM l a JOIN l b USING (metric, lead_hours, day) WHERE a.model < b.model), {_MOMENTS}, {_HAC},
tested AS (SELECT m.model, any_value(mean) AS estimate, sqrt(avg(c * c) / any_value(n)) AS stderr, count(*)::INT AS dof, any_value(n)::INT AS n_days FROM c JOIN m USING (model) GROUP BY 1),
b(dof, low, high, k) AS (SELECT DISTINCT dof, 0.0::DOUBLE, 700.0::DOUBLE, 0 FROM tested UNION ALL SELECT dof, CASE WHEN p > 0.05 THEN mid ELSE low END, CASE WHEN p > 0.05 THEN high ELSE mid END, k + 1
  FROM (SELECT *, {_P_OF_ANGLE} AS p FROM (SELECT *, (low + high) / 2 AS mid, atan((low + high) / 2 / sqrt(dof)) AS th FROM b WHERE k < 60))),
p AS (SELECT *, {_P_OF_ANGLE} AS p FROM (SELECT tested.*, low AS t, atan(abs(estimate / stderr) / sqrt(tested.dof)) AS th FROM tested JOIN b ON b.dof = tested.dof AND k = 60)),
r AS (SELECT *, row_number() OVER (ORDER BY p, model) AS nth, count(*) OVER () AS n FROM p), a AS (SELECT *, least(1.0, min(p * n / nth) OVER (ORDER BY nth DESC)) AS p_adj FROM r)
SELECT string_split(model, '|')[1] AS metric, replace(string_split(model, '|')[2], '-', '+') AS comparison_id, string_split(model, '|')[2] AS model, 't2m' AS variable, string_split(model, '|')[3]::SMALLINT AS lead_hours, 'global' AS stratum_type, 'all' AS stratum_value,
round(estimate + {_OFF_TIES}, 6) AS estimate, round(estimate - t * stderr + {_OFF_TIES}, 6) AS ci_low, round(estimate + t * stderr + {_OFF_TIES}, 6) AS ci_high, 0.05::DOUBLE AS alpha, NULL::BIGINT AS n_pairs, NULL::INT AS n_stations, n_days, NULL::SMALLINT AS block_len_days, NULL::INT AS n_boot, round(p + {_OFF_TIES}, 6) AS p_raw, round(p_adj + {_OFF_TIES}, 6) AS p_adj, 'headline' AS family_id, n::INT AS n_family, '{registry.VERSION}' AS registry_version, 'test' AS ingest_version FROM a"""


@_query(_PAIRED)
def results_paired(spark, sf_dir):
    out = registry.paired_rows(A.pairs(spark, sf_dir), ["A", "N", "R"], "test")
    return out.withColumns({c: F.round(F.col(c) + _OFF_TIES, 6) for c in ("estimate", "ci_low", "ci_high", "p_raw", "p_adj")})


# Parsers: the tables as text in the sources' forms, parsed back, against the tables.

_TENTHS = "floor({} * 10)::BIGINT"


def _tenths(x, mark=","):
    n = F.floor(x * 10)
    return F.concat(F.floor(n / 10).cast("string"), F.lit(mark), (n % 10).cast("string"))


@_query(f"""WITH e AS (SELECT 'inmet:' || event_type AS station_id, event_id, CASE WHEN event_id % 13 > 0 THEN date_trunc('hour', ts) END AS valid_time, {_TENTHS.format("value")} / 10.0::DOUBLE AS v FROM events),
x AS (SELECT station_id, valid_time, 'precip_1h' AS variable, CASE WHEN event_id % 11 > 0 THEN v END AS value FROM e UNION ALL SELECT station_id, valid_time, 't2m', CASE WHEN event_id % 7 > 0 THEN v + 273.15 END FROM e UNION ALL SELECT station_id, valid_time, 'wind10m', CASE WHEN event_id % 17 > 0 THEN v END FROM e)
SELECT station_id, strftime(valid_time, '%Y-%m-%d %H:%M') AS valid_time, variable, CASE WHEN valid_time IS NOT NULL THEN round(value, 4) END AS value, CASE WHEN valid_time IS NULL THEN 'bad_timestamp' WHEN value IS NULL AND variable = 'wind10m' THEN 'value_unparseable' WHEN value IS NULL THEN 'value_missing' END AS drop_reason FROM x""")
def station_files(spark, sf_dir):
    """Bulk files of one station and day each, with missing, unparseable and mistimed cells."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    k, cell = F.col("event_id"), _tenths(F.col("value"))
    line = F.concat_ws(";", F.date_format("t", "yyyy/MM/dd"), F.concat(F.when(k % 13 == 0, "2500").otherwise(F.date_format("t", "HH00")), F.lit(" UTC")), F.when(k % 11 == 0, "").otherwise(cell), F.when(k % 7 == 0, "-9999").otherwise(cell), F.when(k % 17 == 0, "x").otherwise(cell), F.lit(""))
    head = [*(f"{x}:;" for x in ("REGIAO", "UF", "ESTACAO")), "CODIGO (WMO):;", *(f"{x}:;0" for x in ("LATITUDE", "LONGITUDE", "ALTITUDE", "DATA DE FUNDACAO")), "Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);VENTO, VELOCIDADE HORARIA (m/s);"]
    lines = F.concat(F.array(*(F.concat(F.lit(x), F.col("event_type")) if x.startswith("CODIGO") else F.lit(x) for x in head)), F.collect_list(line))  # a station's day
    files = e.groupBy("event_type", F.to_date("t").alias("day")).agg(F.array_join(lines, "\n").alias("text")).select(F.concat_ws("/", "event_type", F.col("day").cast("string")).alias("path"), "text")
    return observations.parse_station_files(files).select("station_id", _ts(), "variable", F.when(F.col("drop_reason").isNull(), F.round("value", 4)).alias("value"), "drop_reason")


@_query(f"""WITH e AS (SELECT event_type AS station_id, event_id, CASE WHEN event_id % 13 > 0 THEN date_trunc('hour', ts) END AS valid_time, {_TENTHS.format("value")} / 10.0::DOUBLE AS v FROM events),
x AS (SELECT station_id, valid_time, 't2m' AS variable, CASE WHEN event_id % 7 > 0 THEN v + 273.15 END AS value FROM e UNION ALL SELECT station_id, valid_time, 'wind10m', CASE WHEN event_id % 17 > 0 THEN v END FROM e UNION ALL SELECT station_id, valid_time, 'precip_1h', v FROM e)
SELECT variable, CASE WHEN valid_time IS NULL THEN 'bad_timestamp' WHEN value IS NULL AND variable = 'wind10m' THEN 'value_unparseable' WHEN value IS NULL THEN 'value_missing' END AS drop_reason, count(*) AS n, count(DISTINCT (station_id, valid_time)) AS n_times, round(sum(value), 2) AS total FROM x GROUP BY 1, 2""")
def api_records(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    k, cell = F.col("event_id"), _tenths(F.col("value"), ".")
    record = F.to_json(F.struct(F.date_format("t", "yyyy-MM-dd").alias("DT_MEDICAO"), F.when(k % 13 == 0, "9900").otherwise(F.date_format("t", "HH00")).alias("HR_MEDICAO"), F.when(k % 7 > 0, cell).alias("TEM_INS"), F.when(k % 17 == 0, "x").otherwise(cell).alias("VEN_VEL"), cell.alias("CHUVA")))
    parsed = observations.parse_api_records(e.select(F.col("event_type").alias("station_id"), record.alias("json")))
    times = F.count_distinct(F.struct("station_id", "valid_time"))
    return parsed.groupBy("variable", "drop_reason").agg(F.count(F.lit(1)).alias("n"), times.alias("n_times"), F.round(F.sum("value"), 2).alias("total"))


@_query("""WITH k AS (SELECT c_custkey AS k, c_name, c_acctbal FROM customer),
i AS (SELECT 'inmet:A' || k AS station_id, 'inmet' AS network, c_name AS name, -30 - (k % 50) / 100.0::DOUBLE AS lat, floor(c_acctbal)::BIGINT::DOUBLE AS elev_station, CASE WHEN k % 9 = 0 OR k % 8 = 1 THEN 'excluded' ELSE 'included' END AS status, CASE WHEN k % 9 = 0 OR k % 8 = 1 THEN 'inactive' END AS exclusion_reason,
  'inmet_apitempo:/estacoes/T situacao=' || CASE WHEN k % 9 = 0 THEN 'Desativada' WHEN k % 4 = 0 THEN 'NA' ELSE 'Operante' END AS source_meta FROM k),
d AS (SELECT 'isd:' || k || '-99999', 'isd', c_name, -20 - (k % 50) / 100.0::DOUBLE, CASE WHEN k % 6 > 0 THEN (k % 3000)::DOUBLE END, 'included', NULL::VARCHAR, 'ncei:isd-history.csv begin=19900101 end=20260101' FROM k WHERE k % 3 > 0) SELECT * FROM i UNION ALL SELECT * FROM d""")
def canonical_stations(spark, sf_dir):
    """Both inventories mapped to the STATIONS contract."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    at = lambda base, mark: F.concat(F.lit(f"-{base}{mark}"), F.lpad((k % 50).cast("string"), 2, "0"))
    inmet = c.select(F.concat(F.lit("A"), k.cast("string")).alias("CD_ESTACAO"), F.col("c_name").alias("DC_NOME"), F.lit("RS").alias("SG_ESTADO"), at(30, ",").alias("VL_LATITUDE"), F.lit("-51,10").alias("VL_LONGITUDE"), F.floor("c_acctbal").cast("string").alias("VL_ALTITUDE"), F.when(k % 8 == 1, "2020-01-01").alias("DT_FIM_OPERACAO"), F.when(k % 9 == 0, "Desativada").when(k % 4 == 0, "").otherwise("Operante").alias("CD_SITUACAO"))
    isd = c.select(k.cast("string").alias("USAF"), F.lit("99999").alias("WBAN"), F.col("c_name").alias("STATION NAME"), F.when(k % 3 > 0, "BR").otherwise("AR").alias("CTRY"), at(20, ".").alias("LAT"), F.lit("-51.1").alias("LON"), F.when(k % 6 == 0, "-0999.9").otherwise((k % 3000).cast("string")).alias("ELEV(M)"), F.lit("19900101").alias("BEGIN"), F.lit("20260101").alias("END"))
    kept = station_sources.tag_isd_history(isd).where("drop_reason is null")
    out = station_sources.to_canonical(inmet, kept, "test", inactive_end_cutoff="2025-01-01")
    return out.select("station_id", "network", "name", "lat", "elev_station", "status", "exclusion_reason", "source_meta")


@_query("""WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT CASE WHEN k % 11 = 0 THEN 'missing_value' WHEN k % 17 = 0 THEN 'malformed_line' WHEN k % 30 > 27 THEN 'bad_date' END AS drop_reason, CASE WHEN k % 17 > 0 OR k % 11 = 0 THEN (k % 8 + 1)::INT END AS phase, count(*) AS n, round(sum((k % 40) / 10.0::DOUBLE), 3) AS amplitude FROM o GROUP BY 1, 2""")
def rmm_parse(spark, sf_dir):
    k = F.col("k")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")).distinct()
    line = F.concat_ws("  ", F.lit("2001"), F.lit("2"), (k % 30 + 1).cast("string"), F.when(k % 11 == 0, "1.E36").otherwise("0.5"), F.lit("-0.25"), F.when((k % 17 == 0) & (k % 11 > 0), "x").otherwise((k % 8 + 1).cast("string")), ((k % 40) / 10.0).cast("string"), F.lit("Final_value"))
    return indices.parse_rmm(o.select(line.alias("line"))).groupBy("drop_reason", "phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amplitude"), 3).alias("amplitude"))


_FILED = "o AS (SELECT o_orderkey AS k, (o_custkey % 50)::VARCHAR AS file, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey, o_totalprice) AS line_no FROM orders)"


def _filed(spark, sf_dir):
    from pyspark.sql import Window as W

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    file = (F.col("o_custkey") % 50).cast("string")
    return o.select(F.col("o_orderkey").alias("k"), file.alias("file"), F.row_number().over(W.partitionBy(file).orderBy("o_orderkey", "o_totalprice")).alias("line_no"))


@_query(f"WITH {_FILED} SELECT file, line_no::INT AS line_no, ['2t', '10u', '10v', 'tp', 'msl'][k % 5 + 1] AS var, 'sfc' AS level, k * 1000 AS start, k * 1000 + 900 + k % 100 AS stop FROM o WHERE k % 5 < 4 AND k % 3 = 1")
def ecmwf_index(spark, sf_dir):
    """JSON index lines of one step's wanted fields."""
    k = F.col("k")
    o = _filed(spark, sf_dir)
    var = F.element_at(F.array(*map(F.lit, ("2t", "10u", "10v", "tp", "msl"))), (k % 5 + 1).cast("int"))
    line = F.to_json(F.struct(F.lit("fc").alias("type"), (k % 3 * 24).cast("string").alias("step"), F.lit("sfc").alias("levtype"), var.alias("param"), (k * 1000).alias("_offset"), (900 + k % 100).alias("_length")))
    entries = gridindex.parse_ecmwf_index(o.select("file", "line_no", line.alias("line")))
    return gridindex.select_ecmwf(entries, 24).select("file", "line_no", "var", "level", "start", "stop")


@_query(f"WITH {_FILED} SELECT file, count(*) AS n, count_if(k % 2 = 0)::BIGINT AS n_rain, sum(k)::BIGINT AS starts FROM o WHERE k % 2 = 1 OR k % 4 = 0 GROUP BY 1")
def apcp_bucket(spark, sf_dir):
    """Of rain entries only the six-hour bucket that ends at the lead."""
    k = F.col("k")
    rain = F.when(k % 4 == 0, "18-24 hour acc fcst").otherwise("0-24 hour acc fcst")
    entries = _filed(spark, sf_dir).select("file", "line_no", F.when(k % 2 == 0, "APCP").otherwise("TMP").alias("var"), F.lit("surface").alias("level"), F.when(k % 2 == 0, rain).otherwise(F.lit("24 hour fcst")).alias("meta"), k.alias("start"), (k + 1).alias("stop"))
    return gridindex.pick_apcp(entries, 24).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("var") == "APCP").alias("n_rain"), F.sum("start").alias("starts"))


_RASTER = "raster AS (SELECT (id // 720)::BIGINT AS r, (id % 720)::BIGINT AS c, CASE WHEN id * 7 % 5 < 3 THEN 0 ELSE (id * 31 % 30 + 1) END::INT AS code FROM range(259200) t(id))"


@_query(f"""WITH {A.STATIONS}, {_RASTER}, pl AS (SELECT station_id, floor((lat + 90) / 0.5)::BIGINT AS y, floor((lon + 180) / 0.5)::BIGINT AS x FROM stations),
near AS (SELECT station_id, code, r = y AND c = x AS own FROM pl JOIN raster ON abs(r - y) <= 1 AND abs(c - x) <= 1), votes AS (SELECT station_id, code, count(*) AS n FROM near WHERE code > 0 GROUP BY 1, 2)
SELECT station_id, coalesce((SELECT any_value(code) FROM near WHERE near.station_id = pl.station_id AND own AND code > 0), (SELECT arg_min(code, (-n, code)) FROM votes WHERE votes.station_id = pl.station_id)) AS code FROM pl""")
def koppen_vote(spark, sf_dir):
    """The climate class at every station, or of its surroundings where its own cell is sea."""
    k = F.col("id")
    raster = spark.range(360 * 720).select(F.floor(k / 720).alias("row"), (k % 720).alias("col"), F.when(k * 7 % 5 < 3, 0).otherwise(k * 31 % 30 + 1).cast("int").alias("code"))
    codes = F.create_map(*(F.lit(x) for code, name in station_sources.KOPPEN.items() for x in (name, code)))
    return station_sources.koppen_lookup(A.stations(spark, sf_dir), raster, 0.5).select("station_id", F.element_at(codes, F.col("koppen")).alias("code"))


_FIELDS = "f AS (SELECT j, i, lat, lon, value, l.lead FROM grid, (VALUES (24), (48)) l(lead))"


def _fields(spark, *names):
    """The test grid as fields of one run at two leads."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("short_name"), (F.col("value") * w + F.col("lead_hours")).alias("v")) for n, w in names))).alias("x")
    leads = _grid(spark).withColumn("lead_hours", F.explode(F.array(F.lit(24), F.lit(48))))
    return leads.select("j", "i", "lead_hours", each).select(F.lit("gfs").alias("model"), F.lit("2024-01-01").cast("timestamp").alias("init_time"), "lead_hours", "x.short_name", "j", "i", F.col("x.v").alias("value"))


@_query(f"""WITH {A.STATIONS}, {_GRID}, {_FIELDS}, w AS (SELECT station_id, lead, value, greatest(0, 1 - abs(y - lat) / 0.5) * greatest(0, 1 - abs(x - lon) / 0.5) AS w FROM s, f WHERE abs(y - lat) < 0.5 AND abs(x - lon) < 0.5)
SELECT station_id, lead AS lead_hours, 't2m' AS variable, round(sum(w * (value + lead)), 6) AS value FROM w GROUP BY 1, 2 UNION ALL SELECT station_id, lead, 'wind10m', round(sum(w * sqrt(pow(value * 2 + lead, 2) + pow(value * 3 + lead, 2))), 6) FROM w GROUP BY 1, 2""")
def grid_points(spark, sf_dir):
    """Temperature and wind speed at stations from gridded fields: speed at the nodes first, then bilinear."""
    weights = geo.grid_weights(A.stations(spark, sf_dir), _grid(spark))
    points = matching.instantaneous_points(_fields(spark, ("2t", 1), ("10u", 2), ("10v", 3)), weights)
    return points.select("station_id", "lead_hours", "variable", F.round("value", 6).alias("value"))


@_query(f"WITH {A.STATIONS}, {_GRID}, {_FIELDS}, node AS (SELECT station_id, arg_min(j, (abs(y - lat), j)) AS j, arg_min(i, (abs(x - lon), i)) AS i FROM s, grid GROUP BY 1) SELECT station_id, lead AS lead_hours, round(CASE lead WHEN 24 THEN (value + lead) * 1000 ELSE value + lead END, 6) AS value FROM node JOIN f USING (j, i)")
def grid_rain(spark, sf_dir):
    """Rain at each station's nearest node in mm, from metres at one lead and kg m-2 at the other."""
    fields = _fields(spark, ("tp", 1)).withColumn("units", F.when(F.col("lead_hours") == 24, "m").otherwise("kg m-2"))
    points = matching.precip_points(fields, geo.nearest_nodes(A.stations(spark, sf_dir), _grid(spark)))
    return points.select("station_id", "lead_hours", F.round("value", 6).alias("value"))


@_query(f"""WITH {A.MONTHLY}, {_MATCHED} SELECT model, count(*) AS n, round(sum(fcst), 4) AS fcst, count(*) AS n_csv, round(sum(obs), 4) AS obs, (SELECT count(*) FROM matched) AS n_rows, (SELECT count(*) FROM k) AS n_keys, 'test' AS ingest_version FROM matched GROUP BY 1""")
def stored_view(spark, sf_dir):
    """A matched view as Parquet with a manifest and metadata, and as CSV; both are read back."""
    path = sinks.new_folder(spark, "stored_view")
    view = matching.matched_view(A.monthly_pairs(spark, sf_dir), ["R", "A", "N"], 1)
    manifest = json.loads(sinks.write_view(view, path, ["valid_time", "station_id", "variable"], ingest_version="test"))
    back = spark.read.parquet(f"{path}/view")
    sinks.write_csv(back.select("model", "obs"), f"{path}/csv")
    lines = spark.read.csv(f"{path}/csv", header=True, schema="model string, obs double").groupBy("model").agg(F.count(F.lit(1)).alias("n_csv"), F.round(F.sum("obs"), 4).alias("obs"))
    sums = back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("fcst"), 4).alias("fcst"))
    told = {"n_rows": F.lit(manifest["rows"]), "n_keys": F.lit(manifest["keys"]), "ingest_version": F.lit(back.schema["obs"].metadata["ingest_version"])}
    return sums.join(lines, "model").withColumns(told)


@_query(f"WITH {A.PAIRS} SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, count(DISTINCT station_id) AS n_stations, round(sum(obs), 4) AS obs FROM pairs GROUP BY 1")
def stored_months(spark, sf_dir):
    """Pairs written by month, sorted by station within files, and read back by their partitions."""
    path = sinks.new_folder(spark, "stored_months")
    sinks.write_table(A.pairs(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM")), path, ["month"], ["station_id"])
    back = spark.read.option("basePath", path).schema("station_id string, obs double, month string").parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("station_id").alias("n_stations"), F.round(F.sum("obs"), 4).alias("obs"))


@_query("""WITH e AS (SELECT o_custkey AS k, o_orderdate AS t, sum(o_orderkey)::BIGINT AS bytes, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2), n AS (SELECT k, arg_max(bytes, t) AS bytes, arg_max(s, t) AS s FROM e GROUP BY 1)
SELECT 'orders/' || c_custkey AS url, bytes, CASE s WHEN 'F' THEN 'fetched' WHEN 'O' THEN 'failed' WHEN 'P' THEN 'pruned' END AS status, coalesce(s = 'O', true) AS pending FROM customer LEFT JOIN n ON k = c_custkey""")
def manifest_append(spark, sf_dir):
    """A manifest of older files takes newer ones; what is then still to fetch."""
    o, wanted = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    status = F.element_at(F.create_map(*map(F.lit, ("F", "fetched", "O", "failed", "P", "pruned"))), F.max("o_orderstatus"))
    made = o.groupBy(F.concat(F.lit("orders/"), F.col("o_custkey")).alias("url"), F.col("o_orderdate").cast("timestamp").alias("downloaded_at")).agg(F.sum("o_orderkey").alias("bytes"), status.alias("status"))
    entries = made.select(*((F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in C.MANIFEST))
    late = F.year("downloaded_at") >= 1996
    manifest = sinks.append_manifest(entries.where(~late), entries.where(late))
    urls = wanted.select(F.concat(F.lit("orders/"), F.col("c_custkey")).alias("url"))
    pending = sinks.to_fetch(urls, manifest).withColumn("pending", F.lit(True))
    return urls.join(manifest.select("url", "bytes", "status"), "url", "left").join(pending, "url", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


@_query("""WITH f AS (SELECT (l_orderkey * 7 + l_linenumber) % 64 AS f FROM lineitem) SELECT concat_ws(',', CASE WHEN f & 1 > 0 THEN 'RANGE' END, CASE WHEN f & 2 > 0 THEN 'STEP' END, CASE WHEN f & 4 > 0 THEN 'PERSISTENCE' END, CASE WHEN f & 8 > 0 THEN 'SPATIAL' END, CASE WHEN f & 16 > 0 THEN 'METADATA' END, CASE WHEN f & 32 > 0 THEN 'DUPLICATE' END) AS names,
f & 3 = 0 AS clean, count(*) AS n FROM f GROUP BY 1, 2""")
def flag_names(spark, sf_dir):
    """Rows by the names of their QC bits, and whether range and step find them clean."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 64).cast("int").alias("f"))
    return rows.groupBy(F.array_join(C.describe(F.col("f")), ",").alias("names"), C.is_clean(F.col("f"), C.RANGE | C.STEP).alias("clean")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {A.STATIONS}, c AS (SELECT CASE WHEN status <> 'included' THEN 'none' WHEN NOT (lat BETWEEN -29 AND -27 AND lon BETWEEN -54 AND -51) THEN 'outside_bbox' WHEN network = 'isd' THEN 'out_of_scope' WHEN abs(elev_station - elev_dem) > 80 THEN 'elev_diff_gt_80m' ELSE 'none' END AS cause, status FROM stations)
SELECT CASE cause WHEN 'none' THEN status WHEN 'elev_diff_gt_80m' THEN 'review' ELSE 'excluded' END AS status, nullif(cause, 'none') AS reason, count(*) AS n FROM c GROUP BY 1, 2""")
def station_status(spark, sf_dir):
    """Stations by status and folded reason after the box, a network that is out of scope, and the terrain check."""
    boxed = geo.clip_bbox(A.stations(spark, sf_dir), (-29.0, -27.0), (-54.0, -51.0))
    return station_sources.status_counts(geo.review_elevation(geo.exclude_network(boxed, "isd", "out_of_scope:isd"), 80.0))


@_query(f"WITH {A.STATIONS} SELECT station_id, name, status FROM stations WHERE station_id = '17' OR contains(upper(name), '17')")
def station_search(spark, sf_dir):
    return station_sources.find_station(A.stations(spark, sf_dir), "17").select("station_id", "name", "status")


@_query(f"WITH {A.ORDER_OBS} SELECT station_id, count(*) AS n, min(valid_time)::DATE AS first_day, max(valid_time)::DATE AS last_day, round(avg(value), 6) AS value FROM order_obs WHERE valid_time::DATE BETWEEN '1995-03-01' AND '1996-02-29' GROUP BY 1")
def obs_window(spark, sf_dir):
    clipped = observations.clip_window(A.order_obs(spark, sf_dir), "1995-03-01", "1996-02-29")
    return clipped.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("valid_time")).alias("first_day"), F.to_date(F.max("valid_time")).alias("last_day"), F.round(F.avg("value"), 6).alias("value"))


@_query(f"WITH {A.FORECASTS} SELECT model, variable, valid_time::DATE AS day, count(*) AS n, round(avg(CASE variable WHEN 't2m' THEN coalesce({_ADJUSTED}, value) ELSE value END), 6) AS fcst FROM tagged WHERE drop_reason IS NULL GROUP BY 1, 2, 3")
def fcst_input(spark, sf_dir):
    """The forecast that errors are made of, adjusted for temperature only, by day."""
    fact = matching.build_fact(A.forecast_points(spark, sf_dir), A.obs_qc(spark, sf_dir), A.event_stations(spark, sf_dir), "test", min_clean_hours=12)
    return metrics.forecast_column(fact).groupBy("model", "variable", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fcst"), 6).alias("fcst"))


@_query(f"""WITH r AS (SELECT o_orderkey AS k, date_trunc('day', o_orderdate) + to_hours(6 * (o_orderkey % 4)) AS init, (o_orderkey % 40 * 3)::INT AS lead FROM orders) SELECT k, '{gridindex.GFS_BASE}/gfs.' || strftime(init, '%Y%m%d/%H') || '/atmos/gfs.t' || strftime(init, '%H') || 'z.pgrb2.0p25.f' || lpad(lead::VARCHAR, 3, '0') AS gfs,
'{gridindex.ECMWF_BASE}/' || strftime(init, '%Y%m%d/%H') || 'z/ifs/0p25/oper/' || strftime(init, '%Y%m%d%H') || '0000-' || lead || 'h-oper-fc.grib2' AS hres, 'bytes=' || k || '-' || CASE WHEN k % 7 > 0 THEN (2 * k + 9)::VARCHAR ELSE '' END AS bytes FROM r""")
def run_urls(spark, sf_dir):
    """Addresses of runs and leads, with byte ranges, the last of a file open."""
    k, lead = F.col("k"), F.col("lead")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.date_trunc("day", F.col("o_orderdate").cast("timestamp")) + F.make_dt_interval(hours=(F.col("o_orderkey") % 4 * 6).cast("int"))).alias("init"), (F.col("o_orderkey") % 40 * 3).cast("int").alias("lead"))
    return o.select("k", gridindex.gfs_url(F.col("init"), lead).alias("gfs"), gridindex.ecmwf_url(F.col("init"), lead, "hres").alias("hres"), gridindex.http_range(k, F.when(k % 7 > 0, 2 * k + 10)).alias("bytes"))


#: The automatic block length: autocovariances, the first lag from which five in a row are small, the flat-top sums.
_BLOCKS = """e AS (SELECT model, lead_hours, day, avg(fcst - obs) AS x FROM pairs GROUP BY 1, 2, 3),
c AS (SELECT model, lead_hours, x - avg(x) OVER g AS x, row_number() OVER (PARTITION BY model, lead_hours ORDER BY day) AS t, count(*) OVER g AS n, max(x) OVER g > min(x) OVER g AS varies FROM e WINDOW g AS (PARTITION BY model, lead_hours)),
z AS (SELECT model, lead_hours, any_value(n) AS n, any_value(varies) AS varies, ceil(sqrt(any_value(n)))::BIGINT + 5 AS far FROM c GROUP BY 1, 2),
v AS (SELECT a.model, a.lead_hours, b.t - a.t AS k, sum(a.x * b.x) / any_value(z.n) AS cov FROM c a JOIN c b USING (model, lead_hours) JOIN z USING (model, lead_hours) WHERE b.t BETWEEN a.t AND a.t + 2 * far GROUP BY 1, 2, 3),
s AS (SELECT v.*, abs(cov) <= 2 * sqrt(log10(n) / n) * (first_value(cov) OVER (PARTITION BY model, lead_hours ORDER BY k)) AS small, n, far FROM v JOIN z USING (model, lead_hours)),
w AS (SELECT *, bool_and(small) OVER r AND count(*) OVER r = 5 AS quiet FROM s WHERE k > 0 WINDOW r AS (PARTITION BY model, lead_hours ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
o AS (SELECT model, lead_hours, n, varies, least(2 * coalesce(min(k - 1) FILTER (quiet AND k - 1 <= w.far), any_value(z.far)), n - 1) AS b FROM z LEFT JOIN w USING (model, lead_hours, n) GROUP BY 1, 2, 3, 4),
f AS (SELECT model, lead_hours, n, varies, b, sum(CASE WHEN k > 0 THEN 2 ELSE 1 END * least(1, 2 - 2 * k / b) * cov) FILTER (k <= b) AS spectrum, sum(2 * k * least(1, 2 - 2 * k / b) * cov) FILTER (k <= b) AS curve FROM o LEFT JOIN v USING (model, lead_hours) GROUP BY 1, 2, 3, 4, 5),
l AS (SELECT model, lead_hours, n, CASE WHEN n < 4 OR NOT varies OR b = 0 OR spectrum = 0 THEN 1 ELSE least(greatest(cbrt(2 * n * curve * curve / (4 / 3 * spectrum * spectrum)), 1), ceil(least(3 * sqrt(n), n / 3))) END AS best FROM f)"""


@_query(f"WITH {A.PAIRS}, {_BLOCKS} SELECT model, lead_hours, n::INT AS n_days, least(n, greatest(ceil(best), 2), 30)::INT AS block_len_days FROM l")
def block_lengths(spark, sf_dir):
    """Automatic lengths of the bootstrap's blocks."""
    return bootstrap.block_bootstrap(A.pairs(spark, sf_dir), ["model", "lead_hours"], ["bias"], n_boot=N_BOOT).select("model", "lead_hours", "n_days", "block_len_days")
