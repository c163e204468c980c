"""Byte indexes of gridded forecast files: entries, selection, ranges and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fields that are used, as the index files name them.
GFS_WANTED = (("TMP", "2 m above ground"), ("UGRD", "10 m above ground"), ("VGRD", "10 m above ground"), ("APCP", "surface"))
ECMWF_WANTED = ("2t", "10u", "10v", "tp")
PRODUCTS = {"hres": "ifs/0p25/oper", "aifs": "aifs-single/0p25/oper"}
GFS_BASE, ECMWF_BASE = "https://noaa-gfs-bdp-pds.s3.amazonaws.com", "https://ecmwf-forecasts.s3.eu-central-1.amazonaws.com"


def parse_gfs_index(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) -> file, line_no, var, level, meta, start, stop; the last entry of a file is open."""
    parts = lines.where(F.trim("line") != "").withColumn("p", F.split("line", ":"))
    part = lambda i: F.when(F.size("p") >= 6, F.get("p", F.lit(i))).otherwise(F.raise_error(F.concat(F.lit("malformed index line: "), F.col("line"))).cast("string"))
    rows = parts.select("file", "line_no", part(3).alias("var"), part(4).alias("level"), part(5).alias("meta"), part(1).cast("long").alias("start"))
    return rows.withColumn("stop", F.lead("start").over(W.partitionBy("file").orderBy("line_no")))


def parse_ecmwf_index(lines: DataFrame) -> DataFrame:
    """JSON lines (file, line_no, line) in the same form, with the forecast step."""
    r = F.from_json("line", "param string, levtype string, step string, _offset long, _length long")
    rows = lines.where(F.trim("line") != "").select("file", "line_no", "line", r.alias("r"))
    return rows.select("file", "line_no", F.col("r.param").alias("var"), F.coalesce("r.levtype", F.lit("")).alias("level"), F.col("line").alias("meta"), F.col("r._offset").alias("start"), (F.col("r._offset") + F.col("r._length")).alias("stop"), F.col("r.step").alias("step"))


def select_gfs(entries: DataFrame, wanted=GFS_WANTED) -> DataFrame:
    """Wanted fields; of equal descriptions in a file the first."""
    keep = F.concat_ws("\u0001", "var", "level").isin(*(f"{v}\u0001{lv}" for v, lv in wanted))
    nth = F.row_number().over(W.partitionBy("file", "var", "level", "meta").orderBy("line_no"))
    return entries.where(keep).withColumn("nth", nth).where("nth = 1").drop("nth")


def select_ecmwf(entries: DataFrame, step: int, wanted=ECMWF_WANTED) -> DataFrame:
    return entries.where(F.col("var").isin(*wanted) & (F.col("step") == str(step)))


def pick_apcp(entries: DataFrame, lead: Column | int) -> DataFrame:
    """Of rain entries only the six-hour bucket that ends at the lead; a file with rain but without it raises."""
    lead = F.lit(lead) if isinstance(lead, int) else lead
    bucket = F.concat((lead - 6).cast("string"), F.lit("-"), lead.cast("string"), F.lit(" hour acc fcst"))
    rain, right = F.col("var") == "APCP", F.col("meta") == bucket
    has = F.max(rain & right).over(W.partitionBy("file"))
    out = entries.withColumn("_has", has).withColumn("_keep", F.when(rain & ~F.col("_has"), F.raise_error(F.concat(F.lit("no six-hour rain bucket in "), F.col("file"))).cast("boolean")).otherwise(~rain | right))
    return out.where("_keep").drop("_has", "_keep")


def coalesce_ranges(entries: DataFrame, max_gap: int = 0) -> DataFrame:
    """(file, start, stop) of merged byte ranges; an open entry ends its range."""
    order = W.partitionBy("file").orderBy("start", F.col("stop").asc_nulls_last())
    reach = F.max(F.coalesce("stop", F.lit((1 << 62)))).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start") <= F.col("_reach") + max_gap, 0).otherwise(1)
    rows = entries.withColumn("_reach", reach).withColumn("_new", new).withColumn("_range", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    stop = F.when(F.count_if(F.col("stop").isNull()) == 0, F.max("stop"))
    return rows.groupBy("file", "_range").agg(F.min("start").alias("start"), stop.alias("stop")).drop("_range")


def http_range(start: Column, stop: Column) -> Column:
    return F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), F.coalesce((stop - 1).cast("string"), F.lit("")))


def gfs_url(init: Column, lead: Column, base: str = GFS_BASE) -> Column:
    return F.concat(F.lit(f"{base}/gfs."), F.date_format(init, "yyyyMMdd/HH"), F.lit("/atmos/gfs.t"), F.date_format(init, "HH"), F.lit("z.pgrb2.0p25.f"), F.lpad(lead.cast("string"), 3, "0"))


def ecmwf_url(init: Column, lead: Column, model: str, base: str = ECMWF_BASE) -> Column:
    if model not in PRODUCTS:
        raise ValueError(f"unknown model {model}")
    return F.concat(F.lit(f"{base}/"), F.date_format(init, "yyyyMMdd/HH"), F.lit(f"z/{PRODUCTS[model]}/"), F.date_format(init, "yyyyMMddHH"), F.lit("0000-"), lead.cast("string"), F.lit("h-oper-fc.grib2"))


def month_coverage(present: DataFrame, days: DataFrame, runs_per_day: int = 1) -> DataFrame:
    """Expected days against present runs: (source, month, expected, present, cell) with complete, partial or absent.

    ``present``: (source, day); ``days``: (day). Expected keys come from the calendar, not from what is there.
    """
    calendar = days.agg(F.collect_set("day").alias("days"))  # one row, of the calendar's days
    expected = present.select("source").distinct().join(F.broadcast(calendar)).select("source", F.explode("days").alias("day"))
    got = present.groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))
    out = expected.join(got, ["source", "day"], "left").groupBy("source", F.date_format("day", "yyyy-MM").alias("month")).agg((F.count(F.lit(1)) * runs_per_day).alias("expected"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.lit(runs_per_day))).alias("present"))
    return out.withColumn("cell", F.when(F.col("present") == 0, "absent").when(F.col("present") < F.col("expected"), "partial").otherwise("complete"))


def lead_completeness(present: DataFrame, runs: DataFrame, leads: list[int]) -> DataFrame:
    """Of every run (source, init_time) the leads that are there and those that lack, its bytes and whether it is complete.

    ``present``: (source, init_time, lead_hours, bytes), a row for each file or range; ``leads`` are the expected ones.
    """
    wanted = F.array(*(F.lit(int(x)) for x in leads))
    got = present.where(F.col("lead_hours").isin(*leads)).groupBy("source", "init_time").agg(F.array_sort(F.collect_set(F.col("lead_hours").cast("int"))).alias("found"), F.sum("bytes").alias("bytes"))
    out = runs.select("source", "init_time").distinct().join(got, ["source", "init_time"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<int>")))
    lacks = F.array_except(wanted, "found")
    return out.select("source", "init_time", F.size("found").alias("n_leads"), lacks.alias("missing"), F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.size(lacks) == 0).alias("complete"))


def bytes_by_run(completeness: DataFrame) -> DataFrame:
    """By source: complete and all runs, median bytes of a complete run."""
    whole = F.when(F.col("complete"), F.col("bytes"))
    return completeness.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.count_if("complete").alias("complete_runs"), F.median(whole).alias("median_bytes"))


def missing_days(present: DataFrame, days: DataFrame, source: str) -> DataFrame:
    return days.join(present.where(F.col("source") == source).select("day").distinct(), "day", "left_anti")
