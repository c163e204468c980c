"""Daily scores of exactly matched models, kept by month; only months that are new or have changed are computed.

    python -m jobs.monthly_scores --pairs PATH --out PATH [--config FILE]

Reads a Parquet table of forecasts with their observations; ``columns`` of the configuration says, as SQL expressions, how its
columns become those of this domain. Every two models, and all of them, are compared over the keys that each of them has under the
QC mask, all comparisons from one scan and one shuffle of the pending months. Under ``--out``:

* ``scores``, partitioned by month: (comparison_id, model, variable, lead_hours, day, n_pairs, bias, mae, rmse)
* ``ledger``, partitioned by month: (rows_in, digest, version), the mark of what the scores were made of

A run digests the input by month and compares with the ledger: a month is pending if it is not there, if its rows have
changed, or if it was made under another configuration. Pending months are written by dynamic partition overwrite, their
scores before their marks, so that a run that dies is made good by the next one, and a run without news writes nothing. A month
that has left the input keeps its scores. Each partition also holds one row without a comparison, so that a month that has lost its last
matched pair is replaced like others; ``read_scores`` leaves these rows out.

Rows are counted while they are written: those without a time belong to no month, those of other models, with a missing value or a
masked flag take no part; counts must add up.
"""

from __future__ import annotations

import calendar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemark.functions import contracts as C
from gaugemark.operators import matching, metrics
from gaugemark.sources import sinks
from jobs import common

JOB, VERSION = "monthly_scores", "1"
NEEDED = {"model": "string", "station_id": "string", "variable": "string", "valid_time": "timestamp", "lead_hours": "int", "fcst": "double", "obs": "double", "qc_flags": "int"}
SCORES = T.StructType([T.StructField(n, t) for n, t in (("comparison_id", T.StringType()), ("model", T.StringType()), ("variable", T.StringType()), ("lead_hours", T.IntegerType()), ("day", T.DateType()), ("n_pairs", T.LongType()), ("bias", T.DoubleType()), ("mae", T.DoubleType()), ("rmse", T.DoubleType()), ("month", T.StringType()))])
LEDGER = T.StructType([T.StructField(n, t) for n, t in (("rows_in", T.LongType()), ("digest", T.StringType()), ("version", T.StringType()), ("month", T.StringType()))])


def read_pairs(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The input in this domain's columns, with ``month`` (null without a time); only the columns that are named are read."""
    if missing := NEEDED.keys() - columns.keys():
        raise ValueError(f"the configuration names no columns for {sorted(missing)}")
    pairs = spark.read.parquet(path).select(*(F.expr(columns[c]).cast(t).alias(c) for c, t in NEEDED.items()))
    return pairs.withColumn("month", F.date_format("valid_time", "yyyy-MM"))


def digests(pairs: DataFrame, version: str) -> DataFrame:
    """The ledger's rows of the input as it is, and one of rows without a month: sums of row hashes, which no order or partitioning changes."""
    row = F.xxhash64(*NEEDED).cast("decimal(38,0)")
    return pairs.groupBy("month").agg(F.count(F.lit(1)).alias("rows_in"), F.sum(row).cast("string").alias("digest")).withColumn("version", F.lit(version)).select(LEDGER.names)


def scores(pairs: DataFrame, config: dict) -> tuple[DataFrame, Observation]:
    """SCORES of all comparisons, and an observation that gets the count of each drop reason from the very job that uses them."""
    models, mask = sorted(set(config["models"])), config.get("mask", C.ALL_BITS)
    clean = F.coalesce(C.is_clean(F.col("qc_flags"), mask), F.lit(False))
    reason = F.when(~F.coalesce(F.col("model").isin(*models), F.lit(False)), "other_model").when(F.col("fcst").isNull() | F.col("obs").isNull(), "value_missing").when(~clean, "flagged")
    tagged, seen = C.watched(pairs.withColumn("drop_reason", reason), ("other_model", "value_missing", "flagged"))
    matched = matching.matched_views(tagged.where("drop_reason is null"), models, mask, ("valid_time", "station_id", "variable", "lead_hours"))
    by = ["month", "comparison_id", "model", "variable", "lead_hours", "day"]
    return metrics.error_stats(matched.withColumn("day", F.to_date("valid_time")), by).select(SCORES.names), seen


def within(months: list[str]):
    """The months as a filter that reaches the scan as a range of times too."""
    year, month = map(int, months[-1].split("-"))
    last = f"{months[-1]}-{calendar.monthrange(year, month)[1]:02d}"
    time = F.col("valid_time")
    return F.col("month").isin(*months) & (time >= F.lit(f"{months[0]}-01").cast("timestamp")) & (time < F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY"))


def write_months(df: DataFrame, path: str) -> None:
    """Replace the partitions of ``df``'s months and no others; a large month is split among files."""
    df.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def run(spark: SparkSession, pairs: str, out: str, config: dict) -> dict:
    """Bring the scores up to date; returns what the run did: months read, written, and the counts of rows."""
    version = f"{VERSION}+{sinks.config_hash(config)}"
    rows = read_pairs(spark, pairs, config["columns"])
    now = digests(rows, version)
    done = common.read_if_there(spark, f"{out}/ledger", LEDGER)
    news = [r.asDict() for r in now.join(done, LEDGER.names, "left_anti").orderBy("month").collect()]  # a row a month
    pending, without_time = [r for r in news if r["month"] is not None], sum(r["rows_in"] for r in news if r["month"] is None)
    months = [r["month"] for r in pending]
    common.said(JOB, read=pairs, version=version, pending=months, without_time=without_time)
    if not pending:
        return {"months": [], "rows_in": 0, "rows_out": 0, "dropped": {}, "without_time": without_time}
    made, seen = scores(rows.where(within(months)), config)
    marks = spark.createDataFrame([(m, 0) for m in months], "month string, n_pairs long").select(*(F.col(f.name) if f.name in ("month", "n_pairs") else F.lit(None).cast(f.dataType).alias(f.name) for f in SCORES))
    write_months(made.unionByName(marks), f"{out}/scores")
    record = C.reconciled(JOB, seen)
    if record["rows_in"] != sum(r["rows_in"] for r in pending):
        raise C.ReconciliationError(f"{JOB}: the input changed while it was read: {sum(r['rows_in'] for r in pending)} rows digested, {record['rows_in']} scored")
    write_months(spark.createDataFrame([tuple(r[n] for n in LEDGER.names) for r in pending], LEDGER), f"{out}/ledger")
    common.said(JOB, wrote=f"{out}/scores", months=months, **record)
    return {"months": months, "without_time": without_time, **{k: record[k] for k in ("rows_in", "rows_out", "dropped")}}


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    return common.read_if_there(spark, f"{out}/scores", SCORES).where("comparison_id is not null")


if __name__ == "__main__":
    common.command_line(JOB, __file__, {"pairs": "Parquet table of forecasts with observations"}, run)
