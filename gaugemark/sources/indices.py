"""Climate index tables (text lines) as rows; dropped lines are tagged with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Three-month seasons by centre month.
SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")
MISSING_ABOVE = 1e35


def parse_oni(lines: DataFrame) -> DataFrame:
    """``line``: SEAS YR TOTAL ANOM -> year, month, oni, drop_reason; other lines are no data."""
    parts = lines.select(F.split(F.trim("line"), r"\s+").alias("p"))
    month = F.array_position(F.array(*map(F.lit, SEASONS)), F.get("p", F.lit(0))).cast("int")
    rows = parts.where(F.size("p") == 4).withColumns({"month": month, "year": F.expr("try_cast(p[1] as int)"), "oni": F.expr("try_cast(p[3] as double)")}).where("month > 0")
    return rows.select("year", "month", "oni", F.when(F.col("year").isNull() | F.col("oni").isNull(), "malformed_line").alias("drop_reason"))


def parse_rmm(lines: DataFrame) -> DataFrame:
    """``line``: year month day RMM1 RMM2 phase amplitude ... -> date, rmm1, rmm2, phase, amplitude, drop_reason."""
    parts = lines.select(F.split(F.trim("line"), r"\s+").alias("p")).where(F.size("p") >= 7)
    cast = lambda i, t: F.expr(f"try_cast(p[{i}] as {t})")
    rows = parts.select(cast(0, "int").alias("y"), cast(1, "int").alias("m"), cast(2, "int").alias("d"), cast(3, "double").alias("rmm1"), cast(4, "double").alias("rmm2"), cast(5, "double").cast("int").alias("phase"), cast(6, "double").alias("amplitude"))
    rows = rows.where("y is not null and m is not null and d is not null").withColumn("date", F.expr("cast(try_make_timestamp(y, m, d, 0, 0, 0) as date)"))
    broken = F.col("rmm1").isNull() | F.col("rmm2").isNull() | F.col("phase").isNull() | F.col("amplitude").isNull()
    reason = F.when(broken, "malformed_line").when((F.abs("rmm1") > MISSING_ABOVE) | (F.abs("rmm2") > MISSING_ABOVE), "missing_value").when(F.col("date").isNull(), "bad_date")
    return rows.select("date", "rmm1", "rmm2", "phase", "amplitude", reason.alias("drop_reason"))
