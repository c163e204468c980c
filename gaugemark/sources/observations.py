"""Parsers of station observations: text in, rows in the OBS contract out.

Every parser tags rows: one potential row for each line and variable, with ``drop_reason`` null where a
value came out. ``emitted`` keeps those, ``drop_counts`` counts the others, so rows always reconcile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..workers import ship
from .zips import ZipSource

MISSING, TRACE = -9999, -1
#: Column titles of the bulk station files (without accents) and the variables they hold.
BULK_COLUMNS = {"PRECIPITACAO TOTAL": "precip_1h", "TEMPERATURA DO AR - BULBO SECO": "t2m", "VENTO, VELOCIDADE": "wind10m"}
API_COLUMNS = {"TEM_INS": "t2m", "VEN_VEL": "wind10m", "CHUVA": "precip_1h"}
_ACCENTS = ("ÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ", "AAAAACEEEEIIIINOOOOOUUUU")


def emitted(tagged: DataFrame, ingest_version: str) -> DataFrame:
    """The rows that hold a value, in the OBS contract."""
    rows = tagged.where("drop_reason is null").withColumn("ingest_version", F.lit(ingest_version))
    return C.validate(rows.select(*(F.col(f.name).cast(f.dataType) for f in C.OBS)), C.OBS, "obs")


def drop_counts(tagged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return tagged.where("drop_reason is not null").groupBy(*by, "drop_reason").agg(F.count(F.lit(1)).alias("n"))


def check(tagged: DataFrame, stage: str) -> dict:
    """Reconcile a parser's rows with one aggregate."""
    counts = {r["drop_reason"]: r["n"] for r in tagged.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a reason
    kept = counts.pop(None, 0)
    return C.reconcile(stage, kept + sum(counts.values()), kept, counts)


def read_texts(spark, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, text) of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", encoding).alias("text"))


def read_zip_texts(spark, path: str, encoding: str = "ISO-8859-1", stations: list[str] | None = None) -> DataFrame:
    """(path, text) of the CSV members of zip files, a task for each; see ``zips``. Of members of other stations than ``stations`` only the head is read."""
    ship(spark)
    spark.dataSource.register(ZipSource)
    options = {} if stations is None else {"stations": ",".join(stations)}
    return spark.read.format("zip_texts").options(encoding=encoding, **options).load(path)


def _plain(x: Column) -> Column:
    return F.translate(F.upper(x), *_ACCENTS)


def _to_kelvin(variable: Column, value: Column) -> Column:
    return F.when(variable == "t2m", C.c_to_k(value)).otherwise(value)


def _station_code(lines: Column) -> Column:
    line = F.get(F.filter(F.slice(lines, 1, 8), lambda x: _plain(x).startswith("CODIGO (WMO)")), F.lit(0))
    return F.trim(F.regexp_extract(line, r"^[^;]*;(.*)$", 1))


def file_counts(files: DataFrame, stations: list[str] | None = None) -> DataFrame:
    """One row: files of (path, text) that ``parse_station_files`` reads and that its ``stations`` filter skips."""
    code = _station_code(F.split(F.substring_index("text", "\n", 9), r"\r?\n"))
    skipped = F.lit(False) if stations is None else ~F.coalesce(code.isin(*stations), F.lit(False))
    return files.agg(F.count_if(~skipped).alias("read"), F.count_if(skipped).alias("skipped"))


def parse_station_files(files: DataFrame, stations: list[str] | None = None) -> DataFrame:
    """Bulk station files (path, text): eight metadata lines, a header from ``Data;``, then hourly lines.

    Columns are found by title, each exactly once; decimal commas; empty or -9999 is missing. A file
    without a station code or with another header raises. ``stations`` filters files by code before
    their lines are split up.
    """
    lines = files.select("path", F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n").alias("lines"))
    code = _station_code(F.col("lines"))
    header = F.coalesce(F.get("lines", F.lit(8)), F.lit(""))
    fail = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.col("path")))
    heads = F.transform(F.split(header, ";"), _plain)
    found = lines.select("path", "lines", F.when(F.coalesce(F.length(code), F.lit(0)) > 0, code).otherwise(fail("no station code").cast("string")).alias("native_id"), F.when(header.startswith("Data;"), heads).otherwise(fail("no header in line 9").cast("array<string>")).alias("heads"))
    if stations is not None:
        found = found.where(F.col("native_id").isin(*stations))

    def place(title: str) -> Column:
        at = F.filter(F.transform(F.col("heads"), lambda x, i: F.when(x.contains(title), i)), lambda i: i.isNotNull())
        return F.when(F.size(at) == 1, at[0]).otherwise(fail(f"column {title} not found once").cast("int"))

    places = F.array(*(F.named_struct(F.lit("variable"), F.lit(v), F.lit("at"), place(t)) for t, v in BULK_COLUMNS.items()))
    data = found.select("path", "native_id", places.alias("places"), F.explode(F.slice("lines", F.lit(10), F.greatest(F.lit(0), F.size("lines") - 9))).alias("line")).where(F.trim("line") != "")
    cells = data.select("path", "native_id", F.split("line", ";").alias("cells"), F.explode("places").alias("p"))
    day = F.regexp_extract(F.get("cells", F.lit(0)), r"^\s*(\d{1,4}/\d{1,2}/\d{1,2})\s*$", 1)
    hhmm = F.regexp_extract(F.coalesce(F.get("cells", F.lit(1)), F.lit("")), r"^\s*(\d{1,4})(?: UTC)?\s*$", 1)
    hour = F.floor(F.expr("try_cast(nullif(hhmm, '') as int)") / 100)
    text = F.trim(F.get("cells", F.col("p.at")))
    out = cells.withColumns({"day": day, "hhmm": hhmm, "text": text})
    date = F.expr("try_to_timestamp(nullif(day, ''), 'y/M/d')")
    value = F.expr("try_cast(replace(text, ',', '.') as double)")
    out = out.withColumns({"date": date, "hour": hour, "value": value})
    time = F.when(F.col("hour").between(0, 23), F.col("date") + F.make_interval(hours=F.col("hour").cast("int")))
    out = out.withColumn("valid_time", time)
    reason = F.when(F.col("valid_time").isNull(), "bad_timestamp").when(F.col("text").isNull(), "value_unparseable").when(F.col("text") == "", "value_missing").when(F.col("value").isNull(), "value_unparseable").when(F.col("value") == MISSING, "value_missing")
    return out.select("path", F.concat(F.lit("inmet:"), "native_id").alias("station_id"), "valid_time", F.col("p.variable").alias("variable"), _to_kelvin(F.col("p.variable"), F.col("value")).alias("value"), F.lit("inmet_bulk").alias("source"), F.lit(None).cast("string").alias("source_qc_raw"), reason.alias("drop_reason"))


def parse_api_records(records: DataFrame) -> DataFrame:
    """Hourly JSON records (station_id, json) with DT_MEDICAO, HR_MEDICAO and values as text or null."""
    fields = ("DT_MEDICAO", "HR_MEDICAO", *API_COLUMNS)
    parsed = records.select("station_id", F.from_json("json", ", ".join(f"{f} string" for f in fields)).alias("r")).select("station_id", "r.*")
    hour = F.floor(F.expr("try_cast(HR_MEDICAO as int)") / 100)
    date = F.expr("try_to_timestamp(DT_MEDICAO, 'yyyy-MM-dd')")
    timed = parsed.withColumns({"hour": hour, "date": date}).withColumn("valid_time", F.when(F.col("hour").between(0, 23), F.col("date") + F.make_interval(hours=F.col("hour").cast("int"))))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f).alias("text")) for f, v in API_COLUMNS.items()))).alias("x")
    out = timed.select("station_id", "valid_time", each).select("station_id", "valid_time", "x.*").withColumn("value", F.expr("try_cast(text as double)"))
    reason = F.when(F.col("valid_time").isNull(), "bad_timestamp").when(F.coalesce("text", F.lit("")) == "", "value_missing").when(F.col("value").isNull(), "value_unparseable")
    return out.select("station_id", "valid_time", "variable", _to_kelvin(F.col("variable"), F.col("value")).alias("value"), F.lit("inmet").alias("source"), F.lit(None).cast("string").alias("source_qc_raw"), reason.alias("drop_reason"))


def parse_isd_lite(lines: DataFrame) -> DataFrame:
    """Hourly fixed-order integers (station_id, line): tenths, -9999 missing, trace rain is 0 with mark T."""
    parts = lines.where(F.trim("line") != "").select("station_id", F.split(F.trim("line"), r"\s+").alias("p"))
    number = lambda i: F.expr(f"try_cast(get(p, {i}) as int)")
    stamp = F.expr("try_make_timestamp(try_cast(get(p, 0) as int), try_cast(get(p, 1) as int), try_cast(get(p, 2) as int), try_cast(get(p, 3) as int), 0, 0)")
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), number(i).alias("raw")) for v, i in (("t2m", 4), ("wind10m", 8), ("precip_1h", 10))))).alias("x")
    out = parts.select("station_id", F.size("p").alias("n"), stamp.alias("valid_time"), each).select("station_id", "n", "valid_time", "x.*")
    trace = (F.col("variable") == "precip_1h") & (F.col("raw") == TRACE)
    value = _to_kelvin(F.col("variable"), F.when(trace, F.lit(0.0)).otherwise(C.scaled_tenths(F.col("raw"), MISSING)))
    reason = F.when(F.col("n") < 12, "malformed_line").when(F.col("valid_time").isNull(), "bad_timestamp").when(F.col("raw").isNull() | (F.col("raw") == MISSING), "value_missing")
    return out.select("station_id", "valid_time", "variable", value.alias("value"), F.lit("isd").alias("source"), F.when(trace, "T").alias("source_qc_raw"), reason.alias("drop_reason"))


def clip_window(obs: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the days from ``start`` to ``end``, both included; the filter reaches a Parquet scan."""
    return obs.where((F.col("valid_time") >= F.lit(start).cast("timestamp")) & (F.col("valid_time") < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY")))
