"""A ledger of raw texts, kept up to date by a stream: each new file's texts are digested once, then audited by source.

    python -m jobs.text_ledger --texts PATH --out PATH [--config FILE]

Every raw text that a verification is built on gets an entry with the digest and size of its bytes, so that runs can be repeated
and gaps, empty and repeated texts are seen. ``--texts`` is a folder of Parquet files (or one file) that grows; a file
stream with ``availableNow`` takes the files that are new since its checkpoint. Under ``--out``:

* ``entries``, written by the stream's file sink, partitioned by source: MANIFEST rows (url, sha256, bytes, source, status, ...)
* ``audit``: for each source its texts, bytes, empty texts, and repeats (texts whose bytes an entry of a smaller url has)
* ``checkpoint``: of the stream

Whole texts are read once, by the run that first sees their file. The audit is made anew from the entries, which hold digests only.
The sink commits each batch once, so a run that dies goes on where it stopped, and one without new files changes nothing.
Texts without an id are named by their digest; sources that are null or empty have partitions of their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemark.functions import contracts as C
from gaugemark.sources import sinks
from jobs import common

JOB = "text_ledger"
ENTRIES = T.StructType([*C.MANIFEST.fields, T.StructField("part", T.StringType())])
AUDIT = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("texts", T.LongType()), ("bytes", T.LongType()), ("empty", T.LongType()), ("repeats", T.LongType()))])


def entries(texts: DataFrame, config: dict) -> DataFrame:
    """MANIFEST rows of the texts and the partition that they go to."""
    name = F.concat(F.lit(f"{config['table']}/"), F.col(config["id"]).cast("string"))
    rows = C.validate(sinks.text_entries(texts, config["text"], config["source"], name), C.MANIFEST, "manifest")
    return rows.withColumn("part", F.when(F.col("source").isNull(), "(null)").when(F.col("source") == "", "(empty)").otherwise(F.col("source")))


def audit(rows: DataFrame) -> DataFrame:
    """AUDIT from all entries. A repeat is told by a minimum for each digest, not by sorting those that share one."""
    filled = F.col("bytes") > 0
    first = rows.where(filled).groupBy("sha256").agg(F.min("url").alias("_first"))
    marked = rows.join(first, "sha256", "left").withColumn("_repeat", F.coalesce(filled & (F.col("url") > F.col("_first")), F.lit(False)))
    out = marked.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if("_repeat").alias("repeats"))
    return out.select(AUDIT.names)


def as_glob(path: str) -> str:
    """A pattern that matches ``path`` alone: the file stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def read_entries(spark: SparkSession, out: str) -> DataFrame:
    return common.read_if_there(spark, f"{out}/entries", ENTRIES)


def run(spark: SparkSession, texts: str, out: str, config: dict) -> dict:
    """Take what is new and audit all; returns the texts taken and the texts audited."""
    schema = spark.read.parquet(texts).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(as_glob(texts))
    common.said(JOB, read=texts, columns=[config[k] for k in ("id", "text", "source")])
    query = entries(stream, config).writeStream.format("parquet").partitionBy("part").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/entries")
    try:
        query.awaitTermination()
    finally:
        query.stop()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    common.said(JOB, wrote=f"{out}/entries", texts=taken, batches=len(query.recentProgress))
    audit(read_entries(spark, out)).coalesce(1).write.mode("overwrite").parquet(f"{out}/audit")
    total = spark.read.parquet(f"{out}/audit").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")).first()["texts"]
    common.said(JOB, wrote=f"{out}/audit", texts=total)
    return {"taken": taken, "texts": total}


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """Every entry with what the audit says of its source."""
    totals = spark.read.schema(AUDIT).parquet(f"{out}/audit").select(F.col("source").alias("_s"), F.col("texts").alias("source_texts"), F.col("bytes").alias("source_bytes"), F.col("empty").alias("source_empty"), F.col("repeats").alias("source_repeats"))
    rows = read_entries(spark, out)
    return rows.join(totals, rows["source"].eqNullSafe(totals["_s"])).select("url", "source", "sha256", "bytes", "status", *totals.columns[1:])


if __name__ == "__main__":
    common.command_line(JOB, __file__, {"texts": "folder of Parquet files with texts, or one file"}, run)
