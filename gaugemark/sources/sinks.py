"""Sinks and the manifest of fetched files."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import contracts as C

#: A manifest entry in one of these states need not be fetched again.
FETCHED = ("fetched", "pruned", "streamed")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of a new name under ``spark.checkpoint.dir``; only in local mode, where that is unset, under the temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid4().hex}"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Parquet by Spark's commit protocol; rows are brought together by partition and sorted within files."""
    out = df.repartition(*partition_by) if partition_by else df
    out = out.sortWithinPartitions(*partition_by, *sort_by) if sort_by else out
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def with_table_metadata(df: DataFrame, **metadata: str) -> DataFrame:
    """Key-value metadata on every column; it is stored in Parquet and read back with the schema."""
    for c in df.columns:
        df = df.withMetadata(c, {**df.schema[c].metadata, **metadata})
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


#: A Markdown table is for reading; a larger result is refused, not cut.
MOST_MARKDOWN_ROWS = 10_000


def markdown(df: DataFrame, most: int = MOST_MARKDOWN_ROWS) -> str:
    """A small result as a Markdown table; raises if it has more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as CSV or Parquet")
    line = lambda cells: "| " + " | ".join("" if x is None else str(x) for x in cells) + " |"
    return "\n".join([line(df.columns), line("-" for _ in df.columns), *map(line, rows)])


def view_manifest(view: DataFrame, key: Sequence[str]) -> str:
    """JSON of a matched view: models, rows and keys."""
    r = view.agg(F.array_sort(F.collect_set("model")).alias("models"), F.count(F.lit(1)).alias("rows"), F.count_distinct(*key).alias("keys")).first()
    return json.dumps(r.asDict())


def write_view(view: DataFrame, path: str, key: Sequence[str], **metadata: str) -> str:
    """A matched view as Parquet under ``path``/view and its manifest as JSON text under ``path``/manifest, which is returned."""
    write_table(with_table_metadata(view, **metadata) if metadata else view, f"{path}/view", sort_by=key)
    spark = view.sparkSession
    text = view_manifest(spark.read.parquet(f"{path}/view"), key)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return text


def ingest_version(files: DataFrame, code_version: str) -> str:
    """A name for one state of the inputs: the code's version and a digest of all files' digests (column ``sha256``), in any order."""
    both = files.select("sha256").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{code_version}+{both['n']}.{int(both['s'] or 0):x}"


def config_hash(config: Mapping) -> str:
    """Eight hexadecimal digits that tell configurations apart, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:8]


def file_entries(files: DataFrame, source: str) -> DataFrame:
    """MANIFEST rows of files read as ``binaryFile``, with their digests."""
    return files.select(
        F.col("path").alias("url"), F.col("path").alias("local_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("timestamp").alias("init_time"), F.col("modificationTime").alias("downloaded_at"), F.lit("fetched").alias("status"),
    )


def text_entries(texts: DataFrame, text: str, source: str, name: Column) -> DataFrame:
    """MANIFEST rows of texts that stand in a table, with the digests of their bytes; null and empty texts have status ``empty``.

    ``name`` is what stands for a url; a text without one is named by its digest. No time of fetching is known.
    """
    none = lambda t: F.lit(None).cast(t)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    digest = F.sha2(body, 256)
    return texts.select(
        F.coalesce(name, F.concat(F.lit("sha256:"), digest)).alias("url"), none("string").alias("local_path"), digest.alias("sha256"), F.octet_length(body).cast("long").alias("bytes"), F.col(source).cast("string").alias("source"),
        none("string").alias("model"), none("timestamp").alias("init_time"), none("timestamp").alias("downloaded_at"), F.when(F.octet_length(body) == 0, "empty").otherwise("fetched").alias("status"),
    )


def append_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each url, the newest."""
    both = C.validate(old, C.MANIFEST, "manifest").unionByName(C.validate(new, C.MANIFEST, "manifest"))
    nth = F.row_number().over(W.partitionBy("url").orderBy(F.col("downloaded_at").desc_nulls_last()))
    return both.withColumn("nth", nth).where("nth = 1").drop("nth")


def to_fetch(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Urls that no entry has as fetched."""
    return wanted.join(manifest.where(F.col("status").isin(*FETCHED)).select("url"), "url", "left_anti")
