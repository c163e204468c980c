"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workers

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test-data layout, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package. Arrow batches are held to 4 MB, so that a worker's memory follows bytes, not rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    workers.ship(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    The folder is read from the session; only in local mode, where it is unset, is one chosen. Spark deletes spent
    checkpoints where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints/{uuid4().hex}")
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Reduce-side parallelism: the session's setting, or the number of input splits if that is larger."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, df.rdd.getNumPartitions()) if df is not None else n


def own_name(base: str, taken: Iterable[str]) -> str:
    """``base``, with underscores added until no column of ``taken`` has that name (case-insensitive)."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base = f"_{base}"
    return base


def md5_uint32(col: Column) -> Column:
    """The first 32 bits of a string's md5 as a long: a hash that other SQL engines can repeat."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")
