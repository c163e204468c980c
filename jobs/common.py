"""What the jobs share: configuration, logging, and a folder that the whole cluster sees."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from gaugemark.sources.sinks import new_folder  # noqa: F401  jobs take it from here

log = logging.getLogger("jobs")


def said(job: str, **what) -> None:
    """One JSON line in the log for what was read, skipped or written."""
    log.info(json.dumps({"job": job, **what}, sort_keys=True, default=str))


def load_config(spark: SparkSession, path: str) -> dict:
    """A JSON file; one with a scheme (``s3a://``, ``hdfs://``) is read through Spark."""
    text = spark.read.text(path, wholetext=True).first()["value"] if "://" in path else Path(path).read_text()
    return json.loads(text)


def default_config(module: str) -> dict:
    return json.loads(Path(module).with_suffix(".json").read_text())


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path``, or an empty one of ``schema`` before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command_line(job: str, module: str, inputs: Mapping[str, str], run: Callable) -> None:
    """Parse paths and configuration, run the job in a session of its own, stop it. ``inputs``: option -> help."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}")
    for name, text in {**inputs, "out": "folder of the results"}.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file; default: the one beside the job")
    args = parser.parse_args()
    logging.basicConfig(stream=sys.stdout, level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = load_config(spark, args.config) if args.config else default_config(module)
        run(spark, *(getattr(args, name) for name in inputs), args.out, config)
    finally:
        spark.stop()
