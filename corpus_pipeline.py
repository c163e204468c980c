"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, byte-level BPE.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame`` over all rows that the stage before it kept, and
all but the last return the columns of ``documents``. Rows without an id are kept by the stages that
judge by id, and rows that share an id share its fate there; columns of any names pass through. No rows in,
no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemark.llm import byte_bpe, exact_dedup, language_id, ngram_join, source_mix
from gaugemark.llm.common import materialise, own_name, table

#: A document is rejected as undetermined, or when no language gets this share of the probability.
LEAST_SCORE = 0.5


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text, without a letter or in doubt go."""
    trees = language_id.train(docs.where(~F.coalesce(language_id.held_out(), F.lit(False))))
    pred, score = own_name("pred", docs.columns), own_name("score", docs.columns)
    told = language_id.identify(docs, trees, pred=pred, score=score)
    return told.where((F.col(pred) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group that n-gram Jaccard links connect, the document with the smallest id."""
    groups = ngram_join.jaccard_components(docs).select(F.col("doc_id").alias("id_"), "component_id")
    rest = materialise(groups.where("id_ <> component_id").select("id_").distinct())
    return docs.join(rest, docs["doc_id"] == rest["id_"], "left_anti")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it. Rows are told apart by their place in ``docs``, a table that rereads alike."""
    row = own_name("row", docs.columns)
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    copies = materialise(source_mix.mix(placed, row=row).where("copies > 0").select(F.col("row").alias(row), "copies"))
    times = own_name("copies", docs.columns)
    taken = placed.join(copies.withColumnRenamed("copies", times), row)
    return taken.select(*(f"`{c}`" for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(times)).drop(times)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's encoded text."""
    return byte_bpe.digests(byte_bpe.encode(docs, decoded="decoded"))


STAGES = [
    ("language ID", stage_language),
    ("exact dedup", stage_exact_dedup),
    ("n-gram Jaccard join", stage_near_dedup),
    ("source mix", stage_mix),
    ("byte-level BPE", stage_encode),
]
#: Trained language models, byte-pair merges and sampling over their results have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is checkpointed for the next one."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
