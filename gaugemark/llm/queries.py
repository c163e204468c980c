"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bsi_topk, byte_bpe, exact_dedup, hard_negatives, html_extract, language_id, license_scan, ngram_join, pii, source_mix, token_counts, url_filter
from .common import table


def op1_language_id(spark, sf_dir):
    return language_id.identify_table(table(spark, sf_dir, "documents"))


def op2_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), decoded="decoded"))


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_bit_sliced_topk(spark, sf_dir):
    return bsi_topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_source_mix(spark, sf_dir):
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark, sf_dir):
    given = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", given))


def op12_pii(spark, sf_dir):
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def queries():
    return {f.__name__: f for f in (op1_language_id, op2_html_extract, op3_byte_bpe, op4_token_counts, op5_bit_sliced_topk, op6_exact_dedup, op7_license_scan, op8_source_mix, op9_ngram_jaccard_join, op10_url_filter, op11_hard_negatives, op12_pii)}


def oracle_sql():
    return {"op5_bit_sliced_topk": bsi_topk.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op8_source_mix": source_mix.ORACLE, "op9_ngram_jaccard_join": ngram_join.ORACLE, "op10_url_filter": url_filter.oracle(), "op11_hard_negatives": hard_negatives.ORACLE}
