"""The jobs as registered queries: each runs twice into one new folder, and the output of both runs is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemark.plans.adapters import PAIRS
from jobs import common, monthly_scores, text_ledger


def job1_monthly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = common.new_folder(spark, "job1"), common.default_config(monthly_scores.__file__)
    for _ in range(2):
        monthly_scores.run(spark, f"{sf_dir}/lineitem.parquet", out, config)
    return monthly_scores.read_scores(spark, out).withColumns({"day": F.col("day").cast("string"), **{c: F.round(c, 6) for c in ("bias", "mae", "rmse")}})


def job2_text_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = common.new_folder(spark, "job2"), common.default_config(text_ledger.__file__)
    for _ in range(2):
        text_ledger.run(spark, f"{sf_dir}/documents.parquet", out, config)
    return text_ledger.read_ledger(spark, out)


QUERIES = {f.__name__: f for f in (job1_monthly_scores, job2_text_ledger)}
ORACLES = {
    "job1_monthly_scores": f"""WITH {PAIRS}, v AS (SELECT * FROM pairs WHERE qc_flags & 1 = 0 AND fcst IS NOT NULL AND obs IS NOT NULL),
k AS (SELECT valid_time, station_id, variable, lead_hours, list(DISTINCT model) AS models FROM v GROUP BY ALL),
c(comparison_id) AS (VALUES ('A+N'), ('A+R'), ('N+R'), ('A+N+R')),
m AS (SELECT c.comparison_id, v.* FROM v JOIN k USING (valid_time, station_id, variable, lead_hours) JOIN c ON list_has_all(k.models, string_split(c.comparison_id, '+')) AND list_contains(string_split(c.comparison_id, '+'), v.model))
SELECT comparison_id, model, variable, lead_hours, day::VARCHAR AS day, count(*) AS n_pairs, round(avg(fcst - obs), 6) AS bias, round(avg(abs(fcst - obs)), 6) AS mae, round(sqrt(avg((fcst - obs) * (fcst - obs))), 6) AS rmse, strftime(day, '%Y-%m') AS month FROM m GROUP BY ALL""",
    "job2_text_ledger": """WITH e AS (SELECT coalesce('documents/' || doc_id, 'sha256:' || sha256(coalesce(text, ''))) AS url, source, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS bytes, CASE WHEN coalesce(text, '') = '' THEN 'empty' ELSE 'fetched' END AS status FROM documents),
f AS (SELECT *, bytes > 0 AND url > min(url) OVER (PARTITION BY sha256) AS again FROM e),
s AS (SELECT source, count(*) AS source_texts, sum(bytes)::BIGINT AS source_bytes, count(*) FILTER (status = 'empty') AS source_empty, count(*) FILTER (again) AS source_repeats FROM f GROUP BY 1)
SELECT url, f.source, sha256, bytes, status, source_texts, source_bytes, source_empty, source_repeats FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source""",
}
