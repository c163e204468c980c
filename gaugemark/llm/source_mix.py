"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a multiple of
all sizes by weight; a target stops at twice its source's size and the excess is shared out again
(water filling, solved in closed form over the sources sorted by cap per weight).

Sampling: every document of a source expects target / source_size copies. Documents are laid in a
fixed order, the expected copies are prefix-summed, one offset per source is added, and a document
is taken once for each integer boundary that its interval crosses. The order goes by size class
first, so that the taken words come near the target as well as the taken documents do.

Scale: a prefix sum never needs a source in one task. A source's size class with n rows is split
into about sqrt(n) cells by hash range; rows are ranked within cells, and cells within sources. The
sources themselves, which may be many, are ranked and summed by ranges.

Defined cases: a null text has size 0; null is a source of its own; sources of size 0 get target 0
and nothing is taken from them; repeated ids are separate rows, ordered by size and a digest of the text,
so that reruns over other partitions agree (rows equal in all of these are alike); no rows in, no rows out;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WHITE, materialise, md5_uint32, partitions

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2


def _before(df: DataFrame, order: Column, sums: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum over all rows that come before in ``order`` (the source breaks ties).

    Rows are dealt to ranges of the order, summed within them and shifted by the sums of the ranges before,
    of which there are as many as partitions.
    """
    spark = df.sparkSession
    source = F.col("source").asc_nulls_last()
    dealt = materialise(df.repartitionByRange(partitions(spark), order, source).withColumn("range_", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    whole = dealt.groupBy("range_").agg(*(F.sum(c).alias(f"{n}_of") for n, c in sums.items()))
    shifts = whole.select("range_", *(F.coalesce(F.sum(f"{n}_of").over(earlier(W.orderBy("range_"))), F.lit(0)).alias(f"{n}_shift") for n in sums))
    within = earlier(W.partitionBy("range_").orderBy(order, source))
    out = dealt.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items())).join(F.broadcast(shifts), "range_")  # a row for each partition
    return out.withColumns({n: F.col(n) + F.col(f"{n}_shift") for n in sums}).drop("range_", *(f"{n}_shift" for n in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size): one row per source with ``target`` added."""
    spark = sizes.sparkSession
    placed = _before(sizes.select("source", "source_size"), F.col("source").asc_nulls_last(), {"nth": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights)).cast("int") + 1)
    weighed = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap))).drop("nth")
    ranked = materialise(_before(weighed, F.col("cap") / F.col("weight"), {"caps_below": F.col("cap"), "weight_below": F.col("weight")}))
    total = ranked.agg(F.sum("weight").alias("w"), F.sum("source_size").alias("s")).first()
    goal, all_weight = float(total["s"] or 0) * share, int(total["w"] or 0)
    level = (F.lit(goal) - F.col("caps_below")) / (F.lit(all_weight) - F.col("weight_below"))
    # The first source (by cap per weight) that its level does not fill sets the level for all; later ones only have lower levels.
    top = ranked.select(level.alias("level"), F.col("cap"), F.col("weight")).where(F.col("level") <= F.col("cap") / F.col("weight")).agg(F.max("level").alias("level")).first()["level"]
    target = F.col("cap") if top is None else F.least(F.col("cap"), F.lit(top) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20240, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, row: str | None = None) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies, taken (= copies * size).

    ``row`` names a column that tells rows apart and is returned too, as ``row``.
    """
    # Words are counted as the starts of runs: what is left of each run is one mark.
    size = F.length(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "\u0001"), WHITE, ""))
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")))
    digits = F.col("size").cast("string")
    base = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.cast("long").alias("size"), F.xxhash64(text).alias("x"), *([F.col(row).alias("row")] if row else []))
    base = materialise(base.withColumn("h", md5_uint32(key)).withColumn("class", F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")))
    classes = base.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    classes = materialise(classes.withColumn("cells", F.ceil(F.sqrt("n")).cast("long")))
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    celled = base.join(classes.select("source", "class", "cells").withColumnsRenamed({"source": "s", "class": "c"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left").drop("s", "c")
    celled = celled.withColumn("cell", F.shiftright(F.col("h") * F.col("cells"), 32)).drop("cells")
    counts = celled.groupBy("source", "class", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("class", "cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    starts = starts.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    starts = starts.withColumnsRenamed({"source": "s", "class": "c", "cell": "k"})
    rank = F.row_number().over(W.partitionBy("source", "class", "cell").orderBy("h", "id", "size", "x"))
    ranked = celled.withColumn("nth", rank).join(materialise(starts), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("cell") == F.col("k")), "left")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = md5_uint32(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("")))) / F.lit(4294967296.0)
    place = (F.col("start") + F.col("nth")).cast("double")
    copies = F.floor(expected * place + offset) - F.floor(expected * (place - 1) + offset)
    return ranked.withColumn("copies", F.least(copies, F.lit(int(cap))).cast("long")).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if row else [])
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('20240:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents),
d2 AS (SELECT *, length(size::VARCHAR) * 100 + rpad(substr(size::VARCHAR, 1, 2), 2, '0')::INT AS class FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0 AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_below,
      sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_from,
      sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM w),
l AS (SELECT *, (goal - caps_below) / weight_from::DOUBLE AS level FROM r),
g AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight, cap)) AS target FROM l),
k AS (SELECT d2.*, g.source_size, g.target, row_number() OVER (PARTITION BY d2.source ORDER BY class, h, doc_id)::DOUBLE AS place,
      ('0x' || substr(md5('20240/' || coalesce(d2.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
      CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS e
      FROM d2 JOIN g ON d2.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (least(floor(e * place + u) - floor(e * (place - 1) + u), 2) * size)::BIGINT AS taken FROM k
"""
