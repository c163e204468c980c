"""Ranks within groups of any size: a group's values are cut into ranges of like size, and ranges add up.

A window over a whole group holds the group in one task. Here every group gets bounds, a window counts within (group, range)
only, and one row for each range carries its rows to the ranges after it. Rows of one value stand in one count, so
ties never straddle a bound and a value that most rows have is one row.

Bounds are quantiles of a sample of the group's distinct values: those whose hash is small, ``SAMPLE`` for each range. The
sample depends on the values alone, so that a task that runs again after a loss deals rows as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RANGES, SAMPLE = 64, 32


def value_counts(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, value, n) of the values that are not null."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def _numbered(df: DataFrame, value: str, bounds: str, ranges: int) -> DataFrame:
    """``df`` with ``range``: how many of its sorted ``bounds`` are smaller than the value, by halving."""
    df, step = df.withColumn("range", F.lit(0)), 1 << max(0, (ranges - 1).bit_length() - 1)
    while step and ranges > 1:
        df = df.withColumn("range", F.when(F.get(bounds, F.col("range") + (step - 1)) < F.col(value), F.col("range") + step).otherwise(F.col("range")))
        step //= 2
    return df


def ranked(counts: DataFrame, group: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``counts`` (group, value, n) with ``range`` (the number of the value's range), ``below`` (rows of smaller values) and ``total`` of the group.

    Groups are keys like those of ``groupBy``: null is one of them. Every branch of the plan that reads the counts
    or the dealt rows needs the same columns of them, so that Spark computes each shuffle once and reuses it.
    """
    if ranges < 1:
        raise ValueError("ranges must be 1 or more")
    counts, keys = counts.select(*group, value, "n"), [f"_g{i}" for i in range(len(group))]
    renamed = [F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)]
    sizes = counts.groupBy(*renamed).agg(F.count(F.lit(1)).alias("_values"), F.sum("n").alias("total"))
    part = F.pmod(F.xxhash64(value), F.lit(1 << 30)) / (1 << 30)
    sized = counts.join(sizes, same).select(*group, value, "n", "_values", "total")
    sample = sized.where(part < ranges * SAMPLE / F.col("_values")).groupBy(*renamed).agg(F.array_sort(F.collect_list(value)).alias("_sample"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(max(1, ranges - 1))), lambda i: F.get("_sample", F.floor(i * F.size("_sample") / ranges).cast("int")))
    bounds = sample.select(*keys, (cut if ranges > 1 else F.slice("_sample", 1, 0)).alias("_bounds"))
    dealt = _numbered(sized.join(bounds, same), value, "_bounds", ranges).select(*group, value, "n", "range", "total")
    inside = W.partitionBy(*group, "range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.withColumn("_within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    order = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy(*renamed, F.col("range").alias("_range")).agg(F.max(F.col("_within") + F.col("n")).alias("_m"), F.max("total").alias("_t"))
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_m").over(order), F.lit(0)).alias("_before"))
    both = dealt.join(sums, [*same, F.col("range") == F.col("_range")])
    return both.select(*counts.columns, "range", (F.col("_before") + F.col("_within")).alias("below"), "total")
