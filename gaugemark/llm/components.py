"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b, as edges of the same form.

    Large: every node gives its larger neighbours its smallest one (or itself). Small: every node
    gives its smaller neighbours and itself the smallest of them. Minima are pre-aggregated, and the
    join back can be split where a node is hot.
    """
    from_ = edges.union(edges.select("b", "a")) if large else edges
    least = materialise(from_.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    joined = from_.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Up to so many edges (a few MB) one task finds the components by union-find; beyond, stars do.
LOCAL_EDGES = 1 << 18


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable from every node of edges (a, b).

    The edges are counted first. Beyond ``local_edges`` star steps run until one changes no edge; then
    every edge joins a node to its component. Their number grows with the logarithm of the largest one.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    print_ = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    last = now.agg(*print_).first()
    if last[0] <= local_edges:
        ship(edges.sparkSession)
        return now.coalesce(1).mapInArrow(_union_find, "node long, component long")
    while True:
        now = materialise(_star(_star(now, True), False))
        mark = now.agg(*print_).first()
        if mark == last:
            break
        last = mark
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
