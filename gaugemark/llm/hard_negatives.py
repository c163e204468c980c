"""Hard-negative mining by branch and bound on ball trees.

Rows are dealt to blocks of bounded size, and every block gets one ball tree over its quantised vectors: a node
knows its rows, their centre and radius and the least and largest label. For an anchor q every row x of a
node satisfies q.c - |q| r <= q.x <= q.c + |q| r, so that a node is passed over when all its scores lie outside the
window that is asked for, when they lie strictly beneath the k-th best found, or when its labels cannot fit. Nodes
are opened from the largest upper bound downward; scores of the rows themselves are exact integers.

Two passes over the stored trees: the first finds each anchor's positives (best rows of its label), the second,
for each anchor and positive, the best rows of other labels within a window of percentages of the positive's score.
Blocks stay where they are, chunks of anchors are sent to each; a pair of block and chunk returns at most k rows a
search, and windows take the k best of them.

Defined cases: rows without id or label, and vectors that are null or hold null or non-finite components, take no
part; empty and shorter vectors count as padded with zeros; an anchor never gets its own row, but other rows of its id;
rows that repeat an id are separate anchors, positives and negatives; positives of a negative score leave no window
(where both percentages are positive) and give no row; fewer rows than asked for give all; scores outside a long's range are compared exactly
within a block and stand at its limits in the result; no rows or no anchors, no result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .blocks import release
from .common import materialise, ship

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
BLOCK_ROWS, CHUNK_ANCHORS, LEAF_ROWS = 1 << 14, 128, 256
_LONG, _EXACT = (1 << 63) - 1, 1 << 53


class BallTree:
    """Rows in tree order and nodes as arrays; children of a node are ``left`` and ``left + 1`` (0: a leaf)."""

    #: name -> dtype of the stored arrays; ``values`` has a dtype of its own, ``centre`` one row of doubles a node.
    FIELDS = {"ids": "<i8", "labels": "<i8", "start": "<i4", "end": "<i4", "left": "<i4", "radius": "<f8", "low": "<i8", "high": "<i8", "centre": "<f8"}

    def __init__(self, values: np.ndarray, **fields: np.ndarray):
        self.__dict__ |= fields
        self.values, self.dims = values, values.shape[1]
        self.centre = self.centre.reshape(len(self.start), self.dims)
        self.most = float(np.abs(values).max(initial=0))
        self.size = np.sqrt((self.centre**2).sum(axis=1))

    @classmethod
    def grow(cls, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        """Halve each node at the median along the line between two of its far rows, until it is small or its rows are equal."""
        order = np.arange(len(ids))
        start, end, left, radius, low, high, centres = [0], [len(ids)], [0], [], [], [], []
        node = 0
        while node < len(start):
            rows = order[start[node] : end[node]]
            of = values[rows]
            with np.errstate(over="ignore", invalid="ignore"):
                centre = of.mean(axis=0)
                away = np.sqrt(((of - centre) ** 2).sum(axis=1))
            wide = float(away.max())
            if not np.isfinite(wide):  # beyond doubles: the node bounds nothing, but is split all the same
                centre, wide = np.zeros_like(centre), np.inf
            centres.append(centre)
            radius.append(wide)
            low.append(labels[rows].min())
            high.append(labels[rows].max())
            if len(rows) > leaf_rows and wide > 0:
                along = of - of[away.argmax()] if np.isfinite(wide) else np.sign(of) * np.log1p(np.abs(of))
                far = (along**2).sum(axis=1).argmax()
                half = len(rows) // 2
                order[start[node] : end[node]] = rows[np.argpartition(along @ along[far], half)]
                left[node] = len(start)
                middle = start[node] + half
                start += [start[node], middle]
                end += [middle, end[node]]
                left += [0, 0]
            node += 1
        return cls(values[order], ids=ids[order], labels=labels[order], start=np.array(start), end=np.array(end), left=np.array(left), radius=np.array(radius), low=np.array(low), high=np.array(high), centre=np.array(centres))

    def stored(self) -> dict[str, bytes | str | int]:
        out = {k: getattr(self, k).astype(t).tobytes() for k, t in self.FIELDS.items()}
        kind = _narrowest(self.values)
        return out | {"values": self.values.astype(kind).tobytes(), "kind": kind, "dims": self.dims}

    @classmethod
    def loaded(cls, row: dict) -> BallTree:
        fields = {k: np.frombuffer(row[k], t) for k, t in cls.FIELDS.items()}
        return cls(np.frombuffer(row["values"], row["kind"]).astype(float).reshape(len(fields["ids"]), row["dims"]), **fields)

    def fitted(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors with as many components as the rows; what a row lacks is zero."""
        out = np.zeros((len(anchors), self.dims))
        out[:, : anchors.shape[1]] = anchors[:, : self.dims]
        return out

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of every node's rows (nodes x anchors), with room for rounding."""
        with np.errstate(over="ignore", invalid="ignore"):
            middle = self.centre @ anchors.T
            length = np.sqrt((anchors**2).sum(axis=1))
            reach = self.radius[:, None] * length * (1 + 1e-9) + 1e-9 * self.size[:, None] * length + 1e-6
            low, high = middle - reach, middle + reach
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


class Search:
    """Searches of one anchor in one tree; scores of a leaf are computed once for all of them."""

    def __init__(self, tree: BallTree, anchor: np.ndarray, label: int, own: int | None, low: np.ndarray, high: np.ndarray):
        self.tree, self.anchor, self.label, self.own, self.low, self.high = tree, anchor, label, own, low, high
        self.exact = tree.dims * tree.most * float(np.abs(anchor).max(initial=0)) < _EXACT
        self.leaves: dict[int, np.ndarray] = {}

    def _scores(self, leaf: int) -> np.ndarray:
        if leaf not in self.leaves:
            of = self.tree.values[self.tree.start[leaf] : self.tree.end[leaf]]
            if self.exact:  # all sums are whole numbers below 2 ** 53
                scores = (of @ self.anchor).astype(np.int64)
            else:
                whole = [int(x) for x in self.anchor.tolist()]
                scores = np.array([sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in of.tolist()] + [None], object)[:-1]
            self.leaves[leaf] = scores
        return self.leaves[leaf]

    def best(self, k: int, same: bool, least: int | None = None, most: int | None = None) -> list[tuple[int, int]]:
        """(-score, id) of the k best rows with the anchor's label or another one, and least <= score <= most."""
        tree, low, high, label = self.tree, self.low, self.high, self.label
        kept: list[tuple[int, int]] = []
        heap = [(-high[0], 0)]
        while heap:
            upper, node = heapq.heappop(heap)
            if least is not None and -upper < least or len(kept) == k and -upper < -kept[-1][0]:
                break  # and so are all others
            if most is not None and low[node] > most:
                continue
            if (label < tree.low[node] or label > tree.high[node]) if same else tree.low[node] == tree.high[node] == label:
                continue
            if child := int(tree.left[node]):
                heapq.heappush(heap, (-high[child], child))
                heapq.heappush(heap, (-high[child + 1], child + 1))
                continue
            scores, start = self._scores(node), int(tree.start[node])
            fits = (tree.labels[start : tree.end[node]] == label) == same
            if least is not None:
                fits &= scores >= least
            if most is not None:
                fits &= scores <= most
            if len(kept) == k:
                fits &= scores >= -kept[-1][0]
            if self.own is not None and start <= self.own < tree.end[node]:
                fits[self.own - start] = False
            at = np.flatnonzero(fits)
            if len(at):
                found = zip((-int(s) for s in scores[at]), tree.ids[start + at].tolist(), strict=True)
                kept = heapq.nsmallest(k, [*kept, *found])
        return kept


def _narrowest(values: np.ndarray) -> str:
    return next((k for k in ("<i1", "<i2", "<i4") if not values.size or np.iinfo(k).min <= values.min() and values.max() <= np.iinfo(k).max), "<f8")


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers s with low * score <= 100 * s <= high * score, as first and last."""
    return -(-low * score // 100), high * score // 100


_BINARY = ("ids", "labels", "start", "end", "left", "radius", "low", "high", "centre", "values")
_INDEX = T.StructType([*(T.StructField(n, T.LongType()) for n in ("block", "home", "chunk")), T.StructField("dims", T.IntegerType()), T.StructField("kind", T.StringType()), *(T.StructField(n, T.BinaryType()) for n in _BINARY)])
_ARROW = pa.schema([*((n, pa.int64()) for n in ("block", "home", "chunk")), ("dims", pa.int32()), ("kind", pa.string()), *((n, pa.binary()) for n in _BINARY)])


def _indexed(scale: int, every: int, chunk_anchors: int, leaf_rows: int):
    """A group of rows -> one row with its tree (chunk -1), and its anchors in chunks (``start``: their places in the tree)."""

    def run(group: pa.Table) -> pa.Table:
        lists = group.column("vector").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        values = np.zeros((len(lengths), int(lengths.max())))
        with np.errstate(over="ignore"):
            scaled = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
        largest = np.finfo(float).max
        values[np.arange(values.shape[1]) < lengths[:, None]] = np.clip(scaled, -largest, largest)
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        first = np.lexsort([*values.T[::-1], labels, ids])  # one tree, in whatever order the rows came
        tree = BallTree.grow(ids[first], labels[first], values[first], leaf_rows)
        block = group.column("block")[0].as_py()
        rows = [{"block": block, "home": block, "chunk": -1, **tree.stored()}]
        asked = np.flatnonzero(tree.ids % every == 0)
        for nth in range(0, len(asked), chunk_anchors):
            at = asked[nth : nth + chunk_anchors]
            part = tree.values[at]
            kind = _narrowest(part)
            rows.append({"block": block, "home": block, "chunk": nth // chunk_anchors, "dims": tree.dims, "kind": kind, "ids": tree.ids[at].astype("<i8").tobytes(), "labels": tree.labels[at].astype("<i8").tobytes(), "start": at.astype("<i4").tobytes(), "values": part.astype(kind).tobytes()})
        return pa.Table.from_pylist(rows, schema=_ARROW)

    return run


def _searches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int, int, Search]]:
    """(chunk row, place, anchor's id, search) of every anchor of the chunks that follow a tree in rows sorted by (block, chunk)."""
    tree = block = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] < 0:
                tree, block = BallTree.loaded(row), row["block"]
                continue
            ids, labels, places = (np.frombuffer(row[k], t).tolist() for k, t in (("ids", "<i8"), ("labels", "<i8"), ("start", "<i4")))
            anchors = tree.fitted(np.frombuffer(row["values"], row["kind"]).astype(float).reshape(len(ids), row["dims"]))
            low, high = tree.bounds(anchors)
            for n, (id_, label, place) in enumerate(zip(ids, labels, places, strict=True)):
                yield row, place, id_, Search(tree, anchors[n], label, place if row["home"] == block else None, low[:, n], high[:, n])
    release()


def _held(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row, place, _, search in _searches(batches):
            out += [(row["home"], row["chunk"], place, id_, _held(-s)) for s, id_ in search.best(k, same=True)]
            if len(out) > 1 << 14:
                yield _longs(out, _FOUND)
                out = []
        yield _longs(out, _FOUND)

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, asked, of = [], {}, None
        for row, place, anchor, search in _searches(batches):
            if row is not of:
                asked, of = {}, row
                for x in row["wanted"]:
                    asked.setdefault(x["place"], []).append(x)
            for x in asked.get(place, ()):
                first, last = window(x["score"], low, high)
                if first <= last:
                    out += [(row["home"], place, x["nth"], anchor, x["positive_id"], x["score"], id_, _held(-s)) for s, id_ in search.best(k, same=False, least=first, most=last)]
            if len(out) > 1 << 14:
                yield _longs(out, _MINED)
                out = []
        yield _longs(out, _MINED)

    return run


_FOUND = ["home", "chunk", "place", "positive_id", "score"]
_MINED = ["home", "place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[] for _ in names])], names=names)


def _meeting(trees: DataFrame, chunks: DataFrame, blocks: int, lanes: int) -> DataFrame:
    """Every tree with every chunk, sorted so that a tree stands before the chunks that it meets."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    trees = trees.withColumn("lane", each(lanes))
    chunks = chunks.withColumn("lane", (F.col("home") + F.col("chunk")) % lanes).withColumn("block", each(blocks))
    both = trees.unionByName(chunks, allowMissingColumns=True)
    return both.repartitionById(blocks * lanes, (F.col("block") * lanes + F.col("lane")).cast("int")).sortWithinPartitions("block", "lane", "chunk")


def mine(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block_rows: int = BLOCK_ROWS, chunk_anchors: int = CHUNK_ANCHORS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    Anchors: rows whose id is divisible by ``every``. A negative's score is between ``low`` and ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    ship(spark)
    limit = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < limit))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and label is not null")
    blocks = max(1, -(-rows.agg(F.count(F.lit(1)).alias("n")).first()["n"] // block_rows))
    # By place, not by content: rows that repeat an id and a vector spread over the blocks too.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    index = materialise(dealt.groupBy("block").applyInArrow(_indexed(scale, every, chunk_anchors, leaf_rows), _INDEX))
    lanes = max(1, -(-spark.sparkContext.defaultParallelism // blocks))  # few trees are read by several tasks each
    trees, chunks = index.where("chunk < 0"), index.where("chunk >= 0")

    found = _meeting(trees, chunks, blocks, lanes).mapInArrow(_positives(positives), ", ".join(f"{n} long" for n in _FOUND))
    nth = F.row_number().over(W.partitionBy("home", "place").orderBy(F.col("score").desc(), "positive_id"))
    best = found.withColumn("nth", nth.cast("long")).where(F.col("nth") <= positives)
    wanted = best.groupBy("home", "chunk").agg(F.collect_list(F.struct("place", "nth", "positive_id", "score")).alias("wanted"))  # as many as a chunk's anchors have positives
    mined = _meeting(trees, chunks.join(wanted, ["home", "chunk"]), blocks, lanes).mapInArrow(_negatives(negatives, low, high), ", ".join(f"{n} long" for n in _MINED))
    rank = F.row_number().over(W.partitionBy("home", "place", "nth").orderBy(F.col("negative_score").desc(), "negative_id"))
    return mined.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
