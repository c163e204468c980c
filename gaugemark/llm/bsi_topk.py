"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers. A block of rows holds, for each component and bit, one bitmap over
its rows (the components shifted to be non-negative; a negative factor takes the complement, whose
constant part is put back at the end). For a query, the slices of every component are added with the
weights of the factor's bits by a carry-save adder, so that the scores of all rows of the block come
out as slices too. The k best rows are then selected from the most significant slice downward, and
the rows that are still tied at the boundary are resolved exactly, by the smaller id.

The index is built once, with its slices stored, and blocks stay where they are: chunks of queries are
sent to every block, each task reads its block and lets chunks stream past it (where blocks are fewer than
cores, several tasks read one). Each pair of block and
chunk returns at most k rows a query, and a window takes the k best of them. Block and chunk sizes are
bounded parameters; the count of blocks grows with the rows.

Defined cases: vectors that are null or hold null or non-finite components take no part; empty ones and
shorter ones count as padded with zeros; quantised components stop at +-2 ** 40, scores at the limits of
a long; a query never gets its own row, but other rows of its id; fewer than k candidates give all; rows
that repeat an id are separate queries and separate candidates; no queries, no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .blocks import release
from .common import materialise, ship

SCALE, K, BLOCK_ROWS, CHUNK_QUERIES = 64, 20, 1 << 16, 128
MOST, _LONG = 1 << 40, (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as array<long>; null where the vector takes no part."""
    limit = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < limit))
    held = lambda x: F.greatest(F.least(x, F.lit(float(MOST))), F.lit(-float(MOST)))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(vector, lambda x: F.floor(held(x.cast("double") * scale))))


class Block:
    """Bit slices of a block's rows, which lie in the order of their ids.

    ``low``: each component's least value, ``bits``: its number of slices, ``slices``: all of them, joined.
    """

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.ids, self.n, self.dims, self.low, self.bits = ids, len(ids), len(low), low, bits.tolist()
        words = -(-self.n // 64)
        self.valid = _bitmap(np.ones(self.n, bool), words)
        rows = iter(slices.reshape(-1, max(words, 1)))
        self.plain = [[next(rows) for _ in range(n)] for n in self.bits]
        self.inverse = [[~x for x in of] for of in self.plain]

    @staticmethod
    def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """low, bits and the joined slices of rows of values."""
        words = -(-len(values) // 64)
        low = values.min(axis=0)
        shifted = values - low
        bits = np.array([int(x).bit_length() for x in shifted.max(axis=0)], np.int32)
        return low, bits, b"".join(_bitmap((shifted[:, d] >> b) & 1 > 0, words).tobytes() for d in range(len(low)) for b in range(bits[d]))

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray | None], int]:
        """Slices of every row's score, lowest first, and the constant to add to them."""
        levels: list[list[np.ndarray]] = []
        constant = 0
        for d, factor in enumerate(query.tolist()):
            constant += factor * int(self.low[d]) if d < self.dims else 0
            if d >= self.dims or not factor or not self.bits[d]:
                continue
            slices = self.plain[d]
            if factor < 0:
                factor = -factor
                slices = self.inverse[d]
                constant -= factor * ((1 << self.bits[d]) - 1)
            for shift in range(factor.bit_length()):
                if factor >> shift & 1:
                    while len(levels) < shift + len(slices):
                        levels.append([])
                    for b, bitmap in enumerate(slices):
                        levels[shift + b].append(bitmap)
        out: list[np.ndarray | None] = []
        at = 0
        while at < len(levels):
            now = levels[at]
            if at + 1 == len(levels) and len(now) > 1:
                levels.append([])
            while len(now) > 2:
                a, b, c = now.pop(), now.pop(), now.pop()
                half = a ^ b
                now.append(half ^ c)
                levels[at + 1].append((a & b) | (half & c))
            if len(now) == 2:
                a, b = now
                levels[at + 1].append(a & b)
                now[:] = [a ^ b]
            out.append(now[0] if now else None)
            at += 1
        return out, constant

    def top(self, own: int | None, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Positions and scores of the k best rows but the one at place ``own``; ties to earlier rows."""
        slices, constant = self.score_slices(query)
        open_ = self.valid.copy()
        if own is not None:
            open_[own >> 6] &= ~np.uint64(1 << (own & 63))
        sure = np.zeros_like(open_)
        have = 0
        for s in reversed(slices):
            if s is None:  # no row has this bit
                continue
            high = open_ & s
            n = have + int(np.bitwise_count(high).sum())
            if n > k:
                open_ = high
            else:
                sure, have, open_ = sure | high, n, open_ & ~s
                if n == k:
                    open_ = np.zeros_like(open_)
                    break
        rows = _positions(sure)
        rows = np.concatenate([rows, _positions(open_)[: k - have]])
        scores = [constant] * len(rows)
        for b, s in enumerate(slices):
            if s is not None:
                for i, bit in enumerate(((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).tolist()):
                    scores[i] += bit << b
        return rows, scores


def _positions(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64)
    word, bit = np.nonzero(bits)
    return words[word] * 64 + bit


def _bitmap(flags: np.ndarray, words: int) -> np.ndarray:
    return np.frombuffer(np.packbits(flags, bitorder="little").tobytes().ljust(words * 8, b"\0"), np.uint64)


_INDEX = T.StructType([T.StructField(n, t) for n, t in (("block", T.LongType()), ("home", T.LongType()), ("chunk", T.IntegerType()), ("rows", T.IntegerType()), ("ids", T.BinaryType()), ("low", T.BinaryType()), ("bits", T.BinaryType()), ("data", T.BinaryType()), ("kind", T.StringType()))])
_ARROW = pa.schema([("block", pa.int64()), ("home", pa.int64()), ("chunk", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("bits", pa.binary()), ("data", pa.binary()), ("kind", pa.string())])


def _indexed(every: int, chunk_queries: int):
    """A group of (id, values) rows -> one row with its slices in the order of the ids (chunk -1), and its queries in chunks.

    Of a chunk, ``low`` holds the queries' places in the block and ``data`` their values in the narrowest integers.
    """

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        lists = group.column("values").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        values = np.zeros((len(ids), int(lengths.max())), np.int64)
        values[np.arange(values.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order].astype("<i8"), values[order]
        block = group.column("block")[0].as_py()
        low, bits, data = Block.slices_of(values)
        rows = [(block, block, -1, len(ids), ids.tobytes(), low.tobytes(), bits.tobytes(), data, None)]
        asked = np.flatnonzero(ids % every == 0).astype("<i4")
        for nth in range(0, len(asked), chunk_queries):
            at = asked[nth : nth + chunk_queries]
            part = values[at]
            kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not part.size or np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
            rows.append((block, block, nth // chunk_queries, len(at), ids[at].tobytes(), at.tobytes(), None, part.astype(kind).tobytes(), kind))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def _searched(k: int):
    """Rows sorted by (block, chunk): an index row, then all chunks of queries -> each query's best rows of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] < 0:
                    block = Block(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["low"], np.int64), np.frombuffer(row["bits"], np.int32), np.frombuffer(row["data"], np.uint64))
                    continue
                out = ([], [], [], [], [])
                places = np.frombuffer(row["low"], "<i4").tolist()
                queries = np.frombuffer(row["data"], row["kind"])
                queries = queries.reshape(row["rows"], len(queries) // row["rows"])
                for q, place, values in zip(np.frombuffer(row["ids"], "<i8").tolist(), places, queries, strict=True):
                    best, scores = block.top(place if row["home"] == row["block"] else None, values, k)
                    for to, x in zip(out, ([row["home"]] * len(best), [place] * len(best), [q] * len(best), block.ids[best].tolist(), [max(-_LONG - 1, min(_LONG, x)) for x in scores]), strict=True):
                        to.extend(x)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["home", "place", "query_id", "vec_id", "score"])
        del block
        release()

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores. Queries: rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector), scale).alias("values")).where("id is not null and values is not null")
    n = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    blocks = max(1, -(-n // block_rows))
    # By place, not by content: rows that repeat an id and a vector spread over the blocks too.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    index = materialise(dealt.groupBy("block").applyInArrow(_indexed(every, chunk_queries), _INDEX))
    # Few blocks are read by several tasks each, as many as keep the cores busy, and the chunks are dealt to them.
    lanes = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    slices = index.where("chunk < 0").withColumn("lane", every_one(lanes))
    asked = index.where("chunk >= 0").withColumn("lane", (F.col("home") + F.col("chunk")) % lanes).withColumn("block", every_one(blocks))
    meeting = slices.unionByName(asked).repartitionById(blocks * lanes, (F.col("block") * lanes + F.col("lane")).cast("int")).sortWithinPartitions("block", "chunk")
    found = meeting.mapInArrow(_searched(k), "home long, place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("home", "place").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
