"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Texts are split into pre-tokens. A block of documents (about ``BLOCK_BYTES`` of text) numbers its
   distinct pre-tokens by falling frequency; a document becomes the sequence of these numbers, one
   for each position. One exchange sends the block's distinct words to the buckets of their hashes
   and its documents to the block's own partition.
2. All blocks' copies of a word meet in one bucket, where it is encoded once. The buckets' number follows
   the bytes of the input, not its splits, and is bounded, so that a block sends a few thousand rows of
   words at most however many partitions there are. Beyond ``MOST_WORDS`` words of a bucket, which is a
   guard of the memory only, they are forgotten and encoded anew.
3. The ids go back to their blocks in a second exchange and meet the documents, which wait in the first
   one (it is read twice, not computed twice): positions move once. Documents are put together again.
Decoding looks ids up in the token-byte table, whose size the vocabulary bounds.

A very common word arrives at its bucket once for each block, not once for each use.

Defined cases: a null text counts as empty and has no ids; repeated rows and null ids are rows like
others; a single very long text is a block of its own; no rows in, no rows out. Special tokens are
never produced: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import Vocabulary, ragged, release, text_blocks, unvarints, varints
from .common import partitions, ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES, MOST_WORDS = 4 << 20, 1 << 19
GROUP_DOCS, SHORT_BYTES = 256, 48
#: A bucket of words for so many bytes of input, within these numbers. A block of 4 MB has some 40,000 distinct words.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 256, 2048
_WORDS, _LAYOUT, _DOCUMENTS = 0, 1, 2


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from a rank file. Read on the driver; tasks get it by broadcast."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _bytes_of(table: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes joined, and the start and length of each id."""
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for token, n in table.items():
        lengths[n] = len(token)
    flat = b"".join(sorted(table, key=table.get))
    return np.frombuffer(flat, np.uint8), np.cumsum(lengths) - lengths, lengths


def pre_tokens():
    """text -> list of its pre-tokens, which together are the text."""
    return regex.compile(public_tokenizers.PATTERN).findall


def merged(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all adjacent pairs the one of lowest rank is joined first, of equal ones the leftmost.

    Pairs of short words are looked through for the lowest; in long ones a queue keeps the time near n log n.
    """
    whole = table.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT_BYTES:
        return _merged_by_queue(word, table)
    get, never = table.get, 1 << 62
    pieces = [word[i : i + 1] for i in range(len(word))]
    order = [get(a + b, never) for a, b in zip(pieces, pieces[1:], strict=False)]
    while order and (best := min(order)) < never:
        i = order.index(best)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del order[i]
        if i < len(order):
            order[i] = get(pieces[i] + pieces[i + 1], never)
        if i:
            order[i - 1] = get(pieces[i - 1] + pieces[i], never)
    return [table[x] for x in pieces]


def _merged_by_queue(word: bytes, table: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))  # neighbours of the piece that begins at a place
    alive = [True] * n
    queue = []
    for i in range(n - 1):
        rank = table.get(word[i : i + 2])
        if rank is not None:
            queue.append((rank, i, i + 2))
    heapify(queue)
    while queue:
        _, i, end = heappop(queue)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:  # one of its pieces has been joined to another
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            rank = table.get(word[i : after[end]])
            if rank is not None:
                heappush(queue, (rank, i, after[end]))
        left = before[i]
        if left >= 0:
            rank = table.get(word[left:end])
            if rank is not None:
                heappush(queue, (rank, left, end))
    return [table[word[i : after[i]]] for i in range(n) if alive[i]]


def _pack(words: list[bytes]) -> bytes:
    lengths = varints(np.fromiter(map(len, words), np.int64, len(words)))
    return zlib.compress(len(lengths).to_bytes(4, "little") + lengths + b"".join(words), 6)


def _unpack(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(unvarints(data[4 : 4 + n])) + 4 + n).tolist()
    return [data[a:b] for a, b in zip([4 + n, *ends], ends, strict=False)]


def word_buckets(size: int) -> int:
    """Buckets of words for an input of ``size`` bytes."""
    return min(max(size // BUCKET_BYTES, LEAST_BUCKETS), MOST_BUCKETS)


def _size(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``; very large where it knows nothing, as behind a checkpoint."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _split(buckets: int, id_type: pa.DataType):
    """Documents -> rows of words by bucket, and by block its layout and its documents, a few in a row."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("kind", pa.int8()), ("bucket", pa.int32()), ("ids", pa.list_(id_type)), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, partition = pre_tokens(), TaskContext.get().partitionId()
        for nth, table in enumerate(text_blocks(batches, "text", BLOCK_BYTES)):
            block = (partition << 24) | nth
            words = Vocabulary()
            number = words.__getitem__
            codes = []
            for text in table.column("text"):
                found = find(text.as_py() or "")
                codes.append(np.fromiter(map(number, found), np.int32, len(found)))
            flat = np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            spelled = [w.encode() for w in words]
            spelled = [spelled[i] for i in order.tolist()]
            bucket = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled)) % buckets
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            rows = [(block, block, _LAYOUT, -1, None, zlib.compress(bucket.astype("<u4").tobytes(), 1))]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                rows.append((-1 - b, block, _WORDS, b, None, _pack([spelled[i] for i in by_bucket[cuts[b] : cuts[b + 1]].tolist()])))
            keys = table.column("id").to_pylist()
            for i in range(0, len(codes), GROUP_DOCS):
                group = codes[i : i + GROUP_DOCS]
                lengths = varints(np.fromiter(map(len, group), np.int64, len(group)))
                positions = varints(rank[np.concatenate(group)])
                data = zlib.compress(len(lengths).to_bytes(4, "little") + lengths + positions, 6)
                rows.append((block, block, _DOCUMENTS, -1, keys[i : i + GROUP_DOCS], data))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            del words, number, codes, flat, rank, order, spelled, bucket, by_bucket, rows, table, keys
        release()

    return run


def _encode_words(table):
    """Rows of words -> (block, bucket, ids of its words in order), each distinct word of a bucket encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            of, at, out = [], [], []
            for kind, block, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "bucket", "data")), strict=True):
                if kind != _WORDS:
                    continue
                if len(known) > MOST_WORDS:
                    known.clear()
                ids = []
                for w in _unpack(data):
                    got = known.get(w)
                    if got is None:
                        known[w] = got = np.array(merged(w, table.value), "<u4").tobytes()
                    ids.append(got)
                lengths = varints(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
                numbers = varints(np.frombuffer(b"".join(ids), "<u4"))
                of.append(block)
                at.append(bucket)
                out.append(zlib.compress(len(lengths).to_bytes(4, "little") + lengths + numbers, 6))
            yield pa.record_batch([pa.array(of, pa.int64()), pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["block", "bucket", "data"])
        del known
        release()

    return run


def _reassembled(id_type: pa.DataType, id_col: str, token_bytes=None, to: str | None = None):
    """One block's ids and its layout and documents -> its documents with ids, and with decoded bytes if asked."""
    fields = [pa.field(id_col, id_type), pa.field("ids", pa.list_(pa.int32())), *([pa.field(to, pa.binary())] if to else [])]
    schema = pa.schema(fields)

    def run(words: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = rows.column("kind").to_pylist()
        if _LAYOUT not in kinds:  # the words of a bucket, which the first exchange holds too
            return schema.empty_table()
        lengths = starts = flat = np.zeros(0, np.int64)
        data = rows.column("data").to_pylist()
        # Words came in order of (bucket, rank); the layout tells each rank's bucket.
        order = np.argsort(np.frombuffer(zlib.decompress(data[kinds.index(_LAYOUT)]), "<u4"), kind="stable")
        if len(order):
            counts, ids = [], []
            packed = words.column("data").to_pylist()
            for i in np.argsort(words.column("bucket").to_numpy(), kind="stable").tolist():
                raw = zlib.decompress(packed[i])
                n = int.from_bytes(raw[:4], "little")
                counts.append(unvarints(raw[4 : 4 + n]))
                ids.append(unvarints(raw[4 + n :]).astype(np.int32))
            each, flat = np.concatenate(counts), np.concatenate(ids)
            lengths, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            lengths[order], starts[order] = each, np.cumsum(each) - each
        keys, parts = [], []
        for kind, of, packed in zip(kinds, rows.column("ids").to_pylist(), data, strict=True):
            if kind == _DOCUMENTS:
                raw = zlib.decompress(packed)
                n = int.from_bytes(raw[:4], "little")
                ends = np.cumsum(unvarints(raw[4 : 4 + n]))
                for codes in np.split(unvarints(raw[4 + n :]), ends[:-1]):
                    parts.append(ragged(flat, starts[codes], lengths[codes]).astype(np.int32) if len(codes) else np.zeros(0, np.int32))
                keys += of
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        columns = [pa.array(keys, id_type), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))]
        if to:
            columns.append(_decoded(np.concatenate(parts), offsets, *_table_of(token_bytes)))
        return pa.table(columns, schema=schema)

    return run


_TABLES: dict[int, tuple] = {}


def _table_of(ranked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table of a broadcast rank table, made once in a worker."""
    if id(ranked.value) not in _TABLES:
        _TABLES.clear()
        _TABLES[id(ranked.value)] = _bytes_of(ranked.value)
    return _TABLES[id(ranked.value)]


def _decoded(ids: np.ndarray, offsets: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of ids (by offsets) joined with the token-byte table: the bytes of each list."""
    each = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(each)])[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ragged(flat, starts[ids], each).tobytes() if len(ids) else b"")])


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """One row per document: its id and ``ids``, array<int>, as the rank file at ``path`` encodes its whole text.

    ``decoded`` names a further binary column, the ids decoded again by the token-byte table in the same task.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(ranks(path or public_tokenizers.path(VOCABULARY)))  # bounded by the vocabulary
    only = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    n = partitions(spark, only)
    id_type = only.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)
    schema = T.StructType([T.StructField(x, t) for x, t in (("part", T.LongType()), ("block", T.LongType()), ("kind", T.ByteType()), ("bucket", T.IntegerType()), ("ids", T.ArrayType(id_type)), ("data", T.BinaryType()))])
    rows = only.mapInArrow(_split(word_buckets(_size(docs)), arrow_id), schema).repartition(n, "part")
    words = rows.mapInArrow(_encode_words(table), "block long, bucket int, data binary").repartition(n, "block")
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])
    return words.groupBy("block").cogroup(rows.groupBy("part")).applyInArrow(_reassembled(arrow_id, id_col, table, decoded), out)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, to: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``to`` added: the bytes of its ids (null for null)."""
    ship(encoded.sparkSession)
    table = encoded.sparkSession.sparkContext.broadcast(ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            made = _decoded(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]), *_table_of(table))
            yield batch.append_column(to, pa.compute.if_else(column.is_valid(), made, pa.scalar(None, pa.binary())))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(to, T.BinaryType())]))


def digests(encoded: DataFrame, decoded: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded documents, beside their other columns but the ids and bytes."""
    made = encoded if decoded in encoded.columns else decode(encoded, to=decoded)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(text.cast("binary"), 256), "decoded_sha256": F.sha2(decoded, 256)}).drop("ids", decoded)
