"""What byte-level BPE shuffles follows the data, not the number of partitions."""

import pyarrow as pa

from gaugemark.llm import byte_bpe
from gaugemark.llm.common import table


def written(spark, sf_dir, n, monkeypatch):
    """Rows and bytes of words and layouts that the blocks send, and the digests, with ``n`` shuffle partitions."""
    seen = []
    monkeypatch.setattr(byte_bpe, "_split", lambda buckets, t, f=byte_bpe._split: seen.append(buckets) or f(buckets, t))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        docs = table(spark, sf_dir, "documents")
        encoded = byte_bpe.encode(docs, decoded="decoded")
        digests = None if n > 100 else sorted(map(tuple, byte_bpe.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        monkeypatch.undo()
    sent = docs.select(docs.doc_id.alias("id"), "text").coalesce(1).mapInArrow(byte_bpe._split(seen[0], pa.int64()), "part long, block long, kind byte, bucket int, ids array<long>, data binary")
    rows, size = sent.where("kind < 2").selectExpr("count(*)", "sum(length(data))").first()
    return rows, size, digests


def test_ten_thousand_partitions_send_what_eight_send(spark, sf_dir, monkeypatch):
    few, many = written(spark, sf_dir, 8, monkeypatch), written(spark, sf_dir, 10_000, monkeypatch)
    assert many[0] <= 1.2 * few[0] and many[1] <= 1.2 * few[1]
    assert few[2] == written(spark, sf_dir, 61, monkeypatch)[2] and few[2]


def test_buckets_follow_bytes_within_bounds(spark):
    sizes = [byte_bpe.word_buckets(x) for x in (0, 1 << 30, 30 << 30, 1 << 40, 1 << 63)]
    assert sizes == sorted(sizes) and sizes[0] == byte_bpe.LEAST_BUCKETS and sizes[2] == 480 and sizes[-1] == byte_bpe.MOST_BUCKETS
    nothing_known = spark.createDataFrame([(1, "The rain."), (2, None)], "doc_id long, text string").repartition(3)
    assert [r["n"] for r in byte_bpe.encode(nothing_known).selectExpr("size(ids) AS n").orderBy("n").collect()] == [0, 3]
