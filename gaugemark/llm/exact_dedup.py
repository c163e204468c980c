"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text's bytes are cut where their own content says so, in any script, so equal passages give equal chunks. Each distinct
chunk text moves once to be verified: grouping by the chunk's text itself shows whether two
different chunks share a 64-bit hash, and those that do get further identifiers. A document is
then its recipe, the ordered list of verified identifiers; documents are compared by recipes, and
no document's text moves.

Defined cases: a null text counts as empty; empty texts are equal to each other (their recipe is
the empty list); a null id sorts after all others; rows that repeat an id and a text stay apart and
only one of them is kept; a table without rows gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WHITE, materialise, own_name

#: A chunk has at least ``MIN_BYTES`` bytes of UTF-8, then ends behind the first pair of bytes that the rule picks, or at ``MAX_BYTES``.
MIN_BYTES, MAX_BYTES = 512, 8192
MAX_CHARS = MAX_BYTES


def _rest(remainder: int) -> str:
    """Character class of the bytes that leave ``remainder`` when divided by 8."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(remainder, 256, 8)) + "]"


#: The pairs stand two or three bytes apart, so that they fall on trailing bytes in scripts of two, three and four bytes a character.
CUT_AFTER = f"(?<={_rest(3)}.{_rest(3)}|{_rest(0)}..{_rest(0)})"


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def chunks_of(text: Column, least: int = MIN_BYTES, most: int = MAX_BYTES) -> Column:
    """The content-defined chunks of a text, in order, each byte of its UTF-8 as one character; joined they give the text's bytes."""
    each = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(each, F.lit(rf"(?s).{{{least},{most}}}?{CUT_AFTER}|.{{1,{most}}}"), F.lit(0))


def bytes_of(chunk: Column) -> Column:
    return F.encode(chunk, "ISO-8859-1")


def colliding_chunks(chunks: DataFrame, hashed: Column) -> DataFrame:
    """Distinct texts of column ``chunk`` whose hash another text has too: (chunk, h, nth).

    Each distinct chunk moves once, after a map-side aggregation; then hashes alone are counted.
    Only if two texts share a hash, which is rare, are those texts gathered in a second pass.
    """
    distinct = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).select("chunk", hashed.alias("h"))
    shared = materialise(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    if shared.isEmpty():
        return chunks.sparkSession.createDataFrame([], "chunk binary, h long, nth int")
    return materialise(distinct.join(shared, "h", "left_semi").withColumn("nth", F.row_number().over(W.partitionBy("h").orderBy("chunk"))))


def recipes(docs: DataFrame, text: str = "text", hashed=F.xxhash64) -> DataFrame:
    """``docs`` with ``recipe``: array<string|long> of verified chunk identifiers, and ``text_sha256``.

    ``hashed`` is the chunk hash (a Column function returning long); tests pass a weak one.
    """
    body = normalised(F.col(text))
    with_chunks = docs.withColumn("chunks", chunks_of(body))
    collided = colliding_chunks(with_chunks.select(F.explode("chunks").alias("chunk")).select(bytes_of(F.col("chunk")).alias("chunk")), hashed(F.col("chunk")))
    made = with_chunks.withColumn("text_sha256", F.sha2(body.cast("binary"), 256)).withColumn("recipe", F.transform("chunks", lambda c: hashed(bytes_of(c))))
    if collided.isEmpty():
        return made.drop("chunks")
    # Documents with such a chunk name it by hash and ordinal; the ordinals are appended in order.
    uid = own_name("row_uid", made.columns)
    made = materialise(made.withColumn(uid, F.monotonically_increasing_id()))
    nth = made.select(uid, F.posexplode("chunks").alias("pos", "chunk")).withColumn("chunk", bytes_of(F.col("chunk"))).join(collided.select("chunk", "nth"), "chunk")
    extra = nth.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct("pos", "nth"))).alias("extra"))
    longs = F.flatten(F.transform(F.col("extra"), lambda x: F.array(x["pos"].cast("long"), x["nth"].cast("long"))))
    mended = F.when(F.col("extra").isNull(), F.col("recipe")).otherwise(F.concat(F.col("recipe"), F.array(F.lit(-1).cast("long")), longs))
    return made.join(extra, uid, "left").withColumn("recipe", mended).drop("chunks", "extra", uid)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hashed=F.xxhash64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs became single spaces. Of equal texts the
    row with the smallest id stays. A hot recipe is pre-aggregated before its shuffle, and the join
    back can be split by adaptive execution, as both of its sides are plain shuffles.
    """
    only = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    base = materialise(recipes(only, "text", hashed).select("id", "recipe", "text_sha256").withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    groups = base.groupBy("recipe").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("recipe", "n", F.col("first.id").alias("keep"), F.col("first.uid").alias("keep_uid"))
    out = base.join(materialise(groups), "recipe", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_uid", "uid") == F.col("uid")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts move once, to meet the small table of (id, digest) of the rows that stay. Only if rows
    repeat an id and a text are they reduced to one in a further step.
    """
    flags = materialise(exact_dedup(docs, id_col, text).select(F.col(id_col).alias("id_"), F.col("text_sha256").alias("sha_"), "kept"))
    repeats = not flags.groupBy("id_", "sha_").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    sha = own_name("sha", docs.columns)
    hashed = docs.withColumn(sha, F.sha2(normalised(F.col(text)).cast("binary"), 256))
    stay = flags.where("kept").select("id_", "sha_")
    out = hashed.join(stay, hashed[id_col].eqNullSafe(stay["id_"]) & (hashed[sha] == stay["sha_"]), "left_semi")
    return (out.dropDuplicates([id_col, sha]) if repeats else out).select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
