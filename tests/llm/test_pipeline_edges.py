"""Every stage of the pipeline on empty tables, clashing columns, repeated rows and ids, and very long texts."""

import random

import corpus_pipeline
from gaugemark.llm import byte_bpe
from test_edges import LANGS, spoken
from test_operators import DOC

CLASH = "nth_ string, copies_ int, lang_pred_ string, pred string, score int, `_score` int, row int, copies int, id int, id_ int, n int, sign int, sha string, decoded string, ids string, block int, part int, component_id int, size int, target int"


def staged(spark, docs, path):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(path))
        docs.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        out.append(docs)
    return out


def test_empty_table(spark, tmp_path):
    out = staged(spark, spark.createDataFrame([], DOC), tmp_path)
    assert [x.count() for x in out] == [0] * 5 and out[3].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_clashing_columns_repeated_rows_and_long_texts(spark, tmp_path):
    r = random.Random(3)
    extra = tuple(f"kept{i}" if "string" in c else i for i, c in enumerate(CLASH.split(", ")))
    long = spoken(r, "en", 200_000)
    plain = [(i, spoken(r, k, 40), k, r.choice("ab"), 1) for i, k in enumerate(list(LANGS) * 30)]
    plain += [(500, long, "en", "a", 1), (500, spoken(r, "en", 50), "en", "b", 1), (501, None, None, None, None), (502, "½ 12", "en", "a", 1), (None, spoken(r, "de", 60), "de", None, None), plain[0], plain[1]]
    docs = spark.createDataFrame([(*x, *extra) for x in plain], f"{DOC}, {CLASH}")
    out = staged(spark, docs, tmp_path)
    kept = {x[1] for x in plain if x[1] and any(map(str.isalpha, x[1]))}
    for stage in out[:4]:
        rows = stage.collect()
        assert stage.columns == docs.columns and all(tuple(x)[5:] == extra for x in rows) and {x["text"] for x in rows} <= kept
    assert {x["text"] for x in out[0].collect()} == kept and out[0].count() == len(plain) - 2
    assert out[1].count() == len(kept) and long in {x["text"] for x in out[2].collect()}
    # The mix takes rows, not ids: two rows of one id may be taken differently.
    mixed = {x["text"]: x["count"] for x in out[3].groupBy("text").count().collect()}
    assert set(mixed.values()) <= {1, 2}
    want = {x["text"]: x["copies"] for x in corpus_pipeline.source_mix.mix(out[2].withColumn("place", corpus_pipeline.F.col("text")), row="place").select(corpus_pipeline.F.col("row").alias("text"), "copies").collect() if x["copies"]}
    assert mixed == want
    assert out[4].count() == sum(mixed.values()) and byte_bpe.digests(byte_bpe.encode(out[3])).count() == out[4].count()
