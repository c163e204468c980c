"""The pipeline's stages on a small corpus, each against a brute-force version of its decision."""

import hashlib
import random
import re

import corpus_pipeline
from gaugemark.llm import byte_bpe, source_mix
from test_operators import DOC, brute_components, prose, tokenizer


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages(spark, tmp_path):
    r = random.Random(8)
    base = [prose(r, r.randint(20, 90)) for _ in range(25)]
    rows = []
    for i in range(120):
        words = r.choice(base).split()
        for _ in range(r.choice((0, 0, 1, 3))):
            words[r.randrange(len(words))] = "zz"
        rows.append((i, " ".join(words).replace(" ", r.choice([" ", "  "])), "en", r.choice("aab"), 1))
    rows += [(500, None, "en", "a", 0), (501, "123", "en", None, 3), (None, prose(r, 30), "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOC)
    got = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got.append([tuple(x) for x in docs.collect()])
        if len(got) < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    key = lambda x: (x[0] is None, x)
    kept = [x for x in rows if x[1] and re.search("[a-z]", x[1])]
    assert sorted(got[0], key=key) == sorted(kept, key=key)
    first = {}
    for x in sorted(kept, key=key):
        first.setdefault(norm(x[1]), x)
    assert sorted(got[1], key=key) == sorted(first.values(), key=key)
    groups = brute_components([(x[0], x[1]) for x in got[1] if x[0] is not None])
    assert sorted(got[2], key=key) == sorted((x for x in got[1] if x[0] is None or groups[x[0]][1] == x[0]), key=key)
    copies = {x["doc_id"]: x["copies"] for x in source_mix.mix(spark.createDataFrame(got[2], DOC)).collect()}
    assert sorted(got[3], key=key) == sorted((x for x in got[2] for _ in range(copies[x[0]])), key=key)
    enc = tokenizer()
    want = []
    for x in got[3]:
        ids = enc.encode_ordinary(x[1])
        want.append((x[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x[1].encode()).hexdigest()))
    assert sorted(got[4], key=key) == sorted(want, key=key)


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert byte_bpe.VOCABULARY.endswith(".tiktoken")
