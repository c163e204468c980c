"""Personal data: base spans against plain patterns, EM against planted reliabilities, added spans, defined cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from gaugemark.llm import pii, queries
from test_operators import docs_of, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found_in(spark, texts, **options):
    out = pii.find_pii(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), **options).collect()
    return {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in out}


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(3)
    for alphabet, n in (("ab0.@-", 3000), ("0123 -.+()", 3000), ("14.", 2000), ("a1.2@ +-_é\n(4)5", 6000), ("0 -", 500)):
        for _ in range(n):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            got = [(pii.KINDS[k], a, b) for k, a, b, base in pii.candidates(text) if base]
            assert got == brute(text), text


def test_base_spans_of_numbers_that_touch_and_of_long_parts():
    card = "4111 1111 1111 1111"
    for text in (f"x{card}.{card}-{card}", f"{card} 5", "1.2.3.4.5.6.7.8", "0255.00000000001.3.256 0255.00000000001.3.255", "9" * 5000 + ".1.1.1", "+1 (017) 555-7713)) +1(2", "a@b.c@d.e_f@g.h.", "@@a@-.-", "é@ü.de a@b.ü"):
        assert [(pii.KINDS[k], a, b) for k, a, b, base in pii.candidates(text) if base] == brute(text)


@pytest.mark.parametrize("unit", ["a", "@", "a@", "1", "1 ", "1.", "+1", "+", "(", ":", "a:", "Aa ", "Mr. ", "A", " at ", "DE12 ", "1-2 ", "12 345 ", "Anna "])
def test_finding_is_linear_in_repetitive_texts(unit):
    n = 400_000 // len(unit)
    start = time.process_time()
    pii.candidates(unit * n)
    assert time.process_time() - start < 8


def test_em_finds_how_reliable_labelers_are():
    rng = np.random.default_rng(1)
    n, share = 40_000, 0.3
    on_yes, on_no = np.array([0.95, 0.9, 0.7, 0.85, 0.8, 0.6]), np.array([0.1, 0.05, 0.4, 0.2, 0.3, 0.5])
    truth = rng.random(n) < share
    said = np.where(truth[:, None], rng.random((n, 6)) < on_yes, rng.random((n, 6)) < on_no).astype(int)
    said[rng.random((n, 6)) < 0.2] = pii.NONE
    counts, own = {}, {}
    for row, t in zip(said.tolist(), truth.tolist(), strict=True):
        code = pii.packed(tuple(row))
        assert pii.unpacked(code) == tuple(row)
        counts[code] = counts.get(code, 0) + 1
        own[code] = own.get(code, 0) + t
    trust, posterior = pii.reliabilities(counts)
    assert np.abs(trust[:, 1] - on_yes).max() < 0.12 and np.abs(trust[:, 0] - on_no).max() < 0.12
    assert trust[0, 1] - trust[0, 0] > trust[2, 1] - trust[2, 0] > trust[5, 1] - trust[5, 0]
    right = sum(own[c] if posterior[c] >= 0.5 else counts[c] - own[c] for c in counts) / n
    majority = sum(own[c] if pii.unpacked(c).count(1) > pii.unpacked(c).count(0) else counts[c] - own[c] for c in counts) / n
    assert right > 0.93 and right > majority
    assert max(abs(a - b) for a, b in zip(posterior.values(), pii.reliabilities({c: 1000 * k for c, k in counts.items()})[1].values(), strict=True)) < 0.01


def test_spellings_beyond_the_base_are_found_and_look_alikes_left(spark):
    r = random.Random(4)
    yes = {"email": "write to john.smith (at) example (dot) org today", "ip": "server 2001:db8:85a3:0:0:8a2e:370:7334 answered", "card": "card 3782 822463 10005 was used", "phone": "call 555-123-4567 now", "iban": "account DE89 3704 0044 0532 0130 00 here", "name": "Signed by Maria Gonzalez here", "ssn": "ssn 536-90-4399 given"}
    no = ["iban DE89 3704 0044 0532 0130 01 is false", "order 4111111111111112 came", "at 12:30:45 on time", "version 1.300.2.1000", "The Long Road", "he was at home dot", "see 2024-01-15", "x" * 50, "hash 4111111111111111000000 end"]
    texts = [*yes.values(), *no, *(f"{prose(r, 30)} {r.choice(list(yes.values()))} {prose(r, 30)}" for _ in range(60)), *(prose(r, 60) for _ in range(40))]
    got = found_in(spark, texts)
    for i, kind in enumerate(yes):
        assert [k for k, _ in got[i]] == [kind], (kind, got[i])
    for i in range(len(yes), len(yes) + len(no)):
        assert not got[i], (texts[i], got[i])
    assert all(len(got[i]) == 1 for i in range(16, 76)) and not any(got[i] for i in range(76, 116))
    assert got[0] == [("email", "john.smith (at) example (dot) org")] and got[5] == [("name", "Maria Gonzalez")]


def test_added_spans_overlap_nothing_that_stands():
    mark = lambda kind, a, b, base: {"kind": pii.KINDS.index(kind), "start": a, "end": b, "base": base}
    of = [mark("email", 0, 9, True), mark("ip", 3, 12, True), mark("card", 20, 30, False), mark("phone", 20, 35, False), mark("phone", 34, 40, False), mark("name", 35, 50, False)]
    got = pii.standing(of, [0.1, 0.2, 0.9, 0.9, 0.9, 0.6])
    assert [(s["kind"], s["start"]) for s in got] == [("email", 0), ("ip", 3), ("phone", 20), ("name", 35)]
    texts = ["+1 (017) 555-7713", "mail a.b@c.de (at) x (dot) org", "97.51.17.173 4111 1111 1111 1111"]
    for t in texts:
        base = [(a, b) for _, a, b, is_base in pii.candidates(t) if is_base]
        assert all(is_base or all(b <= c or a >= d for c, d in base) for _, a, b, is_base in pii.candidates(t))


def test_digests_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = "x y. " * 200_000 + "a@b.de"
    rows = [(1, None), (2, ""), (3, "a.b@mail.com +44 20 7946 0958"), (3, "a.b@mail.com +44 20 7946 0958"), (None, "1.2.3.4"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS candidates", "3 AS kind", "4 AS id", "5 AS votes").repartition(2)
    got = sorted(map(tuple, pii.digests(pii.find_pii(docs)).collect()), key=str)
    want = []
    for i, t in rows:
        spans = brute(t)
        n = [sum(k == x[0] for x in spans) for k in pii.BASE]
        want.append((i, *n, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans)))
    assert got == sorted(want, key=str)
    assert pii.digests(pii.find_pii(docs.limit(0))).collect() == []
    assert [tuple(x)[1:5] for x in pii.digests(pii.find_pii(docs.where("doc_id < 3"))).collect()] == [(0, 0, 0, 0)] * 2


def test_registered_query_has_the_base_spans_of_every_document(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op12_pii(spark, sf_dir)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert list(r)[1:5] == [sum(k == x[0] for x in spans) for k in pii.BASE]
        assert set(joined(spans).split(",")) <= set(r["spans"].split(",")) | {""}
