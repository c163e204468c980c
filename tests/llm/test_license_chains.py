"""Chains of licence matches: equal to all chains tried, linear in repetitive texts; base columns against SQL."""

import random
import time

import duckdb
import pytest

from gaugemark.llm import license_scan as L
from gaugemark.llm import queries


def brute_chain(found, total):
    """Best chain by trying every predecessor of every match."""
    found = sorted(found)
    best = []
    for i, (a, b, c, d) in enumerate(found):
        options = [(0, 0, a)]
        for j in range(i):
            _, b2, c2, d2 = found[j]
            cut = max(0, b2 - a, d2 - c)
            if cut < b - a and a - b2 <= L.MOST_GAP and c >= c2 and c - d2 <= 4 * L.MOST_GAP:
                options.append((best[j][0] - cut, -j, best[j][1]))
        top, _, start = max(options, key=lambda x: x[:2])
        best.append((max(top, 0) + b - a, start if top > 0 else a))
    i = max(range(len(best)), key=lambda i: (best[i][0], -i))
    return min(1.0, best[i][0] / total), best[i][1], found[i][1] - 1


def test_chains_are_the_best_of_all_chains():
    r = random.Random(2)
    words = "a b c d e f g".split()
    template = " ".join(r.choice(words) for _ in range(60))
    scan = L.LicenseAutomaton((("x", template),), {})
    seen = 0
    for _ in range(300):
        text = template.split()
        for _ in range(r.randint(0, 12)):
            at = r.randrange(len(text))
            text[at:at] = [r.choice([*words, "zz"]) for _ in range(r.randint(1, 12))] if r.random() < 0.5 else text[r.randrange(len(text)) :][: r.randint(1, 20)]
        kept = {}
        chain = scan._chain
        scan._chain = lambda t, found: kept.setdefault(t, (chain(t, list(found)), list(found)))[0]
        scan.spans([w.encode() for w in text])
        scan._chain = chain
        for got, found in kept.values():
            assert got == brute_chain(found, 60)
            seen += len(found)
    assert seen > 2000


@pytest.mark.parametrize("unit", ["the terms of this license ", "redistribution and use in source and binary forms ", "of the license of the license ", "the software "])
def test_repetitive_texts_take_time_in_proportion(unit):
    scan = L._automaton(None, tuple(L.BASE.items()))

    def seconds(n):
        start = time.process_time()
        scan.spans(L.words_of(unit * (n // len(unit.split()))))
        return time.process_time() - start

    seconds(1000)
    few, many = seconds(10_000), seconds(40_000)
    assert many < 8 * few + 0.5 and many < 6


def test_base_columns_equal_sql(spark, sf_dir):
    sql = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES ('under the mit license', 'mit'), ('apache license version 2', 'apache-2'), ('cc by nc', 'cc-by-nc')) v(phrase, label)),
f AS (SELECT doc_id, label, unnest([i for i in range(1, len(w) + 1) if list_slice(w, i, i + len(p) - 1) = p]) - 1 AS place FROM w, p)
SELECT w.doc_id, len(w)::BIGINT AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place IS NOT NULL), '') AS base_labels FROM w LEFT JOIN f USING (doc_id) GROUP BY ALL"""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(sql)
    out = queries.op7_license_scan(spark, sf_dir).select(*rel.columns)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(rel.fetchall()) and any(r[2] for r in got)
