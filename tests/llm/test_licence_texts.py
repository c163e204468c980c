"""Licence scans of whole texts: spans, edits, neighbours, long files."""

import random

import pytest

from gaugemark.llm import license_scan as ls
from test_operators import docs_of, prose

TEXTS = dict(ls.whole_texts())


def spans_of(spark, rows):
    return {x["doc_id"]: [(s["label"], s["first_word"], s["last_word"], round(s["coverage"], 3)) for s in x["spans"]] for x in ls.scan_licenses(docs_of(spark, rows)).collect()}


def test_whole_texts_come_with_the_package():
    assert {"mit", "apache-2", "bsd-2", "bsd-3", "isc", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "mpl-2", "cc0", "unlicense"} <= set(TEXTS)
    assert all(len(ls.words_of(t)) > 100 for t in TEXTS.values())


def test_every_text_is_found_in_a_long_file(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i, (label, text) in enumerate(sorted(TEXTS.items())):
        before = prose(r, 30_000 if i == 0 else r.randint(0, 300))
        rows.append((i, f"{before}\n/* {text.upper()} */\n{prose(r, 50)}", "s"))
        first = len(ls.words_of(before))
        want[i] = (label, first, first + len(ls.words_of(text)) - 1, 1.0)
    got = spans_of(spark, rows)
    for i, span in want.items():
        assert span in got[i]
        assert [s for s in got[i] if s[2] - s[1] > 100] == [span]  # no other whole text claims the words


def test_edited_text_and_neighbouring_licences(spark):
    mit = TEXTS["mit"].split()
    edited = " ".join(["Copyright", "2020", "Somebody", *mit[:40], "hereinafter", *mit[43:120], "gladly", *mit[120:]])
    rows = [(1, edited, "s"), (2, TEXTS["bsd-3"] + "\n\n" + TEXTS["mit"], "s"), (3, TEXTS["bsd-2"], "s"), (4, " ".join(mit[:60]), "s"), (5, None, "s"), (6, "", "s")]
    got = spans_of(spark, rows)
    assert [s[0] for s in got[1] if s[2] - s[1] > 100] == ["mit"] and 0.9 < next(s for s in got[1] if s[2] - s[1] > 100)[3] < 1
    assert [s[0] for s in got[2] if s[2] - s[1] > 100] == ["bsd-3", "mit"]
    assert [s[0] for s in got[3] if s[2] - s[1] > 100] == ["bsd-2"]
    assert "mit" not in [s[0] for s in got[4] if s[2] - s[1] > 100] and got[5] == got[6] == []


def test_stretches_that_are_passed_over_hold_no_match():
    """With and without the filter by neighbours the places and coverages are the same."""
    r = random.Random(4)
    a = ls._automaton(None, tuple(ls.BASE.items()))
    words = [w for t in TEXTS.values() for w in ls.words_of(t)]
    for _ in range(20):
        text = []
        for _ in range(60):
            at = r.randrange(len(words))
            text += words[at : at + r.choice((1, 2, 3, 4, 9, 40))] if r.random() < 0.7 else r.choice([b"under the mit license", b"cc by nc", b"zzz"]).split()
        places, found = a.spans(text)
        plain = ls.LicenseAutomaton.__new__(ls.LicenseAutomaton)
        plain.__dict__ = dict(a.__dict__)
        plain._runs = lambda ids: (ls.np.array([0]), ls.np.array([len(ids)]))
        again, whole = plain.spans(text)
        assert places == again and found == whole


@pytest.mark.parametrize("column", ["text", "spans", "score"])
def test_ids_of_any_name(spark, column):
    docs = docs_of(spark, [(1, "released under the MIT license", "s")]).withColumnRenamed("doc_id", "key").selectExpr("key", "text AS body", "1 AS spans", "2 AS score", "3 AS n_words")
    assert ls.scan_licenses(docs, "key", "body").first()["labels"] == "mit"
