"""Inputs on which the corpus operators once did a part of the work."""

import random

import numpy as np
import pytest

from gaugemark.llm import html_extract, url_filter

PAGES = "page_id long, url string, html string"


def link(*hosts):
    return "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)


def test_walk_follows_a_long_chain(spark):
    """Distrust goes back over 16 links, trust forward over 16; both chains are without a rule of their own."""
    pages = [(0, "http://bad.com/de/x", None), *((i, f"http://h{i}.net/", link(f"h{i - 1}.net" if i > 1 else "bad.com")) for i in range(1, 17))]
    pages += [(20, "http://good.org/", link("t1.net")), *((20 + i, f"http://t{i}.net/", link(f"t{i + 1}.net")) for i in range(1, 17))]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert all(got[i] == "block" for i in range(17)) and all(got[20 + i] == "allow" for i in range(17))


def test_walk_settles_on_cycles(spark):
    """Verdicts on a cyclic graph are those of the walks' linear equations."""
    r = random.Random(4)
    hosts = ["good.org", "bad.com", *(f"h{i}.net" for i in range(14))]
    out = {h: set(r.sample([x for x in hosts if x != h], 2)) for h in hosts}
    pages = [(i, f"http://{h}/de/x" if h == "bad.com" else f"http://{h}/", link(*sorted(out[h]))) for i, h in enumerate(hosts)]
    got = {x["host"]: x["verdict"] for x in url_filter.judge_urls(spark.createDataFrame(pages, PAGES), damping=0.5).collect()}
    a = np.array([[1.0 if y in out[x] else 0.0 for y in hosts] for x in hosts])

    def settled(a, seed):
        share = a / np.maximum(a.sum(axis=1, keepdims=True), 1)
        return np.linalg.solve(np.eye(len(hosts)) - 0.5 * share.T, 0.5 * np.array([float(h == seed) for h in hosts]))

    trust, distrust = settled(a, "good.org"), settled(a.T, "bad.com")
    assert np.abs(distrust - trust).min() > 1e-6
    want = {h: "block" if d > t else "allow" for h, t, d in zip(hosts, trust, distrust, strict=True)}
    assert got == want | {"good.org": "allow", "bad.com": "block"} and len(set(want.values())) == 2


def texts(html):
    return [b.text for b in html_extract.leaves(html)]


@pytest.mark.parametrize("tag", "svg math select object canvas template".split())
def test_unclosed_skipped_elements_end_with_their_block(tag):
    assert texts(f"<article><p>One <{tag} id=x><g>icon</p><p>Two</p><p>Three</p></article>") == ["One", "Two", "Three"]
    assert texts(f"<article><{tag}><g>icon<p>One</p><p>Two</p></article>") == ["One", "Two"]
    assert texts(f"<div><span><{tag}>icon</span> One</div><div>Two") == ["One", "Two"]
    assert texts(f"<p>One<{tag}>a<{tag}>b<p>Two<{tag}>c</{tag}> more<p>Three") == ["One", "Two", "more", "Three"]
    # Closed ones hide all that is in them, blocks, stray end tags and nested ones too.
    assert texts(f"<div>One<{tag}><p>no</p><{tag}>no</{tag}></div>no<script>'</{tag}>'</script>no</{tag}></div><p>Two</p>") == ["One", "Two"]


def test_head_ends_before_the_first_element_of_a_body():
    assert texts("<head><title>x</title><article><h1>One</h1><p>Two</p></article>") == ["One", "Two"]
    assert texts("<html><head><meta charset=utf-8><link rel=a href=b><style>p{}</style>\n<p>One</p></html>") == ["One"]
    assert texts("<head><title>x</title>One<p>Two") == ["One", "Two"]
    assert texts("<head><title>x</title><noscript><p>no</p></noscript><noframes>no</noframes><template><p>no</p></template><template>no<body><p>One") == ["One"]
    assert texts("<head><title>no</title><script>no</script></head><body>One</body>") == ["One"]


def test_loose_page_keeps_its_text(spark):
    words = "Rain came over the hills and the wind went down, so the station reported a calm and cool evening."
    page = f"<head><title>T</title><article><h1>A long title here</h1><p>{words} <svg viewBox=1><path d=x></p><p>{words}</p><p>{words}</p></article>"
    out = html_extract.extract(spark.createDataFrame([(1, "u", page)], PAGES)).collect()
    assert out[0]["text"] == "\n".join(["A long title here", words, words, words])


def test_all_words_of_a_block_count():
    first = " ".join(["rain"] * 64)
    a, b = (html_extract.vectors(html_extract.leaves(f"<p>{first} {tail}</p>"))[0] for tail in (" ".join(["wind"] * 40), " ".join(["snow"] * 40)))
    at = slice(html_extract.PATH_BINS, html_extract.PATH_BINS + html_extract.WORD_BINS)
    assert not np.array_equal(a[at], b[at]) and abs(a[at].sum() - 1) < 1e-6 and a[html_extract.PATH_BINS + html_extract._bin("wind", html_extract.WORD_BINS)] == np.float32(40 / 104)


def test_notice_without_telling_names():
    words = "Rain came over the hills and the wind went down, so the station reported a calm and cool evening."
    notice = "Subscribe to our newsletter and accept all cookies, see the privacy policy and settings."
    page = f"<body><article><h1>A title</h1><p>{words}</p><p>{words}</p></article><div><p>{notice}</p></div></body>"
    assert html_extract.extract_pages([page], html_extract.labeller()) == [f"A title\n{words}\n{words}"]


def test_chrome_and_main_text_have_words_of_their_own():
    maker, own = html_extract.PageMaker(5), set(html_extract.CHROME_WORDS)
    main, other = set(), set()
    for _ in range(40):
        for b in html_extract.leaves(maker.page()):
            (main if maker.MARK in b.text else other).update(w.strip(",.!?" + maker.MARK).lower() for w in b.text.split())
    assert other & own and not main & (own - set(maker.words))


def test_walk_of_a_cycle_takes_few_checkpoints(spark, monkeypatch):
    """Three hosts in a cycle: masses of the closed formula, from a dozen blocks of steps."""
    made = []
    monkeypatch.setattr(url_filter, "materialise", lambda df, real=url_filter.materialise: made.append(1) or real(df))
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "a", 0.0)], "kind string, host string, seed double")
    edges = spark.createDataFrame([("trust", "a", "b"), ("trust", "b", "c"), ("trust", "c", "a")], "kind string, src string, dst string")
    got = {(r["kind"], r["host"]): r["mass"] for r in url_filter.walk(seeds, edges).collect()}
    first = 0.15 / (1 - 0.85**3)
    assert got == {("trust", h): pytest.approx(first * 0.85**n, rel=1e-6) for n, h in enumerate("abc")}
    assert len(made) <= 15
