"""Main-text extraction on pages that no generator here made: the tables, other markup, hostile html."""

import re
import time

import pyarrow.parquet as pq
import pytest

from gaugemark.llm import html_extract as h

S = (
    "Rain came over the hills in the night, and the wind went down before the morning.",
    "The station reported a calm and cool evening; nobody had expected that.",
    "In the harbour the boats stayed at their moorings until the fog had lifted.",
    "Those who walked home took the upper road, which is longer but dry.",
)


def page_of(body, head="<head><title>t</title></head>"):
    return f"<!doctype html><html>{head}<body>{body}</body></html>"


#: (html, main blocks, other blocks), labelled by hand, in the markup of common site software.
PAGES = {
    "blog software": (
        page_of(
            f"<div id=page class='hfeed site'><header id=masthead class=site-header><p class=site-title><a href=/>My blog</a></p><nav id=site-navigation class=main-navigation><ul><li class='menu-item menu-item-12'><a href=/a>About me</a></li><li class=menu-item><a href=/c>Contact</a></li></ul></nav></header>"
            f"<div id=content class=site-content><main id=main class=site-main><article id=post-77 class='post type-post hentry'><h1 class=entry-title>A night of rain</h1><div class=entry-content><p>{S[0]}</p><p>{S[1]} {S[2]}</p><blockquote><p>{S[3]}</p></blockquote></div></article>"
            f"<div id=comments class=comments-area><h2 class=comments-title>2 thoughts</h2><ol class=comment-list><li class='comment even'><div class=comment-content><p>Nice read, thank you.</p></div></li></ol></div></main></div>"
            f"<aside id=secondary class=widget-area><section class='widget widget_search'><h2 class=widget-title>Search</h2></section><section class='widget widget_recent_entries'><ul><li><a href=/o>Older post</a></li></ul></section></aside><footer id=colophon class=site-footer><div class=site-info>Proudly made by hand</div></footer></div>"
        ),
        ["A night of rain", S[0], f"{S[1]} {S[2]}", S[3]],
        ["My blog", "About me", "Contact", "2 thoughts", "Nice read, thank you.", "Search", "Older post", "Proudly made by hand"],
    ),
    "server form": (
        page_of(f"<form method=post action=./news.aspx id=aspnetForm><div class=header><ul class=topnav><li><a href=/>Home</a></li><li><a href=/news>News</a></li></ul></div><div id=ctl00_content class=content><h1>Harbour news</h1><p>{S[2]}</p><p>{S[0]} {S[3]}</p></div><div class=footer>All rights reserved. Imprint</div></form>"),
        ["Harbour news", S[2], f"{S[0]} {S[3]}"],
        ["Home", "News", "All rights reserved. Imprint"],
    ),
    "news site": (
        page_of(
            f"<div class=cookie-banner role=dialog><p>We use cookies. See our privacy policy.</p><button>Accept</button></div><header class=topbar><a href=/>The Paper</a></header><nav class=breadcrumb><a href=/w>Weather</a></nav><main><article class=story><h1>Fog in the harbour</h1><div class='ad ad-slot'>Advertisement: buy boats.</div><p class=lead>{S[2]}</p><p>{S[1]}</p>"
            f"<figure><img src=x.jpg></figure><p>{S[3]} {S[0]}</p></article></main><aside class=related><h3>More stories</h3><ul><li><a href=/1>Ice on the lake</a></li><li><a href=/2>Sun at last</a></li></ul></aside><div class=newsletter><p>Subscribe to our newsletter.</p></div><footer><p>Contact | Imprint</p></footer>"
        ),
        ["Fog in the harbour", S[2], S[1], f"{S[3]} {S[0]}"],
        ["We use cookies. See our privacy policy.", "Accept", "The Paper", "Weather", "Advertisement: buy boats.", "More stories", "Ice on the lake", "Sun at last", "Subscribe to our newsletter.", "Contact | Imprint"],
    ),
    "head and body left out": (
        f"<html><head><meta charset=utf-8><title>x</title><link rel=stylesheet href=a.css><article><h1>A long title here</h1><p>{S[0]}<p>{S[1]}<p>{S[2]}</article><footer>Imprint and contact</footer>",
        ["A long title here", *S[:3]],
        ["Imprint and contact"],
    ),
    "documentation": (
        page_of(f"<nav class=sidebar><ul class=toc><li><a href=#a>Install</a></li><li><a href=#b>Use</a></li></ul></nav><main role=main><div class=document><section id=install><h1>Install the tool</h1><p>{S[3]}</p><pre>run the tool</pre><p>{S[1]}</p></section></div></main><footer class=footer><p>Copyright of its authors.</p></footer>"),
        ["Install the tool", S[3], "run the tool", S[1]],
        ["Install", "Use", "Copyright of its authors."],
    ),
    "encyclopedia": (
        page_of(f"<div id=mw-navigation class=navigation><ul><li><a href=/m>Main page</a></li><li><a href=/r>Random page</a></li></ul></div><div id=content class=main-content><h1 id=firstHeading>Harbour</h1><div id=bodyContent><p>{S[2]} {S[1]}</p><h2>History</h2><p>{S[0]}</p><ul><li>{S[3]}</li></ul></div></div><div id=footer class=footer><ul><li>Text is free to use.</li></ul></div>"),
        ["Harbour", f"{S[2]} {S[1]}", "History", S[0], S[3]],
        ["Main page", "Random page", "Text is free to use."],
    ),
}


def test_precision_and_recall_on_other_markup():
    net, hit, taken, wanted = h.labeller(), 0, 0, 0
    for html, main, other in PAGES.values():
        blocks = [b.text for b in h.leaves(html)]
        assert sorted(blocks) == sorted(main + other)
        got = h.extract_pages([html], net)[0].split("\n")
        hit, taken, wanted = hit + len([x for x in got if x in main]), taken + len(got), wanted + len(main)
    assert hit / taken >= 0.95 and hit / wanted >= 0.95, (hit, taken, wanted)


def test_tables_give_their_articles(sf_dir):
    """Every page of the tables has one article element, whose blocks are the text."""
    htmls = pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist()
    got = h.extract_pages(htmls, h.labeller())
    assert got == ["\n".join(b.text for b in h.leaves(re.search(r"<article>(.*?)</article>", x, re.S)[1])) for x in htmls]


HOSTILE = {
    "stray quotes": '<a "' * 250_000,
    "open values": '<a x="' * 170_000,
    "two kinds of quotes": "<a x=\"'" * 140_000,
    "deep": "<div class=x>" * 40_000 + "x" + "</div>" * 40_000,
    "deep with text": "<div>a" * 100_000,
    "end tags of nothing": "<div>" * 50_000 + "</p></span>" * 70_000,
    "brackets": "<" * 1_000_000,
    "comments": "<!--" * 250_000,
    "open icons": "<svg>" * 200_000,
    "long number": "&#" + "9" * 1_000_000 + ";x",
    "equals": "<a " + "= " * 500_000,
    "attribute names": "<p " + "class " * 160_000 + ">x",
    "scripts": "<script>" * 125_000,
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_hostile_megabytes_take_linear_time(kind):
    begin = time.process_time()
    blocks = h.leaves(HOSTILE[kind])
    assert time.process_time() - begin < 2 and all(b.text for b in blocks)


def test_a_long_page_among_short_ones_is_not_padded_to_it(monkeypatch):
    long, short = "<p>a" * 5000, "<article><h1>T</h1><p>One two three.</p></article>"
    seen = []
    monkeypatch.setattr(h, "_padded", lambda pages, f=h._padded: seen.append(len(pages) * max(map(len, pages))) or f(pages))
    got = h.extract_pages([short] * 200 + [long] + [short] * 200, h.labeller())
    assert len(got) == 401 and got[0] == got[-1] and max(seen) <= max(h.MOST_CELLS, 5000)


def test_quotes_and_references():
    assert [b.text for b in h.leaves("<p title=it's>One</p><p x=\"a > b\">Two</p><p \"y\">Three &#65;&#x42;&#00000067; &#99999999;</p><a href=\"x>Four</a>")] == ["One", "Two", "Three ABC �", "Four"]


def test_columns_with_clashing_names(spark):
    page = PAGES["documentation"][0]
    rows = spark.createDataFrame([(1, "u", page, "x", 5, "y"), (1, "u", page, "x", 5, "y"), (None, None, None, None, None, None)], "page_id long, url string, html string, TEXT string, n_chars int, `_html` string")
    out = h.extract(rows)
    assert out.columns == ["page_id", "url", "_html", "text", "n_chars"]
    got = out.collect()
    assert sorted(r["n_chars"] for r in got) == [0, len("\n".join(PAGES["documentation"][1])), len("\n".join(PAGES["documentation"][1]))]
