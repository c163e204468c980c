"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags, each with its path of open
tags. A block becomes a vector of hashed counts (tags, classes and ids of its path, its nearest
element, hashed words) and a few figures (lengths, link share, place). A bidirectional LSTM in numpy
reads the page's sequence of vectors, so that every block is classified with the whole document as
context, and the blocks labelled as main text are joined in page order.

The labeller is trained here, on pages that a seeded generator composes with known labels: articles
in many markups among menus, headers, footers, sidebars, notices, adverts, forms, comments and broken
or cut-off markup. It never sees the tables. Its size and its training are fixed parameters, so a
worker's memory is bounded by a batch of pages.

Defined cases: null or empty html gives the empty text; scripts, styles, markup comments, the head and
other unseen elements are never text, nor are elements below the body with the attribute ``hidden`` or a style
of their own that hides them; unclosed and stray tags are tolerated; a head ends before the
first text or element that cannot stand in one; an svg, math, select, object, canvas or template
without its end tag ends with its parent or before the next block; a page without main blocks gives
the empty text; very long pages are read in whole; repeated rows are separate.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import release, text_blocks
from .common import own_name, ship

PATH_BINS, WORD_BINS, FIGURES, HIDDEN = 256, 32, 8, 16
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 1200, 6, 48, 0.01, 11
BLOCK_BYTES, MOST_CELLS = 2 << 20, 1 << 14
#: A block counts as main text from this probability on: a lost paragraph is worse than a line too many.
MAIN_FROM = 0.35
_UNSEEN = frozenset("script style head title noscript template svg math iframe object select textarea canvas".split())
_RAW = frozenset("script style noscript iframe textarea title".split())
_SKIPPED = frozenset("template svg math object select canvas".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS_SKIPPED = _CLOSES_P - {"hr"} | frozenset("body caption center dd details dialog dt figcaption figure hgroup li menu summary tbody td tfoot th thead tr".split())
#: Comments, declarations and tags. Quotes count behind "=" only, and a quote that never closes is a character like others,
#: so a tag that begins always matches (at the end of the html at the latest) and no part of the html is read twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
#: Numbers of character references that are beyond Unicode; the decoder would refuse very long ones.
_BEYOND = re.compile(r"&#(?:0*+[1-9][0-9]{7,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,}+);?")

_ANY_SKIPPED = re.compile(rf"<(?:{'|'.join(sorted(_SKIPPED))})\b", re.I)
_WORD = re.compile(r"\w+|[^\w\s]")
_PARTS = re.compile(r"[\s_-]+")

_VALUE = re.compile(r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)")
_STYLE = re.compile(r"""(?<![\w-])style\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
_HIDES = re.compile(r"(?<![\w-])(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)\b")


def _hidden(attributes: str) -> bool:
    """Whether a tag's attributes hide its element: ``hidden``, or display or visibility in its style."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    if any(_HIDES.search(x) for m in _STYLE.finditer(low) for x in m.groups() if x):
        return True
    return "hidden" in _VALUE.sub("= ", low).replace("hidden=", "hidden ").rstrip("/").split()


class Leaf:
    """A block: the bins of its path's marks, how many marks, its text, characters within links."""

    __slots__ = ("bins", "marks", "text", "linked")

    def __init__(self, bins: tuple[int, ...], marks: int, text: str, linked: int):
        self.bins, self.marks, self.text, self.linked = bins, marks, text, linked


def _after(tag: str, html: str, at: int) -> int:
    """Where a raw element's end tag ends; without one it runs to the end."""
    close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
    return close.end() if close else len(html)


def _ends(html: str) -> dict[int, int]:
    """Start of a skipped element -> end of its end tag, for those that have one. One pass, elements of a name nest."""
    if not _ANY_SKIPPED.search(html):
        return {}
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {t: [] for t in _SKIPPED}
    at = 0
    while m := _TOKEN.search(html, at):
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if tag in _SKIPPED:
            if not m[1]:
                if not m[3].endswith("/"):
                    opened[tag].append(m.start())
            elif opened[tag]:
                ends[opened[tag].pop()] = at
        elif tag in _RAW and not m[1] and not m[3].endswith("/"):
            at = _after(tag, html, at)
    return ends


def leaves(html: str) -> list[Leaf]:
    """The page's text blocks in order. The path of open elements is kept as a count for each bin of its ``tag`` and
    ``.name`` marks, which opening and closing an element change, so the time does not grow with the depth."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[int, ...], int, bool]] = []
    path: dict[int, int] = {}  # bin -> how many open marks fall into it
    depth = 0
    open_tags: dict[str, int] = {}
    held: list[str] = []
    linked = in_link = unseen = loose = 0
    ends = _ends(html)

    def flush():
        nonlocal linked
        if held:
            text = " ".join(unescape(_BEYOND.sub("\ufffd", "".join(held))).split())
            if text:
                out.append(Leaf(tuple(path), depth, text, linked))
            held.clear()
            linked = 0

    def pop() -> str:
        nonlocal in_link, unseen, loose, depth
        tag, bins, marks, hides = stack.pop()
        open_tags[tag] -= 1
        for i in bins:
            if path[i] == 1:
                del path[i]
            else:
                path[i] -= 1
        depth -= marks
        loose -= tag in _SKIPPED
        in_link -= tag == "a"
        unseen -= hides
        return tag

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else end]
        if stack and stack[-1][0] == "head" and piece.strip():
            pop()
        if piece and not unseen:
            held.append(piece)
            if in_link:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag not in _INLINE:
                flush()
            if open_tags.get(tag):
                while pop() != tag:
                    pass
            continue
        while loose and tag in _ENDS_SKIPPED:
            pop()
        in_head = bool(stack) and stack[-1][0] == "head"
        if in_head and tag not in _IN_HEAD:
            pop()
        if tag == "br":
            held.append(" ")
            continue
        if tag not in _INLINE:
            flush()
            # Inline elements left open end with their block, a paragraph or item with the next one.
            left_open = tag in _SKIPPED and m.start() not in ends and not m[3].endswith("/")
            while not left_open and stack and stack[-1][0] in _INLINE:
                pop()
            closing = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",) if tag in _CLOSES_P else ())
            while stack and stack[-1][0] in closing:
                pop()
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in _RAW or in_head and tag == "noframes":
            at = _after(tag, html, at)
            continue
        if m.start() in ends:
            at = ends[m.start()]
            continue
        bins, marks = (), 0
        if tag not in _INLINE:
            names = " ".join(x for g in _NAMES.findall(m[3]) for x in g).lower() if m[3] else ""
            named = [f".{x}" for x in _PARTS.split(names) if x]
            marks = 1 + len(named)
            bins = tuple(_bin(x, PATH_BINS) for x in ([] if tag in ("html", "body") else [tag]) + named)
            for i in bins:
                path[i] = path.get(i, 0) + 1
            depth += marks
        hides = tag in _UNSEEN or bool(m[3]) and tag not in ("html", "body") and _hidden(m[3])
        stack.append((tag, bins, marks, hides))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        in_link += tag == "a"
        unseen += hides
        loose += tag in _SKIPPED
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _bin(mark: str, bins: int) -> int:
    return crc32(mark.encode("utf-8", "replace")) % bins


class _WordBins(dict):
    """word -> bin; forgets all words when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = n = crc32(word.encode("utf-8", "replace")) % WORD_BINS
        return n


_WORD_BIN = _WordBins()


def vectors(blocks: list[Leaf]) -> np.ndarray:
    """One row of features for each block."""
    out = np.zeros((len(blocks), PATH_BINS + WORD_BINS + FIGURES), np.float32)
    chars = np.array([len(b.text) for b in blocks], np.float32)
    done = np.cumsum(chars) / max(1.0, float(chars.sum()))
    for i, b in enumerate(blocks):
        row = out[i]
        row[list(b.bins)] = 1.0
        words = _WORD.findall(b.text.lower())
        if words:
            row[PATH_BINS : PATH_BINS + WORD_BINS] = np.bincount(list(map(_WORD_BIN.__getitem__, words)), minlength=WORD_BINS) / len(words)
        n = len(b.text)
        row[-FIGURES:] = (min(1.5, np.log1p(n) / 8), min(1.0, b.linked / n), sum(b.text.count(c) for c in ".,;:!?") / n * 10, i / len(blocks), done[i], min(1.0, b.marks / 12), float(b.text[-1] in ".!?"), 1.0)
    return out


class BiLstm:
    """Bidirectional LSTM with a logistic output for each position, in numpy."""

    def __init__(self, inputs: int = PATH_BINS + WORD_BINS + FIGURES, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.normal(size=(inputs, 4 * hidden)) * inputs**-0.5).astype(np.float32)
            self.w[f"h{d}"] = (rng.normal(size=(hidden, 4 * hidden)) * hidden**-0.5).astype(np.float32)
            self.w[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.w["o"] = (rng.normal(size=2 * hidden) * 0.3).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: (pages, steps, inputs) in reading order of direction d. Padding leaves the state alone."""
        h = self.h
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        state = np.zeros((len(x), h), np.float32)
        cell = np.zeros_like(state)
        outs = np.zeros((len(x), x.shape[1], h), np.float32)
        tape = []
        for t in range(x.shape[1]):
            z = pre[:, t] + state @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            m = mask[:, t, None]
            new = np.where(m, f * cell + i * g, cell)
            tanh = np.tanh(new)
            if keep:
                tape.append((i, f, o, g, cell, tanh, state, m))
            state = np.where(m, o * tanh, state)
            cell = new
            outs[:, t] = state
        return outs, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tape_f = self._run("f", x, mask, keep)
        b, tape_b = self._run("b", x[:, ::-1], mask[:, ::-1], keep)
        both = np.concatenate([f, b[:, ::-1]], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["ob"]))), both, tape_f, tape_b

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, tape_f, tape_b = self.forward(x, mask, True)
        err = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        grad = {"o": np.einsum("pt,pth->h", err, both), "ob": err.sum(keepdims=True).reshape(1)}
        h = self.h
        for d, tape, part in (("f", tape_f, self.w["o"][:h]), ("b", tape_b, self.w["o"][h:])):
            e, xs = (err, x) if d == "f" else (err[:, ::-1], x[:, ::-1])
            gz = np.zeros((len(x), x.shape[1], 4 * h), np.float32)
            gh_w = np.zeros_like(self.w[f"h{d}"])
            gs, gc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                i, f, o, g, before, tanh, state, m = tape[t]
                gs = gs + e[:, t, None] * part
                live = np.where(m, gs, 0)
                gn = np.where(m, gc + live * o * (1 - tanh**2), 0)
                z = np.concatenate([gn * g * i * (1 - i), gn * before * f * (1 - f), live * tanh * o * (1 - o), gn * i * (1 - g**2)], axis=1)
                gz[:, t] = z
                gh_w += state.T @ z
                gs = np.where(m, z @ self.w[f"h{d}"].T, gs)
                gc = np.where(m, gn * f, gc)
            grad[f"x{d}"] = np.einsum("pti,ptz->iz", xs, gz, optimize=True)
            grad[f"h{d}"] = gh_w
            grad[f"c{d}"] = gz.sum(axis=(0, 1))
        return grad

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's vectors the probabilities that its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        at: list[int] = []
        for n, i in enumerate(order):
            at.append(i)
            longest = len(pages[order[n + 1]]) if n + 1 < len(order) else 0
            if not longest or (len(at) + 1) * longest > MOST_CELLS:  # of pages x blocks, padding counted
                x, mask = _padded([pages[j] for j in at])
                p = self.forward(x, mask)[0]
                for j, row in zip(at, p, strict=True):
                    out[j] = row[: len(pages[j])]
                at = []
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


#: Words of menus, notices, adverts, forms, comments and footers in four languages; main text has none in training.
CHROME_WORDS = (
    "accept account advert advertisement advertising agree browser cart click comment comments consent contact cookie cookies copyright discount email follow gdpr home login logout menu newsletter offer partners password policy popular preferences previous next privacy promo register related reply reserved rights sale search settings share shop sidebar sign signup sitemap sponsored subscribe subscription tags terms trending unsubscribe username "
    "akzeptieren angebot anmelden anzeige datenschutz einstellungen folgen impressum kommentar kommentare kontakt konto passwort rabatt registrieren startseite suche teilen warenkorb weiterlesen werbung zustimmen "
    "aceptar anuncio boletín buscar compartir comentario comentarios contacto contraseña cuenta derechos inicio oferta patrocinado política privacidad publicidad registrarse reservados suscribirse "
    "abonnez abonner accepter accueil connexion commentaire commentaires confidentialité droits inscription partager politique publicité recherche réservés sponsorisé"
).split()

#: Shares of CHROME_WORDS in pieces of chrome.
OWN_SHARES = (0.0, 0.3, 0.6)


class PageMaker:
    """Seeded composition of training pages; main text carries a mark that tells its label.

    A piece of chrome takes a share of its words from CHROME_WORDS, the rest from those of the main text. A piece
    without telling names takes most of them there, so that it can be told by them and by its place.
    """

    MARK = ""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "eaionrtslducmpghbfvkéüñ"
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) for _ in range(600)]
        self.own = 0.0  # share of CHROME_WORDS
        self.signs = False  # whether words of the page carry signs

    def word(self) -> str:
        word = self.r.choice(CHROME_WORDS if self.r.random() < self.own else self.words)
        return word + self.r.choice("*#%$+/|~=^@!") * self.r.randint(1, 3) if self.signs and self.r.random() < 0.8 else word

    def sentence(self, low: int = 1, high: int = 14) -> str:
        r = self.r
        words = [self.word() for _ in range(r.randint(low, high))]
        if r.random() < 0.2:
            words[r.randrange(len(words))] += ","
        return (" ".join(words)).capitalize() + r.choice("....!?")

    def prose(self, most: int = 12) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 4, self.r.randint(1, most)))))

    def few(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, 4)))

    def menu(self) -> str:
        items = [f'<a href="/{self.r.choice(self.words)}">{self.few()}</a>' for _ in range(self.r.randint(2, 9))]
        return self.r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<span>{x}</span> " for x in items)))

    def wrap(self, names: str, inner: str, tags: str = "div section aside") -> str:
        r = self.r
        tag, name = r.choice(tags.split()), r.choice(names.split())
        return f'<{tag} {r.choice(("class", "class", "id"))}="{r.choice((name, name, f"{name}-{r.choice(self.words)}", f"site-{name}", f"{name} {name}-{r.choice(self.words)}"))}">{inner}</{tag}>'

    def chrome(self) -> str:
        """One piece that is not main text."""
        kind = self.r.randrange(12)
        self.own = 0.7 if kind == 11 else self.r.choice(OWN_SHARES)
        out = self._chrome(kind)
        self.own = 0.0
        return out

    def _chrome(self, kind: int) -> str:
        r = self.r
        text = self.prose(5) if r.random() < 0.7 else f"<p>{self.prose(4)}</p><p>{self.prose(3)}</p>"
        if kind == 0:
            return f"<nav>{self.menu()}</nav>"
        if kind == 1:
            return self.wrap("menu nav navbar breadcrumb breadcrumbs navigation topnav toc pagination", self.menu(), "div ul")
        if kind == 2:
            return self.wrap("ad ads advert advertisement sponsor sponsored promo banner adbox", text)
        if kind == 3:
            return self.wrap("sidebar side related widget rail recommended more popular", r.choice((text, self.menu(), f"<h3>{self.few()}</h3>{text}")), "aside div aside section")
        if kind == 4:
            return self.wrap("cookie notice consent gdpr alert modal popup newsletter subscribe paywall", text + r.choice(("", "<button>OK</button>")))
        if kind == 5:
            return f"<form><label>{self.few()}</label><input name=q><p>{self.few()}</p><button>{self.few()}</button></form>"
        if kind == 6:
            one = lambda: r.choice(("<div class=comment><b>{0}</b><p>{1}</p></div>", "<li class='comment'><cite>{0}</cite> <p>{1}</p></li>", "<div class=\"reply comment-body\"><p>{1}</p></div>")).format(self.few(), self.prose(4))
            return self.wrap("comments comment-list responses discussion disqus", f"<h3>{self.few()}</h3>" * (r.random() < 0.5) + "".join(one() for _ in range(r.randint(1, 5))), "section div ol")
        if kind == 7:
            return self.wrap("share social author-bio byline meta tags login search", r.choice((self.menu(), text)))
        if kind == 8:
            return f"<aside>{text}</aside>"
        if kind == 9:
            return f"<header>{r.choice((self.menu(), self.few(), f'<p>{self.few()}</p>', f'<h2>{self.few()}</h2>'))}</header>"
        if kind == 11:  # told by its words only
            tag = r.choice(("div", "section", "div"))
            return f"<{tag}>{text if text[0] == '<' else r.choice((text, f'<p>{text}</p>'))}</{tag}>"
        return self.wrap("header masthead logo site-header topbar", r.choice((self.few(), self.menu(), f"<h2>{self.few()}</h2>")), "div header")

    def footer(self) -> str:
        inner = self.r.choice((f"&copy; {self.few()} &middot; {self.prose(4)}", self.menu(), f"<p>{self.prose(3)}</p>{self.menu()}"))
        return self.r.choice((f"<footer>{inner}</footer>", self.wrap("footer colophon bottom legal copyright", inner, "div footer")))

    def main(self) -> str:
        r, k = self.r, self.MARK
        style = r.randrange(4)
        out = []
        title = self.prose(2)[: r.randint(10, 70)]
        if r.random() < 0.85:
            out.append(f"<h1>{k}{title}</h1>")
        for i in range(r.choice((1, 2, r.randint(1, 6), r.randint(3, 16)))):
            text = self.prose()
            if r.random() < 0.15:
                text = f"<a href=/x>{self.few()}</a> {text}" if r.random() < 0.5 else f"<em>{text}</em>"
            x = r.random()
            if x < 0.06:
                out.append(f"<h2>{k}{self.few()}</h2>")
            if x > 0.94:
                out.append("<ul>" + "".join(f"<li>{k}{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x > 0.91:
                out.append(f"<blockquote>{k}{text}</blockquote>")
            elif x > 0.89:
                out.append(f"<table><tr><td>{k}{self.few()}</td><td>{k}{self.sentence()}</td></tr></table>")
            elif x > 0.86:
                out.append(f"<pre>{k}{r.choice((text, self.few()))}</pre>")
            elif style == 0 and i == 0:
                out.append(f"<p><b>{k}{text}<br>")
            elif style == 1:
                out.append(f"<p>{k}{text}")
            elif style == 2 and x < 0.5:
                out.append(f"<div>{k}{text}</div>")
            else:
                out.append(f"<p>{k}{text}</p>")
            if r.random() < 0.1:
                out.append(self.chrome())
        inner = "".join(out)
        while r.random() < 0.5:  # containers of the main text, with names that tell or that do not
            name = r.choice((r.choice(self.words), r.choice(self.words), r.choice("body document text content-area page-content inner container row col bodycontent section".split())))
            inner = r.choice(("<div class={1}>{0}</div>", "<section id={1}>{0}</section>", "<div id={1}>{0}</div>", "<section>{0}</section>", "<div>{0}</div>", "<div role=main>{0}</div>")).format(inner, name)
        name = r.choice("content post-body entry-content article-body story main-content post text".split())
        return r.choice((f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main role=main>{inner}</main>", f"<main id={name}>{inner}</main>", f"<main><article class={name}>{inner}</article></main>", f'<div class="{name}">{inner}</div>', f'<div id="{name}"><div>{inner}</div></div>', f"<section class={name}>{inner}</section>"))

    def page(self) -> str:
        r = self.r
        self.signs = r.random() < 0.2
        before = "".join(self.chrome() for _ in range(r.choice((0, 1, 2, 2, 3))))
        after = "".join(self.chrome() for _ in range(r.choice((0, 0, 1, 2, 3))))
        body = before + (self.main() if r.random() < 0.96 else "") + after + (self.footer() if r.random() < 0.8 else "")
        x = r.random()
        if x < 0.25:
            body = f"<div class=wrapper><div id=page>{body}</div></div>"
        elif x < 0.37:  # a form around the whole page
            name = r.choice("aspnetForm form1 main-form theForm page-form f".split())
            body = r.choice((f"<form method=post action=./x id={name}>{body}</form>", f"<form name=x id={name}><div id=page>{body}</div></form>"))
        html = f"<!DOCTYPE html><html><head><title>{self.few()}</title><style>p{{}}</style><script>x('</p>')</script></head><body>{body}</body></html>"
        return html[: r.randint(len(html) // 2, len(html))] if r.random() < 0.12 else html


@lru_cache(maxsize=1)
def labeller(pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> BiLstm:
    """The trained network; the same at every call and in every process."""
    maker = PageMaker(SEED)
    data = []
    while len(data) < pages:
        blocks = leaves(maker.page())
        if blocks:
            y = np.array([PageMaker.MARK in b.text for b in blocks], np.float32)
            for b in blocks:
                b.text = b.text.replace(PageMaker.MARK, "") or "-"
            data.append((vectors(blocks), y))
    net = BiLstm()
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    rng, step, mean, kept = np.random.default_rng(SEED), 0, {k: np.zeros_like(v, dtype=np.float64) for k, v in net.w.items()}, 0
    for epoch in range(epochs):
        order = np.array(sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) + rng.integers(0, 6)))
        batches = np.array_split(order, -(-len(order) // BATCH))
        for k in rng.permutation(len(batches)):
            x, mask = _padded([data[i][0] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for row, i in enumerate(batches[k]):
                y[row, : len(data[i][1])] = data[i][1]
            step += 1
            rate = RATE * (1 - epoch / epochs) + 1e-3
            for name, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                net.w[name] = (net.w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            if epoch >= epochs // 2:  # the mean of later steps is steadier than the last one
                kept += 1
                for name, v in net.w.items():
                    mean[name] += v
    net.w = {k: (v / max(kept, 1)).astype(np.float32) for k, v in mean.items()}
    return net


def extract_pages(htmls: list[str | None], net: BiLstm) -> list[str]:
    parsed = [leaves(h) if h else [] for h in htmls]
    labels = net.label([vectors(b) for b in parsed])
    return ["\n".join(b.text for b, p in zip(blocks, label, strict=True) if p >= MAIN_FROM) for blocks, label in zip(parsed, labels, strict=True)]


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the columns ``text`` and ``n_chars`` in place of ``html`` (and of columns of their names)."""
    ship(pages.sparkSession)
    net = pages.sparkSession.sparkContext.broadcast(labeller().w)  # fixed size
    low = {x.lower() for x in (html, text, n_chars)}
    keep = [c for c in pages.columns if c.lower() not in low]
    source = own_name("html", [*keep, text, n_chars])
    only = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html).alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BiLstm()
        model.w = net.value
        for table in text_blocks(batches, source, BLOCK_BYTES):
            texts = extract_pages(table.column(source).to_pylist(), model)
            out = table.drop_columns([source]).append_column(text, pa.array(texts, pa.string())).append_column(n_chars, pa.array([len(t) for t in texts], pa.int64()))
            yield from out.combine_chunks().to_batches()
            del table, texts, out
        release()

    fields = [only.schema[c] for c in keep]
    return only.mapInArrow(run, T.StructType([*fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())]))
