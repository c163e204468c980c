"""License scans by a generalised suffix automaton of licence words.

The automaton holds all word sequences of the templates. A text streams through it and every
position gets its matching statistic: the length of the longest word sequence ending there that
some template has. Maximal matches of ``SEED`` words or more are then chained per template (ascending
in both, small gaps); the best chain is the template's span in the text, and the share of the template's
words that it covers is its coverage. A short template must stand in whole and without gaps, a long one
by ``LONG_SHARE`` of its words. Templates are whole licence texts (the folder ``licences``) and the sentences
by which works name their licences. Stretches of text without ``SEED`` words whose neighbours are neighbours
in some template cannot hold a match and are passed over.

Base phrases are found on the same stream: a phrase ends where the matching statistic reaches its
length in a state whose suffixes hold it.

Defined cases: a null or empty text has 0 words, no places, no spans, no labels and score 0; repeated rows
are scanned one by one; very long texts are streamed in whole; templates that repeat words are found at
all places where they occur; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import release, text_blocks
from .common import own_name, ship

#: phrase -> label; found wherever their words stand consecutively.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, words): sentences by which works name their licences, and openings of licence texts.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
BLOCK_BYTES, LONG_WORDS, LONG_SHARE, MOST_GAP, SEED = 4 << 20, 16, 0.7, 8, 4
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A-Z): runs of ASCII letters, digits and anything beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_WORDS).split()


@lru_cache(maxsize=1)
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(label, text) of the licences whose whole texts come with the package."""
    folder = files(__package__).joinpath("licences")
    return tuple((p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in sorted(folder.iterdir(), key=lambda p: p.name) if p.name.endswith(".txt"))


class LicenseAutomaton:
    """Generalised suffix automaton of template and phrase words."""

    def __init__(self, templates=TEMPLATES, base: dict[str, str] = BASE):
        self.templates = [(label, words_of(t)) for label, t in templates]
        self.phrases = [(label, words_of(t)) for t, label in base.items()]
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words) in enumerate(self.templates + self.phrases):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.number.setdefault(w, len(self.number) + 1))
                if t < len(self.templates):
                    ends[last].append((t, i + 1))
        # Every state's places (template, end), its own and those of the states that it is a suffix of.
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(len(self.next)), key=self.length.__getitem__, reverse=True):
            self.places[state] += ends.get(state, [])
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]
        self.places = [sorted(set(p)) for p in self.places]
        #: Every state's templates as bits.
        self.mask = [sum(1 << t for t in {t for t, _ in p}) for p in self.places]
        # The phrases that end in a state, by walking its suffixes.
        final = defaultdict(list)
        for p, (_, words) in enumerate(self.phrases):
            state = 0
            for w in words:
                state = self.next[state][self.number[w]]
            final[state].append((len(words), p))
        self.ending: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.ending[state] = final.get(state, []) + (self.ending[self.link[state]] if self.link[state] > 0 else [])
        #: The shortest match that counts, and all neighbours of words in templates and phrases.
        self.least = min([SEED, *(len(w) for _, w in self.templates + self.phrases)])
        both = [[self.number[w] for w in words] for _, words in self.templates + self.phrases]
        self.size = len(self.number) + 1
        self.neighbours = np.unique(np.array([a * self.size + b for x in both for a, b in zip(x, x[1:], strict=False)], np.int64))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, float]]:
        """Base places (start, phrase) and the best coverage of each template that has a match."""
        places, spans = self.spans(words)
        return places, {t: covered for t, (covered, _, _) in spans.items()}

    def _runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First places and ends of the stretches that may hold a match."""
        if self.least < 2:
            good, more = ids > 0, 0
        else:
            pairs = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.neighbours, pairs), len(self.neighbours) - 1)
            good, more = (self.neighbours[at] == pairs) & (ids[:-1] > 0) & (ids[1:] > 0), 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        firsts, ends = edges[0::2], edges[1::2] + more
        long = ends - firsts >= self.least
        return firsts[long], ends[long]

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, tuple[float, int, int]]]:
        """Base places (start, phrase), and of each template that has a match the best chain: coverage, first and last word."""
        ids = np.fromiter(map(self.number.get, words, [0] * len(words)), np.int64, len(words))
        places, matches = [], defaultdict(list)
        nxt, link, length = self.next, self.link, self.length
        for first, end in zip(*(x.tolist() for x in self._runs(ids)), strict=True):
            state = size = 0
            for i, w in enumerate(ids[first:end].tolist(), first):
                before, held = state, size
                while state and w not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if held > size:  # the match could not be extended: it is maximal, and so are those of its suffixes
                    self._note(matches, before, held, i, suffixes=True)
                    before, held = state, size
                state = nxt[state].get(w, 0)
                size = size + 1 if state else 0
                if lost := self.mask[before] & ~self.mask[state]:  # some templates end here, others go on
                    self._note(matches, before, held, i, lost)
                for n, p in self.ending[state]:
                    if size >= n:
                        places.append((i + 1 - n, p))
            self._note(matches, state, size, end, suffixes=True)
        return places, {t: self._chain(t, m) for t, m in matches.items()}

    def _note(self, matches: dict, state: int, size: int, end: int, templates: int = -1, suffixes: bool = False) -> None:
        """Note a match that ends before ``end`` for its ``templates``, and with ``suffixes`` the longest one of all others."""
        while size >= self.least:
            for t, at in self.places[state]:
                if templates >> t & 1 and size >= min(SEED, len(self.templates[t][1])):
                    matches[t].append((end - size, end, at - size, at))
            if not suffixes:
                break
            templates &= ~self.mask[state]
            state = self.link[state]
            size = self.length[state]

    def _chain(self, t: int, found: list[tuple[int, int, int, int]]) -> tuple[float, int, int]:
        """Largest share of template t that one chain of matches covers, and the chain's first and last word."""
        total = len(self.templates[t][1])
        if total < LONG_WORDS:
            a, b, _, _ = max(found, key=lambda m: (m[1] - m[0], -m[0]))
            return (b - a) / total, a, b - 1
        found.sort()
        best: list[tuple[int, int]] = []  # covered words, first word
        near: list[tuple[int, int, int, int, int]] = []  # end, first and last place, coverage and first word of matches that may be followed
        at = -1
        for a, b, c, d in found:
            if a > at:  # a gap only grows: what is too far behind once is so for good
                at, near = a, [x for x in near if x[0] >= a - MOST_GAP]
            top, start = 0, a
            for b2, c2, d2, covered, first in near:
                if c2 <= c and c - d2 <= 4 * MOST_GAP:
                    cut = max(0, b2 - a, d2 - c)  # overlapping words count once
                    if cut < b - a and covered - cut > top:
                        top, start = covered - cut, first
            best.append((top + b - a, start))
            near.append((b, c, d, top + b - a, start))
        i = max(range(len(best)), key=lambda i: (best[i][0], -i))
        return min(1.0, best[i][0] / total), best[i][1], found[i][1] - 1

    def enough(self, t: int, coverage: float) -> bool:
        return coverage >= (LONG_SHARE if len(self.templates[t][1]) >= LONG_WORDS else 1.0)

    def standing(self, found: dict[int, tuple[float, int, int]]) -> list[tuple[int, int, str, float]]:
        """The spans that are enough, as first and last word, label and coverage, by first word.

        Of long templates of like length that claim the same words (licences that differ by a clause), the one best covered.
        """
        kept: list[tuple[int, tuple[float, int, int]]] = []
        for t, span in sorted(found.items(), key=lambda x: (-x[1][0], -len(self.templates[x[0]][1]), x[0])):
            n = len(self.templates[t][1])
            if not self.enough(t, span[0]):
                continue
            rivals = (s for u, s in kept if n >= LONG_WORDS and n <= 2 * len(self.templates[u][1]) <= 4 * n)
            if not any(2 * (min(span[2], s[2]) - max(span[1], s[1]) + 1) > span[2] - span[1] + 1 and s[0] > span[0] for s in rivals):
                kept.append((t, span))
        return sorted((first, last, self.templates[t][0], covered) for t, (covered, first, last) in kept)


@lru_cache(maxsize=2)
def _automaton(templates: tuple | None, base: tuple) -> LicenseAutomaton:
    """Built once in a worker."""
    return LicenseAutomaton(TEMPLATES + whole_texts() if templates is None else templates, dict(base))


_SPAN = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("coverage", T.DoubleType())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple | None = None, base: dict[str, str] = BASE) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score (best coverage of any template), spans.

    ``spans``: of every template that stands in the text, its label, first and last word and coverage, by first word.
    ``templates`` None takes the sentences above and the whole texts.
    """
    ship(docs.sparkSession)
    column = own_name("text", [id_col])
    only = docs.select(F.col(id_col).alias(id_col), F.col(text).alias(column))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), _SPAN]
    arrow = [to_arrow_type(t) for t in types]
    chosen, phrases = None if templates is None else tuple(templates), tuple(base.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(chosen, phrases)
        for table in text_blocks(batches, column, BLOCK_BYTES):
            rows = []
            for value in table.column(column):
                words = words_of(value.as_py() or "")
                places, found = automaton.spans(words)
                based = {automaton.phrases[p][0] for _, p in places}
                stands = automaton.standing(found)
                labels = based | {label for _, _, label, _ in stands}
                starts = [s for s, _ in places]
                spans = [{"label": label, "first_word": a, "last_word": b, "coverage": c} for a, b, label, c in stands]
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(based)), ",".join(sorted(labels)), max((c for c, _, _ in found.values()), default=0.0), spans))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)]
            yield pa.record_batch([table.column(id_col).combine_chunks(), *columns], names=[id_col, *names])
            del table, rows, columns
        release()

    return only.mapInArrow(run, T.StructType([only.schema[id_col], *(T.StructField(n, t) for n, t in zip(names, types, strict=True))]))
