"""Corpus operators against brute force on small fixtures, with the defined edge cases of each."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugemark.llm import bsi_topk, byte_bpe, components, exact_dedup, html_extract, language_id, license_scan, ngram_join, source_mix, token_counts, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and rain wind cold station report model hour value field cloud storm sun sea ice fog".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC)


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", ","]) for _ in range(n))


# -- language ID


def brute_bits(counts, word):
    """Code length of one word under prediction by partial matching, computed from raw counts."""
    seen = {}
    for w, times in counts.items():
        padded = b" " + w + b" "
        for i in range(1, len(padded)):
            for order in range(0, min(language_id.ORDER, i) + 1):
                seen.setdefault(padded[i - order : i], {}).setdefault(padded[i], 0)
                seen[padded[i - order : i]][padded[i]] += times
    bits, padded = 0.0, b" " + word + b" "
    for i in range(1, len(padded)):
        for order in range(min(language_id.ORDER, i), -1, -1):
            here = seen.get(padded[i - order : i])
            if here is None:
                continue
            total, distinct = sum(here.values()), len(here)
            if padded[i] in here:
                bits -= np.log2(here[padded[i]] / (total + distinct))
                break
            bits -= np.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    r = random.Random(3)
    counts = {lang: {"".join(r.choices(letters, k=r.randint(1, 7))).encode(): r.randint(1, 5) for _ in range(40)} for lang, letters in (("aa", "abcde"), ("bb", "cdefg\u00e9"))}
    trees = language_id.ContextTrees(counts)
    words = [b"abc", b"q", "d\u00e9g".encode(), b"cdcdcdcdcd", *list(counts["aa"])[:5]]
    got = trees.word_bits(words)
    for k, lang in enumerate(trees.languages):
        assert np.allclose(got[:, k], [brute_bits(counts[lang], w) for w in words])


def test_language_held_out_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**9, None, "en"), (10**9 + 1, "", None), (10**9 + 2, "123 ... !", "de"), (10**9 + 3, "x" * 200_000, None)], "doc_id long, text string, lang string")
    out = language_id.identify_table(docs.unionByName(extra)).toPandas().set_index("doc_id")
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = out.loc[truth.index][out.loc[truth.index]["held_out"]]
    assert (held["lang_pred"] == truth.loc[held.index]).mean() > 0.95
    assert list(out.loc[[10**9, 10**9 + 1, 10**9 + 2], "lang_pred"]) == ["und"] * 3 and out.loc[10**9, "score"] == 0
    assert out.loc[10**9 + 3, "lang_pred"] != "und" and out["score"].between(0, 1).all()


def test_language_without_training_rows(spark):
    assert [tuple(r) for r in language_id.identify_table(spark.createDataFrame([(5, "abc", None)], "doc_id long, text string, lang string")).select("lang_pred", "score").collect()] == [("und", 0.0)]


# -- HTML


def test_html_blocks_and_labels(spark):
    page = (
        "<!doctype html><html><head><title>T</title><style>p{}</style><script>x('</p>')</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
        "<div class='ad'>Buy this now.</div><article><h1>A long title here</h1><p>First &amp; best  sentence,\n with <b>bold</b> text.<br>More words follow here.</p><p>Second paragraph goes on with more of the story.</p></article>"
        "<section class='comments'><h3>Replies</h3><div class=comment><b>Ann</b><p>I like it.</p></div></section><footer>&copy; 2024 Site</footer></body></html>"
    )
    rows = [(1, "u", page, 7), (2, None, None, 7), (3, "u", "", 7), (4, "u", "<p", 7), (5, "u", page, 7)]
    out = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    want = "A long title here\nFirst & best sentence, with bold text. More words follow here.\nSecond paragraph goes on with more of the story."
    assert out[1]["text"] == out[5]["text"] == want and out[1]["n_chars"] == len(want)
    assert [out[i]["text"] for i in (2, 3, 4)] == ["", "", ""] and out[2]["n_chars"] == 0


def test_html_held_out_synthetic_accuracy():
    maker, net, right, total = html_extract.PageMaker(12345), html_extract.labeller(), 0, 0
    for _ in range(150):
        blocks = html_extract.leaves(maker.page())
        y = [maker.MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(maker.MARK, "") or "-"
        got = net.label([html_extract.vectors(blocks)])[0] >= 0.5
        right, total = right + sum(a == b for a, b in zip(y, got, strict=True)), total + len(y)
    assert right / total > 0.96


def test_lstm_gradients():
    net = html_extract.BiLstm(5, 3, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    x, mask, y = r.normal(size=(2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool), r.integers(0, 2, (2, 4)).astype(float)

    def loss():
        p = net.forward(x, mask)[0]
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for name, g in grads.items():
        at = tuple(r.integers(0, s) for s in net.w[name].shape)
        keep = net.w[name][at]
        net.w[name][at] = keep + 1e-3
        up = loss()
        net.w[name][at] = keep - 1e-3
        down = loss()
        net.w[name][at] = keep
        assert abs((up - down) / 2e-3 - g[at]) < 2e-3


# -- BPE and token counts


EDGES = ["", None, " ", "a", "it's we'll  two   spaces\n\n\tend ", "\u00e9\u00df\u4f60\u597d \U0001f600 \u0001\u0000x", "<|endoftext|> is text", "1234567 12,5", "x" * 5000, ("ab " * 3000), "\u00a0\u2003wide\u3000", "same text", "same text"]


def tokenizer():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, sf_dir):
    rows = [(i, t, "s") for i, t in enumerate(EDGES)] + [(None, "no id", "s"), (3, "id again", "s")]
    rows += [(1000 + r["doc_id"], r["text"], "s") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    want = sorted((-1 if i is None else i, ",".join(map(str, tokenizer().encode_ordinary(t or ""))), (t or "").encode()) for i, t, _ in rows)
    encoded = byte_bpe.decode(byte_bpe.encode(docs_of(spark, rows).repartition(3))).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], ",".join(map(str, r["ids"])), bytes(r["decoded"])) for r in encoded) == want
    digest = {r["doc_id"]: r for r in byte_bpe.digests(byte_bpe.encode(docs_of(spark, rows))).collect()}
    assert digest[0]["n_tokens"] == 0 and digest[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_varints():
    r = np.random.default_rng(1)
    x = np.concatenate([[0, 1, 127, 128, 16383, 16384, 2**34], r.integers(0, 10**6, 1000)])
    assert (byte_bpe.unvarints(byte_bpe.varints(x)) == x).all() and len(byte_bpe.unvarints(b"")) == 0


def brute_count(scores, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores))
    return -best[-1][1]


def test_trie_counts_equal_brute_force(spark):
    r = random.Random(5)
    scores = {bytes([b]): -5.0 for b in b"abc"} | {"".join(r.choices("abc", k=r.randint(2, 5))).encode(): -r.randint(1, 9) for _ in range(40)}
    words = ["".join(r.choices("abc", k=r.randint(0, 12))).encode() for _ in range(300)]
    assert token_counts.UnigramTrie(scores).counts(words) == [brute_count(scores, w) for w in words]
    rows = [(i, t, "s") for i, t in enumerate(EDGES)]
    out = {r["doc_id"]: r for r in token_counts.token_counts(docs_of(spark, rows)).collect()}
    import public_tokenizers

    trie, find = token_counts.UnigramTrie.of_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), byte_bpe.pre_tokens()
    for i, t, _ in rows:
        pieces = find(t or "")
        short = [p.encode() for p in pieces if len(p) < 100]
        assert out[i]["n_words"] == len(pieces)
        if len(short) == len(pieces):
            assert out[i]["n_tokens"] == sum(brute_count(trie.scores, w) for w in short)


# -- top-k


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8) * 0.3]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(900, None), (920, [1.0, None, 0.0]), (940, [float("nan")] * 8), (960, [float("inf")] * 8), (980, []), (None, rows[0][1]), (1000, [0.5, 0.5]), (1001, [2e8] + [0.0] * 7)]
    out = bsi_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7, block_rows=100, chunk_queries=5).collect()
    vec = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    want = []
    for q in vec:
        if q % 20 == 0:
            best = sorted((-dot(vec[q], v), i) for i, v in vec.items() if i != q)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert bsi_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# -- exact dedup


@pytest.mark.parametrize("weak", [False, True])
def test_dedup_equals_brute_force(spark, weak):
    r = random.Random(7)
    texts = [prose(r, n) for n in (0, 1, 5, 300, 900, 4000)]
    rows = [(i, r.choice(texts).replace(" ", r.choice([" ", "  ", "\n", " \t\x0b"])), "s") for i in range(200)] + [(500, None, "s"), (501, "", "s"), (None, texts[3], "s"), (3, "  ", "s"), (502, " ", "s"), (502, " ", "s")]
    hashed = (lambda c: F.length(c).cast("long")) if weak else F.xxhash64
    out = exact_dedup.exact_dedup(docs_of(spark, rows), hashed=hashed).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((-1 if i is None else i, min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in out) == want
    assert sum(x["kept"] for x in out) == len(groups)
    if not weak:
        kept = exact_dedup.keep_first(docs_of(spark, rows)).collect()
        assert sorted(norm(x["text"]) for x in kept) == sorted(groups)


def test_chunks_join_to_the_text(spark):
    t = prose(random.Random(1), 5000) + "\n" + "x" * 30_000
    got = spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks_of(F.col("t")).alias("c")).first()["c"]
    assert "".join(got) == t and len(got) > 20 and max(map(len, got)) <= exact_dedup.MAX_CHARS


# -- licences


def test_license_scan_equals_brute_force(spark):
    r = random.Random(9)
    pieces = [*license_scan.BASE, *(t for _, t in license_scan.TEMPLATES), "the", "license", "under the", "cc by", "\u00e9t\u00e9", "foo bar"]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 12))).upper().replace(" ", r.choice([" ", "-", ", "])), "s") for i in range(150)] + [(900, None, "s"), (901, "", "s")]
    out = {x["doc_id"]: x for x in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    for i, t, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        starts, based = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            starts += found
            based |= {label} if found else set()
        full = {label for label, x in license_scan.TEMPLATES if any(words[k : k + len(x.split())] == x.split() for k in range(len(words)))}
        row = out[i]
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (len(words), len(starts), ",".join(sorted(based)))
        assert (row["first_word"], row["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert based | full <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    assert out[900]["labels"] == "" and out[900]["score"] == 0


def test_automaton_knows_exactly_the_template_factors():
    a = license_scan.LicenseAutomaton((("x", "a b a c a b"), ("y", "b a b b")), {"a b": "p"})
    texts = ["a b a c a b".split(), "b a b b".split()]
    factors = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for n in range(1, 5):
        for w in __import__("itertools").product("abc", repeat=n):
            state = 0
            for x in w:
                state = a.next[state].get(a.number.get(x.encode(), -1)) if state is not None else None
            assert (state is not None) == (w in factors)


def test_long_template_in_parts():
    words = license_scan.TEMPLATES[2][1].split()
    changed = words[:15] + ["really"] + words[15:40] + words[42:]
    a = license_scan.LicenseAutomaton()
    coverage = a.scan([w.encode() for w in changed])[1][2]
    assert 0.9 < coverage < 1 and a.enough(2, coverage) and not a.enough(2, a.scan([w.encode() for w in words[:12]])[1][2])


# -- mixing


def test_targets_equal_iterated_sharing(spark):
    r = random.Random(4)
    for sizes in ({f"s{i}": r.randint(0, 1000) for i in range(13)} | {None: 50}, {"a": 10_000, "b": 1, "c": 1}, {"only": 7}, {"z": 0}):
        got = {x["source"]: x["target"] for x in source_mix.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
        names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
        want, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
        while left > 1e-9 and open_:
            unit, spare = left / sum(weight[k] for k in open_), 0.0
            for k in list(open_):
                want[k] += unit * weight[k]
                if want[k] >= 2 * sizes[k]:
                    spare += want[k] - 2 * sizes[k]
                    want[k] = 2.0 * sizes[k]
                    open_.discard(k)
            left = spare
        assert all(abs(got[k] - want[k]) < 1e-6 for k in sizes)


def test_mix_takes_what_it_should(spark):
    r = random.Random(6)
    rows = [(i, prose(r, r.randint(0, 60)), r.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)] + [(9000, None, "a"), (9001, prose(r, 3000), "b"), (5, "again", "b")]
    first, second = (sorted(map(tuple, source_mix.mix(docs_of(spark, rows)).collect()), key=str) for _ in range(2))
    assert first == second and len(first) == len(rows)
    taken, target, size = {}, {}, {}
    for _, n, source, total, goal, copies, words in first:
        assert words == copies * n and 0 <= words <= 2 * n
        taken[source] = taken.get(source, 0) + words
        target[source], size[source] = goal, total
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) < 0.05 * target[s] + 200


# -- n-gram join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}
    comp = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
            comp = {k: new if v == old else v for k, v in comp.items()}
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("frequent", "rounds", "hot"), [(256, 6, 32), (1, 0, 2), (2, 1, 1000)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, frequent, rounds, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    r = random.Random(hot)
    shared = prose(r, 40)
    rows = []
    for _ in range(8):
        base = prose(r, r.randint(8, 120)).split()
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                w[r.randrange(len(w))] = r.choice(["Xx", "yy", "zz", "THE"])
            rows.append(" ".join(w) if r.random() < 0.7 else " ".join(w) + "\n" + shared)
    rows += ["", None, "one two", "One  TWO", "a b c d", "same words " * 50, "same words " * 60, shared, shared]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    out = ngram_join.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3), frequent=frequent, rounds=rounds).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == brute_components(rows)


def test_ngram_join_edges(spark):
    text = "a b c d e f g h"
    out = ngram_join.jaccard_components(docs_of(spark, [(None, text, "s"), (4, text, "s"), (4, text, "s"), (9, text, "s"), (7, " ", "s")])).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in out) == [("4", 4, "4"), ("4", 4, "4"), ("7", 0, "7"), ("9", 4, "4"), ("None", 4, "None")]
    assert ngram_join.jaccard_components(docs_of(spark, [])).collect() == []


def test_component_paths_agree(spark):
    r = random.Random(1)
    for edges in ([(i, i + 1) for i in range(30)], [(r.randrange(150), r.randrange(150)) for _ in range(110)]):
        frame = spark.createDataFrame(edges, "a long, b long")
        assert sorted(map(tuple, components.components(frame).collect())) == sorted(map(tuple, components.components(frame, local_edges=0).collect()))


# -- urls


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme/x", "http://ORG", "https://A.Example.ORG/es/1", "http://example.org/en/12?q#f", "http://example.org/en/2", "http://badexample.org/es/", "ftp://x.com/fr/", "http://x.com/de/?a", "http://x.net/de/", "://h.org/a://b"]
    out = {x["page_id"]: x for x in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string"))).collect()}
    assert [(out[i]["host"], out[i]["path"]) for i in range(5)] == [("", ""), ("", ""), ("", ""), ("org", ""), ("a.example.org", "/es/1")]
    assert [out[i]["rule"] for i in range(3, 12)] == [None, "example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, "org/"]
    assert [out[i]["verdict"] for i in (4, 5, 6, 8, 9, 10)] == ["block", "block", "allow", "allow", "block", "allow"]


def test_link_walk_equals_brute_force(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/p">x</a>' for h in hosts)
    pages = [(1, "http://good.org/a", link("mid.net", "mid.net", "good.org")), (2, "http://bad.com/de/x", link("lost.net")), (3, "http://mid.net/", link("far.net")), (4, "http://far.net/", None), (5, "http://lurer.net/", link("bad.com")), (6, "http://pair.net/", link("lurer.net") + '<a href="/own">'), (7, "http://lone.net/", "<a href='//good.org/'>")]
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    edges = {("good.org", "mid.net"), ("bad.com", "lost.net"), ("mid.net", "far.net"), ("lurer.net", "bad.com"), ("pair.net", "lurer.net"), ("lone.net", "good.org")}

    def walk(seeds, edges):
        mass = {h: 0.15 * s for h, s in seeds.items()}
        for _ in range(url_filter.STEPS):
            new = {h: 0.15 * s for h, s in seeds.items()}
            for a, b in edges:
                new[b] = new.get(b, 0) + 0.85 * mass.get(a, 0) / sum(x == a for x, _ in edges)
            mass = new
        return mass

    trust, distrust = walk({"good.org": 1.0}, edges), walk({"bad.com": 1.0}, {(b, a) for a, b in edges})
    for i, u, _ in pages:
        h = u.split("/")[2]
        want = "block" if distrust.get(h, 0) > 0.5 * (distrust.get(h, 0) + trust.get(h, 0)) else "allow"
        assert got[i] == ({1: "allow", 2: "block"}.get(i) or want)
    assert got[5] == got[6] == "block" and got[3] == got[4] == got[7] == "allow"


# -- all of them


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (language_id.identify_table(empty), html_extract.extract(pages), byte_bpe.digests(byte_bpe.encode(empty)), token_counts.token_counts(empty), exact_dedup.exact_dedup(empty), exact_dedup.keep_first(empty), license_scan.scan_licenses(empty), source_mix.mix(empty), url_filter.judge_urls(pages)):
        assert out.collect() == []


def test_clashing_columns(spark):
    rows = docs_of(spark, [(1, "some words under the MIT license here now", "a"), (2, None, None)])
    odd = rows.selectExpr("*", "1 AS id", "'x' AS recipe", "2 AS n", "3 AS block", "'y' AS ids", "4 AS chunks", "5 AS h", "6 AS size", "7 AS score", "'z' AS lang_pred", "8 AS sha", "9 AS copies")
    for run in (language_id.identify_table, lambda d: byte_bpe.digests(byte_bpe.encode(d)), token_counts.token_counts, exact_dedup.exact_dedup, exact_dedup.keep_first, license_scan.scan_licenses, source_mix.mix, ngram_join.jaccard_components):
        assert run(odd).count() == 2 if run is not exact_dedup.keep_first else 2
