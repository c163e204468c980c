"""The n-gram join's index: which branch finds which links, and the filters that must lose none."""

import itertools
import random

import numpy as np
import pytest

from gaugemark.llm import ngram_join as nj
from test_operators import brute_components, docs_of, prose


def classes_of(sets):
    """index_keys' arguments for integer sets, as the shuffle makes them: shared shingles by (frequency, value)."""
    often = {}
    for x in sets:
        for t in x:
            often[t] = often.get(t, 0) + 1
    rows = [sorted((t for t in x if often[t] > 1), key=lambda t: (often[t], t)) for x in sets]
    token = np.array([t for r in rows for t in r], np.uint64)
    return token, np.array([often[t] for r in rows for t in r], np.int64), np.array([len(r) for r in rows]), np.array([len(x) for x in sets])


@pytest.mark.parametrize("threshold", [(3, 4), (1, 2), (9, 10)])
def test_size_levels_of_partners_are_neighbours(threshold):
    bounds = nj.size_levels(threshold)
    level = lambda n: int(np.searchsorted(bounds, n, side="right")) - 1
    for n in [*range(1, 400), 4095, 4096, 4097, 99_999]:
        for m in range(n, n * threshold[1] // threshold[0] + 1):
            assert level(m) - level(n) <= 1
    assert (nj.buckets_of(np.arange(len(bounds) - 2), threshold) < -(-threshold[0] * bounds[:-2] // threshold[1])).all()


@pytest.mark.parametrize(("frequent", "threshold"), [(1, (3, 4)), (3, (3, 4)), (1000, (3, 4)), (1, (1, 2)), (2, (9, 10))])
def test_every_link_has_a_key(frequent, threshold):
    """Also where all common shingles are frequent, so that combinations alone can find the link."""
    r = random.Random(frequent)
    sets = []
    for _ in range(12):
        base = [r.getrandbits(63) for _ in range(r.choice((3, 5, 9, 20, 60, 140)))]
        for _ in range(r.randint(2, 9)):
            kept = [t for t in base if r.random() > r.choice((0.0, 0.02, 0.1, 0.2))] or base[:1]
            sets.append(frozenset(kept + [r.getrandbits(63) for _ in range(r.randint(0, max(1, len(kept) // 6)))]))
    sets = sorted(set(sets), key=sorted)
    token, often, counts, sizes = classes_of(sets)
    of, key, at, pair = nj.index_keys(token, often, counts, sizes, frequent, threshold)
    keys = [set() for _ in sets]
    for i, k in zip(of.tolist(), key.tolist(), strict=True):
        keys[i].add(k)
    bits = nj.parities(token, counts)
    linked = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and threshold[1] * both >= threshold[0] * len(sets[a] | sets[b]):
            linked += 1
            assert keys[a] & keys[b]
            differ = sum(int(x).bit_count() for x in bits[a] ^ bits[b])
            assert (threshold[0] + threshold[1]) * (counts[a] + counts[b] - differ) >= 2 * threshold[0] * (sizes[a] + sizes[b])
    assert linked > 2
    assert not pair.any() if frequent == 1000 else pair.sum() <= 2 * sizes.sum()  # combinations stay about as many as the shingles


def by_branch(sets, frequent):
    """How many linked pairs share single keys, and how many share combinations only."""
    token, often, counts, sizes = classes_of(sets)
    of, key, _, pair = nj.index_keys(token, often, counts, sizes, frequent)
    single, combined = ([{k for o, k, p in zip(of.tolist(), key.tolist(), pair.tolist(), strict=True) if o == i and p == kind} for i in range(len(sets))] for kind in (False, True))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    return len(links), sum(bool(single[a] & single[b]) for a, b in links), sum(bool(combined[a] & combined[b]) and not single[a] & single[b] for a, b in links)


def test_combinations_alone_find_links_of_a_large_group():
    """60 near copies of one text: every shingle that two of them have in common stands in more than FREQUENT of them."""
    r = random.Random(6)
    base = [r.getrandbits(63) for _ in range(120)]
    sets = [frozenset(base[:k] + base[k + 5 :] + [r.getrandbits(63) for _ in range(5)]) for k in range(0, 115, 2)]
    links, singly, combined = by_branch(sets, nj.FREQUENT)
    assert links == len(sets) * (len(sets) - 1) // 2 and singly == 0 and combined == links


def test_rare_shingles_find_links_of_small_groups():
    r = random.Random(7)
    sets = []
    for _ in range(10):
        base = [r.getrandbits(63) for _ in range(80)]
        sets += [frozenset(base[3 * k :]) for k in range(3)]
    links, singly, combined = by_branch(sets, nj.FREQUENT)
    assert links >= 20 and singly == links and combined == 0


@pytest.mark.parametrize("rounds", [0, 6])
def test_large_group_of_near_copies_in_spark(spark, rounds):
    r = random.Random(2)
    base, rows = prose(r, 150).split(), []
    for i in range(70):  # one passage changed in each
        k = 2 * i
        rows.append((i, " ".join(base[:k] + [f"new{i}x{j}" for j in range(4)] + base[k + 4 :])))
    rows += [(100 + i, " ".join(base[:60]) + " " + prose(r, 120)) for i in range(50)]  # a common passage only
    r.shuffle(rows)
    out = nj.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(4), rounds=rounds).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == brute_components(rows)


def test_hot_shingles_by_their_share_of_a_partition(spark, monkeypatch):
    """With many partitions a shingle of two classes of a block counts as hot; results stay."""
    monkeypatch.setattr(nj, "partitions", lambda *_: 300)
    r = random.Random(3)
    base = [prose(r, r.randint(20, 60)) for _ in range(6)]
    rows = [(i, base[i % 6] + (f" tail{i} more" if i % 4 else "")) for i in range(40)]
    out = nj.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == brute_components(rows)
