"""Hard negatives against brute force: ties, windows, repeated ids and rows, odd vectors and labels."""

import random

import numpy as np
import pytest

from gaugemark.llm import hard_negatives as H
from gaugemark.llm import queries

VEC = "vec_id long, embedding array<float>, label int"
LONG = (1 << 63) - 1


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """The definition, row by row with whole numbers."""
    part = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda x, y: sum(s * t for s, t in zip(x, y))  # noqa: E731, B905 - what the shorter one lacks is zero
    held = lambda x: max(-LONG - 1, min(LONG, x))
    out = []
    for a, (i, x, c) in enumerate(part):
        if i % every:
            continue
        others = [(-dot(x, y), j, d) for b, (j, y, d) in enumerate(part) if a != b]
        for s, j, _ in sorted(o for o in others if o[2] == c)[:positives]:
            fits = sorted(o for o in others if o[2] != c and low * -s <= 100 * -o[0] <= high * -s)[:negatives]
            out += [(i, j, n + 1, k, held(-s), held(-t)) for n, (t, k, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, parts=3, **options):
    return sorted(map(tuple, H.mine(spark.createDataFrame(rows, VEC).repartition(parts), **options).collect()))


def rows_of(n, seed, dims=6, labels=4, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.uniform(-spread, spread) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("block_rows,chunk,leaf", [(1 << 14, 128, 256), (40, 2, 4), (7, 1, 1)])
def test_hard_negatives_are_those_of_brute_force(spark, block_rows, chunk, leaf):
    rows = rows_of(260, 1)
    assert mined(spark, rows, every=20, block_rows=block_rows, chunk_anchors=chunk, leaf_rows=leaf) == brute(rows, every=20)


def test_ties_equal_rows_and_repeated_ids(spark):
    r = random.Random(2)
    same, near = [0.5, 0.25, -0.5], [0.25, 0.125, -0.25]
    rows = [(i if i % 4 else 100, same if i % 3 == 0 else near, i % 2) for i in range(120)]
    rows += [(200, same, 0)] * 3 + [(201, near, 1)] * 14 + [(300, [r.uniform(-1, 1)] * 3, 1), (-100, same, 1), (0, near, -1)]
    for options in ({}, {"block_rows": 16, "chunk_anchors": 3, "leaf_rows": 2}):
        assert mined(spark, rows, **options) == brute(rows)


def test_rows_without_part_short_vectors_and_clashing_columns(spark):
    rows = rows_of(60, 3) + [(100, None, 1), (200, [float("nan"), 1.0], 1), (300, [1.0, None], 1), (400, [float("inf")], 1), (500, [0.3], None), (None, [0.3], 1), (600, [], 1), (700, [0.9], 1), (800, [0.9] * 9, 2), (900, [-0.9] * 9, 2)]
    odd = spark.createDataFrame(rows, VEC).selectExpr("*", "1 AS id", "2 AS vector", "3 AS block", "4 AS home", "5 AS rank", "6 AS score", "'x' AS place")
    got = sorted(map(tuple, H.mine(odd, block_rows=20, leaf_rows=4).collect()))
    assert got == brute(rows)
    assert {x[0] for x in got} == {0, 600, 700, 800, 900}


def test_scores_beyond_doubles_are_whole_numbers(spark):
    big = 3e38
    rows = [(0, [big, 1.0], 1), (1, [big, 0.0], 1), (2, [big / 4, 5.0], 2), (3, [0.9 * big, 0.0], 2), (4, [-big, 0.0], 2), (100, [2.0**20 + 0.25, 2.0**20], 3), (5, [2.0**20, 2.0**20], 3), (6, [2.0**19, 2.0**19 + 0.5], 1), (7, [2.0**19, 2.0**19], 1)]
    assert mined(spark, rows, parts=1) == brute(rows)


def test_negative_positives_give_no_row_and_empty_tables_none(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2), (3, [0.5, 0.0], 2)]
    assert mined(spark, rows) == []
    assert mined(spark, rows[1:]) == [] == mined(spark, [], parts=1)
    zero = [(100, [0.0], 1), (1, [1.0], 1), (2, [2.0], 2)]
    assert mined(spark, zero) == [(100, 1, 1, 2, 0, 0)]


def test_nodes_outside_the_window_or_beneath_the_kth_are_not_opened():
    """On far clusters a search reads few leaves; a window below the best ones does not read the best."""
    rng = np.random.default_rng(0)
    centres = np.arange(-32, 32)[:, None] * np.ones((1, 4)) * 1000.0
    values = np.floor(np.repeat(centres, 100, axis=0) + rng.uniform(-20, 20, (6400, 4)))
    labels = rng.integers(0, 2, 6400)
    tree = H.BallTree.loaded(H.BallTree.grow(np.arange(6400), labels, values, 64).stored())
    anchor = tree.fitted(np.full((1, 4), 3.0))
    low, high = tree.bounds(anchor)
    exact = (tree.values @ anchor[0]).astype(int)
    for node in range(len(tree.start)):
        of = exact[tree.start[node] : tree.end[node]]
        assert low[node, 0] <= of.min() and of.max() <= high[node, 0]
    leaves = int((tree.left == 0).sum())
    search = H.Search(tree, anchor[0], 1, None, low[:, 0], high[:, 0])
    top = search.best(5, same=True)
    assert top == sorted((-int(s), int(i)) for s, i, c in zip(exact, tree.ids, tree.labels, strict=True) if c == 1)[:5]
    assert len(search.leaves) <= 0.05 * leaves
    search.leaves.clear()
    within = search.best(10, same=False, least=100_000, most=200_000)
    assert within == sorted((-int(s), int(i)) for s, i, c in zip(exact, tree.ids, tree.labels, strict=True) if c == 0 and 100_000 <= s <= 200_000)[:10]
    assert len(search.leaves) <= 0.1 * leaves


def test_registered_query_relabels(spark, sf_dir):
    rows = [(x["vec_id"], x["embedding"], (x["label"] + 1) % 10 if x["vec_id"] % 7 == 0 else x["label"]) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, sf_dir).collect())) == brute(rows)
