import math
import random

import numpy as np
import pytest

from larder.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, anchor int, window int"


def brute(rows, every=50, positives=5, negatives=3):
    ok = []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, lab, v in ok:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in ok)
        pos = [(j, -s) for s, j, m in scored if m == lab and j != i][:positives]
        for p, ps in pos:
            neg = [(j, -s) for s, j, m in scored if m != lab and 50 * ps <= -100 * s <= 95 * ps][:negatives]
            out += [(i, p, r, j, ps, s) for r, (j, s) in enumerate(neg, 1)]
    return sorted(out)


def made(seed, n=700, dims=6, spread=1.0):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = r.choice(centers)
        v = [x + r.gauss(0, spread) for x in c]
        rows.append((i, rows[-1][1] if rows and r.random() < 0.2 else v, r.randrange(4)))
    return rows


@pytest.mark.parametrize(("seed", "spread"), [(1, 1.0), (2, 0.05), (3, 0.0)])
def test_against_all_pairs(spark, seed, spread):
    rows = made(seed, spread=spread)
    got = hn.mine(spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA), every=20, block=64, anchors=15)
    assert sorted(map(tuple, got.collect())) == brute(rows, every=20)


def test_nulls_ties_lengths_and_large_values(spark):
    r = random.Random(4)
    rows = made(5, 120, 3) + [(None, [1.0, 2.0, 3.0], 1), (900, None, 1), (901, [1.0, None, 2.0], 1), (902, [1.0, float("nan"), 2.0], 1), (903, [1.0, float("inf"), 1.0], 2), (904, [1.0, 1.0, 1.0], None)]
    rows += [(950, [], 1), (951, [1.0], 1), (952, [1.0, 1.0, 1.0, 1.0, 1.0], 1), (1000, [2e6, 1e6, 3e6], 1), (1001, [2e6, 1e6, 3e6], 1), (1002, [1.5e6, 1e6, 2e6], 2), (1003, [1.5e6, 1e6, 2e6], 3)]
    rows += [(1050, [0.5, 0.5, 0.5], 3)] * 3 + [(1051, [0.5, 0.5, 0.5], 3)] * 40 + [(2000 + i, [0.3, 0.4, 0.3], i % 5) for i in range(60)]
    r.shuffle(rows)
    got = hn.mine(spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA), block=32)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_anchor_and_no_row(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(1, [1.0], 1, 1, 1)], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(50, [1.0], 1, 1, 1)], SCHEMA)).count() == 0


def test_tree_covers_and_skips():
    r = np.random.default_rng(6)
    x = np.repeat(r.integers(-300, 300, (12, 5)), 40, axis=0) + r.integers(-3, 4, (480, 5))
    tree = hn.CoverTree.build(x, np.arange(480), np.zeros(480, np.int64))
    top = (tree.x.astype(float) ** 2).sum(1).max()
    y = np.column_stack([tree.x, np.sqrt(top - (tree.x.astype(float) ** 2).sum(1))])

    def below(node):
        if tree.last[node] == 0:
            return [tree.center[node]]
        return [v for k in range(tree.first[node], tree.last[node]) for v in below(k)]

    assert sorted(below(0)) == list(range(len(tree.x)))
    for node in range(len(tree.center)):
        assert np.sqrt(((y[below(node)] - y[tree.center[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-6 or tree.last[node] == 0
        if tree.last[node]:
            assert tree.center[tree.first[node]] == tree.center[node]
    seen = []
    products, hn.products = hn.products, lambda a, q: seen.append(len(a)) or products(a, q)
    try:
        queries = hn.Queries([-1], [1], x[:1], [[hn.Wanted(hn.LEAST, hn.MOST, 3)]], False)
        tree.search(queries, np.array([0]))
    finally:
        hn.products = products
    assert sum(seen) < len(tree.x) / 2  # whole nodes are passed over
