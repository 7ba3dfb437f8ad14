import random
import re

import numpy as np

from larder.llm import superkmer_dedup as sd


def brute(rows, k):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {p for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_as_brute_force(table, near):
    rows = near(200)
    for options in ({}, {"hot": 1, "broadcast_rows": 0}):
        assert got(sd.remove_repeats(table(rows), k=50, **options)) == brute(rows, 50)
    assert got(sd.remove_repeats(table(rows), k=7, m=3)) == brute(rows, 7)


def test_edges(table):
    long = " ".join(random.Random(1).choices("ab", k=30_000))
    rows = [(1, None), (2, ""), (3, "x " * 49), (4, "x\n" * 50), (5, "x\t" * 50), (6, "x  " * 120), (7, long), (8, long + " c"), (9, "é " * 60)]
    assert got(sd.remove_repeats(table(rows))) == brute(rows, 50)
    assert [r[2] for r in sd.remove_repeats(table([(None, "x " * 60), (2, "x " * 60)])).collect()] == [0, 0]
    twice = got(sd.remove_repeats(table([(1, "x " * 60), (2, "x " * 60), (2, "y " * 60)])))
    assert [r[:3] for r in twice] == [(1, 60, 0), (2, 60, 0), (2, 60, 60)]
    assert sd.remove_repeats(table([])).count() == 0


def test_minimisers():
    h = np.random.default_rng(0).integers(0, 1 << 63, 90).astype(np.uint64)
    for k, m in ((50, 8), (7, 3), (5, 5), (9, 1)):
        low = sd.minimisers(h, k, m)
        assert len(low) == 90 - k + 1
        assert (sd.minimisers(h[10 : 10 + k], k, m) == low[10]).all()
