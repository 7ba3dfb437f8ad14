import random

import pytest
from pyspark.sql import functions as F

from larder.functions import similarity
from larder.operators import fuzzy


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def made(r, n, letters):
    words = ["".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(25)]
    return sorted({" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(n)})


@pytest.mark.parametrize(("top", "threshold", "letters"), [(1024, 70.0, "abcdefgh"), (6, 70.0, "abcdefgh"), (6, 50.0, "abé😀z"), (10, 100.0, "ab"), (3, 85.0, "abcdefghijklmnopqrstuvwxyzäöüß0123456789")])
def test_no_pair_is_lost(spark, monkeypatch, top, threshold, letters):
    monkeypatch.setattr(fuzzy, "TOP", top)
    r = random.Random(top)
    a, b = made(r, 60, letters), made(r, 70, letters)
    a += [x.swapcase() for x in a[:5]] + ["  ".join(reversed(x.split())) for x in a[5:9]] + ["", " "]
    want = {}
    for x in set(a):
        for y in set(b) | {""}:
            p, q = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
            if p and q and 200 * lcs(p, q) / (len(p) + len(q)) >= threshold:
                want[x, y] = 200 * lcs(p, q) / (len(p) + len(q))
    got = fuzzy.similar(spark.createDataFrame([(x,) for x in a * 2] + [(None,)], "name string"), spark.createDataFrame([(y,) for y in [*b, "", None]], "key string"), threshold)
    rows = got.collect()
    assert len(rows) == len(want) and {(x.name, x["key"]): x.similarity for x in rows} == pytest.approx(want)


def test_pairs_that_meet_are_few(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "TOP", 40)
    r = random.Random(9)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkjqxz", weights=range(26, 0, -1), k=r.randint(3, 9))) for _ in range(300)]
    strings = sorted({" ".join(r.choices(words, k=3)) for _ in range(900)})
    df = spark.createDataFrame([(side, s) for side in "ab" for s in strings], "side string, s string")
    leaves, pairs = fuzzy.candidates(df, 75.0)
    assert leaves.count() == 2 * len(strings) and pairs.count() < len(strings) ** 2 / 10
    assert pairs.distinct().count() == pairs.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "name string")
    some = spark.createDataFrame([("rice",)], "key string")
    assert fuzzy.similar(none, some, 60.0).count() == 0
    assert fuzzy.similar(some.toDF("name"), none.toDF("key"), 60.0).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").select(similarity.token_sort_ratio("a", "b"), similarity.partial_ratio("a", "b"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_windows_and_long_strings(spark):
    r = random.Random(2)
    pairs = [("".join(r.choices("abc ", k=r.choice((0, 3, 61, 62, 63, 124, 125, 190)))), "".join(r.choices("abc d", k=r.randint(0, 200)))) for _ in range(80)] + [("", ""), ("ab", "xxabxx")]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    for a, b, whole, part in map(tuple, df.select("a", "b", similarity.ratio("a", "b"), similarity.partial_ratio("a", F.substring("b", 1, 40)).alias("p")).collect()):
        if a is None or b is None:
            assert whole is None and part is None
            continue
        assert whole == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)
        c = b[:40]
        p, t = (a, c) if len(a) <= len(c) else (c, a)
        want = max(100 * lcs(p, t[i : i + len(p)]) / len(p) for i in range(len(t) - len(p) + 1)) if p else 0.0 if t else 100.0
        assert part == pytest.approx(want)
