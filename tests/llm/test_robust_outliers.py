import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import robust_outliers as ro


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b\xa0#|", max_size=60))
def test_counts_as_defined(text):
    assert ro.counts(text)[:5] == brute(text)


def corpus(seed=0, n=400):
    r = random.Random(seed)
    vocab = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(3000)]
    clean = [(i, ". ".join(" ".join(r.choices(vocab, k=12)).capitalize() for _ in range(r.randint(6, 60)))) for i in range(n)]
    junk = [(n + i, " ".join(w + "$%#" for w in r.choices(vocab, k=100))) for i in range(10)] + [(n + 10 + i, " ".join(w.upper() for w in r.choices(vocab, k=100))) for i in range(10)]
    return clean, junk


def test_outliers_go_and_clean_texts_stay(table):
    clean, junk = corpus()
    out = {r.doc_id: r for r in ro.judge(table(clean + junk)).collect()}
    assert all(out[i].kept for i, _ in clean)
    assert not any(out[i].kept or out[i].base_failed for i, _ in junk)
    assert all(tuple(out[i])[1:6] == brute(t) for i, t in clean + junk)


def test_the_estimate_as_numpy_has_it(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(ro.P, ro.P)) / 3
    x = np.vstack([r.normal(size=(900, ro.P)) @ a + 1, r.normal(size=(100, ro.P)) + 25])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], ["grp", *ro.XS]).cache()
    now = ro.start(rows)
    for _ in range(6):
        now = ro.cut(ro.concentrate(rows, now))
    got = now.collect()[0]
    c, s = np.median(x, 0), np.diag((1.4826 * np.median(abs(x - np.median(x, 0)), 0)) ** 2)
    for _ in range(6):
        d = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s + np.diag(ro.FLOOR**2)), x - c)
        h = x[d <= np.quantile(d, ro.SHARE)]
        c, s = h.mean(0), np.cov(h.T, bias=True) * ro.CONSISTENCY
    assert np.abs(np.array(got.centre) - c).max() < 0.1
    assert np.abs(c - 1).max() < 0.2


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "x " * 60, "en", "a"), (3, "x " * 60, "en", None), (None, long, None, "a/b")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, bin int, centre double")
    out = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in ro.judge(docs).collect()), key=str)
    assert out == sorted([(1, 0, True, False), (2, 0, True, False), (3, 60, True, False), (3, 60, True, False), (None, 30_000, False, True)], key=str)
    assert ro.judge(docs.limit(0)).count() == 0


def test_verdicts_as_numpy_has_them(spark):
    """The whole verdict against an estimate over all rows of a group: the same starts and steps, without bins."""
    r = random.Random(5)
    rows = []
    for source, n, alphabet in (("a", 300, "etaoin"), ("b", 250, "sRdlu#"), ("c", 20, "etaoin")):
        vocab = ["".join(r.choices(alphabet, k=r.randint(2, 9))) for _ in range(800)]
        rows += [(len(rows) + i, ". ".join(" ".join(r.choices(vocab, k=12)) for _ in range(r.randint(6, 40))), "en", source) for i in range(n)]
    rows += [(900 + i, " ".join(w.upper() for w in t.split()), "en", s) for i, (_, t, _, s) in enumerate(rows[::29])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = ro.statistics(docs).select("doc_id", "source", *(x.alias(n) for x, n in zip(ro.vector(), ro.XS, strict=True))).toPandas()
    x, far = found[ro.XS].to_numpy(), {}
    for group, level in ((found.source == "a", "a"), (found.source == "b", "b"), (found.source != "", "c")):
        own, best = x[group], None
        mid = np.median(own, 0)
        mad = 1.4826 * np.median(abs(own - mid), 0)
        for s in (np.diag(mad**2), np.eye(ro.P) * (mad**2).mean()):
            c, steps = mid, []
            for _ in range(10):
                d = np.einsum("ij,jk,ik->i", own - c, np.linalg.inv(s + np.diag(ro.FLOOR**2)), own - c)
                h = own[d <= np.quantile(d, ro.SHARE)]
                c, s = h.mean(0), np.cov(h.T, bias=True) * ro.CONSISTENCY
                steps.append((np.linalg.slogdet(s + np.diag(ro.FLOOR**2))[1], c, s))
            best = min([*([best] if best else []), steps[-1]], key=lambda e: e[0])
        take = found.source == level
        d = np.sqrt(np.einsum("ij,jk,ik->i", x[take] - best[1], np.linalg.inv(best[2] + np.diag(ro.FLOOR**2)), x[take] - best[1]))
        far |= dict(zip(found.doc_id[take], d, strict=True))
    out = {v.doc_id: v for v in ro.judge(docs).collect()}
    sure = [i for i in out if not out[i].base_failed and abs(far[i] - ro.LIMIT) > 0.5]
    assert len(sure) > 0.9 * len(out) and {out[i].kept for i in sure} == {True, False}
    assert all(out[i].kept == (far[i] <= ro.LIMIT) for i in sure)
    assert np.median([abs(out[i].distance - far[i]) / far[i] for i in sure]) < 0.05
