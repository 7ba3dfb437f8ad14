import random

import numpy as np
import pytest

from larder.operators import forest, models


@pytest.fixture
def scored(spark):
    """Classes by two of the features, with some noise."""
    r, rows = random.Random(3), []
    for i in range(3000):
        v = [round(r.random(), 3) for _ in models.FEATURES]
        high = (v[0] > 0.6) != (v[3] > 0.5)
        rows.append((i, "calculated", "High" if high != (r.random() < 0.03) else "Low", *v))
    return spark.createDataFrame(rows, "recipe_id long, data_status string, weighted_risk_level string, " + ", ".join(f"{c} double" for c in models.FEATURES))


def test_trees_vote_in_tasks_and_tell_which_features_matter(scored, tmp_path):
    model, got = models.evaluated(scored, models.forest(24, 12))
    got = {r.recipe_id: (r.label, r.predicted) for r in got.collect()}
    test = models.split(models.features(scored), "label").where("not train")
    assert got.keys() == {r.recipe_id for r in test.select("recipe_id").collect()}
    assert sum(a == b for a, b in got.values()) > 0.9 * len(got)
    found = {r.feature: r.importance for r in models.importances(model).collect()}
    assert sum(found.values()) == pytest.approx(1)
    assert sorted(found, key=found.get)[-2:] == sorted([models.FEATURES[0], models.FEATURES[3]], key=found.get)
    models.save(model, str(tmp_path / "m"))
    kept = models.saved(str(tmp_path / "m"))
    assert kept.trees.count() == 24
    again = {r.recipe_id: (r.label, r.predicted) for r in models.predicted(kept, test).collect()}
    assert again.keys() == got.keys() and sum(again[i] == got[i] for i in got) > 0.995 * len(got)


def test_no_forest_reaches_the_driver(scored):
    model, got = models.evaluated(scored, models.forest(6))
    assert not hasattr(model, "stages") and "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def plain(x, y, ids, weights, depth, least):
    """Gain by gain, over all features: the shares of each row's leaf."""
    counts = np.array([(y[ids] == c).sum() for c in range(len(weights))]) * weights
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    best = (1e-12, None)
    for f in range(x.shape[1]) if depth else ():
        for b in range(forest.BINS - 1):
            low = x[ids, f] <= b
            if min(low.sum(), (~low).sum()) < least:
                continue
            lc = np.array([(y[ids][low] == c).sum() for c in range(len(weights))]) * weights
            rc = counts - lc
            gain = gini(counts) - (lc.sum() * gini(lc) + rc.sum() * gini(rc)) / counts.sum()
            if gain > best[0] + 1e-12:
                best = (gain, low)
    if best[1] is None:
        return {i: counts / counts.sum() for i in ids}
    return plain(x, y, ids[best[1]], weights, depth - 1, least) | plain(x, y, ids[~best[1]], weights, depth - 1, least)


@pytest.mark.parametrize(("depth", "least", "cells"), [(30, 1, 1 << 21), (3, 4, 1 << 21), (30, 1, 200)])
def test_a_tree_is_the_plain_one(depth, least, cells, monkeypatch):
    r = np.random.default_rng(5)
    x = np.zeros((300, 5), np.uint8)
    x[:, :3] = r.integers(0, 32, (300, 3))
    x[:, 3] = (x[:, 0] > 12).astype(int) + ((x[:, 1] > 20) & (x[:, 2] < 9))
    x[:60, 4] = 1
    weights = np.array([1.0, 0.5, 3.0])

    class Once:
        """Each row once, all features in their order."""

        poisson = staticmethod(lambda _, n: np.ones(n, np.int64))
        random = staticmethod(lambda shape: np.tile(np.arange(shape[1]), (shape[0], 1)))

    monkeypatch.setattr(forest, "CELLS", cells)
    monkeypatch.setattr(forest, "BLOCK", 70)
    tree = forest.grown(x, 1, weights, forest.Trees(1, depth, "all", least), Once())
    got = np.zeros((300, 3), np.float32)
    tree.votes(x, got)
    for i, want in plain(x[:, :3], x[:, 3], np.arange(60, 300), weights, depth, least).items():
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_macro_f1_is_that_of_the_metrics(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "label string, predicted string")
    want = models.metrics(df).where("class = 'macro'").first()["f1"]
    assert models.macro_f1({p: pairs.count(p) for p in pairs}) == pytest.approx(want)
