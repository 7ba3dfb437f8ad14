import json

import pytest
from test_analysis import ref  # noqa: F401

from larder.streaming import recipes

NEW = [
    {"name": "b soup", "cuisine": "west", "servings": "2", "url": "http://x.org/b/", "ingredients": ["200 g white rice", " ", "100 g stone"]},
    {"name": "a stew", "servings": "none", "url": "https://www.x.org/a", "ingredients": ["100 g white rice"]},
    {"name": "twice", "servings": "4", "url": "x.org/B", "ingredients": ["1 kg white rice"]},
    {"name": "no url", "servings": "1", "ingredients": []},
]
LATE = [{"name": "again", "servings": "1", "url": "x.org/a", "ingredients": ["1 g white rice"]}, {"name": "c", "servings": "1", "url": "x.org/c", "ingredients": ["100 g fonio"]}]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def run(spark, tmp_path, reference):
    recipes.add_recipes(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", reference, 11).awaitTermination()


def state(spark, tmp_path):
    read = lambda t: recipes.committed(spark, f"{tmp_path}/out", t)
    return (
        sorted((r.recipe_id, r.recipe_name, r.servings_raw) for r in read("recipes").collect()),
        sorted((r.recipe_id, r.servings, r.ingredients_total, r.ingredients_used, r.energy_kcal) for r in read("nutrition").collect()),
        sorted((r.recipe_id, r.ingredient_coverage_pct, r.coverage_tier, r.data_status) for r in read("scores").collect()),
    )


FIRST = (
    [(11, "NO URL", "MAKES 1 SERVINGS"), (12, "A STEW", "MAKES 1 SERVINGS"), (13, "B SOUP", "MAKES 2 SERVINGS")],
    [(11, 1, 0, 0, 0.0), (12, 1, 1, 1, 365.0), (13, 2, 2, 1, 365.0)],
    [(11, 0.0, "warn", "insufficient_data"), (12, 100.0, "ok", "calculated"), (13, 50.0, "info", "calculated")],
)


def test_a_batch_that_fails_between_tables_adds_nothing_twice(spark, tmp_path, ref, monkeypatch):  # noqa: F811
    put(tmp_path / "in", "1.json", NEW)
    write, calls = recipes.write, []

    def broken(df, path):
        calls.append(path)
        if "/nutrition/" in path:
            raise OSError("lost")
        write(df, path)

    monkeypatch.setattr(recipes, "write", broken)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, ref)
    assert any("/recipes/" in p for p in calls) and recipes.committed(spark, f"{tmp_path}/out", "recipes").count() == 0
    monkeypatch.setattr(recipes, "write", write)
    run(spark, tmp_path, ref)
    assert state(spark, tmp_path) == FIRST

    put(tmp_path / "in", "2.json", LATE)
    run(spark, tmp_path, ref)
    assert [x[:2] for x in state(spark, tmp_path)[0]] == [x[:2] for x in FIRST[0]] + [(14, "C")]
    before = state(spark, tmp_path)
    recipes.add_batch(spark.createDataFrame([("again", "", "1", "x.org/z", ["1 g rice"])], recipes.SCHEMA), 1, f"{tmp_path}/out", ref)
    assert state(spark, tmp_path) == before  # the ledger has batch 1
