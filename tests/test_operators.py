import json
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import similarity
from larder.operators import dedup, density, dimensions, models, resolve, scoring
from larder.sources import html, tables
from larder.streaming import ingest


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_as_the_textbook_has_it(spark):
    r = random.Random(1)
    pairs = [("".join(r.choices("abc ", k=r.randint(0, 90))), "".join(r.choices("abc ", k=r.randint(0, 30)))) for _ in range(300)]
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select("a", "b", similarity.ratio("a", "b").alias("s"), similarity.ratio_bound("a", "b").alias("top"))
    for a, b, s, top in map(tuple, df.collect()):
        assert (s is None) if a is None else (s == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100) and s <= top + 1e-9)
    best = spark.createDataFrame([("rice", "brown rice, raw"), ("", "x"), ("abc", "abc")], "a string, b string").select(similarity.partial_ratio("a", "b").alias("s")).collect()
    assert [x.s for x in best] == [100.0, 0.0, 100.0]


def test_ladder(spark):
    curated = spark.createDataFrame([("tomato", "Tomatoes, raw", 1), ("cumin", "Spices, cumin", 2), ("bell pepper red", "Peppers", 3), ("chili", "Chili", 4)], "key string, food string, fdc_id long")
    names = spark.createDataFrame([("Ripe diced tomatoes",), ("ground cumin",), ("red bell pepper",), ("mild chili powder",), ("granite",), ("",), ("tomatoes",), ("tomatoes",)], "name string")
    assert {r.name: r.fdc_id for r in resolve.match_ladder(names, curated).collect()} == {"Ripe diced tomatoes": 1, "ground cumin": 2, "red bell pepper": 3, "mild chili powder": 4, "tomatoes": 1}


def test_search_rules_and_layers(spark):
    foods = spark.createDataFrame([(1, "Carrots, raw"), (2, "Carrot cake with icing"), (3, "Rice, white, NFS")], "fdc_id long, description string")
    names = spark.createDataFrame([("carrots",), ("white rice",), ("stone",)], "name string")
    assert {r.name: r.fdc_id for r in resolve.search(names, foods, 1, 40.0).collect()} == {"carrots": 1, "white rice": 3}
    rules = spark.createDataFrame([(1, "salt", None), (2, "butter", "Butter")], "priority int, keyword string, food string")
    got = {r.name: (r.keyword, r.food) for r in resolve.first_rule(spark.createDataFrame([("unsalted butter",), ("butter",), ("x",)], "name string"), rules).collect()}
    assert got == {"unsalted butter": ("salt", None), "butter": ("butter", "Butter"), "x": (None, None)}
    fixed = lambda word, i: lambda left: left.where(F.col("name").contains(word)).withColumn("fdc_id", F.lit(i).cast("long"))
    out = {r.name: (r.fdc_id, r.match_type) for r in resolve.layers(names, [("a", fixed("carrot", 7)), ("b", fixed("r", 8))]).collect()}
    assert out == {"carrots": (7, "a"), "white rice": (8, "b"), "stone": (None, "no_match")}


def test_density(spark):
    names = [("cassava flour", 0.53), ("palm oil", 0.91), ("granulated sugar", 0.85), ("chopped spinach", 0.20), ("raw honey", 1.42), ("nonsense", 1.0), ("boiled rice", 0.91)]
    assert spark.createDataFrame(names, "n string, want double").where(density.category("n") != F.col("want")).collect() == []
    portions = spark.createDataFrame([(1, "1 cup, sliced", 120.0, 1), (1, "1 cup", 240.0, 2), (1, "1 piece", 50.0, 3), (2, "1/2 cup", 900.0, 4), (3, "2 tablespoons", 27.0, 5)], "fdc_id long, portion_description string, gram_weight double, ord int")
    assert {r.fdc_id: (r.g_per_ml, r.source_portion) for r in density.build(portions).collect()} == {1: (1.0, "1 cup"), 3: (0.9, "2 tablespoons")}


def test_scores(spark):
    df = spark.createDataFrame([(500.0, 400.0, 15.0, 12.0, 15.0), (800.0, 700.0, 25.0, 20.0, 8.0), (1600.0, 1400.0, 50.0, 40.0, 0.0), (0.0, 0.0, 0.0, 0.0, 11.5)], "energy_kcal double, sodium_mg double, fat_g double, sugars_g double, protein_g double")
    got = [r.s for r in df.select(scoring.weighted({n: F.col(n) for n in scoring.WEIGHTS}).alias("s")).collect()]
    assert got == [0.0, 50.0, 100.0, 2.5]
    assert df.select(scoring.band("energy_kcal", F.col("energy_kcal")).alias("b")).first().b == "medium"  # the score is 0 there, the band is not low


def test_duplicates(spark):
    recipes = spark.createDataFrame([(1, "Jollof Rice!"), (2, '"jollof  rices"'), (3, "Égusi soup"), (4, None)], "recipe_id long, recipe_name string")
    lines = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "recipe_id long, ingredient_index int")
    assert [(r.recipe_id, r.kept_id) for r in dedup.removed(recipes, lines).collect()] == [(1, 2)]


def test_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("ord"))
    out = dimensions.assign_ids(df, "ord", 50, "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(50, 1050)) and [r.ord for r in out] == sorted(r.ord for r in out)
    master = spark.createDataFrame([("rice", 4)], "name string, i long")
    names = spark.createDataFrame([("yam", 1), ("rice", 2), ("okra", 3), ("yam", 4)], "name string, ord int")
    assert {r.name: r.i for r in dimensions.get_or_create(names, master, "name", "ord", "i").collect()} == {"rice": 4, "yam": 5, "okra": 6}


def test_pages(spark):
    node = {"@type": ["Recipe"], "name": "A <b>dish</b>", "recipeYield": [6], "recipeIngredient": ["1 cup <span>rice</span>", " "], "image": ["http://x/y.jpg"]}
    block = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    pages = [("a", block(node)), ("b", block({"@graph": [{"@type": "WebSite"}, node]})), ("c", block([node])), ("d", "<script type='application/ld+json'>{bad</script>"), ("e", None), ("f", "<li itemprop='ingredients'>salt &amp; pepper</li>"), ("g", '<li class="wprm-recipe-ingredient"><span class="wprm-recipe-ingredient-amount">2</span><span class="wprm-recipe-ingredient-name">eggs</span></li>')]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {r.url: (r.title, r.ingredients, r.servings, r.image) for r in html.jsonld(df).collect()}
    assert got == {u: ("A dish", ["1 cup rice"], 6, "http://x/y.jpg") for u in "abc"}
    assert {r.url: (r.status, r.ingredients) for r in html.best(df).collect()} == {**{u: ("jsonld", ["1 cup rice"]) for u in "abc"}, "d": ("no_recipe", None), "e": ("no_recipe", None), "f": ("microdata", ["salt & pepper"]), "g": ("wprm", ["2 eggs"])}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿recipe_title,source_url,ingredients\n"x, y",http://u,"1 cup\nrice|salt"\n,,\n')
    (tmp_path / "b.csv").write_text("recipe_title\nz\n")
    df = tables.read_csv(spark, f"{tmp_path}/a.csv")
    assert df.columns == ["recipe_title", "source_url", "ingredients"] and tuple(df.first()) == ("x, y", "http://u", "1 cup\nrice|salt")
    assert tables.discover(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]).count() == df.count()


def test_metrics(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2
    got = {r["class"]: (r.precision, r.recall, r.support) for r in models.metrics(spark.createDataFrame(rows, "label string, predicted string")).collect()}
    assert got["a"] == (1.0, 0.75, 4) and got["b"] == (2 / 3, 1.0, 2) and got["macro"][2] == 6


def test_stream_as_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(([("http://a/1", "x"), ("https://www.a/2/", "y")], [("a/2", "again"), ("http://a/3", "z")])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"source_url": u, "recipe_title": t}) for u, t in rows))
        ingest.ingest(spark, f"{tmp_path}/in", "source_url string, recipe_title string", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("recipe_id").collect()
    assert [(r.recipe_id, r.url_key, r.recipe_title) for r in got] == [(1, "a/1", "x"), (2, "a/2", "y"), (3, "a/3", "z")]
