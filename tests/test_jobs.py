"""Whole jobs, sinks and blocked matching against plain versions."""

import random

from larder.functions import text
from larder.functions.similarity import _window, masks
from larder.operators import jobs, models, resolve
from larder.sources import tables

WORDS = "red blue onion onions tomato raw flour dried white maize yam leaf oil palm nut".split()


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_fuzzy_match_loses_no_pair(spark):
    r = random.Random(3)
    names = sorted({" ".join(r.choices(WORDS, k=r.randint(1, 4))) for _ in range(60)} | {"", "  ", "z"})
    keys = [(k, i) for i, k in enumerate(sorted({" ".join(r.choices(WORDS, k=r.randint(1, 5))) for _ in range(80)} | {""}))]
    for threshold in (50.0, 65.0, 78.0, 100.0):
        want = {}
        for n in names:
            a = " ".join(sorted(n.split()))
            scored = [(-200.0 * plain_lcs(a, b) / (len(a) + len(b)), o, k) for k, o in keys if (b := " ".join(sorted(k.split()))) and a]
            best = min(scored, default=(0, 0, ""))
            if -best[0] >= threshold:
                want[n] = (best[2], f"fuzzy_{int(-best[0])}%")
        got = resolve.match_fuzzy(spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string"), spark.createDataFrame(keys, "key string, ord int"), threshold)
        assert {x.name: (x.key, x.match_type) for x in got.collect()} == want


def test_bilingual_search(spark):
    r = random.Random(4)
    foods = [(f"01_{i}", i, " ".join(r.choices(WORDS, k=r.randint(1, 5))), r.choice([None, "", "oignon rouge", "farine de maize"])) for i in range(40)]
    foods += [("01_90", 90, None, "oignon"), ("01_91", 91, "long " * 14 + "yam", "igname")]
    names = ["red onions", "maize flour", "oignon", "yam", "farine", "it", ""]
    want = {}
    for name in names:
        asked = [w for w in name.split() if len(w) > 2]
        best = None
        for code, ord_, en, fr in foods:
            en, fr = (en or "").lower(), (fr or "").lower()
            have = {t for t in (en + " " + fr).split() if len(t) > 2}
            have |= {t[:-1] for t in have if t.endswith("s") and len(t) > 3}
            if not en or not any(w in have or (w.endswith("s") and len(w) > 3 and w[:-1] in have) for w in asked):
                continue
            s = max(_window(name, masks(name), x) if x else 0.0 for x in (en, fr))
            if s < 55:
                continue
            s += 15 * all(w in en or w in fr for w in asked) + 10 * any(w in en for w in ("raw", "dried", "flour", "fresh", "boiled")) - 5 * (len(en) > 60)
            if best is None or s > best[0]:
                best = (s, code)
        if best:
            want[name] = best[1]
    df = spark.createDataFrame(foods, "code string, ord int, name_en string, name_fr string")
    assert {x.name: x.code for x in resolve.bilingual_search(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), df).collect()} == want and len(want) > 3


MAPPING = "name string, match_status string, notes string, fdc_id long, food string, match_type string"


def test_staged_rows_are_fixed_by_the_first_rule(spark):
    rows = [(n, s, t, None, None, "no_match") for n, s, t in [("Fonio ", "skip", "scraped"), ("egusi", "skip", "scraped"), ("my® egusi", " skip", "scraped"), ("salt", "skip", "scraped"), ("step 2", "skip", "scraped"), ("yam", "skip", "scraped"), ("fonio", "skip", None), ("fonio", "matched", "scraped")]]
    food = "name string, fdc_id long, food string"
    got = jobs.fix_staged(
        spark.createDataFrame(rows, MAPPING),
        spark.createDataFrame([("fonio", 1, "Millet"), ("fonio", 9, "x")], food),
        spark.createDataFrame([("egusi", 2, "Seeds"), ("fonio", 3, "never")], food),
        spark.createDataFrame([(2, "egusi", 4, "Seeds"), (1, "my®", 5, "Brand")], "priority int, keyword string, fdc_id long, food string"),
        ["salt"],
        ["step 2"],
    )
    found = {(x.name, x.match_status.strip(), x.match_type, x.fdc_id) for x in got.collect()}
    assert found == {("Fonio ", "matched", "proxy_fix", 1), ("egusi", "matched", "manual_fix", 2), ("my® egusi", "matched", "manual_fix", 5), ("salt", "skip", "negligible", None), ("step 2", "skip", "artifact", None), ("yam", "skip", "no_match", None), ("fonio", "skip", "no_match", None), ("fonio", "matched", "no_match", None)}
    assert got.count() == len(rows)


def test_rematch(spark):
    rows = [("onion red", "skip", "scraped", None, None, "no_match"), ("qqq", "skip", "scraped", None, None, "no_match"), ("red onion", "skip", "by hand", None, None, "no_match")]
    foods = spark.createDataFrame([(7, "Red onion"), (5, "red ONION"), (6, "yam")], "fdc_id long, description string")
    got = {x.name: (x.fdc_id, x.food, x.match_status, x.match_type) for x in jobs.rematch_full(spark.createDataFrame(rows, MAPPING), foods).collect()}
    assert got == {"onion red": (5, "red ONION", "matched", "fuzzy_usda_100%"), "qqq": (None, None, "skip", "no_match"), "red onion": (None, None, "skip", "no_match")}


def test_a_source_is_integrated(spark):
    scraped = spark.createDataFrame([(2, "b ", "4", "1 cup red onion|2 yam, cut|1 x", "u2"), (1, "a", None, " | 3 cups Red onion", "u1"), (3, None, None, None, None)], "ord int, recipe_title string, servings string, ingredients string, source_url string")
    out = jobs.integrate_source(
        scraped,
        spark.createDataFrame([(10,)], "recipe_id long"),
        spark.createDataFrame([(5, "Yam")], "ingredient_id long, ingredient_name string"),
        spark.createDataFrame([("YAM",)], "recipe_ingredient_name string"),
        spark.createDataFrame([("red onion", "Onions, red", 77)], "key string, food string, fdc_id long"),
        spark.createDataFrame([], "local string, proxy string, display string"),
        [],
        [],
    )
    assert sorted((x.recipe_id, x.recipe_name) for x in out["recipes"].collect()) == [(11, "A"), (12, "B"), (13, None)]
    assert sorted((x.recipe_id, x.ingredient_id, x.ingredient_index, x.actual_measure, x.measure_only) for x in out["lines"].collect()) == [(11, 6, 1, "720.0 g", "3 cups"), (12, 5, 2, "", "2"), (12, 6, 1, "240.0 g", "1 cup")]
    assert [(x.ingredient_id, x.ingredient_name.lower()) for x in out["master"].collect()] == [(6, "red onion")]
    assert [(x.matched_fdc_id, x.match_status, x.match_type) for x in out["mapping"].collect()] == [(77, "matched", "manual_match")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i int, t string")
    path = str(tmp_path / "t.csv")
    tables.overwrite_csv(df, path)
    tables.overwrite_csv(tables.read_csv(spark, path).where("i = 1"), path)
    assert [tuple(x) for x in tables.read_csv(spark, path).collect()] == [("1", 'a "b", c')]
    both = str(tmp_path / "p")
    tables.append(df, both)
    tables.append(df, both)
    assert spark.read.parquet(both).count() == 4
    tables.overwrite(df, both)
    assert spark.read.parquet(both).count() == 2
    assert tables.replace_tables({"larder_a": df, "larder_b": df.limit(0)}, folder=str(tmp_path / "w")) == {"larder_a": 2, "larder_b": 0}
    spark.sql("DROP TABLE larder_a")
    spark.sql("DROP TABLE larder_b")


def test_models_survive_saving(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, "calculated", ["Low", "High"][i % 2], *(r.random() + i % 2 for _ in models.FEATURES)) for i in range(80)]
    df = spark.createDataFrame(rows, "recipe_id long, data_status string, weighted_risk_level string, " + ", ".join(f"{c} double" for c in models.FEATURES))
    model, want = models.evaluated(df, models.logistic())
    models.save(model, str(tmp_path / "m"))
    models.save(model, str(tmp_path / "m"))
    got = models.predicted(models.saved(str(tmp_path / "m")), models.split(models.features(df), "label").where("not train"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 16
    assert models.importances(models.evaluated(df, models.forest(5))[0]).count() == len(models.FEATURES)
    search = models.random_search(df, combos=2, folds=2, grid={"numTrees": [3], "maxDepth": [2, 3]})
    assert search.count() == 2 and search.where("macro_f1 between 0 and 1").count() == 2


def test_fixed_lists(spark):
    df = spark.createDataFrame([("Deep-fry, knead and sauté",), ("chop and mix",), ("",), (None,)], "t string").select(text.cooking_methods("t").alias("m"))
    assert [x.m for x in df.collect()] == ["deep-fry, fry, knead, sauté", "", "", ""]
    base = spark.createDataFrame([("2 grams salt",), ("a dash of pounds cake",)], "t string").select(text.base_ingredient("t").alias("b"))
    assert [x.b for x in base.collect()] == ["salt", "pound cake"]
    curated = spark.createDataFrame([("carrot onion", "x", 1)], "key string, food string, fdc_id long")
    names = spark.createDataFrame([("carrots onions",), ("raw carrots onions",)], "name string")
    assert [x.name for x in resolve.match_ladder(names, curated).collect()] == ["raw carrots onions"]
