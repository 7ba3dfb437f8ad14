import pytest
from pyspark.sql import functions as F

from larder.operators import analysis, dimensions, jobs

PER = ", ".join(f"{n} double" for n in analysis.NAMES)


@pytest.fixture(scope="module")
def ref(spark):
    foods = spark.createDataFrame([(1, "Onions, red, raw"), (2, "Rice, white, raw"), (3, "Okra"), (4, "Spices, cumin"), (5, "Nothing known, raw")], "fdc_id long, description string")
    return analysis.Reference(
        spark.createDataFrame([("red onion", "Onions, red, raw", 1), ("cumin seed", "Spices, cumin", 4)], "key string, food string, fdc_id long"),
        foods.where("fdc_id = 3"),
        foods,
        spark.createDataFrame([(1, 1.0, 0.0, 9.0, 40.0, 4.0, 4.0), (2, 7.0, 1.0, 80.0, 365.0, 0.1, 5.0), (3, 2.0, 0.2, 7.0, 33.0, 1.5, 7.0), (4, 18.0, 22.0, 44.0, 375.0, 2.0, 168.0)], f"fdc_id long, {PER}"),
        spark.createDataFrame([(2, 0.8), (3, 9.0)], "fdc_id long, g_per_ml double"),
        spark.createDataFrame([("01_7", 1, "Fonio, dried", "fonio", 8.0, 1.0, 75.0, 350.0, 0.5, 3.0), ("01_8", 2, "Egusi, dried", None, 28.0, 47.0, 15.0, 560.0, 1.0, 5.0)], f"code string, ord int, name_en string, name_fr string, {PER}"),
        spark.createDataFrame([("ogbono", "okra", "Ogbono"), ("hungry rice", "zzz", "Hungry rice")], "local string, proxy string, display string"),
        [],
        ["chopped"],
    )


LINES = ["2 chopped red onions", "1 cup white rice", "1 cup okro", "1 tsp cumin sead", "100 g fonio", "100 g stone", "a little ogbono", "1 cup nothing known", None, " ", "2 chopped red onions"]


def test_layers_weights_and_status(spark, ref):
    df = spark.createDataFrame([(1, i, t, "x", 1.0) for i, t in enumerate(LINES, 1)], "recipe_id long, ingredient_index int, raw string, name string, grams double")
    got = {r.ingredient_index: r for r in analysis.analyse_lines(df, ref).collect()}
    assert len(got) == len(LINES)
    kinds = {i: (r.match_type, r.status) for i, r in got.items()}
    assert kinds[1] == kinds[11] == ("manual_match", "matched") and got[1].fdc_id == 1
    assert kinds[2] == ("usda_search", "matched") and got[2].grams == pytest.approx(240 * 0.8)
    assert kinds[3] == ("fuzzy_75%", "matched") and got[3].grams == 240.0  # a density of 9 is none
    assert kinds[4] == ("fuzzy_90%", "matched") and got[4].fdc_id == 4
    assert (got[5].match_type, got[5].code, got[5].status) == ("wafct", "01_7", "matched") and float(got[5].energy_kcal) == 350.0
    assert kinds[6] == ("no_match", "no_usda_match") and got[6].energy_kcal is None
    assert got[7].cleaned == "a little ogbono" and got[7].status == "no_grams"
    assert got[8].status == "no_usda_data" and got[9].match_type is None and got[9].raw is None


def test_overrides_come_first(spark, ref):
    df = spark.createDataFrame([(1, 1, "100 g stone"), (1, 2, "100 g stone"), (2, 1, "100 g fonio"), (2, 2, "1 cup stone")], "recipe_id long, ingredient_index int, raw string")
    chosen = spark.createDataFrame([(1, 1, 3), (2, 1, 99), (2, 2, 2), (1, 2, None)], "recipe_id long, ingredient_index int, fdc_id long")
    got = {(r.recipe_id, r.ingredient_index): (r.match_type, r.fdc_id, r.food, r.status, r.grams) for r in analysis.analyse_lines(df, ref, chosen).collect()}
    assert got == {(1, 1): ("user_override", 3, "Okra", "matched", 100.0), (1, 2): ("no_match", None, None, "no_usda_match", 100.0), (2, 1): ("user_override", 99, "USDA 99", "no_usda_data", 100.0), (2, 2): ("user_override", 2, "Rice, white, raw", "matched", 192.0)}


def test_empty(spark, ref):
    none = spark.createDataFrame([], "recipe_id long, ingredient_index int, raw string")
    assert analysis.analyse_lines(none, ref).count() == 0
    assert analysis.analyse_recipes(none, ref, spark.createDataFrame([], "recipe_id long, servings string")).count() == 0


def test_reanalysis_leaves_nothing_stale(spark, ref):
    lines = spark.createDataFrame([(1, 1, "200 g white rice"), (2, 1, "200 g white rice"), (3, 1, "200 g white rice")], "recipe_id long, ingredient_index int, raw string")
    old = analysis.analyse_recipes(lines, ref, spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "recipe_id long, servings string"))
    old = old.withColumn("weighted_risk_level", F.lit("Very High"))
    scraped = spark.createDataFrame([(1, None, "100 g stone"), (2, "0", "100 g white rice|50 g fonio"), (3, "x", " | "), (9, "1", "1 cup rice")], "recipe_id long, servings string, ingredients string")
    got = {r.recipe_id: r for r in jobs.reanalyse(scraped, old, ref, []).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.energy_kcal == 0 and one.data_status == "insufficient_data" and one.servings == 1
    assert one.weighted_risk_level is None and one.weighted_risk_score is None and one.energy_risk is None and one.flag_count is None
    assert got[2].energy_kcal == 135.0 and got[2].servings == 2  # for four, as stated nought
    assert got[3].weighted_risk_level == "Very High" and got[3].energy_kcal == 730.0


def test_update_takes_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b"), (None, 4.0, "c")], "i long, x double, t string")
    new = spark.createDataFrame([(1, None), (7, 1.0)], "i long, x double")
    assert sorted(map(tuple, dimensions.update_by_id(df, new, "i").collect()), key=str) == [(1, None, "a"), (2, 3.0, "b"), (None, 4.0, "c")]


def test_integration_counts_and_refuses_a_second_run(spark):
    scraped = spark.createDataFrame([(1, "a", "4", "1 cup red onion|2 yams, cut|1 x", "u1"), (2, "b", None, "3 cups red onion|1 tsp cumen", "u2")], "ord int, recipe_title string, servings string, ingredients string, source_url string")
    recipes = spark.createDataFrame([(10,)], "recipe_id long")
    master = spark.createDataFrame([(5, "Red onion")], "ingredient_id long, ingredient_name string")
    mapping = spark.createDataFrame([("RED ONION",)], "recipe_ingredient_name string")
    curated = spark.createDataFrame([("cumin", "Spices, cumin", 4)], "key string, food string, fdc_id long")
    pool = spark.createDataFrame([(9, "Yam, raw"), (8, "yams")], "fdc_id long, description string")
    proxies = spark.createDataFrame([], "local string, proxy string, display string")
    run = lambda have: jobs.integrate_source(scraped, have, master, mapping, curated, proxies, [], [], pool, 40)
    out = run(recipes)
    assert out["stats"].first().asDict() == {"recipes": 2, "ingredients_parsed": 4, "ingredients_skipped": 1, "master_reused": 2, "master_new": 2, "mapping_reused": 2, "mapping_new_matched": 2, "mapping_new_no_match": 0, "has_grams": 3, "no_grams": 1}
    assert {r.recipe_ingredient_name: (r.matched_fdc_id, r.match_type) for r in out["mapping"].collect()} == {"yams": (8, "fuzzy_100%"), "cumen": (4, "fuzzy_80%")}
    assert sorted(r.recipe_id for r in out["recipes"].collect()) == [40, 41]
    with pytest.raises(ValueError, match="40"):
        run(recipes.union(out["recipes"].select("recipe_id")))
