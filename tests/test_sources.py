import pytest
from pyspark.sql import functions as F

from larder.operators import dimensions, insights
from larder.sources import html, markup, tables

NESTED = """<ul><li class="wprm-recipe-ingredient"><span class="wprm-recipe-ingredient-amount"><span>1</span><sup>1</sup></span>
<span class="wprm-recipe-ingredient-unit">cup</span><span class="wprm-recipe-ingredient-name"><span><a href="/x">red &amp; white</a> <span>onions</span></span></span>
<span class="wprm-recipe-ingredient-notes">cut</span><li class="x wprm-recipe-ingredient"><span class="wprm-recipe-ingredient-amount">2</span></li>
<li class="wprm-recipe-ingredient"><span class="wprm-recipe-ingredient-name">salt</span></ul><h2 class="wprm-recipe-name">A <b>dish</b></h2><span class="wprm-recipe-servings">6 people</span>"""
SITE = """<html><script>var t="<li class='mm-recipes-structured-ingredients__list-item'>"</script><h1> Okra <i>soup</i></h1><p>Makes 4 Servings
<ul><li class="mm-recipes-structured-ingredients__list-item"><p><span data-ingredient-quantity="true">1½</span> <span data-ingredient-unit="true">cup</span> <span data-ingredient-name="true">okra, <b>cut</b></span></p>
<li class="mm-recipes-structured-ingredients__list-item"><span data-ingredient-name="true">salt</span><span data-ingredient-name="true">again</span><li class="other">no</li></ul>
<div class="mm-recipes-steps__content"><p>Wash.<p>Fry the onions until they are <b>soft</b>.<div><p>Simmer for twenty minutes or so.</p></div></div><p>A comment that is no step at all.</p>"""


def test_nested_plugin_markup(spark):
    df = spark.createDataFrame([("n", NESTED), ("f", '<li class="wprm-recipe-ingredient"><span class="wprm-recipe-ingredient-name">eggs</span></li>'), ("e", ""), ("0", None)], "url string, html string")
    got = {r.url: (r.title, r.ingredients, r.servings) for r in html.wprm(df).collect()}
    assert got == {"n": ("A dish", ["1 1 cup red & white onions cut", "salt"], 6), "f": ("", ["eggs"], None)}


def test_structured_lists(spark):
    df = spark.createDataFrame([(1, SITE), (2, "<p>nothing"), (3, None)], "page_id long, html string")
    got = {r.page_id: r for r in html.site_lists(df, "page_id").collect()}
    one = got[1]
    assert (one.title, one.servings, one.ingredients) == ("Okra soup", "4", ["1 1/2 cup okra, cut", "salt"])
    assert one.directions == "Fry the onions until they are soft . Simmer for twenty minutes or so." and one.cooking_methods == "fry, simmer"
    assert all((got[i].title, got[i].servings, got[i].ingredients, got[i].directions) == ("", "", [], "") for i in (2, 3))


def test_tag_soup():
    rules = {"a": ("div", "class", "x"), "a/b": ("p", None, None)}
    found, text = markup.elements("<div class='y x'>1<p>2<p>3<br>4</div></div></b><div class=xx><p>5</div>6", rules)
    assert found == [("a", None, "1 2 3 4"), ("a/b", 0, "2"), ("a/b", 0, "3 4")] and text == "1 2 3 4 5 6"


def test_files_are_read_by_header(spark, tmp_path):
    for i in range(60):
        head = ("recipe_url,ingredients", "ingredients,title,Source_URL", "title")[i % 3]
        (tmp_path / f"{i}.csv").write_text(("﻿" if i % 2 else "") + head + "\n" + ",".join(f"{c[0]}{i}" for c in head.split(",")) + "\n")
    (tmp_path / "empty.csv").write_text("")
    df = tables.discover(spark, f"{tmp_path}/*.csv")
    rows = {(r.source_url, r.ingredients) for r in df.collect()}
    assert rows == {(f"r{i}", f"i{i}") for i in range(0, 60, 3)} | {(f"S{i}", f"i{i}") for i in range(1, 60, 3)}
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2  # as many as headers
    assert tables.discover(spark, []).count() == 0


def test_a_failure_leaves_the_old_file(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    tables.overwrite(spark.range(3), path)

    def broken(df):
        return df.select(F.raise_error(F.lit("lost")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        tables.overwrite(broken(spark.range(2)), path)
    assert spark.read.parquet(path).count() == 3
    move, calls = tables.move, []

    def once(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("between the renames")
        move(*a)

    monkeypatch.setattr(tables, "move", once)
    with pytest.raises(OSError):
        tables.overwrite(spark.range(5), path)
    monkeypatch.setattr(tables, "move", move)
    tables.overwrite(spark.read.parquet(f"{path}.before").where("id > 0"), f"{path}2")
    tables.overwrite(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and spark.read.parquet(f"{path}2").count() == 2
    tables.overwrite(spark.read.parquet(path).where("id > 4"), path)  # from itself
    assert spark.read.parquet(path).count() == 2


def test_tables_are_replaced_together(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables.replace_tables({"larder_x": spark.range(3), "larder_y": spark.range(1)}, folder=folder)
    with pytest.raises(Exception, match="lost"):
        tables.replace_tables({"larder_x": spark.range(9), "larder_y": spark.range(2).select(F.raise_error(F.lit("lost")).alias("id"))}, folder=folder)
    assert spark.table("larder_x").count() == 3 and spark.table("larder_y").count() == 1
    assert tables.replace_tables({"larder_x": spark.table("larder_x").select((F.col("id") + 1).alias("n"), F.lit("new").alias("t"))}, folder=folder) == {"larder_x": 3}
    assert [r.n for r in spark.table("larder_x").orderBy("n").collect()] == [1, 2, 3] and len([p for p in tmp_path.iterdir() if p.name.startswith("larder_x-")]) == 2
    for t in ("larder_x", "larder_y"):
        spark.sql(f"DROP TABLE {t}")


def test_ranks_of_few_large_keys(spark):
    rows = [(i, ["a", "b", None][i % 7 % 3], (i * 37) % 91) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, k string, x int")
    got = dimensions.ranked(df, "k", [F.col("x").desc(), F.col("i")], "place", "of").collect()
    want = {}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0]))
        want |= {r[0]: (n, len(own)) for n, r in enumerate(own, 1)}
    assert {r.i: (r.place, r.of) for r in got} == want
    assert dimensions.ranked(df.limit(0), "k", [F.col("x")], "place").count() == 0


def test_totals_of_grouped_rows(spark):
    rows = [(i, "calculated" if i % 5 else "insufficient_data", "Low" if i % 3 else "High", *(["low", "high"][(i + k) % 2] for k in range(5))) for i in range(40)]
    df = spark.createDataFrame(rows, "recipe_id int, data_status string, weighted_risk_level string, energy_risk string, sodium_risk string, fat_risk string, sugar_risk string, protein_risk string")
    levels = {r.weighted_risk_level: (r.recipes, r.share_pct) for r in insights.level_distribution(df).collect()}
    high = sum(1 for r in rows if r[1] == "calculated" and r[2] == "High")
    assert levels == {"Low": (32 - high, round((32 - high) * 100 / 32, 1)), "High": (high, round(high * 100 / 32, 1)), "Medium": (0, 0.0), "Very High": (0, 0.0)}
    bands = insights.nutrient_breakdown(df).collect()
    assert sum(r.recipes for r in bands) == 160 and {r.share_pct for r in bands} == {50.0}
    assert insights.level_distribution(df.limit(0)).where("recipes = 0 and share_pct = 0").count() == 4
