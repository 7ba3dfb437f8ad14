from larder.operators import analysis
from larder.plans import text
from larder.sources import shared

PART = "p_partkey long, p_name string, p_type string, p_size int, p_brand string, p_retailprice double"


def reference(spark, tmp_path):
    spark.createDataFrame([(i, n, "STEEL", i, "b", 1.0) for i, n in enumerate(["blue widget", "new widget", "green gadget"], 1)], PART).write.parquet(str(tmp_path / "part.parquet"))
    return text.reference(spark, str(tmp_path))


def test_chosen_foods_in_passes_and_with_a_dictionary_that_is_not_sent(spark, tmp_path, monkeypatch):
    ref = reference(spark, tmp_path)
    raws = ["1 cup blue widget", "2 green gadget", None, "3 tbsp new widget", "1 cup blue widget"]
    spark.createDataFrame([(i // 5, i % 5, raws[i % 5]) for i in range(60)], "recipe_id long, ingredient_index int, raw string").write.parquet(str(tmp_path / "lines"))
    df = spark.read.parquet(str(tmp_path / "lines"))
    chosen = spark.createDataFrame([(0, 0, 2700003), (0, 2, 2700002), (1, 1, None), (2, 1, 99), (3, 0, 2700002)], "recipe_id long, ingredient_index int, fdc_id long")
    got = lambda: {(r.recipe_id, r.ingredient_index): r for r in analysis.analyse_lines(df, ref, chosen).collect()}
    want = got()
    plain = {(r.recipe_id, r.ingredient_index): r for r in analysis.analyse_lines(df, ref).collect()}
    assert len(want) == 60 and {k for k in want if want[k] != plain[k]} == {(0, 0), (0, 2), (2, 1), (3, 0)}
    assert [(want[k].raw, want[k].fdc_id, want[k].match_type, want[k].food, want[k].status) for k in ((0, 0), (0, 2), (2, 1))] == [
        ("1 cup blue widget", 2700003, "user_override", "green gadget, steel, raw", "matched"), (None, 2700002, None, None, None), ("2 green gadget", 99, "user_override", "USDA 99", "no_usda_data")
    ]
    monkeypatch.setattr(shared, "PASS_BYTES", 100)
    monkeypatch.setattr(analysis, "BROADCAST_ENTRIES", 0)
    stored = []
    monkeypatch.setattr(shared, "cut", lambda x, cut=shared.cut: stored.append(x.columns) or cut(x))
    assert got() == want
    assert stored == [["recipe_id", "ingredient_index", "_entry", "_kept"]] * shared.PASSES  # no texts of lines
