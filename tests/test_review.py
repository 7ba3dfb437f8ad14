from larder.operators import analysis


def test_lines_for_review(spark):
    rows = ["1 cup salt and pepper", "2 cups rice", "1 tsp seasoning", "!!! 12", "2 cups chopped", "1 cup very long base phrase of five words", None, "1 2 3 4 5 6 7 8 9 rice"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "recipe_id long, ingredient_index int, raw string")
    got = {r.ingredient_line_raw: (r.parse_status, r.review_reason) for r in analysis.review_queue(df).collect()}
    assert got["1 cup salt and pepper"] == ("flagged", "contains_conjunction")
    assert got["1 tsp seasoning"] == ("flagged", "mixed_seasoning")
    assert got["!!! 12"] == ("dropped", "non_ingredient_text")
    assert got["2 cups chopped"] == ("dropped", "empty_base_after_cleaning")
    assert "long_base_phrase" in got["1 cup very long base phrase of five words"][1]
    assert got["1 2 3 4 5 6 7 8 9 rice"] == ("flagged", "long_raw_phrase")
    assert "2 cups rice" not in got and got[None] == ("dropped", "empty_base_after_cleaning")
