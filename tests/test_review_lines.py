from larder.operators import analysis


def test_lines_are_read_once_and_before_their_reasons_are_asked_for(spark):
    rows = ["1 cup salt and pepper", "2 cups rice", None, "2 cups chopped"]
    df = spark.createDataFrame([(i, 1, rows[i % 4]) for i in range(40)], "recipe_id long, ingredient_index int, raw string")
    queue = analysis.review_queue(df)
    assert "regexp_extract(" not in queue._jdf.queryExecution().optimizedPlan().toString()
    got = queue.groupBy("ingredient_line_raw", "review_reason").count().collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == [("1 cup salt and pepper", "contains_conjunction", 10), ("2 cups chopped", "empty_base_after_cleaning", 10), ("None", "empty_base_after_cleaning", 10)]
