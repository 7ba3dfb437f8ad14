import random

from larder.operators import models


def test_more_sets_take_no_more_jobs(spark):
    r, rows = random.Random(1), []
    for i in range(300):
        v = [r.random() for _ in models.FEATURES]
        rows.append((i, "calculated", "High" if v[0] > 0.5 else "Low", *v))
    df = spark.createDataFrame(rows, "recipe_id long, data_status string, weighted_risk_level string, " + ", ".join(f"{c} double" for c in models.FEATURES))
    jobs = []
    for combos in (1, 9):
        spark.sparkContext.setJobGroup(f"search {combos}", "")
        found = models.random_search(df, combos=combos, folds=3, grid={"numTrees": [8], "maxDepth": [1, 4]}).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search {combos}")))
        assert len(found) == combos and all(x.macro_f1 > 0.6 for x in found)
    assert jobs[1] <= jobs[0] + 3
