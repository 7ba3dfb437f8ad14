from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import dimensions, models
from larder.sources import shared


def by_key(spark, path):
    spark.range(4000).select((F.col("id") % 501).alias("k"), "id").write.parquet(path)
    df = spark.read.parquet(path)
    return df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id"))).groupBy("k").agg(F.sum(F.col("n") * F.col("id")).alias("s"))


def test_passes_give_what_one_cut_gives(spark, tmp_path, monkeypatch):
    df, shares = by_key(spark, str(tmp_path / "t")), []
    want = sorted(map(tuple, df.collect()))
    monkeypatch.setattr(shared, "PASS_BYTES", 100)
    monkeypatch.setattr(shared, "cut", lambda x, cut=shared.cut: shares.append((x, out := cut(x))) or out)
    assert sorted(map(tuple, shared.cut_in_passes(df, "k").collect())) == want
    assert len(shares) == shared.PASSES and all(0 < out.count() < len(want) for _, out in shares)
    plan = shares[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Filter")  # the share is taken below the window


def test_rows_are_ranked_where_they_lie(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else "ab"[i % 2], i * 7919 % 1000) for i in range(1000)], "k string, x int")
    out = dimensions.ranked(df, "k", [F.col("x")], "place", "of")
    rows = [tuple(r) for r in out.collect()]
    want = {x: i + 1 for k in (None, "a", "b") for i, x in enumerate(sorted(r[1] for r in rows if r[0] == k))}
    assert len(rows) == 1000 and all(place == want[x] and of == sum(r[0] == k for r in rows) for k, x, place, of in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_models_store_what_they_are_fitted_on(spark):
    row = (1, "calculated", "Low", "a long name", *(1.0 for _ in models.FEATURES))
    df = spark.createDataFrame([row], "recipe_id long, data_status string, weighted_risk_level string, recipe_name string, " + ", ".join(f"{c} double" for c in models.FEATURES))
    assert models.narrow(df).columns == ["recipe_id", "label", *models.FEATURES]
