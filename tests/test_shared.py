import time
from pathlib import Path

from pyspark.sql import functions as F

from larder.sources import shared


def shuffles(spark) -> set[str]:
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in names.split("\n") if "/shuffle_" in x}


def test_a_stored_result_leaves_no_shuffle_behind(spark):
    before = shuffles(spark)
    kept = shared.cut(spark.range(1000).groupBy(F.col("id") % 7).agg(F.count("*").alias("n")))
    for _ in range(50):
        if shuffles(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffles(spark) <= before
    assert spark.conf.get(shared.CLEAN_UP, None) is None and kept.agg(F.sum("n")).first()[0] == 1000


def test_a_query_runs_again_after_it_was_stored(spark):
    df = spark.range(1000).groupBy(F.col("id") % 7).agg(F.count("*").alias("n"))
    assert sorted(r.n for r in shared.cut(df).collect()) == sorted(r.n for r in df.collect()) == sorted(r.n for r in shared.cut(df).collect())


def test_files_of_a_forgotten_result_go(spark):
    kept = shared.cut(spark.range(10))
    path = Path(kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert path.exists()
    shared.forget(kept)
    assert not path.exists()
