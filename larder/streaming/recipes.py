"""New recipes as a stream of files into three tables, each recipe once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.functions.text import url_key
from larder.operators import analysis, scoring
from larder.operators.dimensions import assign_ids
from larder.operators.insights import coverage_tier
from larder.sources.shared import cut, exists

SCHEMA = "name string, cuisine string, servings string, url string, ingredients array<string>"
TABLES = ("recipes", "nutrition", "scores")
LEDGER = "batch long, first_id long, recipes long"


def write(df: DataFrame, path: str) -> None:
    """A batch's rows in a folder of their own; writing them again replaces them."""
    df.write.mode("overwrite").parquet(path)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that are whole, each with its first id and number of recipes."""
    path = f"{folder}/ledger"
    return spark.read.schema(LEDGER).parquet(f"{path}/*") if exists(spark, path) else spark.createDataFrame([], LEDGER)


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows of the batches that the ledger has; what a batch that failed has left is not among them."""
    done = ledger(spark, folder).select("batch")
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(done), "batch", "left_semi").drop("batch")  # a row a batch


def add_batch(new: DataFrame, number: int, folder: str, ref: analysis.Reference, first_id: int = 1) -> None:
    """Analyses recipes of SCHEMA and adds them to the three tables as batch ``number``.

    The batch counts when the ledger has it, which is written last: a batch that failed before runs again over its own
    folders with the same ids, one that is in the ledger adds nothing.  A recipe whose url an earlier batch or the batch itself has is
    left out (the first by name stays); recipes without a url are all added.  Servings that are no number, or less than 1, count as 1.
    """
    spark = new.sparkSession
    known = ledger(spark, folder)
    if not known.where(F.col("batch") == number).isEmpty():
        return
    start = known.agg(F.coalesce(F.max(F.col("first_id") + F.col("recipes")), F.lit(first_id))).first()[0]
    new = new.withColumn("_key", url_key(F.coalesce("url", F.lit(""))))
    once = new.where("_key <> ''").groupBy("_key").agg(F.min(F.struct("name", "cuisine", "servings", "url", "ingredients")).alias("r")).select("_key", "r.*")
    if not known.isEmpty():
        once = once.join(committed(spark, folder, "recipes").select(url_key("recipe_url").alias("_key")), "_key", "left_anti")
    every = once.unionByName(new.where("_key = ''")).withColumn("_o", F.concat_ws("\0", "_key", "name"))
    made = cut(assign_ids(every, "_o", start, "recipe_id").withColumn("name", F.upper("name")))

    servings = F.greatest(F.coalesce(F.col("servings").try_cast("int"), F.lit(1)), F.lit(1))
    lines = made.select("recipe_id", F.posexplode("ingredients").alias("_p", "raw")).where(F.trim("raw") != "").select("recipe_id", (F.col("_p") + 1).alias("ingredient_index"), "raw")
    found = cut(analysis.analyse_recipes(lines, ref, made.select("recipe_id", "servings")))
    zero = {n: 0.0 for n in (*scoring.NUTRIENTS.values(), "ingredient_coverage_pct")}
    scored = made.select("recipe_id", F.col("name").alias("recipe_name"), servings.alias("servings")).join(found.drop("servings"), "recipe_id", "left")
    scored = scored.na.fill({**zero, "ingredients_total": 0, "ingredients_used": 0, "data_status": "insufficient_data"}).withColumn("coverage_tier", coverage_tier(F.col("ingredient_coverage_pct")))
    out = {
        "recipes": made.select("recipe_id", F.col("name").alias("recipe_name"), F.coalesce("cuisine", F.lit("")).alias("cuisine"), F.concat(F.lit("MAKES "), servings.cast("string"), F.lit(" SERVINGS")).alias("servings_raw"), F.coalesce("url", F.lit("")).alias("recipe_url"), F.lit("").alias("instructions")),
        "nutrition": scored.select("recipe_id", "servings", "ingredients_total", "ingredients_used", *scoring.NUTRIENTS.values()),
        "scores": scored.drop("ingredients_total", "ingredients_used"),
    }
    for name in TABLES:
        write(out[name], f"{folder}/{name}/batch={number}")
    write(spark.createDataFrame([(number, start, made.count())], LEDGER), f"{folder}/ledger/{number}")


def add_recipes(spark: SparkSession, source: str, folder: str, checkpoint: str, ref: analysis.Reference, first_id: int = 1, files: int = 100) -> StreamingQuery:
    """JSON files of SCHEMA under source, ``files`` a batch, into the tables under folder; ends when all that is there is added."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(source)
    return stream.writeStream.foreachBatch(lambda df, n: add_batch(df, n, folder, ref, first_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
