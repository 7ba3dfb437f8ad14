"""Summaries, rankings and filters over the table of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import dimensions
from larder.operators.scoring import LEVELS, RISKS, rounded


def share(condition, of):
    """Percentage of the rows of ``of`` that meet the condition, rounded to 0.1; 0 where there are none."""
    n = F.count(F.when(of, 1))
    return F.when(n > 0, rounded(F.count(F.when(of & condition, 1)).cast("double") * 100 / n, 1)).otherwise(0.0)


def level_distribution(scores: DataFrame) -> DataFrame:
    """Recipes and share of each level, levels without any too; the total is that of the four rows."""
    spark = scores.sparkSession
    every = spark.createDataFrame([(v,) for v in LEVELS], "weighted_risk_level string")
    n = scores.where("data_status = 'calculated'").groupBy("weighted_risk_level").agg(F.count("*").alias("recipes"))
    out = every.join(n, "weighted_risk_level", "left").withColumn("recipes", F.coalesce("recipes", F.lit(0)))
    total = F.sum("recipes").over(Window.partitionBy())
    return out.select("weighted_risk_level", "recipes", F.when(total > 0, rounded(F.col("recipes").cast("double") * 100 / total, 1)).otherwise(0.0).alias("share_pct"))


def bands_long(scores: DataFrame) -> DataFrame:
    return scores.where("data_status = 'calculated'").unpivot(["recipe_id"], list(RISKS.values()), "nutrient", "band")


def nutrient_breakdown(scores: DataFrame) -> DataFrame:
    """Recipes and share of each band of each nutrient; the total is that of a nutrient's three rows."""
    n = bands_long(scores).groupBy("nutrient", "band").agg(F.count("*").alias("recipes"))
    total = F.sum("recipes").over(Window.partitionBy("nutrient"))
    return n.select("nutrient", "band", "recipes", rounded(F.col("recipes").cast("double") * 100 / total, 1).alias("share_pct"))


def findings(scores: DataFrame) -> DataFrame:
    elevated = F.col("weighted_risk_level").isin("High", "Very High")
    any_ = F.lit(True)
    return scores.where("data_status = 'calculated'").agg(
        share(F.col("fat_risk") == "high", elevated).alias("fat_high_of_elevated"),
        share(F.col("sodium_risk") == "high", elevated).alias("sodium_high_of_elevated"),
        share(F.col("weighted_risk_level").isin("Low", "Medium"), any_).alias("low_or_medium"),
        share(F.col("protein_risk") == "high", any_).alias("protein_high"),
        share(F.col("fat_risk") == "high", F.col("sodium_risk") == "high").alias("fat_high_given_sodium_high"),
    )


def kpis(scores: DataFrame) -> DataFrame:
    scored = F.col("data_status") == "calculated"
    mean = F.sum(F.when(scored, F.col("weighted_risk_score").cast("decimal(20,4)"))).cast("double") / F.count(F.when(scored, 1))
    return scores.agg(F.count("*").alias("recipes"), F.count(F.when(scored, 1)).alias("scored"), rounded(mean, 1).alias("mean_score"), F.count(F.when(F.col("flag_risk_level") == "High", 1)).alias("flag_high"))


def flag_cooccurrence(scores: DataFrame) -> DataFrame:
    """How many recipes are high in both, for every two of the five: 25 sums of one pass, no self-join."""
    names = list(RISKS.values())
    cells = [F.count(F.when((F.col(a) == "high") & (F.col(b) == "high"), 1)).alias(f"{a}|{b}") for a in names for b in names]
    wide = scores.where("data_status = 'calculated'").agg(*cells)
    return wide.unpivot([], wide.columns, "pair", "recipes").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "recipes")


def top_k(scores: DataFrame, metric: str, k: int) -> DataFrame:
    """The k highest, ties by id; names cut to 40 characters."""
    return scores.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), "recipe_id").limit(k).select("recipe_id", F.substring("recipe_name", 1, 40).alias("recipe_name"), metric)


def explored(scores: DataFrame) -> DataFrame:
    """(recipe_id, place): recipes of each level by score, the highest first, then by name and id."""
    order = [F.col("weighted_risk_score").desc_nulls_last(), F.lower("recipe_name"), F.col("recipe_id")]
    return dimensions.ranked(scores.select("recipe_id", "recipe_name", "weighted_risk_level", "weighted_risk_score"), "weighted_risk_level", order, "place").select("recipe_id", F.col("place").cast("int").alias("place"))


def explore(scores: DataFrame, levels=None, flags=None, min_coverage: float = 0, contains: str = "", with_ingredient: DataFrame | None = None, include_insufficient: bool = False) -> DataFrame:
    df = scores if include_insufficient else scores.where("data_status = 'calculated'")
    if levels:
        df = df.where(F.col("weighted_risk_level").isin(*levels))
    if flags:
        df = df.where(F.col("flag_risk_level").isin(*flags))
    df = df.where(F.col("ingredient_coverage_pct") >= min_coverage)
    if contains:
        df = df.where(F.lower("recipe_name").contains(contains.lower()))
    return df if with_ingredient is None else df.join(with_ingredient.select("recipe_id").distinct(), "recipe_id", "left_semi")


def coverage_tier(pct):
    return F.when(pct < 30, "warn").when(pct < 60, "info").otherwise("ok")
