"""Duplicate recipes, blocks of rows and filled columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_key(name: str) -> Column:
    """Lower case, without outer quotes, single blanks, without trailing s, without punctuation."""
    low = F.regexp_replace(F.lower(F.trim(name)), "^\"+|\"+$", "")
    low = F.regexp_replace(low, "^'+|'+$", "")
    low = F.regexp_replace(F.trim(low), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "s+$", ""), r"(?U)[^\w\s]", ""))


def judged(recipes: DataFrame, lines: DataFrame) -> DataFrame:
    """recipes with kept_id and kept_name: of each name key, the recipe of the most ingredients, ties by id.

    The winner is one aggregation a key and is joined back, so a key of very many recipes is summed before the shuffle.
    """
    df = recipes.join(lines.groupBy("recipe_id").agg(F.count("*").alias("n_lines")), "recipe_id", "left").withColumn("name_key", name_key("recipe_name"))
    best = df.groupBy("name_key").agg(F.min(F.struct(-F.coalesce("n_lines", F.lit(0)), "recipe_id", "recipe_name")).alias("b"))
    return df.join(best, "name_key").withColumns({"kept_id": F.col("b.recipe_id"), "kept_name": F.col("b.recipe_name")}).drop("b")


def removed(recipes: DataFrame, lines: DataFrame) -> DataFrame:
    """The audit table of what goes."""
    out = judged(recipes, lines).where("recipe_id <> kept_id")
    return out.withColumn("reason", F.concat(F.lit('norm_key="'), "name_key", F.lit('"'))).drop("n_lines", "name_key")


def kept(recipes: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recipes and lines without the duplicates."""
    stay = judged(recipes, lines).where("recipe_id = kept_id").select("recipe_id")
    return recipes.join(stay, "recipe_id", "left_semi"), lines.join(stay, "recipe_id", "left_semi")


def run_blocks(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """block goes up by one where value differs from the row before, within each group."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.lag(value).over(w)
    return df.withColumn("_new", (~before.eqNullSafe(F.col(value))).cast("int")).withColumn("block", F.sum("_new").over(w)).drop("_new")


def forward_fill(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(*order)))


def first_title(df: DataFrame, columns: list[str]) -> Column:
    """The first of the columns that the table has and that isn't null."""
    return F.coalesce(*(F.col(c) for c in columns if c in df.columns), F.lit("Unknown Recipe"))
