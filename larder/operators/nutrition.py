"""From ingredient lines to nutrients per serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.scoring import NUTRIENTS, rounded


def weighed(rif: DataFrame, measures: DataFrame, servings: DataFrame) -> DataFrame:
    """Each line with grams per serving: the extracted measure, already divided and rounded, else the parsed one by the recipe's servings (4 where unknown)."""
    return with_grams(rif.join(measures, ["recipe_id", "ingredient_index"], "left").join(servings, "recipe_id", "left"))


def with_grams(df: DataFrame) -> DataFrame:
    """weighed() where grams_per_serving, fallback_grams and servings are columns of the lines."""
    servings_ = F.coalesce("servings", F.lit(4))
    return df.withColumns({
        "servings": servings_,
        "source": F.when(F.col("grams_per_serving").isNotNull(), "used_extracted").when(F.col("fallback_grams").isNotNull(), "fallback").otherwise("no_grams"),
        "grams": F.coalesce("grams_per_serving", (F.col("fallback_grams") / servings_).cast("decimal(18,6)")),
    })


def resolved(lines: DataFrame, mapping: DataFrame, wide: DataFrame) -> DataFrame:
    """Lines with their food, its nutrients, and the reason they count or don't: used, no_grams, no_fdc, no_usda."""
    # Foods meet their nutrients first, so lines are moved once.
    foods = mapping.join(wide.withColumn("has_data", F.lit(True)), "fdc_id", "left")
    of = [c for c in foods.columns if c not in ("fdc_id", "ingredient_id", *mapping.columns)]
    extra = [c for c in mapping.columns if c not in ("fdc_id", "ingredient_id")]
    others = [c for c in lines.columns if c != "ingredient_id"]
    df = lines.join(foods, "ingredient_id", "left").select("fdc_id", "ingredient_id", *others, *extra, *of)
    return df.withColumn("reason", F.when(F.col("grams").isNull(), "no_grams").when(F.col("fdc_id").isNull(), "no_fdc").when(F.col("has_data").isNull(), "no_usda").otherwise("used"))


def nutrient_pivot(nutrients: DataFrame, foods: DataFrame | None = None) -> DataFrame:
    """A row a food with the six nutrients; with foods, those without data stay with nulls."""
    wide = nutrients.groupBy("fdc_id").pivot("nutrient_id", list(NUTRIENTS)).agg(F.max("amount"))
    wide = wide.select("fdc_id", *(F.col(str(k)).alias(v) for k, v in NUTRIENTS.items()))
    return wide if foods is None else foods.join(wide, "fdc_id", "left")


def rollup(lines: DataFrame) -> DataFrame:
    """Nutrients per serving of every recipe of resolved() lines, rounded to 0.1; recipes with nothing usable have zeros.

    The sums are decimal, and a line has its food's nutrients, so a recipe is one partial aggregation.
    """
    used = F.col("reason") == "used"
    sums = [rounded(F.coalesce(F.sum(F.when(used, F.col("grams") * F.col(n))), F.lit(0)).cast("double") / 100, 1).alias(n) for n in NUTRIENTS.values()]
    return lines.groupBy("recipe_id").agg(F.max("servings").alias("servings"), F.count("*").alias("ingredients_total"), F.count(F.when(used, 1)).alias("ingredients_used"), *sums)


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the last by order.  Keeps a later join from multiplying rows."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(*key, "r.*")


def best_portion(portions: DataFrame) -> DataFrame:
    """One portion a food: the least rank, ties by order of the file."""
    w = Window.partitionBy("fdc_id").orderBy("rank", "ord")
    return portions.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def coverage(used, total):
    return F.when(total > 0, rounded(used.cast("double") * 100 / total, 1)).otherwise(0.0)
