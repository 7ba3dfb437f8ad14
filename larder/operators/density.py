"""Densities of foods and weights of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.lines import number
from larder.functions.text import col
from larder.operators.nutrition import best_portion

# Millilitres by keyword and grams a millilitre by category, both in the order that decides.
MILLILITRES = (("fluid ounce", 29.5735), ("fl oz", 29.5735), ("tablespoon", 15.0), ("teaspoon", 5.0), ("milliliter", 1.0), ("millilitre", 1.0), ("cubic inch", 16.387), ("gallon", 3785.41), ("quart", 946.35), ("pint", 473.18), ("liter", 1000.0), ("litre", 1000.0), ("cup", 240.0))
CATEGORIES = (
    ("oil butter ghee margarine lard shortening dripping", 0.91),
    ("honey syrup molasses treacle", 1.42),
    ("flour cornmeal cornflour semolina besan starch", 0.53),
    ("sugar icing confectioner", 0.85),
    ("rice couscous bulgur fonio millet quinoa oats oatmeal cornmeal sorghum semolina", 0.85),
    ("spinach kale cabbage lettuce greens leaf leaves ugu herb parsley cilantro coriander basil mint", 0.20),
    ("water milk broth stock juice vinegar wine beer cream sauce puree yoghurt yogurt", 1.00),
)
LOW, HIGH = 0.1, 2.0


def millilitres(c) -> Column:
    low, out = F.lower(col(c)), F
    for word, ml in MILLILITRES:
        out = out.when(low.rlike(rf"\b{word}"), ml)
    return out.otherwise(None)


def build(portions: DataFrame) -> DataFrame:
    """portions(fdc_id, portion_description, gram_weight, ord) -> (fdc_id, g_per_ml, source_portion): one plausible density a food."""
    low = F.trim(F.lower("portion_description"))
    rank = F.when(low.rlike(r"^[0-9]*\s*cup(, nfs)?$"), 0).when(low.contains("cup"), 1).otherwise(2)
    df = portions.withColumns({"g_per_ml": F.try_divide("gram_weight", F.coalesce(number("portion_description"), F.lit(1.0)) * millilitres("portion_description")), "rank": rank})
    best = best_portion(df.where(F.col("g_per_ml").between(LOW, HIGH) & (F.col("gram_weight") > 0)))
    return best.select("fdc_id", F.round(F.col("g_per_ml").cast("decimal(20,8)"), 4).cast("double").alias("g_per_ml"), F.col("portion_description").alias("source_portion"))


def category(name) -> Column:
    """By the first category of which a keyword is part of the name; water's density without any."""
    low, out = F.lower(col(name)), F
    for words, density in CATEGORIES:
        out = out.when(low.rlike("|".join(words.split())), density)
    return out.otherwise(1.0)


def resolve(foods: DataFrame, densities: DataFrame, name: str) -> DataFrame:
    own = F.when(F.col("g_per_ml").between(LOW, HIGH), F.col("g_per_ml"))
    return foods.join(densities.select("fdc_id", "g_per_ml"), "fdc_id", "left").withColumn("density", F.coalesce(own, category(name)))


def grams(volume_ml, density, provisional) -> Column:
    """A volume weighs by its density; anything else keeps its weight."""
    return F.when(col(volume_ml).isNotNull(), F.round((col(volume_ml) * col(density)).cast("decimal(20,8)"), 1).cast("double")).otherwise(col(provisional))
