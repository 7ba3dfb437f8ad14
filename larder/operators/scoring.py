"""Dietary risk: bands, continuous scores, weighted score, levels, sentences, what-if."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds and weights per serving.
NUTRIENTS = {203: "protein_g", 204: "fat_g", 205: "carbohydrate_g", 208: "energy_kcal", 269: "sugars_g", 307: "sodium_mg"}
THRESHOLDS = {"energy_kcal": (500, 800), "sodium_mg": (400, 700), "fat_g": (15, 25), "sugars_g": (12, 20), "protein_g": (15, 8)}
WEIGHTS = {"sodium_mg": 0.30, "energy_kcal": 0.25, "fat_g": 0.20, "sugars_g": 0.15, "protein_g": 0.10}
RISKS = {"energy_kcal": "energy_risk", "sodium_mg": "sodium_risk", "fat_g": "fat_risk", "sugars_g": "sugar_risk", "protein_g": "protein_risk"}
LEVELS = ("Low", "Medium", "High", "Very High")
DAILY = {"energy_kcal": 2000.0, "fat_g": 78.0, "carbohydrate_g": 275.0, "sugars_g": 50.0, "protein_g": 50.0, "sodium_mg": 2300.0}
VERDICT_WORDS = (("sodium_risk", "salty"), ("fat_risk", "fatty"), ("energy_risk", "calorie-dense"), ("sugar_risk", "sugary"), ("protein_risk", "low on protein"))
TIPS = ("fat_g", "sugars_g", "protein_g", "sodium_mg", "energy_kcal")


def rounded(x: Column, digits: int) -> Column:
    """Half up in decimal arithmetic, so that the result doesn't depend on the engine."""
    return F.round(x.cast("decimal(20,8)"), digits).cast("double")


def band(nutrient: str, value: Column) -> Column:
    """low, medium or high; for protein much is low risk."""
    medium, high = THRESHOLDS[nutrient]
    if nutrient == "protein_g":
        return F.when(value >= medium, "low").when(value >= high, "medium").when(value.isNotNull(), "high")
    return F.when(value < medium, "low").when(value < high, "medium").when(value.isNotNull(), "high")


def score(nutrient: str, value: Column) -> Column:
    """0 at the medium threshold or better, 0.5 at the high one, 1 at twice that (protein: at none), linear between."""
    medium, high = (float(x) for x in THRESHOLDS[nutrient])
    if nutrient == "protein_g":
        return F.when(value >= medium, 0.0).when(value >= high, 0.5 * (medium - value) / (medium - high)).otherwise(0.5 + F.least(0.5 * (high - value) / high, F.lit(0.5)))
    return F.when(value <= medium, 0.0).when(value <= high, 0.5 * (value - medium) / (high - medium)).otherwise(0.5 + F.least(0.5 * (value - high) / high, F.lit(0.5)))


def weighted(values: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for n, w in WEIGHTS.items():
        total = total + score(n, values[n]) * w
    return rounded(total * 100, 1)


def level(s: Column) -> Column:
    return F.when(s < 25, "Low").when(s < 50, "Medium").when(s < 75, "High").when(s.isNotNull(), "Very High")


def flag_level(n: Column) -> Column:
    return F.when(n == 0, "Low").when(n <= 2, "Medium").when(n.isNotNull(), "High")


def risk_scores(nutrition: DataFrame, names: DataFrame) -> DataFrame:
    """nutrition(recipe_id, servings, ingredients_total, ingredients_used, nutrients) with bands, flags, scores and levels.

    A recipe without energy has data_status ``insufficient_data`` and null risk fields; a recipe without a name is ``?``.
    """
    df = nutrition.join(names.select("recipe_id", "recipe_name"), "recipe_id", "left")
    known = F.col("energy_kcal") > 0
    total, used = F.col("ingredients_total"), F.col("ingredients_used")
    df = df.withColumns({r: F.when(known, band(n, F.col(n))) for n, r in RISKS.items()})
    flags = sum(((F.col(r) == "high").cast("int") for r in RISKS.values()), F.lit(0))
    df = df.withColumns({
        "recipe_name": F.coalesce("recipe_name", F.lit("?")),
        "ingredient_coverage_pct": F.when(total > 0, rounded(used.cast("double") * 100 / total, 1)).otherwise(0.0),
        "flag_count": F.when(known, flags),
        "weighted_risk_score": F.when(known, weighted({n: F.col(n) for n in WEIGHTS})),
    })
    return df.withColumns({
        "flag_risk_level": flag_level(F.col("flag_count")),
        "weighted_risk_level": level(F.col("weighted_risk_score")),
        "data_status": F.when(known, "calculated").otherwise("insufficient_data"),
    })


def verdict(df: DataFrame) -> Column:
    """One sentence from the bands, words in a fixed order."""

    def words(which: str) -> Column:
        return F.array_compact(F.array(*(F.when(F.col(c) == which, w) for c, w in VERDICT_WORDS)))

    def joined(a: Column) -> Column:
        return F.when(F.size(a) == 1, a[0]).otherwise(F.concat(F.array_join(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(a, -1)))

    high, medium = words("high"), words("medium")
    return (
        F.when(F.col("weighted_risk_level").isNull(), None)
        .when(F.col("weighted_risk_level") == "Low", "A well-balanced dish — nothing here stands out as a concern.")
        .when(F.size(high) > 0, F.concat(F.lit("A good meal overall, but quite "), joined(F.when(F.size(high) > 0, high)), F.lit(".")))
        .when(F.size(medium) > 0, F.concat(F.lit("A decent meal — just a little "), joined(F.when(F.size(medium) > 0, medium)), F.lit(".")))
        .otherwise("A reasonably balanced dish.")
    )


def daily_values(df: DataFrame) -> DataFrame:
    return df.select("recipe_id", *(rounded(F.col(n) * 100 / dv, 0).cast("int").alias(f"{n}_pct") for n, dv in DAILY.items()))


def traffic_light(nutrient: str, value: Column) -> Column:
    s = score(nutrient, value)
    return F.when(s < 0.25, "green").when(s < 0.5, "amber").otherwise("red")


def adjusted(on: dict[str, Column]) -> dict[str, Column]:
    """Nutrients after the tips that are on: less fat and sugar take their energy away, more protein brings its own, a lighter side comes last."""
    v = {n: F.col(n) for n in THRESHOLDS}
    cut_fat = F.when(on["fat_g"], v["fat_g"] * 0.33).otherwise(0.0)
    cut_sugar = F.when(on["sugars_g"], v["sugars_g"] * 0.5).otherwise(0.0)
    add_protein = F.when(on["protein_g"], v["protein_g"] * 0.4).otherwise(0.0)
    energy = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), v["energy_kcal"] - cut_fat * 9) - cut_sugar * 4) + add_protein * 4
    return {
        "fat_g": v["fat_g"] - cut_fat,
        "sugars_g": v["sugars_g"] - cut_sugar,
        "protein_g": v["protein_g"] + add_protein,
        "sodium_mg": F.when(on["sodium_mg"], v["sodium_mg"] * 0.6).otherwise(v["sodium_mg"]),
        "energy_kcal": F.when(on["energy_kcal"], energy * 0.85).otherwise(energy),
    }


def whatif(scores: DataFrame) -> DataFrame:
    """Each scored recipe under each non-empty set of tips for its medium and high nutrients: new score, level and direction."""
    spark = scores.sparkSession
    tips = spark.range(1, 1 << len(TIPS)).select(F.col("id").cast("int").alias("tips"))
    bit = {n: F.col("tips").bitwiseAND(F.lit(1 << i)) > 0 for i, n in enumerate(TIPS)}
    fits = F.lit(True)
    for n in TIPS:
        fits = fits & (~bit[n] | F.col(RISKS[n]).isin("medium", "high"))
    df = scores.where("data_status = 'calculated'").join(F.broadcast(tips), fits)  # 31 sets, always
    new = weighted(adjusted(bit))
    df = df.withColumn("new_score", new)
    old = F.col("weighted_risk_score")
    arrow = F.when(F.col("new_score") < old - 0.5, "down").when(F.col("new_score") > old + 0.5, "up").otherwise("same")
    return df.select("recipe_id", "tips", "new_score", level(F.col("new_score")).alias("new_level"), arrow.alias("direction"))
