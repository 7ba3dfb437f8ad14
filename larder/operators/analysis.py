"""Analysis of whole recipes from their lines, and repairs of mapping tables.

Lines repeat, and so do the names in them: distinct lines are parsed once and distinct names resolved once, layer by layer, into a dictionary that
is stored and joined back to the lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import lines, text
from larder.operators import density, resolve, scoring
from larder.operators.nutrition import nutrient_pivot
from larder.sources.shared import cut, cut_in_passes

NAMES = list(scoring.NUTRIENTS.values())


@dataclass(frozen=True)
class Reference:
    """What names are resolved with and lines are weighed with.

    curated(key, food, fdc_id); pool and foods(fdc_id, description); nutrients(fdc_id, six per 100 g); densities(fdc_id, g_per_ml); others(code, ord,
    name_en, name_fr, six per 100 g), the list in two languages; proxies(local, proxy, display), brands and noise as
    resolve.clean_names takes them.
    """

    curated: DataFrame
    pool: DataFrame
    foods: DataFrame
    nutrients: DataFrame
    densities: DataFrame
    others: DataFrame
    proxies: DataFrame
    brands: list[str] = field(default_factory=list)
    noise: list[str] = field(default_factory=list)


def per_100g(nutrients: DataFrame) -> DataFrame:
    wide = nutrient_pivot(nutrients)
    return wide.select("fdc_id", *(F.col(n).cast("double").alias(n) for n in NAMES))


def resolved_names(names: DataFrame, ref: Reference) -> DataFrame:
    """(name, cleaned, fdc_id, code, food, match_type) of each distinct name: by curated keys and similarity, by search, then in the list of two languages, where the name as it stands comes after the cleaned one.

    A layer sees only the names that none before it has resolved, and is stored before the next one runs.
    """
    cleaned = cut(resolve.clean_names(names, ref.proxies, ref.brands, ref.noise).select("name", "cleaned"))
    other = lambda left: resolve.bilingual_search(left, ref.others)
    found = resolve.layers(
        cleaned.select(F.col("cleaned").alias("name")),
        [
            ("manual_match", lambda left: resolve.match(left, ref.curated, ref.pool)),
            ("usda_search", lambda left: resolve.search(left, ref.foods).withColumnRenamed("description", "food")),
            ("wafct", other),
        ],
    )
    both = cleaned.join(found.withColumnRenamed("name", "cleaned"), "cleaned")
    rest = both.where("match_type = 'no_match' and lower(name) <> lower(cleaned)").select("name")
    late = other(rest).select("name", F.col("code").alias("_code"), F.col("food").alias("_food"))
    both = both.join(late, "name", "left")
    hit = F.col("_code").isNotNull()
    return both.select("name", "cleaned", "fdc_id", F.coalesce("code", "_code").alias("code"), F.coalesce("food", "_food").alias("food"), F.when(hit, "wafct").otherwise(F.col("match_type")).alias("match_type"))


def weighed(parsed: DataFrame, ref: Reference) -> DataFrame:
    """parsed lines(fdc_id, code, cleaned, volume_ml, grams, ...) with grams by density, status, and what they add of each nutrient.

    A volume weighs by its food's own density, else by its name's category.  A status is the first that holds of
    no_grams, no_usda_match, no_usda_data, matched.
    """
    own = ref.densities.select("fdc_id", F.when(F.col("g_per_ml").between(density.LOW, density.HIGH), F.col("g_per_ml")).alias("_own"))
    per = ref.nutrients.select("fdc_id", F.struct(*NAMES).alias("_n"))
    per_code = ref.others.select("code", F.struct(*(F.col(n).cast("double").alias(n) for n in NAMES)).alias("_c"))
    df = parsed.join(own, "fdc_id", "left").join(per, "fdc_id", "left").join(per_code, "code", "left")
    df = df.withColumn("grams", density.grams("volume_ml", F.coalesce("_own", density.category("cleaned")), "grams"))
    per = F.coalesce("_c", "_n")
    matched = F.col("fdc_id").isNotNull() | F.col("code").isNotNull()
    status = F.when(F.coalesce("grams", F.lit(0.0)) == 0, "no_grams").when(~matched, "no_usda_match").when(per.isNull(), "no_usda_data").otherwise("matched")
    df = df.withColumn("status", status)
    adds = {n: F.when(F.col("status") == "matched", (F.col("grams") * F.coalesce(per[n], F.lit(0.0)) / 100).cast("decimal(20,6)")) for n in NAMES}
    return df.withColumns(adds).drop("_own", "_n", "_c")


DETAIL = ["qty", "unit", "name_raw", "cleaned", "fdc_id", "code", "food", "match_type", "grams", "status", *NAMES]


#: Entries of the dictionary of lines are sent to the lines up to this many; beyond it both are shuffled.
BROADCAST_ENTRIES = 50_000


def line_dictionary(df: DataFrame, ref: Reference, overrides: DataFrame | None = None) -> DataFrame:
    """A row for each distinct line (raw), and, with overrides, for each line and food (chosen) that a person chose for it."""
    each = cut(lines.parsed_live(df.select("raw").where("raw is not null").distinct()))
    names = resolved_names(each.select(F.col("name_raw").alias("name")), ref)
    names = cut(names.withColumnRenamed("name", "name_raw"))
    known = weighed(each.join(names, "name_raw"), ref).select("raw", *DETAIL)
    if overrides is None:
        return known
    chosen = df.join(overrides, ["recipe_id", "ingredient_index"]).select("raw", "fdc_id").where("fdc_id is not null").distinct()
    chosen = chosen.join(ref.foods.select("fdc_id", F.col("description").alias("food")), "fdc_id", "left").withColumn("food", F.coalesce("food", F.concat(F.lit("USDA "), F.col("fdc_id").cast("string"))))
    chosen = chosen.withColumns({"code": F.lit(None).cast("string"), "match_type": F.lit("user_override")})
    own = weighed(chosen.join(each.join(names.select("name_raw", "cleaned"), "name_raw"), "raw"), ref).select("raw", *DETAIL)
    return known.withColumn("chosen", F.lit(None).cast("long")).unionByName(own.withColumn("chosen", F.col("fdc_id")))


def analyse_lines(df: DataFrame, ref: Reference, overrides: DataFrame | None = None) -> DataFrame:
    """df(recipe_id, ingredient_index, raw) -> each line with quantity, food, weight, status and what it adds of each nutrient.

    overrides(recipe_id, ingredient_index, fdc_id), a row a line, come before all matching; a null fdc_id overrides nothing.
    Null lines stay, without any of this; repeated lines are lines each; other columns of df are left behind.
    """
    df = df.select("recipe_id", "ingredient_index", "raw")
    if overrides is None:
        out = df.join(cut(line_dictionary(df, ref)), "raw", "left")
    else:
        o = overrides.select("recipe_id", "ingredient_index", "fdc_id").where("fdc_id is not null")
        out = overridden(df, line_dictionary(df, ref, o), o)
    return out.select("recipe_id", "ingredient_index", "raw", *DETAIL[:8], text.confidence("match_type").alias("confidence"), *DETAIL[8:])


def overridden(df: DataFrame, dictionary: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each line with its entry of dictionary(raw, chosen, ...).

    Lines meet what was chosen for them in passes over the recipes, and only the number of the entry is stored for each.
    """
    entries = cut(cut(dictionary).withColumn("_entry", F.monotonically_increasing_id()))
    sent = F.broadcast if entries.count() <= BROADCAST_ENTRIES else lambda x: x
    keys = sent(entries.select(F.col("raw").alias("_raw"), F.col("chosen").alias("_key"), "_entry"))
    o = overrides.select("recipe_id", "ingredient_index", F.col("fdc_id").cast("long").alias("_chosen"))
    placed = df.join(o, ["recipe_id", "ingredient_index"], "left")
    placed = placed.join(keys, (F.col("raw") == F.col("_raw")) & F.col("_chosen").eqNullSafe(F.col("_key")), "left")
    # A line that is null has no entry and keeps its food.
    kept = F.when(F.col("_entry").isNull(), F.col("_chosen")).alias("_kept")
    placed = cut_in_passes(placed.select("recipe_id", "ingredient_index", "_entry", kept), "recipe_id")
    out = placed.join(sent(entries), "_entry", "left")
    return out.withColumn("fdc_id", F.coalesce("fdc_id", "_kept")).drop("_entry", "_kept", "chosen")


def analyse_recipes(df: DataFrame, ref: Reference, servings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row a recipe: nutrients per serving rounded to 0.1, coverage, and the risk of the rounded values.

    servings(recipe_id, servings); what can't be read as a number counts as 1, less than 1 as 1.
    """
    a = analyse_lines(df, ref, overrides)
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in NAMES]
    total = a.groupBy("recipe_id").agg(F.count("*").alias("ingredients_total"), F.count(F.when(F.col("status") == "matched", 1)).alias("ingredients_used"), *sums)
    per = F.greatest(F.coalesce(F.col("servings").try_cast("int"), F.lit(1)), F.lit(1))
    total = total.join(servings.select("recipe_id", "servings"), "recipe_id", "left").withColumn("servings", per)
    rounded = total.withColumns({n: scoring.rounded(F.col(n) / F.col("servings"), 1) for n in NAMES})
    names = df.select("recipe_id").distinct().withColumn("recipe_name", F.lit(None).cast("string"))
    return scoring.risk_scores(rounded, names).drop("recipe_name")


def method_breakdown(measured: DataFrame) -> DataFrame:
    n = measured.groupBy("extraction_method").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # of a row for each method
    return n.select("extraction_method", "n", F.floor(F.col("n") * 100 / total).cast("int").alias("pct"))


def fixed(mapping: DataFrame, fixes: DataFrame, key: str, applies: Column) -> DataFrame:
    """Rows to which a fix applies, with the fix's columns; others as they are."""
    f = fixes.select(key, *(F.col(c).alias(f"_f_{c}") for c in fixes.columns if c != key))
    out = mapping.join(f, key, "left")
    return out.select(*(F.when(applies & F.col(f"_f_{c}").isNotNull(), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) if f"_f_{c}" in out.columns else F.col(c) for c in mapping.columns))


def mapping_status(matched: Column, proxy: Column, fragment: Column) -> Column:
    return F.when(matched, "matched").when(proxy, "african_proxy").when(fragment, "skip").otherwise("still_unmatched")


def review_queue(df: DataFrame) -> DataFrame:
    """Lines that a person should look at, with the reasons.

    The limits are ours: a long base has more than three words, a long line more than eight.  Distinct lines are read once and
    stored in between: a filter on the reasons would be worked out from the line itself, with each step as often as the next one names it.
    """
    each = cut(lines.parsed_live(df.select("raw").distinct()).select("raw", "name_raw"))
    parsed = cut(each.select("raw", "name_raw", text.base_ingredient("name_raw").alias("base_ingredient"), text.form("name_raw").alias("form")))
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    low = F.lower("raw")
    reasons = F.concat_ws(
        ";",
        F.when(low.rlike(r"\b(and|or)\b"), "contains_conjunction"),
        F.when(words("base_ingredient") > 3, "long_base_phrase"),
        F.when(words("raw") > 8, "long_raw_phrase"),
        F.when(low.rlike(r"seasoning|spice mix"), "mixed_seasoning"),
    )
    empty = F.col("base_ingredient") == ""
    out = parsed.withColumns({"review_reason": F.when(~low.rlike("[a-z]"), "non_ingredient_text").when(empty, "empty_base_after_cleaning").otherwise(reasons), "parse_status": F.when(empty | ~low.rlike("[a-z]"), "dropped").otherwise("flagged")})
    flagged = out.where("review_reason <> ''").withColumnRenamed("raw", "_raw")
    out = df.select("recipe_id", "ingredient_index", "raw").join(flagged, F.col("raw").eqNullSafe(F.col("_raw")))
    return out.select("recipe_id", "ingredient_index", F.col("raw").alias("ingredient_line_raw"), F.col("name_raw").alias("ingredient_name_clean"), "base_ingredient", "form", "parse_status", "review_reason")
