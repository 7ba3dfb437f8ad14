"""Whole jobs over the project's tables: new sources, staged fixes, full rematching, re-analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import lines, text
from larder.operators import analysis, dimensions, resolve, scoring
from larder.sources.shared import cut

# Notes that the tables hold.
ADDED = "Added from scraped allrecipes data"
REMATCHED = "Added from scraped allrecipes data; rematched vs full USDA"
NEGLIGIBLE = "Negligible: spice/flavouring with <5 kcal contribution per serving"
ARTIFACT = "Parsing artefact: not a real ingredient"
#: What a re-analysis replaces.
SCORED = [*scoring.NUTRIENTS.values(), "ingredient_coverage_pct", "energy_risk", "sodium_risk", "fat_risk", "sugar_risk", "protein_risk", "flag_count", "flag_risk_level", "weighted_risk_score", "weighted_risk_level", "data_status"]


def integrate_source(
    scraped: DataFrame, recipes: DataFrame, master: DataFrame, mapping: DataFrame, curated: DataFrame, proxies: DataFrame, brands: list[str], noise: list[str], pool: DataFrame | None = None, first_id: int | None = None
) -> dict[str, DataFrame]:
    """The rows that a scraped source adds to four tables (recipes, lines, master, mapping), and their counters (stats, one row).

    scraped(ord, recipe_title, servings, ingredients, source_url), ord in the order of the source; recipes(recipe_id),
    master(ingredient_id, ingredient_name) and mapping(recipe_ingredient_name) as they are; curated(key, food, fdc_id);
    pool(fdc_id, description), foods that a name may resemble; proxies(local, proxy, display).  Ids go on from the highest there is, or
    start from first_id, names in order of first appearance.  A source whose first_id recipes has was integrated before: ValueError.
    Lines whose name has fewer than two characters, before cleaning or after, are left out; numbers of lines count them.
    The lines are parsed and numbered in one stored pass, names are resolved once each.  A null list of ingredients has no lines, a null title stays null.
    """
    if first_id is not None and dimensions.already_integrated(recipes, "recipe_id", first_id):
        raise ValueError(f"recipe {first_id} is there already: this source was integrated before")
    top = recipes.agg(F.coalesce(F.max("recipe_id"), F.lit(0)).alias("_top")) if first_id is None else recipes.sparkSession.range(1).select(F.lit(first_id - 1).cast("long").alias("_top"))
    new = cut(dimensions.assign_ids(scraped, "ord", 1, "_place").crossJoin(F.broadcast(top)).withColumn("recipe_id", F.col("_top") + F.col("_place")))  # by one row
    added = new.select("recipe_id", F.upper(F.trim("recipe_title")).alias("recipe_name"), F.lit("").alias("cuisine"), F.trim("servings").alias("servings_raw"), F.trim("source_url").alias("recipe_url"), F.lit("").alias("instructions"))

    every = lines.parsed_batch(lines.exploded(new.select("recipe_id", "ingredients"), "ingredients")).withColumn("name", text.remainder_name("remainder"))
    every = cut(every.select("recipe_id", "ingredient_index", "measure_only", "grams", "name"))
    names = resolve.clean_names(every.where(F.length("name") >= 2), proxies, brands, noise).where(F.length("cleaned") >= 2)
    parsed = cut(every.join(names, "name").withColumns({"key": F.lower("cleaned"), "_at": F.struct("recipe_id", "ingredient_index")}))
    first = cut(parsed.groupBy("key").agg(F.min_by(F.struct("cleaned", "tag", "display"), "_at").alias("f"), F.count("*").alias("n")).select("key", "f.*", "n"))

    known = master.select(F.lower("ingredient_name").alias("key"), "ingredient_id").groupBy("key").agg(F.min("ingredient_id").alias("ingredient_id"))
    ids = cut(dimensions.get_or_create(parsed, known, "key", "_at", "ingredient_id"))
    rows = parsed.join(ids, "key").select("recipe_id", "ingredient_id", "ingredient_index", F.lit(1).alias("portion_factor"), F.when(F.col("grams").isNotNull(), F.concat(F.col("grams").cast("string"), F.lit(" g"))).otherwise("").alias("actual_measure"), "measure_only")
    fresh = first.join(known, "key", "left_anti").join(ids, "key")
    base, form = text.base_ingredient("cleaned"), text.form("cleaned")
    created = fresh.select("ingredient_id", F.col("cleaned").alias("ingredient_name"), base.alias("base_ingredient"), form.alias("form"), text.lookup_key("cleaned").alias("nutrition_lookup_key"))

    unmapped = first.join(mapping.select(F.lower("recipe_ingredient_name").alias("key")).distinct(), "key", "left_anti")
    hits = resolve.match(unmapped.select(F.col("cleaned").alias("name")), curated, pool).withColumnRenamed("name", "cleaned")
    mapped = cut(
        unmapped.join(hits, "cleaned", "left").select(
            F.col("cleaned").alias("recipe_ingredient_name"),
            F.col("display").alias("cleaned_ingredient_name"),
            F.col("fdc_id").alias("matched_fdc_id"),
            F.col("food").alias("matched_food_name"),
            F.when(F.col("fdc_id").isNotNull(), "matched").otherwise("skip").alias("match_status"),
            F.when(F.col("tag") == "african_proxy", "african_proxy").otherwise(F.coalesce("match_type", F.lit("no_match"))).alias("match_type"),
            F.lit(ADDED).alias("notes"),
        )
    )
    # Lines whose name the tables have, or an earlier line has brought, reuse it.
    of_lines = parsed.agg(F.count("*").alias("parsed"), F.count("grams").alias("has_grams"))
    of_new = fresh.agg(F.count("*").alias("master_new"))
    of_mapping = mapped.agg(F.count("matched_fdc_id").alias("mapping_new_matched"), F.count_if(F.col("matched_fdc_id").isNull()).alias("mapping_new_no_match"))
    stats = new.agg(F.count("*").alias("recipes")).crossJoin(every.agg(F.count("*").alias("lines"))).crossJoin(of_lines).crossJoin(of_new).crossJoin(of_mapping)  # one row each
    stats = stats.select(
        "recipes",
        F.col("parsed").alias("ingredients_parsed"),
        (F.col("lines") - F.col("parsed")).alias("ingredients_skipped"),
        (F.col("parsed") - F.col("master_new")).alias("master_reused"),
        "master_new",
        (F.col("parsed") - F.col("mapping_new_matched") - F.col("mapping_new_no_match")).alias("mapping_reused"),
        "mapping_new_matched",
        "mapping_new_no_match",
        "has_grams",
        (F.col("parsed") - F.col("has_grams")).alias("no_grams"),
    )
    return {"recipes": added, "lines": rows, "master": created, "mapping": mapped, "stats": stats}


def staged(mapping: DataFrame) -> Column:
    """Rows of a scraped source that have no food yet."""
    return (F.trim("match_status") == "skip") & F.coalesce(F.contains("notes", F.lit("scraped")), F.lit(False))


def fix_staged(mapping: DataFrame, proxies: DataFrame, direct: DataFrame, substrings: DataFrame, negligible: list[str], artifacts: list[str]) -> DataFrame:
    """mapping(name, match_status, notes, fdc_id, food, match_type) with each staged row by the first that holds: a proxy, a
    direct food, the first substring rule, a negligible spice, an artefact.  Other rows and columns stay.

    proxies and direct(name, fdc_id, food) are equi-joined; of a name that they hold twice the least fdc_id counts.
    substrings(priority, keyword, fdc_id, food) and the two lists are kept by people.
    """
    one = lambda df: df.groupBy(F.col("name").alias("_k")).agg(F.min(F.struct("fdc_id", "food")).alias("_v"))
    df = mapping.withColumns({"_k": F.lower(F.trim("name")), "_open": staged(mapping)})
    rules = resolve.first_rule(df.where("_open").select(F.col("_k").alias("name")), substrings.select("priority", "keyword", F.struct("fdc_id", "food").alias("food")))
    rules = rules.where("keyword is not null").select(F.col("name").alias("_k"), F.col("keyword").alias("_w"), F.col("food").alias("_s"))
    df = df.join(one(proxies).withColumnRenamed("_v", "_p"), "_k", "left").join(one(direct).withColumnRenamed("_v", "_d"), "_k", "left").join(rules, "_k", "left")
    food = F.coalesce("_p", "_d", "_s")
    has, spice, junk = food.isNotNull(), F.col("_k").isin(*negligible), F.col("_k").isin(*artifacts)
    said = F.concat(F.when(F.col("_p").isNotNull(), "Proxy resolved").when(F.col("_d").isNotNull(), "Manual fix").otherwise(F.concat(F.lit('Manual fix (substring "'), "_w", F.lit('")'))), F.lit(': matched to USDA "'), food["food"], F.lit('"'))
    now = {
        "fdc_id": F.when(has, food["fdc_id"]),
        "food": F.when(has, food["food"]),
        "match_status": F.when(has, "matched").when(spice | junk, "skip"),
        "match_type": F.when(F.col("_p").isNotNull(), "proxy_fix").when(has, "manual_fix").when(spice, "negligible").when(junk, "artifact"),
        "notes": F.when(has, said).when(spice, NEGLIGIBLE).when(junk, ARTIFACT),
    }
    return df.select(*(F.when(F.col("_open") & now[c].isNotNull(), now[c]).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in mapping.columns))


def rematch_full(mapping: DataFrame, foods: DataFrame, threshold: float = 65.0) -> DataFrame:
    """mapping(name, match_status, notes, fdc_id, food, match_type) with each staged row matched to the description of the
    highest token-sort similarity at or above the threshold, of equal ones to that of the least fdc_id."""
    each = foods.groupBy(F.lower("description").alias("key")).agg(F.min(F.struct("fdc_id", "description")).alias("ord"))
    df = mapping.withColumns({"_k": F.lower(F.trim("name")), "_open": staged(mapping)})
    hits = resolve.match_fuzzy(df.where("_open").select(F.col("_k").alias("name")), each, threshold)
    df = df.join(hits.select(F.col("name").alias("_k"), F.col("ord").alias("_f"), F.col("similarity").cast("int").cast("string").alias("_pct")), "_k", "left")
    hit = F.col("_open") & F.col("_f").isNotNull()
    now = {"fdc_id": F.col("_f.fdc_id"), "food": F.col("_f.description"), "match_status": F.lit("matched"), "match_type": F.concat(F.lit("fuzzy_usda_"), "_pct", F.lit("%")), "notes": F.lit(REMATCHED)}
    return df.select(*(F.when(hit, now[c]).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in mapping.columns))


def reanalyse(scraped: DataFrame, scores: DataFrame, ref: analysis.Reference, excluded: list[int]) -> DataFrame:
    """scores with the recipes of scraped(recipe_id, servings, ingredients) analysed anew, nulls included; all others stay.

    Recipes without lines, excluded ones and ones that scores doesn't have change nothing.  Servings below 1 count as 4;
    unreadable ones give way to those of scores, then to 4.  A recipe with energy is ``calculated``, else ``insufficient_data``.
    """
    s = scraped.where(~F.col("recipe_id").isin(*excluded)) if excluded else scraped
    s = s.join(scores.select("recipe_id", F.col("servings").alias("_old")), "recipe_id")
    stated = F.col("servings").cast("string").try_cast("double").try_cast("int")
    servings = s.select("recipe_id", F.when(stated < 1, 4).otherwise(F.coalesce(stated, F.col("_old").try_cast("int"), F.lit(4))).alias("servings"))
    each = lines.exploded(s.select("recipe_id", "ingredients"), "ingredients").withColumn("raw", text.scraped_line("raw")).where("raw <> ''")
    found = analysis.analyse_recipes(each, ref, servings)
    found = found.withColumn("data_status", F.when(F.col("energy_kcal").cast("double") > 0, "calculated").otherwise("insufficient_data"))
    types = dict(scores.dtypes)
    return dimensions.update_by_id(scores, found.select("recipe_id", *(F.col(c).cast(types[c]).alias(c) for c in SCORED if c in types)), "recipe_id")
