"""Whole jobs, sources and sinks over the adapter's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import dimensions, jobs, models, resolve
from larder.plans.adapter import table
from larder.plans.registry import SHARED, query
from larder.plans.relational import scores
from larder.plans.text import PERCENT, food_names, fuzzy_sql, joined, recipes_sql, reference, two_languages
from larder.sources import tables
from larder.sources.shared import cut, new_path
from larder.streaming import recipes

# ---------------------------------------------------------------- sources and sinks

PART = "SELECT p_partkey, p_name, p_size FROM part"


def parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", "p_name", "p_size")


def typed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in like.dtypes))


def through_csv(s: SparkSession, df: DataFrame, first: str = "") -> DataFrame:
    """df written as CSV, its first name behind ``first``, and read again."""
    path = new_path(s, "csv")
    df.toDF(first + df.columns[0], *df.columns[1:]).write.option("header", True).option("escape", '"').csv(path)
    return typed(tables.read_csv(s, path), df)


def discovered(s: SparkSession, d: str) -> DataFrame:
    """Two sources with ingredients and a url, one without."""
    base = new_path(s, "scraped")
    df = joined(s, d)
    df.where("recipe_id % 2 = 0").select(F.col("recipe_id").alias("Recipe_URL"), "ingredients").write.option("header", True).csv(f"{base}/a.csv")
    df.where("recipe_id % 2 <> 0").select("ingredients", F.col("recipe_id").alias("source_url")).write.option("header", True).csv(f"{base}/b.csv")
    df.select("recipe_id").write.option("header", True).csv(f"{base}/c.csv")
    return tables.discover(s, f"{base}/*.csv").select("source_url", F.size(F.split("ingredients", r"\|")).cast("long").alias("parts"))


def appended(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "appended")
    for half in ("p_partkey % 2 = 0", "p_partkey % 2 <> 0"):
        tables.append(parts(s, d).where(half), path)
    return s.read.parquet(path)


def overwritten(s: SparkSession, d: str) -> DataFrame:
    """A CSV that is rewritten from itself."""
    path = new_path(s, "csv")
    like = parts(s, d)
    tables.overwrite_csv(like, path)
    tables.overwrite_csv(typed(tables.read_csv(s, path), like).withColumn("p_size", F.col("p_size") + 1), path)
    return typed(tables.read_csv(s, path), like)


def replaced(s: SparkSession, d: str) -> DataFrame:
    """Row counts of three tables as they are written."""
    folder = new_path(s, "tables")
    tag = folder.rsplit("-", 1)[-1]
    counts = tables.replace_tables({f"larder_{n}_{tag}": table(s, d, n) for n in ("recipes", "food", "food_nutrient")}, folder=folder)
    for k in counts:
        s.sql(f"DROP TABLE {k}")
    return s.createDataFrame([(k.removeprefix("larder_").removesuffix(f"_{tag}"), n) for k, n in counts.items()], "name string, n long")


query("src_csv", PART)(lambda s, d: through_csv(s, parts(s, d)))
query("src_csv_bom", PART)(lambda s, d: through_csv(s, parts(s, d), "﻿"))
query("src_glob_discover", "SELECT CAST(recipe_id AS STRING) AS source_url, count(*) + 1 AS parts FROM line GROUP BY recipe_id")(discovered)
query("sink_csv_overwrite", "SELECT p_partkey, p_name, p_size + 1 AS p_size FROM part")(overwritten)
query("sink_append", PART)(appended)
query("sink_table_replace", "SELECT 'recipes' AS name, count(*) AS n FROM recipes UNION ALL SELECT 'food', count(*) FROM food UNION ALL SELECT 'food_nutrient', count(*) FROM food_nutrient")(replaced)

# ---------------------------------------------------------------- a scraped source

#: Names whose food is even are in the master already, those divisible by three are mapped, by five curated.
HAVE = "SELECT ingredient_name AS name, min(ingredient_id) AS id FROM food GROUP BY 1"
TOP = 1000
SHARED["scraped_name"] = "SELECT recipe_id, ingredient_index, unit2, qty_expected, grams2, raw, CASE WHEN unit2 = '' AND qty_expected = 1.5 THEN concat('1/2 ', name2) ELSE name2 END AS name FROM read"
SHARED["have"] = HAVE
SHARED["new_recipe"] = f"SELECT o.recipe_id AS old_id, {TOP} + row_number() OVER (ORDER BY o.recipe_id) AS recipe_id FROM (SELECT DISTINCT recipe_id FROM line) o"
SHARED["new_name"] = "SELECT name, 900000000 + row_number() OVER (ORDER BY min(struct_pack(a := recipe_id, b := ingredient_index))) AS ingredient_id FROM scraped_name WHERE name NOT IN (SELECT name FROM have WHERE id % 2 = 0) GROUP BY name"


SHARED["key2"] = "SELECT name, min(id) AS id FROM have WHERE id % 5 <> 0 AND name LIKE '%e%' GROUP BY name"
SHARED["unmapped"] = "SELECT DISTINCT name FROM scraped_name WHERE name NOT IN (SELECT name FROM have WHERE id % 3 = 0)"
SHARED["like2"] = f"SELECT *, {PERCENT} AS match_type FROM ({fuzzy_sql('SELECT name FROM unmapped WHERE name NOT IN (SELECT name FROM key2)', 'SELECT name AS key, id AS ord FROM key2', 78)})"
SHARED["mapped2"] = "SELECT u.name, coalesce(k.id, l.ord) AS id, coalesce(k.name, l.key) AS food, CASE WHEN k.id IS NOT NULL THEN 'manual_match' ELSE coalesce(l.match_type, 'no_match') END AS match_type FROM unmapped u LEFT JOIN key2 k ON k.name = u.name LEFT JOIN like2 l ON l.name = u.name"


def source(s: SparkSession, d: str, first_id: int | None = None) -> dict[str, DataFrame]:
    """Recipes of every line as a scraped source; keys are curated for names with an e, others may resemble one."""
    have = table(s, d, "food").groupBy(F.col("ingredient_name").alias("name")).agg(F.min("ingredient_id").alias("id"))
    scraped = joined(s, d).select(F.col("recipe_id").alias("ord"), F.concat(F.lit(" title "), F.col("recipe_id").cast("string")).alias("recipe_title"), F.lit(" 4 ").alias("servings"), "ingredients", F.concat(F.lit("x/"), F.col("recipe_id").cast("string")).alias("source_url"))
    # The highest id of the master belongs to a name that no line has.
    master = have.where("id % 2 = 0").select(F.col("id").alias("ingredient_id"), F.col("name").alias("ingredient_name")).union(s.createDataFrame([(900000000, "-")], "i long, n string"))
    return jobs.integrate_source(
        scraped,
        s.createDataFrame([(TOP,)], "recipe_id long"),
        master,
        have.where("id % 3 = 0").select(F.col("name").alias("recipe_ingredient_name")),
        have.where("id % 5 <> 0 and name like '%e%'").select(F.col("name").alias("key"), F.col("name").alias("food"), F.col("id").alias("fdc_id")),
        s.createDataFrame([], "local string, proxy string, display string"),
        [],
        [],
        first_id=first_id,
    )


query("integrate_recipes", "SELECT recipe_id, concat('TITLE ', CAST(old_id AS STRING)) AS recipe_name, '4' AS servings_raw, concat('x/', CAST(old_id AS STRING)) AS recipe_url FROM new_recipe")(
    lambda s, d: source(s, d)["recipes"].select("recipe_id", "recipe_name", "servings_raw", "recipe_url")
)
query("integrate_source", "SELECT r.recipe_id, coalesce(h.id, n.ingredient_id) AS ingredient_id, x.ingredient_index, x.grams2 AS grams, CASE WHEN unit2 = '' AND qty_expected = 1.5 THEN '1' ELSE concat_ws(' ', regexp_extract(raw, '^[0-9/ ]*[0-9]'), nullif(unit2, '')) END AS measure_only FROM scraped_name x JOIN new_recipe r ON r.old_id = x.recipe_id LEFT JOIN have h ON h.name = x.name AND h.id % 2 = 0 LEFT JOIN new_name n ON n.name = x.name")(
    lambda s, d: source(s, d)["lines"].select("recipe_id", "ingredient_id", "ingredient_index", F.regexp_extract("actual_measure", "^([0-9.E]+) g$", 1).try_cast("double").alias("grams"), "measure_only")
)
query("integrate_master", "SELECT ingredient_id, name AS ingredient_name FROM new_name")(lambda s, d: source(s, d)["master"].select("ingredient_id", "ingredient_name"))
query("integrate_mapping", "SELECT name AS recipe_ingredient_name, id AS matched_fdc_id, food AS matched_food_name, CASE WHEN id IS NULL THEN 'skip' ELSE 'matched' END AS match_status, match_type FROM mapped2")(
    lambda s, d: source(s, d)["mapping"].select("recipe_ingredient_name", "matched_fdc_id", "matched_food_name", "match_status", "match_type")
)
query(
    "integration_stats",
    "SELECT (SELECT count(*) FROM new_recipe) AS recipes, count(*) AS ingredients_parsed, 0 AS ingredients_skipped, count(*) - (SELECT count(*) FROM new_name) AS master_reused, (SELECT count(*) FROM new_name) AS master_new, count(*) - (SELECT count(*) FROM mapped2) AS mapping_reused, (SELECT count(id) FROM mapped2) AS mapping_new_matched, (SELECT count(*) - count(id) FROM mapped2) AS mapping_new_no_match, count(grams2) AS has_grams, count(*) - count(grams2) AS no_grams FROM scraped_name",
)(lambda s, d: source(s, d)["stats"])


def guarded(s: SparkSession, d: str) -> DataFrame:
    """For sources that would start at some id: whether recipes have it, so that the source is refused."""
    have = table(s, d, "recipes").select("recipe_id")
    firsts = [3, 5, -1, 10**9]
    return s.createDataFrame([(i, dimensions.already_integrated(have, "recipe_id", i)) for i in firsts], "first_id long, refused boolean")


query("idempotency_guard", "SELECT CAST(i AS BIGINT) AS first_id, i IN (SELECT recipe_id FROM recipes) AS refused FROM (VALUES (3), (5), (-1), (1000000000)) AS x(i)")(guarded)

# ---------------------------------------------------------------- fixes


def mapping(s: SparkSession, d: str) -> DataFrame:
    """A mapping of every food: most are staged, with names in capitals."""
    return table(s, d, "food").selectExpr("ingredient_id", "upper(ingredient_name) AS name", "if(ingredient_id % 7 = 0, 'matched', 'skip') AS match_status", "if(ingredient_id % 5 = 0, 'by hand', 'scraped') AS notes", "CAST(NULL AS BIGINT) AS fdc_id", "CAST(NULL AS STRING) AS food", "'no_match' AS match_type")


THINGS = "anvil bolt gear gizmo plate ring rod widget".split()
NAMED = "SELECT ingredient_name AS name, min(fdc_id) AS fdc_id FROM food GROUP BY 1"
query("fix_staged", f"""SELECT ingredient_id, CASE WHEN NOT open THEN status WHEN rule IN ('proxy_fix', 'manual_fix') THEN 'matched' ELSE 'skip' END AS match_status, CASE WHEN open AND rule IS NOT NULL THEN rule ELSE 'no_match' END AS match_type, CASE WHEN open THEN found END AS fdc_id
FROM (SELECT f.ingredient_id, f.ingredient_id % 7 <> 0 AND f.ingredient_id % 5 <> 0 AS open, CASE WHEN f.ingredient_id % 7 = 0 THEN 'matched' ELSE 'skip' END AS status,
  CASE WHEN n.fdc_id % 4 = 0 THEN 'proxy_fix' WHEN n.fdc_id % 4 = 1 OR contains(n.name, 'blue') OR contains(n.name, 'ed') THEN 'manual_fix' WHEN n.name LIKE 'hot %' THEN 'negligible' WHEN n.name LIKE 'cold %' THEN 'artifact' END AS rule,
  CASE WHEN n.fdc_id % 4 IN (0, 1) THEN n.fdc_id WHEN contains(n.name, 'blue') THEN 1 WHEN contains(n.name, 'ed') THEN 2 END AS found
  FROM food f JOIN ({NAMED}) n ON n.name = f.ingredient_name)""")(
    lambda s, d: (
        lambda n: jobs.fix_staged(
            mapping(s, d),
            n.where("fdc_id % 4 = 0"),
            n.where("fdc_id % 4 = 1"),
            s.createDataFrame([(2, "ed", 2, "red"), (1, "blue", 1, "blue")], "priority int, keyword string, fdc_id long, food string"),
            [f"hot {x}" for x in THINGS],
            [f"cold {x}" for x in THINGS],
        ).select("ingredient_id", "match_status", "match_type", "fdc_id")
    )(table(s, d, "food").groupBy(F.col("ingredient_name").alias("name")).agg(F.min("fdc_id").alias("fdc_id"), F.min_by("description", "fdc_id").alias("food")))
)
STAGED = "SELECT ingredient_id, upper(ingredient_name) AS name, ingredient_id % 7 = 0 AS matched, CASE WHEN ingredient_id % 5 = 0 THEN 'by hand' ELSE 'scraped' END AS notes, ingredient_id % 7 <> 0 AND ingredient_id % 5 <> 0 AS open FROM food"
LIKED = fuzzy_sql(f"SELECT lower(name) AS name FROM ({STAGED}) WHERE open", "SELECT lower(description) AS key, min(fdc_id) AS ord FROM food GROUP BY 1", 65)
query("rematch_full", f"SELECT m.ingredient_id, m.name, CASE WHEN m.matched OR h.ord IS NOT NULL THEN 'matched' ELSE 'skip' END AS match_status, CASE WHEN h.ord IS NOT NULL THEN '{jobs.REMATCHED}' ELSE m.notes END AS notes, h.ord AS fdc_id, f.description AS food, CASE WHEN h.ord IS NOT NULL THEN concat('fuzzy_usda_', CAST(CAST(floor(similarity) AS INTEGER) AS VARCHAR), '%') ELSE 'no_match' END AS match_type FROM ({STAGED}) m LEFT JOIN ({LIKED}) h ON h.name = lower(m.name) AND m.open LEFT JOIN food f ON f.fdc_id = h.ord")(lambda s, d: jobs.rematch_full(mapping(s, d), table(s, d, "food")))


def resolved_names(s: SparkSession, d: str) -> DataFrame:
    """(name, fdc_id, match_type) of names as people misspell them, layer by layer over those that no layer before has found."""
    foods = table(s, d, "food")
    names = table(s, d, "part").selectExpr("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, 'x') WHEN 2 THEN concat(p_name, ' ', lower(p_type)) ELSE concat(p_brand, ' ', p_size) END AS name")
    keys = foods.groupBy(F.col("ingredient_name").alias("key")).agg(F.min("fdc_id").alias("fdc_id"), F.min_by("description", "fdc_id").alias("food"))
    both = two_languages(s, d)
    found = resolve.layers(
        names,
        [
            ("manual_match", lambda left: resolve.match_ladder(left, keys)),
            ("fuzzy", lambda left: resolve.match_fuzzy(left, keys.select("key", F.col("fdc_id").alias("ord")), 78.0).select("name", F.col("ord").alias("fdc_id"), F.lit("fuzzy").alias("match_type"))),
            ("usda_search", lambda left: resolve.search(left, foods)),
            ("wafct", lambda left: resolve.bilingual_search(left, both).select("name", F.substring("code", 4, 20).cast("long").alias("fdc_id"))),
        ],
    )
    return found.select("name", "fdc_id", "match_type")


query("resolve_every_layer")(resolved_names)
NEW_SERVINGS = "SELECT recipe_id, CASE WHEN recipe_id % 2 = 0 THEN 6 ELSE servings END AS servings FROM nutrition"
query("reanalyse", "SELECT o.recipe_id, o.servings, " + ", ".join(f"CASE WHEN n.recipe_id IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in jobs.SCORED) + f" FROM scores o LEFT JOIN ({recipes_sql(NEW_SERVINGS)}) n ON n.recipe_id = o.recipe_id AND o.recipe_id % 3 = 0")(
    lambda s, d: jobs.reanalyse(joined(s, d).where("recipe_id % 3 = 0").withColumn("servings", F.when(F.col("recipe_id") % 2 == 0, "6")), cut(scores(s, d)), reference(s, d), []).select("recipe_id", "servings", *jobs.SCORED)
)


def streamed(s: SparkSession, d: str) -> DataFrame:
    """Scores of recipes that come as files of a stream, some twice."""
    base = new_path(s, "stream")
    lists = joined(s, d).select("recipe_id", F.split(F.col("ingredients"), r" \| ").alias("ingredients"))
    new = table(s, d, "recipes").join(lists, "recipe_id").select(F.col("recipe_name").alias("name"), F.lit("west").alias("cuisine"), F.col("servings_expected").cast("string").alias("servings"), F.concat(F.lit("http://x.org/"), "recipe_id", F.lit("/")).alias("url"), "ingredients")
    new.write.json(f"{base}/in")
    new.where("hash(url) % 10 = 0").withColumn("url", F.upper("url")).write.mode("append").json(f"{base}/in")
    recipes.add_recipes(s, f"{base}/in", f"{base}/out", f"{base}/state", reference(s, d)).awaitTermination()
    url = recipes.committed(s, f"{base}/out", "recipes").select("recipe_id", F.regexp_extract(F.lower("recipe_url"), "([0-9]+)/$", 1).cast("long").alias("source_id"))
    return recipes.committed(s, f"{base}/out", "scores").join(url, "recipe_id").select("source_id", "servings", *jobs.SCORED, "coverage_tier")


query("add_recipes", "SELECT recipe_id AS source_id, servings, " + ", ".join(jobs.SCORED) + f", CASE WHEN ingredient_coverage_pct < 30 THEN 'warn' WHEN ingredient_coverage_pct < 60 THEN 'info' ELSE 'ok' END AS coverage_tier FROM ({recipes_sql('SELECT recipe_id, servings_expected AS servings FROM recipes')})")(streamed)


def reloaded(s: SparkSession, d: str) -> DataFrame:
    """Predictions of a model that was saved and read again."""
    df = cut(scores(s, d))
    path = new_path(s, "model")
    models.save(models.evaluated(df, models.logistic())[0], path)
    return models.predicted(models.saved(path), models.split(models.features(df), "label").where("not train"))


query("ml_save")(reloaded)
