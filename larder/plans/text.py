"""Lines, names, pages, densities, matching, analysis and models over the adapter's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import lines, similarity, text
from larder.operators import analysis, density, fuzzy, models, resolve, scoring
from larder.plans.adapter import table
from larder.plans.registry import SHARED, query
from larder.plans.relational import band_sql, level_sql, r, recipe_nutrition, scores, weighted_sql
from larder.sources import html, tables

SHARED["line"] = """SELECT i.recipe_id, i.ingredient_id, i.ingredient_index, i.unit, i.qty_expected, i.unit_grams, f.ingredient_name, f.description,
  concat_ws(' ', qty_text, nullif(unit, ''), ingredient_name) AS raw FROM recipe_ingredient i JOIN food f ON f.ingredient_id = i.ingredient_id"""
# A name that starts with a size, after no other unit, reads as a counted size of the rest.
SIZED = "unit = '' AND split_part(ingredient_name, ' ', 1) IN ('large', 'medium', 'small')"
SHARED["read"] = f"""SELECT *, CASE WHEN {SIZED} THEN split_part(ingredient_name, ' ', 1) ELSE unit END AS unit2,
  CASE WHEN {SIZED} THEN substr(ingredient_name, strpos(ingredient_name, ' ') + 1) ELSE ingredient_name END AS name2,
  CAST(qty_expected * CASE WHEN {SIZED} THEN CASE split_part(ingredient_name, ' ', 1) WHEN 'large' THEN 150 WHEN 'medium' THEN 110 ELSE 70 END ELSE unit_grams END AS DOUBLE) AS grams2 FROM line"""


def line(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "recipe_ingredient").join(table(s, d, "food").select("ingredient_id", "ingredient_name", "description"), "ingredient_id")
    return df.withColumn("raw", F.concat_ws(" ", "qty_text", F.nullif("unit", F.lit("")), "ingredient_name"))


def joined(s: SparkSession, d: str) -> DataFrame:
    """Each recipe's lines as one string, with a blank one in front."""
    return line(s, d).groupBy("recipe_id").agg(F.concat(F.lit(" | "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ingredient_index", "raw"))), lambda x: x.raw), " | ")).alias("ingredients"))


G = "CAST(qty_expected * unit_grams AS DOUBLE)"

# ---------------------------------------------------------------- lines

query("explode_lines", "SELECT recipe_id, ingredient_index, raw FROM line")(lambda s, d: lines.exploded(joined(s, d), "ingredients").select("recipe_id", "ingredient_index", "raw"))
query("unit_standardise", "SELECT recipe_id, ingredient_index, concat_ws(' ', regexp_extract(raw, '^[0-9/ ]*[0-9]'), CASE unit WHEN 'tsp' THEN 'teaspoon' WHEN 'tbsp' THEN 'tablespoon' ELSE nullif(unit, '') END, ingredient_name) AS line FROM line")(
    lambda s, d: line(s, d).select("recipe_id", "ingredient_index", text.standard_units("raw").alias("line"))
)
query("paren_measure", "SELECT recipe_id, ingredient_index, concat(CAST(ingredient_index AS STRING), ' g') AS actual_measure, raw AS standard_unit FROM line")(
    lambda s, d: line(s, d).withColumn("p", F.concat("raw", F.lit(" ("), F.col("ingredient_index").cast("string"), F.lit(" g)"))).select("recipe_id", "ingredient_index", text.paren_measure("p").alias("actual_measure"), text.without_parens("p").alias("standard_unit"))
)
query("measure_only", "SELECT recipe_id, ingredient_index, CASE WHEN unit IN ('cup', 'tbsp', 'tsp', 'cloves') THEN regexp_extract(raw, '^[0-9/ ]*[0-9]') || ' ' || unit END AS measure FROM line")(
    lambda s, d: line(s, d).select("recipe_id", "ingredient_index", text.measure_only("raw").alias("measure"))
)
query("extract_measures", "SELECT recipe_id, ingredient_index, grams2 AS grams_total, CASE WHEN unit IN ('cup', 'tbsp', 'tsp') THEN 'volume_unit' WHEN grams2 IS NOT NULL THEN 'count_estimate' ELSE 'no_match' END AS extraction_method FROM read")(
    lambda s, d: lines.extracted(line(s, d)).select("recipe_id", "ingredient_index", "grams_total", "extraction_method")
)
query("method_breakdown", "SELECT extraction_method, count(*) AS n, CAST(floor(count(*) * 100 / (SELECT count(*) FROM line)) AS INTEGER) AS pct FROM (SELECT CASE WHEN unit IN ('cup', 'tbsp', 'tsp') THEN 'volume_unit' WHEN grams2 IS NOT NULL THEN 'count_estimate' ELSE 'no_match' END AS extraction_method FROM read) GROUP BY 1")(
    lambda s, d: analysis.method_breakdown(lines.extracted(line(s, d)))
)
query("parse_lines_batch", "SELECT recipe_id, ingredient_index, CASE WHEN unit2 = '' AND qty_expected = 1.5 THEN '1' ELSE concat_ws(' ', regexp_extract(raw, '^[0-9/ ]*[0-9]'), nullif(unit2, '')) END AS measure_only, grams2 AS grams, CASE WHEN unit2 = '' AND qty_expected = 1.5 THEN concat('1/2 ', name2) ELSE name2 END AS remainder FROM read")(
    lambda s, d: lines.parsed_batch(line(s, d)).select("recipe_id", "ingredient_index", "measure_only", "grams", "remainder")
)
query("parse_lines_live", f"SELECT recipe_id, ingredient_index, CAST(qty_expected AS DOUBLE) AS qty, unit2 AS unit, coalesce(grams2, CAST(qty_expected * 150 AS DOUBLE)) AS grams, CASE WHEN unit IN ('cup', 'tbsp', 'tsp') THEN {G} END AS volume_ml, name2 AS name_raw FROM read")(
    lambda s, d: lines.parsed_live(line(s, d).drop("unit")).select("recipe_id", "ingredient_index", "qty", "unit", "grams", "volume_ml", "name_raw")
)
query("name_from_remainder", "SELECT recipe_id, ingredient_index, ingredient_name AS name FROM line")(
    lambda s, d: line(s, d).withColumn("x", F.when(F.col("ingredient_index") % 2 == 0, F.concat("ingredient_name", F.lit(" for frying, chopped"))).otherwise(F.concat("ingredient_name", F.lit("  to taste")))).select("recipe_id", "ingredient_index", text.remainder_name("x").alias("name"))
)
query("parse_servings", "SELECT recipe_id, servings_expected AS servings FROM recipes")(lambda s, d: table(s, d, "recipes").select("recipe_id", text.servings("servings_raw").alias("servings")))
query("parse_yield", "SELECT recipe_id, CASE servings_raw WHEN 'MAKES 4 TO 7 SERVINGS' THEN 4 WHEN '6 servings' THEN 6 WHEN '4 - 5' THEN 4 WHEN 'Makes a 900 g loaf' THEN 900 WHEN '99' THEN 99 WHEN '2' THEN 2 END AS servings FROM recipes")(
    lambda s, d: table(s, d, "recipes").select("recipe_id", text.yield_count("servings_raw").alias("servings"))
)
query("fallback_grams", "SELECT recipe_id, ingredient_index, CASE WHEN ingredient_index % 2 = 0 THEN CAST(ingredient_index * 10 AS DOUBLE) ELSE grams2 END AS grams FROM read")(
    lambda s, d: line(s, d).withColumn("actual", F.when(F.col("ingredient_index") % 2 == 0, F.concat((F.col("ingredient_index") * 10).cast("string"), F.lit(" ml")))).select("recipe_id", "ingredient_index", lines.fallback_grams("actual", "raw").alias("grams"))
)
query("clean_scraped_line", "SELECT recipe_id, ingredient_index, concat(CAST(ingredient_index * 20 AS STRING), ' g ', ingredient_name) AS cleaned FROM line")(
    lambda s, d: line(s, d).withColumn("x", F.concat((F.col("ingredient_index") * 20).cast("string"), F.when(F.col("ingredient_index") % 2 == 0, "g/4½oz <b>").otherwise("-900 g&nbsp; <i>"), F.col("ingredient_name"), F.lit("</b> "))).select("recipe_id", "ingredient_index", text.scraped_line("x").alias("cleaned"))
)
query("normalise_fractions", "SELECT recipe_id, ingredient_index, raw AS line FROM line")(
    lambda s, d: line(s, d).withColumn("x", F.regexp_replace(F.regexp_replace("raw", r"^1 1/2\b", "1½"), r"^1/2\b", "½")).select("recipe_id", "ingredient_index", text.glyphs_expanded("x").alias("line"))
)
query("fragment_filter", "SELECT fdc_id, p_brand AS name FROM (SELECT 2700000 + p_partkey AS fdc_id, left(p_brand, CAST(p_partkey % 3 AS INTEGER)) AS p_brand FROM part) WHERE length(p_brand) >= 2")(
    lambda s, d: table(s, d, "part").select((F.col("p_partkey") + 2700000).alias("fdc_id"), F.substring("p_brand", F.lit(1), (F.col("p_partkey") % 3).cast("int")).alias("name")).where("length(name) >= 2")
)
query("url_normalise", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '^https?://', ''), '^www\\.', '') AS url_key FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", text.url_key("url").alias("url_key")))
query("source_classify", "SELECT page_id, CASE WHEN strpos(lower(url), 'example.org') > 0 THEN 'org' WHEN strpos(lower(url), 'example.com') > 0 THEN 'com' ELSE 'other' END AS label FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", text.source_of("url", {"example.org": "org", "example.com": "com"}).alias("label"))
)
query("match_confidence", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'custom' WHEN 2 THEN 'medium' WHEN 3 THEN (CASE WHEN p_size + 50 >= 85 THEN 'medium' ELSE 'low' END) ELSE 'none' END AS bucket FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", text.confidence(F.expr("CASE p_partkey % 5 WHEN 0 THEN 'manual_match' WHEN 1 THEN 'user_override' WHEN 2 THEN 'wafct' WHEN 3 THEN concat('fuzzy_', p_size + 50, '%') ELSE 'no_match' END")).alias("bucket"))
)
query("base_ingredient", "SELECT DISTINCT ingredient_name AS name, array_to_string(list_filter(string_split(ingredient_name, ' '), lambda w: w <> 'fresh'), ' ') AS base FROM food")(
    lambda s, d: table(s, d, "food").select(F.col("ingredient_name").alias("name"), text.base_ingredient(F.concat(F.lit("2 cups freshly chopped "), "ingredient_name", F.lit("s (ripe), to taste"))).alias("base")).distinct()
)
query("form_and_key", None)(lambda s, d: table(s, d, "food").select("fdc_id", text.base_ingredient("description").alias("base"), text.form("description").alias("form"), text.lookup_key("description").alias("lookup")))
query("cooking_methods", "SELECT doc_id, coalesce(array_to_string(list_filter(['bake', 'blend', 'boil', 'braise', 'broil', 'deep fry', 'deep-fry', 'fry', 'grill', 'knead', 'marinate', 'microwave', 'poach', 'pressure cook', 'roast', 'saute', 'sauté', 'simmer', 'slow cook', 'smoke', 'steam', 'stew', 'stir-fry', 'toast'], lambda w: contains(lower(text), w)), ', '), '') AS methods FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", text.cooking_methods("text").alias("methods"))
)
query("src_text_lines", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where("trim(l) <> ''").groupBy("doc_id").agg(F.count("*").alias("n"))
)

# ---------------------------------------------------------------- sources

query("src_parquet_narrow", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25")(lambda s, d: table(s, d, "part").select("p_partkey", "p_name", "p_size").where("p_size > 25"))
query("nutrient_prefilter", "SELECT fdc_id, nutrient_id, CASE WHEN fdc_id % 4 = 0 THEN 0.0 ELSE CAST(amount AS DOUBLE) END AS amount FROM food_nutrient WHERE fdc_id % 5 <> 0")(
    lambda s, d: tables.nutrient_prefilter(table(s, d, "food_nutrient").select(F.when(F.col("fdc_id") % 5 != 0, F.col("fdc_id").cast("string")).otherwise("?").alias("fdc_id"), F.col("nutrient_id").cast("string").alias("nutrient_id"), F.when(F.col("fdc_id") % 4 != 0, F.col("amount").cast("string")).alias("amount")))
)
query("sitemap_urls", "SELECT DISTINCT url FROM pages WHERE contains(lower(url), '1') OR contains(lower(url), '7')")(
    lambda s, d: tables.sitemap_urls(table(s, d, "pages").select(F.concat(F.lit("<url><loc> "), "url", F.lit("</loc></url>")).alias("t")), "t", ["1", "7"])
)
query("wafct_clean", "SELECT concat('01_', CAST(p_partkey AS STRING)) AS code, p_name AS food_name_en, CAST(p_size AS DOUBLE) AS energy_kcal, CASE WHEN p_partkey % 3 = 0 THEN 0.0 WHEN p_partkey % 3 = 1 THEN 0.0 ELSE p_size + 0.5 END AS protein_g FROM part WHERE p_partkey % 7 <> 0")(
    lambda s, d: tables.food_table_clean(table(s, d, "part").select(F.expr("concat(if(p_partkey % 7 = 0, 'x', '01_'), p_partkey)").alias("code"), F.col("p_name").alias("food_name_en"), F.col("p_brand").alias("food_name_fr"), F.expr("concat('[', p_size, ']')").alias("energy_kcal"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'tr' WHEN 1 THEN '—' ELSE concat(p_size, ',5*') END").alias("protein_g"), *(F.lit("n.d.").alias(c) for c in ("fat_g", "carbohydrate_g", "sodium_mg")))).select("code", "food_name_en", "energy_kcal", "protein_g")
)

# ---------------------------------------------------------------- pages

PAGE = "concat('<html><script type=\"application/ld+json\">', CASE WHEN recipe_id % 4 = 0 THEN concat('{\"@graph\":[{\"@type\":\"WebPage\"},', node, ']}') WHEN recipe_id % 4 = 1 THEN concat('[', node, ']') WHEN recipe_id % 4 = 2 THEN node ELSE '{bad' END, '</script></html>')"


def recipe_pages(s: SparkSession, d: str) -> DataFrame:
    node = F.concat(F.lit('{"@type":["Recipe"],"name":"<b>Recipe</b> '), F.col("recipe_id").cast("string"), F.lit('","recipeYield":["'), (F.col("recipe_id") % 9).cast("string"), F.lit(' servings"],"recipeIngredient":["'), F.array_join(F.transform("l", lambda x: x.raw), '","'), F.lit('"]}'))
    df = line(s, d).groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("ingredient_index", "raw"))).alias("l"))
    return df.withColumn("node", node).select(F.col("recipe_id").cast("string").alias("url"), "recipe_id", F.expr(PAGE).alias("html"))


RECIPE_LINES = "SELECT recipe_id, string_agg(raw, '|' ORDER BY ingredient_index) AS ingredients FROM line GROUP BY recipe_id"
query("html_jsonld", f"SELECT CAST(recipe_id AS STRING) AS url, concat('Recipe ', CAST(recipe_id AS STRING)) AS title, ingredients, CAST(recipe_id % 9 AS INTEGER) AS servings FROM ({RECIPE_LINES}) WHERE recipe_id % 4 <> 3")(
    lambda s, d: html.jsonld(recipe_pages(s, d)).select("url", "title", F.array_join("ingredients", "|").alias("ingredients"), "servings")
)


def plugin_pages(s: SparkSession, d: str) -> DataFrame:
    own = lambda x: F.when(x.nested, F.concat(F.lit("<span><span>"), x.unit, F.lit("</span></span>"))).otherwise(x.unit)
    item = lambda x: F.concat(F.lit('<li class="wprm-recipe-ingredient" data-uid="1"><span class="wprm-recipe-ingredient-amount">'), x.qty_text, F.lit('</span> <span class="wprm-recipe-ingredient-unit">'), own(x), F.lit('</span> <span class="wprm-recipe-ingredient-name"><a href="/x">'), x.ingredient_name, F.lit("</a></span></li>"))
    df = line(s, d).groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("ingredient_index", "qty_text", "unit", "ingredient_name", (F.col("recipe_id") % 3 == 0).alias("nested")))).alias("l"))
    return df.select(F.col("recipe_id").cast("string").alias("url"), F.concat(F.lit("<ul>"), F.array_join(F.transform("l", item), "\n"), F.lit("</ul>")).alias("html"))


query("html_wprm", f"SELECT CAST(recipe_id AS STRING) AS url, ingredients FROM ({RECIPE_LINES})")(lambda s, d: html.wprm(plugin_pages(s, d)).select("url", F.array_join("ingredients", "|").alias("ingredients")))
query("html_microdata", f"SELECT CAST(recipe_id AS STRING) AS url, ingredients FROM ({RECIPE_LINES})")(
    lambda s, d: html.microdata(line(s, d).groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("ingredient_index", "raw"))).alias("l")).select(F.col("recipe_id").cast("string").alias("url"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("<li itemprop='ingredients'> "), x.raw, F.lit(" </li>"))), "").alias("html"))).select("url", F.array_join("ingredients", "|").alias("ingredients"))
)
query("html_strategy", f"SELECT CAST(recipe_id AS STRING) AS url, CASE WHEN recipe_id % 4 <> 3 THEN 'jsonld' ELSE 'no_recipe' END AS status FROM ({RECIPE_LINES})")(lambda s, d: html.best(recipe_pages(s, d)).select("url", "status"))
query("html_instructions", "SELECT recipe_id, concat('Wash ', recipe_name_clean, '. Serve.') AS steps FROM (SELECT o_orderkey AS recipe_id, CAST(o_custkey AS STRING) AS recipe_name_clean FROM orders)")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("recipe_id"), F.try_parse_json(F.concat(F.lit('{"recipeInstructions":[{"@type":"HowToSection","itemListElement":[{"text":"Wash '), F.col("o_custkey").cast("string"), F.lit('."}]},{"@type":"HowToStep","text":"Serve."}]}'))).alias("v")).select("recipe_id", html.instructions(F.col("v")).alias("steps"))
)
query("html_image_url", "SELECT page_id, concat(url, '/p.jpg') AS image FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "<meta property='og:image' content='").otherwise("<meta content='"), "url", F.lit("/p.jpg'"), F.when(F.col("page_id") % 2 == 0, ">").otherwise(" property='og:image'>")).alias("h")).select("page_id", html.image_url("h").alias("image"))
)
LINKED = "<a class='x' href='"


def linking_pages(s: SparkSession, d: str) -> DataFrame:
    """The given pages, each with links of an article, of a tag and of a listing before what it holds."""
    link = lambda tail: F.concat(F.lit(LINKED), F.lit("https://food.example/"), tail, F.lit("'>more</a>"))
    n = F.col("page_id").cast("string")
    return table(s, d, "pages").select("page_id", F.concat(link(F.concat((F.col("page_id") % 50).cast("string"), F.lit("/"))), link(F.concat(F.lit("tag/"), n)), link(F.concat(n, F.lit("/a/b"))), "html").alias("html"))


query(
    "html_links",
    "SELECT DISTINCT link FROM (SELECT concat('https://food.example/', CAST(page_id % 50 AS VARCHAR), '/') AS link FROM pages UNION ALL SELECT unnest(regexp_extract_all(html, '(?is)<a[^>]*href=[\"'']([^\"'']+)[\"'']', 1)) FROM pages) WHERE length(link) - length(replace(link, '/', '')) = 4 AND NOT regexp_matches(link, '/(category|tag|author|page)/')",
)(lambda s, d: html.links(linking_pages(s, d)))


def site_pages(s: SparkSession, d: str) -> DataFrame:
    """The given pages behind a structured list: parts that nest, an item without a unit, items that end where the next begins."""
    n = F.col("page_id").cast("string")
    item = lambda q, u, name: F.concat(F.lit('<li class="x mm-recipes-structured-ingredients__list-item"><p><span data-ingredient-quantity="true">'), q, F.lit("</span>"), u, F.lit('<span data-ingredient-name="true"><b>'), name, F.lit("</b> <i>fresh</i></span></p>"))
    unit = F.lit(' <span data-ingredient-unit="true">cup<span>s</span></span> ')
    block = F.concat(
        F.lit("<html><body><h1> Dish <b>"), n, F.lit("</b></h1><div data-ingredient-serving-size=''>"), ((F.col("page_id") % 9) + 1).cast("string"), F.lit("</div><ul>"),
        item(F.concat(n, F.lit("½")), unit, F.lit("rice &amp; peas")), item(F.lit("2"), F.lit(""), F.concat(F.lit("yam "), n)),
        F.lit("</ul><div class='mm-recipes-steps__content'><p>Wash.<p>Boil all of it for <b>"), n, F.lit("</b> minutes.</p></div><p>Not a step of this recipe at all.</p>"), "html",
    )
    return table(s, d, "pages").select("page_id", block.alias("html"))


query("html_site_list", "SELECT page_id, concat('Dish ', CAST(page_id AS VARCHAR)) AS title, CAST(page_id % 9 + 1 AS VARCHAR) AS servings, concat(CAST(page_id AS VARCHAR), ' 1/2 cup s rice & peas fresh|2 yam ', CAST(page_id AS VARCHAR), ' fresh') AS ingredients, concat('Boil all of it for ', CAST(page_id AS VARCHAR), ' minutes.') AS directions, 'boil' AS cooking_methods FROM pages")(
    lambda s, d: html.site_lists(site_pages(s, d), "page_id").withColumn("ingredients", F.array_join("ingredients", "|"))
)

# ---------------------------------------------------------------- densities

PORTION = "concat(CASE p_partkey % 4 WHEN 0 THEN '1 cup' WHEN 1 THEN '2 tablespoons' WHEN 2 THEN '1 1/2 cups, chopped' ELSE '1 slice' END)"
ML = "CASE p_partkey % 4 WHEN 0 THEN 240.0e0 WHEN 1 THEN 30.0e0 WHEN 2 THEN 360.0e0 END"


def portions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").selectExpr("2700000 + p_partkey % 500 AS fdc_id", f"{PORTION} AS portion_description", "CAST(p_size * 10 AS DOUBLE) AS gram_weight", "p_partkey AS ord")


DENSITY = f"SELECT fdc_id, CAST(round(CAST(g AS DECIMAL(20,8)), 4) AS DOUBLE) AS g_per_ml, source_portion FROM (SELECT *, row_number() OVER (PARTITION BY fdc_id ORDER BY rank, ord) AS n FROM (SELECT 2700000 + p_partkey % 500 AS fdc_id, {PORTION} AS source_portion, p_size * 10 / ({ML}) AS g, p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS rank FROM part) WHERE g BETWEEN 0.1 AND 2.0) WHERE n = 1"
query("density_build", DENSITY)(lambda s, d: density.build(portions(s, d)))
query("best_portion", f"SELECT fdc_id, source_portion FROM ({DENSITY})")(lambda s, d: density.build(portions(s, d)).select("fdc_id", "source_portion"))
query("density_summary", f"SELECT count(*) AS n, median(g_per_ml) AS mid, min(g_per_ml) AS low, max(g_per_ml) AS high FROM ({DENSITY})")(
    lambda s, d: density.build(portions(s, d)).agg(F.count("*").alias("n"), F.median("g_per_ml").alias("mid"), F.min("g_per_ml").alias("low"), F.max("g_per_ml").alias("high"))
)
SHARED["density"] = DENSITY
FOOD_DENSITY = "SELECT f.fdc_id, coalesce(p.g_per_ml, CASE " + " ".join(f"WHEN regexp_matches(lower(f.description), '{'|'.join(w.split())}') THEN CAST({v} AS DOUBLE)" for w, v in density.CATEGORIES) + " ELSE 1.0 END) AS density FROM food f LEFT JOIN density p ON p.fdc_id = f.fdc_id"
query("density_resolve", FOOD_DENSITY)(lambda s, d: density.resolve(table(s, d, "food"), density.build(portions(s, d)), "description").select("fdc_id", "density"))
query("volume_to_grams", f"SELECT l.recipe_id, l.ingredient_index, CASE WHEN unit IN ('cup', 'tbsp', 'tsp') THEN CAST(round(CAST({G} * v.density AS DECIMAL(20,8)), 1) AS DOUBLE) ELSE coalesce(grams2, CAST(qty_expected * 150 AS DOUBLE)) END AS grams FROM read l JOIN food f ON f.ingredient_id = l.ingredient_id JOIN ({FOOD_DENSITY}) v ON v.fdc_id = f.fdc_id")(
    lambda s, d: (
        lambda v: lines.parsed_live(line(s, d).drop("unit")).join(table(s, d, "food").select("ingredient_id", "fdc_id"), "ingredient_id").join(v, "fdc_id").select("recipe_id", "ingredient_index", density.grams("volume_ml", "density", "grams").alias("grams"))
    )(density.resolve(table(s, d, "food"), density.build(portions(s, d)), "description").select("fdc_id", "density"))
)

# ---------------------------------------------------------------- matching


def food_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "food").select(F.col("ingredient_name").alias("name")).distinct()


def curated(s: SparkSession, d: str) -> DataFrame:
    """A curated list: one food a name, for the names of every other food."""
    return table(s, d, "food").where("ingredient_id % 2 = 0").groupBy(F.col("ingredient_name").alias("key")).agg(F.min("fdc_id").alias("fdc_id"), F.min_by("description", "fdc_id").alias("food"))


CURATED = "SELECT ingredient_name AS key, min(fdc_id) AS fdc_id FROM food WHERE ingredient_id % 2 = 0 GROUP BY 1"
query("reference_pool", "SELECT DISTINCT m.fdc_id, f.description FROM ingredient_mapping m JOIN food f ON f.fdc_id = m.fdc_id")(
    lambda s, d: table(s, d, "ingredient_mapping").join(table(s, d, "food").select("fdc_id", "description"), "fdc_id").select("fdc_id", "description").dropna().distinct()
)
query("match_ladder", f"SELECT n.name, c.fdc_id FROM (SELECT DISTINCT ingredient_name AS name FROM food) n JOIN ({CURATED}) c ON c.key = n.name")(
    lambda s, d: resolve.match_ladder(food_names(s, d).select(F.concat("name", F.lit("s")).alias("name")), curated(s, d)).select(F.regexp_replace("name", "s$", "").alias("name"), "fdc_id")
)


def ratio_sql(a: str, b: str) -> str:
    """Indel similarity of two expressions of up to 62 characters, by the recurrence on bits."""
    mask = f"CAST(coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, CAST(i AS INTEGER) + 1, 1) = c THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)), 0) AS BIGINT)"
    full = f"((CAST(1 AS BIGINT) << CAST(length({a}) AS INTEGER)) - 1)"
    state = f"list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask})), lambda s, m: ((s + (s & m)) | (s & ~m)) & {full})"
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100e0 ELSE 200e0 * (length({a}) - bit_count({state})) / (length({a}) + length({b})) END)"


def sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')), ' ')"


def fuzzy_sql(names: str, keys: str, threshold: float) -> str:
    """(name, key, ord, similarity) of the best key, from queries of names (name) and keys (key, ord)."""
    scored = f"SELECT name, key, ord, {ratio_sql('x', 'y')} AS similarity FROM (SELECT DISTINCT name, {sorted_sql('name')} AS x FROM ({names})) n, (SELECT key, ord, {sorted_sql('key')} AS y FROM ({keys})) k WHERE x <> '' AND y <> ''"
    return f"SELECT * FROM ({scored}) WHERE similarity >= {threshold} QUALIFY row_number() OVER (PARTITION BY name ORDER BY similarity DESC, ord, key) = 1"


PERCENT = "concat('fuzzy_', CAST(CAST(floor(similarity) AS INTEGER) AS VARCHAR), '%')"
NAMES = "SELECT DISTINCT ingredient_name AS name FROM food"
query("match_fuzzy_keys", f"SELECT *, {PERCENT} AS match_type FROM ({fuzzy_sql("SELECT DISTINCT concat(ingredient_name, 'x') AS name FROM food", f"SELECT key, fdc_id AS ord FROM ({CURATED})", 78)})")(
    lambda s, d: resolve.match_fuzzy(food_names(s, d).select(F.concat("name", F.lit("x")).alias("name")), curated(s, d).select("key", F.col("fdc_id").alias("ord")), 78.0)
)
query("match_fuzzy_foods", f"SELECT *, {PERCENT} AS match_type FROM ({fuzzy_sql(NAMES, 'SELECT lower(description) AS key, min(fdc_id) AS ord FROM food GROUP BY 1', 70)})")(
    lambda s, d: resolve.match_fuzzy(food_names(s, d), table(s, d, "food").groupBy(F.lower("description").alias("key")).agg(F.min("fdc_id").alias("ord")), 70.0)
)
query("sim_token_sort", f"SELECT * FROM (SELECT a.name, b.name AS other, {ratio_sql('a.t', 'b.t')} AS similarity FROM (SELECT name, {sorted_sql('name')} AS t FROM ({NAMES})) a, (SELECT name, {sorted_sql('name')} AS t FROM ({NAMES})) b) WHERE similarity >= 60")(
    lambda s, d: (lambda n: fuzzy.similar(n, n.select(F.col("name").alias("key")), 60.0).withColumnRenamed("key", "other"))(food_names(s, d))
)


def partial_sql(a: str, b: str) -> str:
    """The best window of b, which is no shorter than a."""
    at = f"substr({b}, CAST(j AS INTEGER), length({a}))"
    return f"(CASE WHEN length({a}) = 0 THEN CASE WHEN length({b}) = 0 THEN 100e0 ELSE 0e0 END ELSE list_max(list_transform(range(1, length({b}) - length({a}) + 2), lambda j: {ratio_sql(a, at)})) END)"


def window_sql(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) <= length({b}) THEN {partial_sql(a, b)} ELSE {partial_sql(b, a)} END)"


query("sim_partial", f"SELECT ingredient_name, description, {window_sql('ingredient_name', 'description')} AS similarity FROM (SELECT DISTINCT ingredient_name, description FROM food)")(
    lambda s, d: table(s, d, "food").select("ingredient_name", "description").distinct().select("ingredient_name", "description", similarity.partial_ratio("ingredient_name", "description").alias("similarity"))
)
TOKENS = "regexp_split_to_array(lower(description), '[\\s,;/]+')"
query("token_index_build", f"SELECT DISTINCT fdc_id, token FROM (SELECT fdc_id, token FROM (SELECT fdc_id, unnest({TOKENS}) AS token FROM food) WHERE length(token) > 2 UNION ALL SELECT fdc_id, left(token, length(token) - 1) FROM (SELECT fdc_id, unnest({TOKENS}) AS token FROM food) WHERE length(token) > 3 AND token LIKE '%s')")(
    lambda s, d: resolve.token_index(table(s, d, "food"))
)


def search_sql(names: str, n: int, threshold: float | None, partial: bool = False) -> str:
    """resolve.search over a query of names (name); words of the given tables have no plurals."""
    raw, plain, dish, per_char = (15, 8, 15, 0.2) if partial else (20, 10, 20, 0.4)
    sim = window_sql("q", "d") if partial else ratio_sql(sorted_sql("q"), sorted_sql("d"))
    dishes = ", ".join(f"'{w}'" for w in resolve.DISHES)
    pairs = f"""SELECT name, lower(trim(name)) AS q, fdc_id, description, lower(description) AS d
    FROM (SELECT DISTINCT name FROM ({names})) x, (SELECT description, min(fdc_id) AS fdc_id FROM food GROUP BY 1) f
    WHERE list_has_any(string_split_regex(lower(trim(name)), '\\s+'), list_filter(regexp_split_to_array(lower(description), '[\\s,;/]+'), lambda t: length(t) > 2))"""
    dished = f"len(list_filter([{dishes}], lambda w: contains(d, w) AND NOT list_contains(string_split_regex(q, '\\s+'), w))) > 0"
    score = f"similarity + CASE WHEN contains(d, ', raw') THEN {raw}e0 WHEN d LIKE '%nfs' OR contains(d, ', nfs') THEN {plain}e0 ELSE 0e0 END - CASE WHEN {dished} THEN {dish}e0 ELSE 0e0 END - length(d) * {per_char}e0"
    scored = f"SELECT name, fdc_id, description, {score} AS score FROM (SELECT *, {sim} AS similarity FROM ({pairs})) WHERE {'true' if threshold is None else f'similarity >= {threshold}'}"
    return f"SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, fdc_id) AS INTEGER) AS place, fdc_id, description, score FROM ({scored}) QUALIFY place <= {n}"


query("food_search_top1", search_sql(NAMES, 1, 60))(lambda s, d: resolve.search(food_names(s, d), table(s, d, "food")))
query("food_search_topn", search_sql(NAMES, 8, None, True))(lambda s, d: resolve.search(food_names(s, d), table(s, d, "food"), 8, None, partial=True))


def two_languages(s: SparkSession, d: str) -> DataFrame:
    """Foods by English description and brand, the brand standing for the other language, with nutrients of their own; no gizmos."""
    per = [f"CAST((p_partkey * {k}) % {40 + k} AS DOUBLE) AS {n}" for k, n in enumerate(scoring.NUTRIENTS.values(), 3)]
    return table(s, d, "part").where("not contains(p_name, 'gizmo')").selectExpr("concat('01_', p_partkey) AS code", "p_partkey AS ord", "concat(p_name, ', ', lower(p_type)) AS name_en", "lower(p_brand) AS name_fr", *per)


SHARED["other_food"] = "SELECT concat('01_', CAST(p_partkey AS VARCHAR)) AS code, p_partkey AS ord, concat(p_name, ', ', lower(p_type)) AS name_en, lower(p_brand) AS name_fr, " + ", ".join(f"CAST((p_partkey * {k}) % {40 + k} AS DOUBLE) AS {n}" for k, n in enumerate(scoring.NUTRIENTS.values(), 3)) + " FROM part WHERE NOT contains(p_name, 'gizmo')"


def bilingual_sql(names: str) -> str:
    asked = "list_filter(string_split_regex(q, '\\s+'), lambda t: length(t) > 2)"
    # Rows of equal names score alike and the first counts, so each pair of names is scored once.
    pairs = f"""SELECT name, lower(trim(name)) AS q, code, ord, name_en, lower(name_en) AS en, name_fr AS fr
    FROM (SELECT DISTINCT name FROM ({names})) x, (SELECT arg_min(code, ord) AS code, min(ord) AS ord, name_en, name_fr FROM other_food GROUP BY name_en, name_fr) f
    WHERE list_has_any(list_filter(string_split_regex(lower(trim(name)), '\\s+'), lambda t: length(t) > 2), regexp_split_to_array(concat(lower(name_en), ' ', name_fr), '[\\s,;/()\\-]+'))"""
    scored = f"SELECT *, greatest({window_sql('q', 'en')}, CASE WHEN fr <> '' THEN {window_sql('q', 'fr')} ELSE 0e0 END) AS s FROM ({pairs})"
    score = f"s + CASE WHEN len(list_filter({asked}, lambda t: NOT contains(en, t) AND NOT contains(fr, t))) = 0 THEN 15e0 ELSE 0e0 END + CASE WHEN regexp_matches(en, 'raw|dried|flour|fresh|boiled') THEN 10e0 ELSE 0e0 END - CASE WHEN length(name_en) > 60 THEN 5e0 ELSE 0e0 END"
    return f"SELECT name, code, name_en AS food, score FROM (SELECT *, {score} AS score FROM ({scored}) WHERE s >= 55) QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, ord) = 1"


query("bilingual_search", bilingual_sql(NAMES))(lambda s, d: resolve.bilingual_search(food_names(s, d), two_languages(s, d)))
query("food_describe", "SELECT m.ingredient_id, f.description FROM ingredient_mapping m JOIN food f ON f.fdc_id = m.fdc_id")(lambda s, d: table(s, d, "ingredient_mapping").join(table(s, d, "food").select("fdc_id", "description"), "fdc_id").select("ingredient_id", "description"))
RULES = [(1, "almond", "nuts"), (2, "a", "starts of many"), (3, "blue", "never reached"), (4, "z", "rare")]
query("fix_keyword_rules", "SELECT name, CASE WHEN contains(name, 'almond') THEN 'almond' WHEN contains(name, 'a') THEN 'a' WHEN contains(name, 'blue') THEN 'blue' WHEN contains(name, 'z') THEN 'z' END AS keyword FROM (SELECT DISTINCT ingredient_name AS name FROM food)")(
    lambda s, d: resolve.first_rule(food_names(s, d), s.createDataFrame(RULES, "priority int, keyword string, food string")).select("name", "keyword")
)
query("join_contains", "SELECT count(*) AS hits FROM (SELECT DISTINCT ingredient_name AS name FROM food) n JOIN (VALUES ('almond'), ('a'), ('blue'), ('z')) AS k(k) ON contains(n.name, k.k)")(
    lambda s, d: (lambda k: food_names(s, d).join(F.broadcast(k), F.col("name").contains(F.col("keyword"))).agg(F.count("*").alias("hits")))(s.createDataFrame(RULES, "priority int, keyword string, food string"))
)
query("fix_proxies", "SELECT fdc_id, CASE WHEN fdc_id % 4 = 0 THEN 'african_proxy' ELSE 'other' END AS status, CASE WHEN fdc_id % 4 = 0 THEN coalesce(p.to_id, fdc_id) ELSE fdc_id END AS new_id FROM food LEFT JOIN (SELECT fdc_id AS from_id, min(fdc_id) + 1000000 AS to_id FROM food WHERE fdc_id % 8 = 0 GROUP BY fdc_id) p ON p.from_id = food.fdc_id")(
    lambda s, d: analysis.fixed(
        table(s, d, "food").select("fdc_id", F.when(F.col("fdc_id") % 4 == 0, "african_proxy").otherwise("other").alias("status"), F.col("fdc_id").alias("new_id")), table(s, d, "food").where("fdc_id % 8 = 0").select("fdc_id", (F.col("fdc_id") + 1_000_000).alias("new_id")), "fdc_id", F.col("status") == "african_proxy"
    )
)
query("build_mapping", "SELECT f.fdc_id, CASE WHEN m.fdc_id IS NOT NULL THEN 'matched' WHEN f.fdc_id % 2 = 0 THEN 'african_proxy' WHEN f.fdc_id % 3 = 0 THEN 'skip' ELSE 'still_unmatched' END AS match_status FROM food f LEFT JOIN ingredient_mapping m ON m.fdc_id = f.fdc_id")(
    lambda s, d: table(s, d, "food").join(table(s, d, "ingredient_mapping").select("fdc_id", F.lit(True).alias("hit")), "fdc_id", "left").select("fdc_id", analysis.mapping_status(F.col("hit"), F.col("fdc_id") % 2 == 0, F.col("fdc_id") % 3 == 0).alias("match_status"))
)

query("clean_ingredient", "SELECT DISTINCT name, CASE WHEN k = 0 THEN concat('proxy of ', ingredient_name) ELSE ingredient_name END AS cleaned, CASE WHEN k = 0 THEN 'african_proxy' ELSE 'cleaned' END AS tag, ingredient_name AS display FROM (SELECT ingredient_name, x.k, CASE x.k WHEN 0 THEN concat('ACME ', ingredient_name) WHEN 1 THEN concat('acme the coarsely ', ingredient_name, ' .') ELSE concat('(', ingredient_name, ')') END AS name FROM food, (VALUES (0), (1), (2)) AS x(k))")(
    lambda s, d: resolve.clean_names(
        food_names(s, d).select(F.explode(F.array(F.concat(F.lit("ACME "), "name"), F.concat(F.lit("acme the coarsely "), "name", F.lit(" .")), F.concat(F.lit("("), "name", F.lit(")")))).alias("name")),
        food_names(s, d).select(F.col("name").alias("local"), F.concat(F.lit("proxy of "), "name").alias("proxy"), F.col("name").alias("display")),
        ["acme"],
        [r"\bcoarsely\b", r"\bthe\b"],
    )
)
query("proxy_dimension", "SELECT DISTINCT p_name AS local, CASE WHEN strpos(p_name, 'red') > 0 THEN 'North' ELSE 'Africa' END AS region FROM part")(
    lambda s, d: (lambda n: resolve.proxy_dimension(n, n.where("contains(local, 'red')").distinct().withColumn("region", F.lit("North"))))(table(s, d, "part").select(F.col("p_name").alias("local"))).select("local", "region")
)
query("fix_bad_matches", "SELECT fdc_id, CASE WHEN fdc_id % 8 = 0 THEN 'corrected' ELSE description END AS description FROM food")(
    lambda s, d: analysis.fixed(table(s, d, "food").select("fdc_id", "description"), table(s, d, "food").where("fdc_id % 8 = 0").select("fdc_id", F.lit("corrected").alias("description")), "fdc_id", F.lit(True))
)

# ---------------------------------------------------------------- analysis of recipes



def reference(s: SparkSession, d: str) -> analysis.Reference:
    """Each layer has names of its own: blue and new ones are curated, red ones curated but misspelt, old ones stand for new ones, others are
    searched, and single words, to which cold ones are cleaned, are in the list of two languages alone, which has no gizmos."""
    foods = table(s, d, "food").select("fdc_id", "ingredient_name", "description")
    first, rest = F.split_part("ingredient_name", F.lit(" "), F.lit(1)), F.split_part("ingredient_name", F.lit(" "), F.lit(2))
    keys = foods.where(first.isin("blue", "new", "red")).groupBy(F.when(first == "red", F.concat(F.lit("redd "), rest)).otherwise(F.col("ingredient_name")).alias("key")).agg(F.min("fdc_id").alias("fdc_id"), F.min_by("description", "fdc_id").alias("food"))
    proxies = foods.where(first == "old").select(F.col("ingredient_name").alias("local"), F.concat(F.lit("new "), rest).alias("proxy"), F.col("ingredient_name").alias("display")).distinct()
    pool = table(s, d, "ingredient_mapping").join(foods, "fdc_id").select("fdc_id", "description")
    return analysis.Reference(keys, pool, foods, analysis.per_100g(table(s, d, "food_nutrient")), density.build(portions(s, d)), two_languages(s, d), proxies, [], [r"\bcold\b"])


SHARED["asked"] = "SELECT DISTINCT name2 AS name, CASE WHEN name2 LIKE 'old %' THEN concat('new ', substr(name2, 5)) WHEN name2 LIKE 'cold %' THEN substr(name2, 6) ELSE name2 END AS cleaned FROM read"
SHARED["curated_key"] = "SELECT CASE WHEN ingredient_name LIKE 'red %' THEN concat('redd ', substr(ingredient_name, 5)) ELSE ingredient_name END AS key, min(fdc_id) AS fdc_id, arg_min(description, fdc_id) AS food FROM food WHERE split_part(ingredient_name, ' ', 1) IN ('blue', 'new', 'red') GROUP BY 1"
SHARED["layer1"] = "SELECT DISTINCT cleaned AS name, fdc_id, food, 'manual_match' AS match_type FROM asked JOIN curated_key ON key = cleaned"
LEFT = "SELECT DISTINCT cleaned AS name FROM asked WHERE cleaned NOT IN (SELECT name FROM layer{})"
SHARED["layer2"] = f"SELECT * FROM layer1 UNION ALL SELECT f.name, f.ord, k.food, {PERCENT} FROM ({fuzzy_sql(LEFT.format(1), 'SELECT key, fdc_id AS ord FROM curated_key', 78)}) f JOIN curated_key k ON k.key = f.key"
SHARED["layer3"] = f"SELECT * FROM layer2 UNION ALL SELECT f.name, f.ord, k.description, {PERCENT} FROM ({fuzzy_sql(LEFT.format(2), 'SELECT lower(f.description) AS key, min(f.fdc_id) AS ord FROM food f JOIN ingredient_mapping m ON m.fdc_id = f.fdc_id GROUP BY 1', 70)}) f JOIN food k ON k.fdc_id = f.ord"
SHARED["layer4"] = f"SELECT * FROM layer3 UNION ALL SELECT name, fdc_id, description, 'usda_search' FROM ({search_sql(LEFT.format(3), 1, 60)})"
SHARED["layer5"] = f"SELECT name, fdc_id, CAST(NULL AS VARCHAR) AS code, food, match_type FROM layer4 UNION ALL SELECT name, NULL, code, food, 'wafct' FROM ({bilingual_sql(LEFT.format(4))})"
SHARED["late"] = f"SELECT * FROM ({bilingual_sql('SELECT name FROM asked WHERE name <> cleaned AND cleaned NOT IN (SELECT name FROM layer5)')})"
SHARED["resolved_name"] = "SELECT a.name, a.cleaned, l.fdc_id, coalesce(l.code, w.code) AS code, coalesce(l.food, w.food) AS food, CASE WHEN w.code IS NOT NULL THEN 'wafct' ELSE coalesce(l.match_type, 'no_match') END AS match_type FROM asked a LEFT JOIN layer5 l ON l.name = a.cleaned LEFT JOIN late w ON w.name = a.name"
query("resolve_layers", "SELECT * FROM resolved_name")(lambda s, d: analysis.resolved_names(lines.parsed_live(line(s, d).select("raw").distinct()).select(F.col("name_raw").alias("name")), reference(s, d)))

CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(cleaned), '{'|'.join(w.split())}') THEN {v}e0" for w, v in density.CATEGORIES) + " ELSE 1e0 END"
SHARED["chosen"] = "SELECT l.*, n.cleaned, n.fdc_id, n.code, n.food, n.match_type FROM read l JOIN resolved_name n ON n.name = l.name2"


def analysed_sql(chosen: str) -> str:
    """Lines by what was chosen for each: a table of the columns of ``chosen``."""
    volume = "unit IN ('cup', 'tbsp', 'tsp')"
    per = [f"CASE WHEN status = 'matched' THEN CAST(grams * coalesce(CASE WHEN code IS NOT NULL THEN o_{n} ELSE CAST(w_{n} AS DOUBLE) END, 0e0) / 100 AS DECIMAL(20,6)) END AS {n}" for n in scoring.NUTRIENTS.values()]
    names = ", ".join(f"w.{n} AS w_{n}, o.{n} AS o_{n}" for n in scoring.NUTRIENTS.values())
    grams = f"CASE WHEN {volume} THEN CAST(round(CAST(CAST(qty_expected * unit_grams AS DOUBLE) * coalesce(p.g_per_ml, {CATEGORY}) AS DECIMAL(20,8)), 1) AS DOUBLE) ELSE coalesce(grams2, CAST(qty_expected * 150 AS DOUBLE)) END"
    status = "CASE WHEN coalesce(grams, 0) = 0 THEN 'no_grams' WHEN fdc_id IS NULL AND code IS NULL THEN 'no_usda_match' WHEN code IS NULL AND w_fdc IS NULL THEN 'no_usda_data' ELSE 'matched' END"
    confidence = "CASE WHEN match_type = 'manual_match' THEN 'high' WHEN match_type = 'user_override' THEN 'custom' WHEN match_type IN ('usda_search', 'wafct') THEN 'medium' WHEN match_type LIKE 'fuzzy%' THEN CASE WHEN CAST(regexp_extract(match_type, '[0-9]+') AS INTEGER) >= 85 THEN 'medium' ELSE 'low' END ELSE 'none' END"
    return f"""SELECT recipe_id, ingredient_index, raw, CAST(qty_expected AS DOUBLE) AS qty, unit2 AS unit, name2 AS name_raw, cleaned, fdc_id, code, food, match_type, {confidence} AS confidence, grams, status, {", ".join(per)}
    FROM (SELECT *, {status} AS status FROM (SELECT c.*, {grams} AS grams, w.fdc_id AS w_fdc, {names} FROM ({chosen}) c LEFT JOIN density p ON p.fdc_id = c.fdc_id LEFT JOIN wide w ON w.fdc_id = c.fdc_id LEFT JOIN other_food o ON o.code = c.code))"""


def recipes_sql(servings: str) -> str:
    """Scores of recipes from the table ``analysed`` and a query of (recipe_id, servings)."""
    sums = ", ".join(r(f"CAST(coalesce(sum({n}), 0) AS DOUBLE) / any_value(greatest(coalesce(s.servings, 1), 1))") + f" AS {n}" for n in scoring.NUTRIENTS.values())
    total = f"SELECT a.recipe_id, any_value(greatest(coalesce(s.servings, 1), 1)) AS servings, count(*) AS ingredients_total, count(CASE WHEN status = 'matched' THEN 1 END) AS ingredients_used, {sums} FROM analysed a LEFT JOIN ({servings}) s ON s.recipe_id = a.recipe_id GROUP BY a.recipe_id"
    bands = ", ".join(f"CASE WHEN energy_kcal > 0 THEN {band_sql(n)} END AS {risk}" for n, risk in scoring.RISKS.items())
    flags = " + ".join(f"(CASE WHEN {x} = 'high' THEN 1 ELSE 0 END)" for x in scoring.RISKS.values())
    banded = f"SELECT *, {bands}, CASE WHEN ingredients_total > 0 THEN {r('CAST(ingredients_used AS DOUBLE) * 100 / ingredients_total')} ELSE 0.0 END AS ingredient_coverage_pct, CASE WHEN energy_kcal > 0 THEN {weighted_sql()} END AS weighted_risk_score, CASE WHEN energy_kcal > 0 THEN 'calculated' ELSE 'insufficient_data' END AS data_status FROM ({total})"
    return f"SELECT *, CASE WHEN flag_count = 0 THEN 'Low' WHEN flag_count <= 2 THEN 'Medium' WHEN flag_count IS NOT NULL THEN 'High' END AS flag_risk_level, {level_sql('weighted_risk_score')} AS weighted_risk_level FROM (SELECT *, CASE WHEN data_status = 'calculated' THEN CAST({flags} AS INTEGER) END AS flag_count FROM ({banded}))"


def asked_lines(s: SparkSession, d: str) -> DataFrame:
    return line(s, d).select("recipe_id", "ingredient_index", "raw")


SHARED["analysed"] = analysed_sql("SELECT * FROM chosen")
query("analyse_lines", "SELECT * FROM analysed")(lambda s, d: analysis.analyse_lines(asked_lines(s, d), reference(s, d)))
query("analyse_overrides", analysed_sql("SELECT * REPLACE (CASE WHEN ingredient_index = 1 THEN 2700001 ELSE fdc_id END AS fdc_id, CASE WHEN ingredient_index = 1 THEN NULL ELSE code END AS code, CASE WHEN ingredient_index = 1 THEN (SELECT description FROM food WHERE fdc_id = 2700001) ELSE food END AS food, CASE WHEN ingredient_index = 1 THEN 'user_override' ELSE match_type END AS match_type) FROM chosen"))(
    lambda s, d: (lambda x: analysis.analyse_lines(x, reference(s, d), x.where("ingredient_index = 1").select("recipe_id", "ingredient_index", F.lit(2700001).cast("long").alias("fdc_id"))))(asked_lines(s, d))
)
query("analyse_recipes", recipes_sql("SELECT recipe_id, servings_expected AS servings FROM recipes"))(lambda s, d: analysis.analyse_recipes(asked_lines(s, d), reference(s, d), table(s, d, "recipes").select("recipe_id", F.col("servings_expected").alias("servings"))))
query("review_queue", None)(lambda s, d: analysis.review_queue(line(s, d).select("recipe_id", "ingredient_index", F.concat("raw", F.when(F.col("ingredient_index") % 3 == 0, " and seasoning mix").otherwise("")).alias("raw"))))

# ---------------------------------------------------------------- models

query("ml_merge_classes", "SELECT recipe_id, CASE WHEN weighted_risk_level IN ('High', 'Very High') THEN 'Elevated' ELSE weighted_risk_level END AS label FROM scores WHERE data_status = 'calculated'")(lambda s, d: models.merged(scores(s, d)).select("recipe_id", "label"))
query("ml_stratified_split", "SELECT recipe_id, rn <= CAST(round(0.8e0 * n) AS BIGINT) AS train FROM (SELECT recipe_id, row_number() OVER (PARTITION BY weighted_risk_level ORDER BY md5(concat(CAST(recipe_id AS STRING), '-42')), recipe_id) AS rn, count(*) OVER (PARTITION BY weighted_risk_level) AS n FROM scores WHERE data_status = 'calculated')")(
    lambda s, d: models.split(scores(s, d).where("data_status = 'calculated'"), "weighted_risk_level").select("recipe_id", "train")
)
query("ml_class_weights", "SELECT weighted_risk_level AS label, CAST(round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS DOUBLE) AS weight FROM scores WHERE data_status = 'calculated' GROUP BY 1")(
    lambda s, d: models.class_weights(scores(s, d).where("data_status = 'calculated'").withColumn("label", F.col("weighted_risk_level"))).select("label", F.round("weight", 6).alias("weight"))
)
query("ml_features", "SELECT recipe_id, " + ", ".join([*scoring.NUTRIENTS.values(), "ingredient_coverage_pct"]) + " FROM scores WHERE data_status = 'calculated'")(lambda s, d: models.features(scores(s, d)).select("recipe_id", *models.FEATURES))
query("ml_logreg", None)(lambda s, d: models.evaluated(scores(s, d), models.logistic())[1])
query("ml_forest", None)(lambda s, d: models.evaluated(models.merged(scores(s, d)), models.forest())[1])
query("ml_coefficients", None)(lambda s, d: models.coefficients(models.evaluated(scores(s, d), models.logistic())[0]))
query("ml_importance", None)(lambda s, d: models.importances(models.evaluated(models.merged(scores(s, d)), models.forest())[0]))
#: Small trees, so that thirty sets over five folds take a minute or two and not hours; models.GRID is the surveyed grid.
SMALL_GRID = {"numTrees": [2, 4, 6], "maxDepth": [2, 4], "featureSubsetStrategy": ["sqrt", "log2"], "minInstancesPerNode": [1, 2, 4]}
query("ml_random_search", None)(lambda s, d: models.random_search(models.merged(scores(s, d)), grid=SMALL_GRID))
query("ml_metrics", None)(lambda s, d: models.metrics(models.evaluated(scores(s, d), models.logistic())[1]))

__all__ = ["line", "recipe_nutrition"]
