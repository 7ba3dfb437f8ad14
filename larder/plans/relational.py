"""Joins, rollups, scores, rankings, windows and dimension upkeep over the adapter's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import dedup, dimensions, insights, nutrition, resolve, scoring
from larder.plans.adapter import table
from larder.plans.registry import SHARED, query

# ---------------------------------------------------------------- shared steps


def r(x: str, digits: int = 1) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(20,8)), {digits}) AS DOUBLE)"


SHARED["measures"] = """SELECT recipe_id, ingredient_index,
  CAST(round(CAST(CAST(qty_expected * unit_grams AS DOUBLE) / servings_expected AS DECIMAL(20,8)), 2) AS DECIMAL(18,2)) AS grams_per_serving
FROM recipe_ingredient JOIN recipes USING (recipe_id) WHERE unit_grams IS NOT NULL AND ingredient_index % 5 <> 0"""
SHARED["fallback"] = """SELECT recipe_id, ingredient_index, qty_expected * unit_grams AS fallback_grams FROM recipe_ingredient WHERE unit_grams IS NOT NULL"""
SHARED["weighed"] = """SELECT i.recipe_id, i.ingredient_id, i.ingredient_index, coalesce(s.servings_expected, 4) AS servings,
  CASE WHEN m.grams_per_serving IS NOT NULL THEN 'used_extracted' WHEN f.fallback_grams IS NOT NULL THEN 'fallback' ELSE 'no_grams' END AS source,
  coalesce(CAST(m.grams_per_serving AS DECIMAL(18,6)), CAST(CAST(f.fallback_grams AS DOUBLE) / coalesce(s.servings_expected, 4) AS DECIMAL(18,6))) AS grams
FROM recipe_ingredient i LEFT JOIN measures m ON m.recipe_id = i.recipe_id AND m.ingredient_index = i.ingredient_index
LEFT JOIN fallback f ON f.recipe_id = i.recipe_id AND f.ingredient_index = i.ingredient_index
LEFT JOIN recipes s ON s.recipe_id = i.recipe_id"""
SHARED["wide"] = (
    "SELECT fdc_id, " + ", ".join(f"max(CASE WHEN nutrient_id = {k} THEN amount END) AS {v}" for k, v in scoring.NUTRIENTS.items()) + " FROM food_nutrient GROUP BY fdc_id"
)
SHARED["resolved"] = """SELECT w.*, m.fdc_id, CASE WHEN w.grams IS NULL THEN 'no_grams' WHEN m.fdc_id IS NULL THEN 'no_fdc' WHEN n.fdc_id IS NULL THEN 'no_usda' ELSE 'used' END AS reason
FROM weighed w LEFT JOIN ingredient_mapping m ON m.ingredient_id = w.ingredient_id LEFT JOIN wide n ON n.fdc_id = m.fdc_id"""
SHARED["nutrition"] = (
    "SELECT recipe_id, max(servings) AS servings, count(*) AS ingredients_total, count(CASE WHEN reason = 'used' THEN 1 END) AS ingredients_used, "
    + ", ".join(r(f"CAST(coalesce(sum(CASE WHEN reason = 'used' THEN grams * {v} END), 0) AS DOUBLE) / 100") + f" AS {v}" for v in scoring.NUTRIENTS.values())
    + " FROM resolved LEFT JOIN wide USING (fdc_id) GROUP BY recipe_id"
)


def band_sql(n: str) -> str:
    medium, high = scoring.THRESHOLDS[n]
    return f"CASE WHEN {n} >= {medium} THEN 'low' WHEN {n} >= {high} THEN 'medium' ELSE 'high' END" if n == "protein_g" else f"CASE WHEN {n} < {medium} THEN 'low' WHEN {n} < {high} THEN 'medium' ELSE 'high' END"


def score_sql(n: str, x: str | None = None) -> str:
    medium, high = scoring.THRESHOLDS[n]
    x = x or n
    if n == "protein_g":
        return f"(CASE WHEN {x} >= {medium} THEN 0.0e0 WHEN {x} >= {high} THEN 0.5e0 * ({medium}.0e0 - {x}) / {medium - high}.0e0 ELSE 0.5e0 + least(0.5e0 * ({high}.0e0 - {x}) / {high}.0e0, 0.5e0) END)"
    return f"(CASE WHEN {x} <= {medium} THEN 0.0e0 WHEN {x} <= {high} THEN 0.5e0 * ({x} - {medium}.0e0) / {high - medium}.0e0 ELSE 0.5e0 + least(0.5e0 * ({x} - {high}.0e0) / {high}.0e0, 0.5e0) END)"


def weighted_sql(values: dict[str, str] | None = None) -> str:
    return r("(0.0e0 + " + " + ".join(f"{score_sql(n, (values or {}).get(n))} * {w}e0" for n, w in scoring.WEIGHTS.items()) + ") * 100")


def level_sql(x: str) -> str:
    return f"CASE WHEN {x} < 25 THEN 'Low' WHEN {x} < 50 THEN 'Medium' WHEN {x} < 75 THEN 'High' WHEN {x} IS NOT NULL THEN 'Very High' END"


SHARED["banded"] = (
    "SELECT n.*, coalesce(recipe_name, '?') AS recipe_name, "
    + ", ".join(f"CASE WHEN energy_kcal > 0 THEN {band_sql(n)} END AS {risk}" for n, risk in scoring.RISKS.items())
    + f", CASE WHEN ingredients_total > 0 THEN {r('CAST(ingredients_used AS DOUBLE) * 100 / ingredients_total')} ELSE 0.0 END AS ingredient_coverage_pct"
    + f", CASE WHEN energy_kcal > 0 THEN {weighted_sql()} END AS weighted_risk_score, CASE WHEN energy_kcal > 0 THEN 'calculated' ELSE 'insufficient_data' END AS data_status"
    + " FROM nutrition n LEFT JOIN recipes p ON p.recipe_id = n.recipe_id"
)
SHARED["scores"] = (
    "SELECT f.*, CASE WHEN flag_count = 0 THEN 'Low' WHEN flag_count <= 2 THEN 'Medium' WHEN flag_count IS NOT NULL THEN 'High' END AS flag_risk_level, "
    + level_sql("weighted_risk_score")
    + " AS weighted_risk_level FROM (SELECT *, CASE WHEN data_status = 'calculated' THEN CAST("
    + " + ".join(f"(CASE WHEN {x} = 'high' THEN 1 ELSE 0 END)" for x in scoring.RISKS.values())
    + " AS INTEGER) END AS flag_count FROM banded) f"
)


def measures(spark: SparkSession, d: str) -> DataFrame:
    g = (F.col("qty_expected") * F.col("unit_grams")).cast("double") / F.col("servings_expected")
    lines = table(spark, d, "recipe_ingredient").where("unit_grams is not null and ingredient_index % 5 <> 0")
    return lines.join(table(spark, d, "recipes"), "recipe_id").select("recipe_id", "ingredient_index", F.round(g.cast("decimal(20,8)"), 2).cast("decimal(18,2)").alias("grams_per_serving"))


def weighed(spark: SparkSession, d: str) -> DataFrame:
    rif = table(spark, d, "recipe_ingredient")
    rif = rif.withColumn("fallback_grams", (F.col("qty_expected") * F.col("unit_grams")).cast("double"))
    return nutrition.weighed(rif, measures(spark, d), table(spark, d, "recipes").select("recipe_id", F.col("servings_expected").alias("servings")))


def wide(spark: SparkSession, d: str) -> DataFrame:
    return nutrition.nutrient_pivot(table(spark, d, "food_nutrient"))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """One scan of the lines: the measure that measures() gives is worked out beside each."""
    rif = table(spark, d, "recipe_ingredient").join(table(spark, d, "recipes").select("recipe_id", F.col("servings_expected").alias("servings")), "recipe_id", "left")
    g = (F.col("qty_expected") * F.col("unit_grams")).cast("double")
    measure = F.when(F.col("ingredient_index") % 5 != 0, F.round((g / F.col("servings")).cast("decimal(20,8)"), 2).cast("decimal(18,2)"))
    lines = nutrition.with_grams(rif.withColumns({"fallback_grams": g, "grams_per_serving": measure}))
    return nutrition.resolved(lines, table(spark, d, "ingredient_mapping"), wide(spark, d))


def recipe_nutrition(spark: SparkSession, d: str) -> DataFrame:
    return nutrition.rollup(resolved(spark, d))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.risk_scores(recipe_nutrition(spark, d), table(spark, d, "recipes"))


# ---------------------------------------------------------------- joins

query("join_measure_fallback", "SELECT recipe_id, ingredient_index, source, CAST(grams AS DOUBLE) AS grams FROM weighed")(lambda s, d: weighed(s, d).select("recipe_id", "ingredient_index", "source", F.col("grams").cast("double")))
query("join_star_lookup", "SELECT recipe_id, ingredient_index, fdc_id, reason FROM resolved")(lambda s, d: resolved(s, d).select("recipe_id", "ingredient_index", "fdc_id", "reason"))
query("join_servings_default", "SELECT o.o_orderkey AS recipe_id, coalesce(s.servings_expected, 4) AS servings FROM orders o LEFT JOIN (SELECT * FROM recipes WHERE servings_raw <> '') s ON s.recipe_id = o.o_orderkey")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("recipe_id")).join(table(s, d, "recipes").where("servings_raw <> ''"), "recipe_id", "left").select("recipe_id", F.coalesce("servings_expected", F.lit(4)).alias("servings"))
)
query("join_left_enrich", "SELECT r.recipe_id, r.recipe_name, n.ingredients_total, n.ingredients_used, c.lines FROM recipes r LEFT JOIN nutrition n ON n.recipe_id = r.recipe_id LEFT JOIN (SELECT recipe_id, count(*) AS lines FROM recipe_ingredient GROUP BY recipe_id) c ON c.recipe_id = r.recipe_id")(
    lambda s, d: table(s, d, "recipes").join(recipe_nutrition(s, d), "recipe_id", "left").join(table(s, d, "recipe_ingredient").groupBy("recipe_id").agg(F.count("*").alias("lines")), "recipe_id", "left").select("recipe_id", "recipe_name", "ingredients_total", "ingredients_used", "lines")
)
query("join_semi", "SELECT recipe_id, recipe_name FROM recipes WHERE recipe_id IN (SELECT recipe_id FROM scores WHERE data_status = 'insufficient_data')")(
    lambda s, d: table(s, d, "recipes").join(scores(s, d).where("data_status = 'insufficient_data'"), "recipe_id", "left_semi").select("recipe_id", "recipe_name")
)
query("join_anti", "SELECT recipe_id, recipe_name FROM recipes WHERE recipe_id NOT IN (SELECT recipe_id FROM recipe_ingredient)")(
    lambda s, d: table(s, d, "recipes").join(table(s, d, "recipe_ingredient"), "recipe_id", "left_anti").select("recipe_id", "recipe_name")
)
query("join_url", "SELECT p.page_id, q.page_id AS other_id FROM pages p JOIN pages q ON regexp_replace(regexp_replace(rtrim(lower(trim(p.url)), '/'), '^https?://', ''), '^www\\.', '') = regexp_replace(regexp_replace(rtrim(lower(trim(q.url)), '/'), '^https?://', ''), '^www\\.', '')")(
    lambda s, d: (lambda p: p.select("page_id", text.url_key("url").alias("k")).join(p.select(F.col("page_id").alias("other_id"), text.url_key("url").alias("k")), "k").select("page_id", "other_id"))(table(s, d, "pages"))
)
query("sql_join2", "SELECT f.fdc_id, f.description, n.nutrient_id, CAST(n.amount AS DOUBLE) AS amount FROM food f JOIN food_nutrient n ON n.fdc_id = f.fdc_id ORDER BY f.fdc_id, n.nutrient_id LIMIT 20")(
    lambda s, d: table(s, d, "food").join(table(s, d, "food_nutrient"), "fdc_id").orderBy("fdc_id", "nutrient_id").limit(20).select("fdc_id", "description", "nutrient_id", F.col("amount").cast("double"))
)
NAMES = ", ".join(f"({k}, '{v}')" for k, v in scoring.NUTRIENTS.items())
query("sql_join3", f"SELECT f.fdc_id, f.description, u.name, CAST(n.amount AS DOUBLE) AS amount FROM food f JOIN food_nutrient n ON n.fdc_id = f.fdc_id JOIN (VALUES {NAMES}) AS u(nutrient_nbr, name) ON u.nutrient_nbr = n.nutrient_id")(
    lambda s, d: s.sql(
        f"SELECT f.fdc_id, f.description, u.name, CAST(n.amount AS DOUBLE) AS amount FROM {{food}} f JOIN {{n}} n ON n.fdc_id = f.fdc_id JOIN (VALUES {NAMES}) AS u(nutrient_nbr, name) ON u.nutrient_nbr = n.nutrient_id",
        food=table(s, d, "food"),
        n=table(s, d, "food_nutrient"),
    )
)
query("join_token", "SELECT t.token, count(*) AS pairs FROM (SELECT DISTINCT fdc_id, unnest(string_split(lower(ingredient_name), ' ')) AS token FROM food) t JOIN (SELECT DISTINCT ingredient_name, unnest(string_split(lower(ingredient_name), ' ')) AS token FROM food) q ON q.token = t.token GROUP BY t.token")(
    lambda s, d: (
        lambda f: f.select("fdc_id", F.explode(F.split(F.lower("ingredient_name"), " ")).alias("token")).distinct().join(f.select("ingredient_name").distinct().select(F.explode(F.split(F.lower("ingredient_name"), " ")).alias("token"), "ingredient_name").distinct(), "token")
    )(table(s, d, "food")).groupBy("token").agg(F.count("*").alias("pairs"))
)

# ---------------------------------------------------------------- aggregations

query("nutrition_rollup", "SELECT * FROM nutrition")(recipe_nutrition)
query("nutrient_pivot", "SELECT f.fdc_id, f.description, " + ", ".join(f"CAST(w.{v} AS DOUBLE) AS {v}" for v in scoring.NUTRIENTS.values()) + " FROM food f LEFT JOIN wide w ON w.fdc_id = f.fdc_id")(
    lambda s, d: nutrition.nutrient_pivot(table(s, d, "food_nutrient"), table(s, d, "food")).select("fdc_id", "description", *(F.col(v).cast("double") for v in scoring.NUTRIENTS.values()))
)
query("skip_reason_counts", "SELECT CASE WHEN reason = 'used' THEN source ELSE reason END AS reason, count(*) AS n FROM resolved GROUP BY 1")(
    lambda s, d: resolved(s, d).groupBy(F.when(F.col("reason") == "used", F.col("source")).otherwise(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))
)
query("coverage_pct", f"SELECT {r('CAST(sum(CAST(ingredient_coverage_pct AS DECIMAL(20,4))) AS DOUBLE) / count(*)')} AS mean_coverage, count(*) AS recipes FROM scores")(
    lambda s, d: scores(s, d).agg(scoring.rounded(F.sum(F.col("ingredient_coverage_pct").cast("decimal(20,4)")).cast("double") / F.count("*"), 1).alias("mean_coverage"), F.count("*").alias("recipes"))
)
query("mapping_summary", "SELECT count(m.fdc_id) AS matched, count(*) - count(m.fdc_id) AS skipped, count(*) AS total FROM food f LEFT JOIN ingredient_mapping m ON m.ingredient_id = f.ingredient_id")(
    lambda s, d: table(s, d, "food").select("ingredient_id").join(table(s, d, "ingredient_mapping"), "ingredient_id", "left").agg(F.count("fdc_id").alias("matched"), F.count_if(F.col("fdc_id").isNull()).alias("skipped"), F.count("*").alias("total"))
)
LEVELS = ", ".join(f"('{v}')" for v in scoring.LEVELS)
query("level_distribution", f"SELECT l.v AS weighted_risk_level, count(s.recipe_id) AS recipes, {r('CAST(count(s.recipe_id) AS DOUBLE) * 100 / (SELECT count(*) FROM scores WHERE weighted_risk_level IS NOT NULL)')} AS share_pct FROM (VALUES {LEVELS}) AS l(v) LEFT JOIN scores s ON s.weighted_risk_level = l.v GROUP BY l.v")(
    lambda s, d: insights.level_distribution(scores(s, d))
)
SHARED["bands"] = " UNION ALL ".join(f"SELECT recipe_id, '{x}' AS nutrient, {x} AS band FROM scores WHERE data_status = 'calculated'" for x in scoring.RISKS.values())
query("nutrient_breakdown", f"SELECT nutrient, band, count(*) AS recipes, {r('CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM scores WHERE weighted_risk_level IS NOT NULL)')} AS share_pct FROM bands GROUP BY nutrient, band")(
    lambda s, d: insights.nutrient_breakdown(scores(s, d))
)


def share_sql(cond: str, of: str) -> str:
    n = f"count(CASE WHEN {of} THEN 1 END)"
    return f"CASE WHEN {n} > 0 THEN {r(f'CAST(count(CASE WHEN {of} AND {cond} THEN 1 END) AS DOUBLE) * 100 / {n}')} ELSE 0.0 END"


UP = "weighted_risk_level IN ('High', 'Very High')"
FINDINGS = {"fat_high_of_elevated": ("fat_risk = 'high'", UP), "sodium_high_of_elevated": ("sodium_risk = 'high'", UP), "low_or_medium": ("weighted_risk_level IN ('Low', 'Medium')", "true"), "protein_high": ("protein_risk = 'high'", "true"), "fat_high_given_sodium_high": ("fat_risk = 'high'", "sodium_risk = 'high'")}
query("findings", "SELECT " + ", ".join(f"{share_sql(*v)} AS {k}" for k, v in FINDINGS.items()) + " FROM scores WHERE data_status = 'calculated'")(lambda s, d: insights.findings(scores(s, d)))
query("kpis", f"SELECT count(*) AS recipes, count(weighted_risk_score) AS scored, {r('CAST(sum(CAST(weighted_risk_score AS DECIMAL(20,4))) AS DOUBLE) / count(weighted_risk_score)')} AS mean_score, count(CASE WHEN flag_risk_level = 'High' THEN 1 END) AS flag_high FROM scores")(
    lambda s, d: insights.kpis(scores(s, d))
)
query("flag_cooccurrence", "SELECT a.nutrient AS a, b.nutrient AS b, count(CASE WHEN a.band = 'high' AND b.band = 'high' THEN 1 END) AS recipes FROM bands a JOIN bands b ON a.recipe_id = b.recipe_id GROUP BY 1, 2")(
    lambda s, d: insights.flag_cooccurrence(scores(s, d))
)
query("ingredient_concat", "SELECT i.recipe_id, string_agg(f.ingredient_name, ' ; ' ORDER BY ingredient_index) AS ingredients, count(*) AS ingredient_count FROM recipe_ingredient i JOIN food f ON f.ingredient_id = i.ingredient_id GROUP BY i.recipe_id")(
    lambda s, d: table(s, d, "recipe_ingredient").join(table(s, d, "food"), "ingredient_id").groupBy("recipe_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ingredient_index", "ingredient_name"))), lambda x: x.ingredient_name), " ; ").alias("ingredients"), F.count("*").alias("ingredient_count"))
)
query("ingredient_text_index", "SELECT i.recipe_id, string_agg(DISTINCT f.ingredient_name, ' ' ORDER BY f.ingredient_name) AS ingredients_text FROM recipe_ingredient i JOIN food f ON f.ingredient_id = i.ingredient_id GROUP BY i.recipe_id")(
    lambda s, d: table(s, d, "recipe_ingredient").join(table(s, d, "food"), "ingredient_id").groupBy("recipe_id").agg(F.array_join(F.array_sort(F.collect_set("ingredient_name")), " ").alias("ingredients_text"))
)
query("distinct_counts", "SELECT nutrient_id, count(DISTINCT fdc_id) AS foods FROM food_nutrient GROUP BY nutrient_id")(lambda s, d: table(s, d, "food_nutrient").groupBy("nutrient_id").agg(F.countDistinct("fdc_id").alias("foods")))

# ---------------------------------------------------------------- scoring

COLUMNS = ["recipe_id", "recipe_name", "servings", "ingredients_total", "ingredients_used", *scoring.NUTRIENTS.values(), "ingredient_coverage_pct", *scoring.RISKS.values(), "flag_count", "flag_risk_level", "weighted_risk_score", "weighted_risk_level", "data_status"]
query("risk_scores", f"SELECT {', '.join(COLUMNS)} FROM scores")(lambda s, d: scores(s, d).select(*COLUMNS))
query("classify_nutrients", "SELECT recipe_id, " + ", ".join(f"{band_sql(n)} AS {risk}" for n, risk in scoring.RISKS.items()) + " FROM nutrition")(
    lambda s, d: recipe_nutrition(s, d).select("recipe_id", *(scoring.band(n, F.col(n)).alias(risk) for n, risk in scoring.RISKS.items()))
)
query("nutrient_score", "SELECT recipe_id, " + ", ".join(f"{r(score_sql(n), 6)} AS {n}_score" for n in scoring.RISKS) + " FROM nutrition")(
    lambda s, d: recipe_nutrition(s, d).select("recipe_id", *(scoring.rounded(scoring.score(n, F.col(n)), 6).alias(f"{n}_score") for n in scoring.RISKS))
)
query("weighted_score", f"SELECT recipe_id, {weighted_sql()} AS weighted_risk_score FROM nutrition")(lambda s, d: recipe_nutrition(s, d).select("recipe_id", scoring.weighted({n: F.col(n) for n in scoring.WEIGHTS}).alias("weighted_risk_score")))
query("risk_levels", "SELECT flag_risk_level, weighted_risk_level, count(*) AS recipes FROM scores GROUP BY 1, 2")(lambda s, d: scores(s, d).groupBy("flag_risk_level", "weighted_risk_level").agg(F.count("*").alias("recipes")))
W = {which: "list_filter([" + ", ".join(f"CASE WHEN {c} = '{which}' THEN '{w}' END" for c, w in scoring.VERDICT_WORDS) + "], lambda x: x IS NOT NULL)" for which in ("high", "medium")}


def joined_sql(a: str) -> str:
    return f"CASE WHEN len({a}) = 1 THEN {a}[1] ELSE array_to_string({a}[1:len({a}) - 1], ', ') || ', and ' || {a}[len({a})] END"


query("plain_verdict", f"SELECT recipe_id, CASE WHEN weighted_risk_level IS NULL THEN NULL WHEN weighted_risk_level = 'Low' THEN 'A well-balanced dish — nothing here stands out as a concern.' WHEN len(h) > 0 THEN 'A good meal overall, but quite ' || {joined_sql('h')} || '.' WHEN len(m) > 0 THEN 'A decent meal — just a little ' || {joined_sql('m')} || '.' ELSE 'A reasonably balanced dish.' END AS verdict FROM (SELECT recipe_id, weighted_risk_level, {W['high']} AS h, {W['medium']} AS m FROM scores)")(
    lambda s, d: (lambda x: x.select("recipe_id", scoring.verdict(x).alias("verdict")))(scores(s, d))
)
# What a band of a nutrient says.
SENTENCES = [
    ("energy_risk", "low", "Energy is in a comfortable range for one serving."),
    ("energy_risk", "medium", "A little calorie-dense — fine occasionally, not an everyday portion."),
    ("energy_risk", "high", "Very calorie-dense per serving — a smaller portion or lighter sides would help."),
    ("sodium_risk", "low", "Salt is well within a healthy range."),
    ("sodium_risk", "medium", "Salt is creeping up — go easy on extra bouillon or added salt next time."),
    ("sodium_risk", "high", "Very salty per serving — worth watching, given how common high blood pressure is across Africa."),
    ("fat_risk", "low", "Fat content is modest."),
    ("fat_risk", "medium", "Moderately rich — keep an eye on how much oil goes in."),
    ("fat_risk", "high", "High in fat — likely from oil, palm oil, or fatty cuts of meat."),
    ("sugar_risk", "low", "Sugar is low — good."),
    ("sugar_risk", "medium", "Some added sugar in there — not alarming, just worth noting."),
    ("sugar_risk", "high", "Quite sugary for a savoury dish — worth checking where the sugar's coming from."),
    ("protein_risk", "low", "Good protein content — this will be filling."),
    ("protein_risk", "medium", "Decent protein, but not a stand-out source."),
    ("protein_risk", "high", "Low on protein — this dish alone won't be very filling."),
]
SENTENCE_ROWS = ", ".join("('{}', '{}', '{}')".format(a, b, c.replace("'", "''")) for a, b, c in SENTENCES)
query("nutrient_sentences", f"SELECT b.recipe_id, b.nutrient, t.sentence FROM bands b JOIN (VALUES {SENTENCE_ROWS}) AS t(nutrient, band, sentence) ON t.nutrient = b.nutrient AND t.band = b.band")(
    lambda s, d: insights.bands_long(scores(s, d)).join(F.broadcast(s.createDataFrame(SENTENCES, "nutrient string, band string, sentence string")), ["nutrient", "band"]).select("recipe_id", "nutrient", "sentence")
)
query("daily_values", "SELECT recipe_id, " + ", ".join(f"CAST({r(f'{n} * 100 / {dv}e0', 0)} AS INTEGER) AS {n}_pct" for n, dv in scoring.DAILY.items()) + " FROM nutrition")(lambda s, d: scoring.daily_values(recipe_nutrition(s, d)))
query("traffic_light", "SELECT recipe_id, " + ", ".join(f"CASE WHEN {score_sql(n)} < 0.25 THEN 'green' WHEN {score_sql(n)} < 0.5 THEN 'amber' ELSE 'red' END AS {n}" for n in scoring.RISKS) + " FROM nutrition")(
    lambda s, d: recipe_nutrition(s, d).select("recipe_id", *(scoring.traffic_light(n, F.col(n)).alias(n) for n in scoring.RISKS))
)
ON = {n: f"(tips & {1 << i}) > 0" for i, n in enumerate(scoring.TIPS)}
CUT = {"fat_g": f"(CASE WHEN {ON['fat_g']} THEN fat_g * 0.33e0 ELSE 0.0e0 END)", "sugars_g": f"(CASE WHEN {ON['sugars_g']} THEN sugars_g * 0.5e0 ELSE 0.0e0 END)", "protein_g": f"(CASE WHEN {ON['protein_g']} THEN protein_g * 0.4e0 ELSE 0.0e0 END)"}
ENERGY = f"(greatest(0.0e0, greatest(0.0e0, energy_kcal - {CUT['fat_g']} * 9) - {CUT['sugars_g']} * 4) + {CUT['protein_g']} * 4)"
ADJUSTED = {"fat_g": f"(fat_g - {CUT['fat_g']})", "sugars_g": f"(sugars_g - {CUT['sugars_g']})", "protein_g": f"(protein_g + {CUT['protein_g']})", "sodium_mg": f"(CASE WHEN {ON['sodium_mg']} THEN sodium_mg * 0.6e0 ELSE sodium_mg END)", "energy_kcal": f"(CASE WHEN {ON['energy_kcal']} THEN {ENERGY} * 0.85e0 ELSE {ENERGY} END)"}
FITS = " AND ".join(f"(NOT {ON[n]} OR {scoring.RISKS[n]} IN ('medium', 'high'))" for n in scoring.TIPS)
query(
    "whatif",
    f"SELECT recipe_id, tips, new_score, {level_sql('new_score')} AS new_level, CASE WHEN new_score < weighted_risk_score - 0.5 THEN 'down' WHEN new_score > weighted_risk_score + 0.5 THEN 'up' ELSE 'same' END AS direction FROM (SELECT s.recipe_id, s.weighted_risk_score, CAST(t.tips AS INTEGER) AS tips, {weighted_sql(ADJUSTED)} AS new_score FROM scores s CROSS JOIN range(1, 32) AS t(tips) WHERE data_status = 'calculated' AND {FITS})",
)(lambda s, d: scoring.whatif(scores(s, d)))

# ---------------------------------------------------------------- rankings, filters, windows

for _metric in ("sodium_mg", "energy_kcal", "weighted_risk_score"):
    query(f"topk_{_metric}", f"SELECT recipe_id, left(recipe_name, 40) AS recipe_name, {_metric} FROM scores WHERE {_metric} IS NOT NULL ORDER BY {_metric} DESC, recipe_id LIMIT 10")(lambda s, d, m=_metric: insights.top_k(scores(s, d), m, 10))
query("explore_sort", "SELECT recipe_id, CAST(row_number() OVER (PARTITION BY weighted_risk_level ORDER BY weighted_risk_score DESC NULLS LAST, lower(recipe_name), recipe_id) AS INTEGER) AS place FROM scores")(lambda s, d: insights.explored(scores(s, d)))
query("head_n", "SELECT recipe_id, recipe_name FROM recipes ORDER BY recipe_id LIMIT 48")(lambda s, d: table(s, d, "recipes").orderBy("recipe_id").limit(48).select("recipe_id", "recipe_name"))
query("union_sources", "SELECT recipe_name AS t FROM recipes UNION SELECT ingredient_name FROM food UNION SELECT description FROM food")(
    lambda s, d: table(s, d, "recipes").select(F.col("recipe_name").alias("t")).union(table(s, d, "food").select("ingredient_name")).union(table(s, d, "food").select("description")).distinct()
)
query("explore_filter", "SELECT recipe_id, weighted_risk_level, ingredient_coverage_pct FROM scores WHERE data_status = 'calculated' AND weighted_risk_level IN ('Medium', 'High') AND flag_risk_level IN ('Medium', 'High') AND ingredient_coverage_pct >= 50 AND lower(recipe_name) LIKE '%soup 1%' AND recipe_id IN (SELECT recipe_id FROM recipe_ingredient WHERE ingredient_id % 3 = 0)")(
    lambda s, d: insights.explore(scores(s, d), ["Medium", "High"], ["Medium", "High"], 50, "Soup 1", table(s, d, "recipe_ingredient").where("ingredient_id % 3 = 0")).select("recipe_id", "weighted_risk_level", "ingredient_coverage_pct")
)
query("coverage_tier", "SELECT CASE WHEN ingredient_coverage_pct < 30 THEN 'warn' WHEN ingredient_coverage_pct < 60 THEN 'info' ELSE 'ok' END AS tier, count(*) AS recipes FROM scores GROUP BY 1")(
    lambda s, d: scores(s, d).groupBy(insights.coverage_tier(F.col("ingredient_coverage_pct")).alias("tier")).agg(F.count("*").alias("recipes"))
)
query("inspection_table", "SELECT s.recipe_id, s.recipe_name, s.servings, s.ingredient_coverage_pct, i.ingredients, i.n AS ingredient_count FROM scores s LEFT JOIN (SELECT i.recipe_id, string_agg(f.ingredient_name, ' ; ' ORDER BY ingredient_index) AS ingredients, count(*) AS n FROM recipe_ingredient i JOIN food f ON f.ingredient_id = i.ingredient_id GROUP BY i.recipe_id) i ON i.recipe_id = s.recipe_id WHERE data_status = 'insufficient_data'")(
    lambda s, d: (
        lambda lines: scores(s, d).where("data_status = 'insufficient_data'").join(lines, "recipe_id", "left").select("recipe_id", "recipe_name", "servings", "ingredient_coverage_pct", "ingredients", "ingredient_count")
    )(table(s, d, "recipe_ingredient").join(table(s, d, "food"), "ingredient_id").groupBy("recipe_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ingredient_index", "ingredient_name"))), lambda x: x.ingredient_name), " ; ").alias("ingredients"), F.count("*").alias("ingredient_count")))
)
query("run_block_id", "SELECT event_id, CAST(sum(CASE WHEN event_type IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS block FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)")(
    lambda s, d: dedup.run_blocks(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "block")
)
query("forward_fill_id", "SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")(
    lambda s, d: dedup.forward_fill(table(s, d, "events").withColumn("given", F.when(F.col("event_id") % 4 == 0, F.col("event_id"))), "user_id", ["ts", "event_id"], "given", "filled").select("event_id", "filled")
)
query("title_fallback", "SELECT o_orderkey AS recipe_id, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 10 > 0 THEN o_orderstatus END, 'Unknown Recipe') AS title FROM orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("recipe_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("recipe_title"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderstatus")).alias("title2")).transform(lambda x: x.select("recipe_id", dedup.first_title(x, ["recipe_title", "name", "title2"]).alias("title")))
)
KEY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(recipe_name)), '\\s+', ' ', 'g'), 's+$', ''), '[^\\w\\s]', '', 'g'))"
query(
    "dedup_recipes",
    f"SELECT recipe_id, recipe_name, kept_id, kept_name FROM (SELECT recipe_id, recipe_name, first_value(recipe_id) OVER w AS kept_id, first_value(recipe_name) OVER w AS kept_name FROM (SELECT r.*, {KEY_SQL} AS k, coalesce(c.n, 0) AS n FROM recipes r LEFT JOIN (SELECT recipe_id, count(*) AS n FROM recipe_ingredient GROUP BY recipe_id) c ON c.recipe_id = r.recipe_id) WINDOW w AS (PARTITION BY k ORDER BY n DESC, recipe_id)) WHERE recipe_id <> kept_id",
)(lambda s, d: dedup.removed(table(s, d, "recipes"), table(s, d, "recipe_ingredient")).select("recipe_id", "recipe_name", "kept_id", "kept_name"))
query("last_wins_lookup", "SELECT l_orderkey AS k, max_by(l_partkey, (l_linenumber, l_partkey)) AS v FROM lineitem GROUP BY 1")(
    lambda s, d: nutrition.last_wins(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"), F.struct("l_linenumber", "l_partkey").alias("ord")), ["k"], "ord").select("k", "v")
)

# ---------------------------------------------------------------- dimension upkeep


def laddered(new: DataFrame, foods: DataFrame) -> DataFrame:
    """New names by the ladder of keys over the names of foods."""
    keys = foods.groupBy(F.col("ingredient_name").alias("key")).agg(F.min("fdc_id").alias("fdc_id"), F.min_by("description", "fdc_id").alias("food"))
    hits = resolve.match_ladder(new, keys).select("name", F.lit("matched").alias("status"))
    return new.join(hits, "name", "left").select("name", F.coalesce("status", F.lit("skip")).alias("status"))


query("assign_recipe_ids", "SELECT c_custkey AS src_ord, upper(c_name) AS recipe_name, CAST(500000 + row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS recipe_id FROM customer")(
    lambda s, d: dimensions.assign_ids(table(s, d, "customer").select(F.col("c_custkey").alias("src_ord"), F.upper("c_name").alias("recipe_name")), "src_ord", 500_000, "recipe_id")
)
NEW = "SELECT lower(p_type) AS name, min(p_partkey) AS ord FROM part GROUP BY 1"
MASTER = "SELECT DISTINCT lower(p_type) AS name, dense_rank() OVER (ORDER BY lower(p_type)) AS ingredient_id FROM part WHERE p_size % 9 = 0"
query("get_or_create_ingredient", f"SELECT n.name, coalesce(m.ingredient_id, (SELECT max(ingredient_id) FROM ({MASTER})) + row_number() OVER (PARTITION BY m.ingredient_id IS NULL ORDER BY n.ord)) AS ingredient_id FROM ({NEW}) n LEFT JOIN ({MASTER}) m ON m.name = n.name")(
    lambda s, d: dimensions.get_or_create(
        table(s, d, "part").select(F.lower("p_type").alias("name"), F.col("p_partkey").alias("ord")), s.sql("SELECT DISTINCT lower(p_type) AS name, CAST(dense_rank() OVER (ORDER BY lower(p_type)) AS BIGINT) AS ingredient_id FROM {part} WHERE p_size % 9 = 0", part=table(s, d, "part")), "name", "ord", "ingredient_id"
    )
)
KEYS = "SELECT ingredient_name AS key, min(fdc_id) AS fdc_id FROM food WHERE ingredient_name LIKE '%a%' GROUP BY 1"
query("get_or_create_mapping", f"SELECT DISTINCT f.ingredient_name AS name, CASE WHEN x.name IS NOT NULL THEN 'reused' WHEN k.key IS NOT NULL THEN 'matched' ELSE 'skip' END AS status FROM food f LEFT JOIN (SELECT DISTINCT ingredient_name AS name FROM food WHERE ingredient_id % 50 = 0) x ON x.name = f.ingredient_name LEFT JOIN ({KEYS}) k ON k.key = f.ingredient_name OR f.ingredient_name LIKE 'hot %' AND k.key = substr(f.ingredient_name, 5)")(
    lambda s, d: (lambda foods: dimensions.mapping_for(foods.select(F.col("ingredient_name").alias("name")), foods.where("ingredient_id % 50 = 0").select(F.col("ingredient_name").alias("name")), lambda new: laddered(new, foods.where("ingredient_name like '%a%'"))))(table(s, d, "food"))
)
query("replace_rows", "SELECT recipe_id, ingredient_index, ingredient_id FROM recipe_ingredient WHERE recipe_id % 10 <> 0 UNION ALL SELECT recipe_id, ingredient_index, ingredient_id + 1 FROM recipe_ingredient WHERE recipe_id % 10 = 0 AND ingredient_index <= 2")(
    lambda s, d: (lambda x: dimensions.replace_rows(x.select("recipe_id", "ingredient_index", "ingredient_id"), x.where("recipe_id % 10 = 0 and ingredient_index <= 2").select("recipe_id", "ingredient_index", (F.col("ingredient_id") + 1).alias("ingredient_id")), x.where("recipe_id % 10 = 0").select("recipe_id"), "recipe_id"))(table(s, d, "recipe_ingredient"))
)
query("update_by_id", "SELECT n.recipe_id, CASE WHEN n.recipe_id % 6 = 0 THEN 1.5 ELSE n.energy_kcal END AS energy_kcal, CASE WHEN n.recipe_id % 6 = 0 THEN 9 ELSE n.servings END AS servings FROM nutrition n")(
    lambda s, d: (lambda n: dimensions.update_by_id(n.select("recipe_id", "energy_kcal", "servings"), n.where("recipe_id % 6 = 0").select("recipe_id", F.lit(1.5).alias("energy_kcal"), F.lit(9).alias("servings")), "recipe_id"))(recipe_nutrition(s, d))
)
