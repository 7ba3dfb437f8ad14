"""Ingredient names to foods: curated keys, fuzzy matching, blocked search, ordered rules, layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import similarity
from larder.functions.text import col
from larder.operators import fuzzy
from larder.sources.shared import cut

# Words that stand before or after a name without changing the food, and words of composed dishes.
MODIFIERS = "ripe overripe unripe fresh dried dehydrated reconstituted canned tinned frozen thawed jarred raw cooked roasted toasted smoked charred boiled steamed fried diced chopped sliced minced grated crushed ground mashed pureed blended shredded whole halved quartered cubed baby mini mild hot spicy extra plain organic mixed assorted".split()
FORM_ENDINGS = "powder flakes flake extract seeds seed leaves leaf".split()
SAME_PLURAL = "couscous molasses bass rice spinach garlic broth beef milk flour pasta".split()
DISHES = "cake pie stew casserole sandwich burger pizza muffin cookie pudding pastry biscuit salad dip spread dressing soup fried sauce gravy stuffed filled mixed combination blend roll wrap taco burrito dumpling".split()


def singular(t: Column) -> Column:
    return (
        F.when(t.isin(*SAME_PLURAL), t)
        .when(t.endswith("ies") & (F.length(t) > 4), F.concat(t.substr(F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(t.endswith("oes") & (F.length(t) > 3), t.substr(F.lit(1), F.length(t) - 2))
        .when(t.endswith("ses") & (F.length(t) > 4), t.substr(F.lit(1), F.length(t) - 2))
        .when(t.endswith("s") & (F.length(t) > 3), t.substr(F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )


def _unmodified(a: Column) -> Column:
    """Tokens from the first that isn't a modifier on; the last one always stays."""
    words = F.array(*(F.lit(w) for w in MODIFIERS))
    at = F.transform(a, lambda t, i: F.when(~F.array_contains(words, t), i + 1))
    first = F.least(F.coalesce(F.array_min(F.filter(at, lambda x: x.isNotNull())), F.size(a)), F.size(a))
    return F.slice(a, F.greatest(first, F.lit(1)), F.greatest(F.size(a), F.lit(1)))


def ladder_keys(name) -> Column:
    """The keys to look up, best first: as it is, singular, sorted, without modifiers, without a form at the end."""
    a = F.filter(F.split(F.lower(F.trim(col(name))), r"\s+"), lambda t: t != "")
    n = F.size(a)
    join = lambda x: F.array_join(x, " ")
    all_singular = lambda x: F.transform(x, singular)
    last = F.concat(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.transform(F.slice(a, F.greatest(n, F.lit(1)), 1), singular))
    bare = _unmodified(a)
    shorter = F.when((n > 1) & F.element_at(a, -1).isin(*FORM_ENDINGS), F.slice(a, 1, F.greatest(n - 1, F.lit(0))))
    stripped = F.when(join(bare) != join(a), bare)
    keys = [a, last, F.array_sort(a), stripped, all_singular(stripped), F.array_sort(stripped), shorter, all_singular(shorter), F.array_sort(shorter), _unmodified(shorter)]
    return F.when(n > 0, F.array_compact(F.array(*(join(k) for k in keys)))).otherwise(F.array().cast("array<string>"))


def match_ladder(names: DataFrame, curated: DataFrame) -> DataFrame:
    """names(name) and curated(key, food, fdc_id) -> (name, food, fdc_id) of the best key that hits.

    Every distinct name brings at most ten keys to one equi-join; the least rank wins in a partial aggregation.
    """
    keys = names.select("name").distinct().select("name", F.posexplode(ladder_keys("name")).alias("rank", "key"))
    best = keys.join(curated, "key").groupBy("name").agg(F.min(F.struct("rank", "food", "fdc_id")).alias("b"))
    return best.select("name", "b.food", "b.fdc_id")


def match_fuzzy(names: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """names(name), keys(key, ord) -> (name, key, ord, similarity, match_type) of the best key at or above the threshold, ties by ord.

    Distinct names and keys meet through the index of their characters (larder.operators.fuzzy).  A name or key without
    a word matches nothing.
    """
    scored = fuzzy.similar(names, keys, threshold).join(keys.select("key", "ord"), "key")
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "ord", "key")).alias("b"))
    out = best.select("name", "b.key", "b.ord", (-F.col("b.s")).alias("similarity"))
    return out.withColumn("match_type", F.concat(F.lit("fuzzy_"), F.col("similarity").cast("int").cast("string"), F.lit("%")))


def tokens_of(c) -> Column:
    """Words of a description as the index has them: without brackets, dots and quotes, longer than two, with their singulars."""
    words = F.transform(F.split(F.lower(col(c)), r"[\s,;/]+"), lambda t: F.regexp_replace(t, "^[().'-]+|[().'-]+$", ""))
    words = F.filter(words, lambda t: F.length(t) > 2)
    one = F.transform(F.filter(words, lambda t: t.endswith("s") & (F.length(t) > 3)), lambda t: t.substr(F.lit(1), F.length(t) - 1))
    return F.array_distinct(F.concat(words, one))


def token_index(foods: DataFrame) -> DataFrame:
    return foods.select("fdc_id", F.explode(tokens_of("description")).alias("token")).distinct()


def candidates(names: DataFrame, foods: DataFrame) -> DataFrame:
    """(name, fdc_id, description): foods that share a token with the name or with its singular; each pair once.

    Distinct names and distinct descriptions meet, so repeated lines and repeated descriptions cost nothing here.
    """
    words = F.filter(F.split(F.lower(F.trim("name")), r"\s+"), lambda t: t != "")
    one = F.transform(F.filter(words, lambda t: t.endswith("s") & (F.length(t) > 3)), lambda t: t.substr(F.lit(1), F.length(t) - 1))
    q = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.concat(words, one))).alias("token"))
    each = foods.groupBy("description").agg(F.min("fdc_id").alias("fdc_id"))
    return q.join(token_index(each), "token").select("name", "fdc_id").distinct().join(each, "fdc_id")


def search(names: DataFrame, foods: DataFrame, n: int = 1, threshold: float | None = 60.0, partial: bool = False) -> DataFrame:
    """(name, place, fdc_id, description, score) of the n best foods; raw and plain foods gain, dishes and long descriptions lose.

    The threshold holds for the plain similarity.  Ties go to the smallest fdc_id.  With partial, the best window counts,
    and gains and losses are gentler.
    """
    raw, plain, dish, per_char = (15.0, 8.0, 15.0, 0.2) if partial else (20.0, 10.0, 20.0, 0.4)
    c = candidates(names, foods).withColumn("_d", F.lower("description")).withColumn("_q", F.lower(F.trim("name")))
    if threshold is not None and not partial:
        c = c.where(similarity.ratio_bound("_q", "_d") >= threshold)
    sim = similarity.partial_ratio("_q", "_d") if partial else similarity.token_sort_ratio("_q", "_d")
    c = c.withColumn("_s", sim)
    if threshold is not None:
        c = c.where(F.col("_s") >= threshold)
    asked = F.split("_q", r"\s+")
    is_dish = F.exists(F.array(*(F.lit(w) for w in DISHES)), lambda w: F.col("_d").contains(w) & ~F.array_contains(asked, w))
    gain = F.when(F.col("_d").contains(", raw"), raw).when(F.col("_d").endswith("nfs") | F.col("_d").contains(", nfs"), plain).otherwise(0.0)
    c = c.withColumn("score", F.col("_s") + gain - F.when(is_dish, dish).otherwise(0.0) - F.length("_d") * per_char)
    w = Window.partitionBy("name").orderBy(F.desc("score"), "fdc_id")
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("name", "place", "fdc_id", "description", "score")


def bilingual_search(names: DataFrame, foods: DataFrame, threshold: float = 55.0) -> DataFrame:
    """names(name), foods(code, ord, name_en, name_fr) -> (name, code, food, score) of the best food of a list in two languages.

    Foods that share a word of more than two letters with the name, in either language, are scored by their better window
    similarity; all words found gain 15, plain preparations 10, names of more than 60 characters lose 5.  Ties go to the
    least ord.  Null names and foods without an English name match nothing; a null French name has a similarity of 0.
    """
    foods = foods.select("code", "ord", F.trim("name_en").alias("name_en"), F.coalesce(F.lower(F.trim("name_fr")), F.lit("")).alias("_fr")).where("name_en <> ''").withColumn("_en", F.lower("name_en"))
    words = F.transform(F.split(F.concat_ws(" ", "_en", "_fr"), r"[\s,;/()\-]+"), lambda t: F.btrim(t, F.lit("'.:*[]")))
    words = F.filter(words, lambda t: F.length(t) > 2)
    one = lambda a: F.transform(F.filter(a, lambda t: t.endswith("s") & (F.length(t) > 3)), lambda t: t.substr(F.lit(1), F.length(t) - 1))
    asked = F.filter(F.split("_q", r"\s+"), lambda t: F.length(t) > 2)
    q = names.select("name").distinct().withColumn("_q", F.lower(F.trim("name"))).select("name", "_q", F.explode(F.array_distinct(F.concat(asked, one(asked)))).alias("_t"))
    index = foods.select("ord", F.explode(F.array_distinct(F.concat(words, one(words)))).alias("_t"))
    c = cut(q.join(index, "_t").select("name", "_q", "ord").distinct().join(foods, "ord"))
    # Names repeat from food to food, those of the other language most of all: a pair of strings is compared once.
    english = c.select("_q", "_en").distinct().withColumn("_e", similarity.partial_ratio("_q", "_en"))
    french = c.where("_fr <> ''").select("_q", "_fr").distinct().withColumn("_f", similarity.partial_ratio("_q", "_fr"))
    c = c.join(english, ["_q", "_en"]).join(french, ["_q", "_fr"], "left")
    c = c.withColumn("_s", F.greatest("_e", F.coalesce("_f", F.lit(0.0)))).where(F.col("_s") >= threshold)
    every = F.forall(asked, lambda t: F.contains("_en", t) | F.contains("_fr", t))
    plain = F.col("_en").rlike("raw|dried|flour|fresh|boiled")
    c = c.withColumn("score", F.col("_s") + F.when(every, 15.0).otherwise(0.0) + F.when(plain, 10.0).otherwise(0.0) - F.when(F.length("name_en") > 60, 5.0).otherwise(0.0))
    best = c.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "code", "name_en")).alias("b"))
    return best.select("name", "b.code", F.col("b.name_en").alias("food"), (-F.col("b.s")).alias("score"))


def first_rule(names: DataFrame, rules: DataFrame) -> DataFrame:
    """names(name), rules(priority, keyword, food) -> each distinct name with the food of its first keyword that it contains; null without any."""
    distinct = names.select("name").distinct()
    # Rules are a list that people keep; names are not.
    hits = distinct.join(F.broadcast(rules), F.col("name").contains(F.col("keyword"))).groupBy("name").agg(F.min(F.struct("priority", "keyword", "food")).alias("b"))
    return distinct.join(hits, "name", "left").select("name", "b.keyword", "b.food")


def match(names: DataFrame, curated: DataFrame, pool: DataFrame | None, keys: float = 78.0, foods: float = 70.0) -> DataFrame:
    """names(name), curated(key, food, fdc_id), pool(fdc_id, description) -> (name, food, fdc_id, match_type): by the ladder of keys, by similarity to a key, by similarity to a food of the pool.

    Of keys and descriptions that are as similar the one of the least fdc_id counts.
    """
    key = curated.groupBy("key").agg(F.min(F.struct("fdc_id", "food")).alias("ord"))
    similar = lambda which, threshold: lambda left: match_fuzzy(left, which, threshold).select("name", "ord.food", "ord.fdc_id", "match_type")
    steps = [("manual_match", lambda left: match_ladder(left, curated)), ("fuzzy", similar(key, keys))]
    if pool is not None:
        food = pool.groupBy(F.lower("description").alias("key")).agg(F.min(F.struct("fdc_id", F.col("description").alias("food"))).alias("ord"))
        steps.append(("fuzzy", similar(food, foods)))
    return layers(names, steps).where("match_type <> 'no_match'").drop("code")


Layer = tuple[str, Callable[[DataFrame], DataFrame]]


def layers(names: DataFrame, steps: list[Layer]) -> DataFrame:
    """(name, fdc_id, code, food, match_type): each step sees only the names that no step before it has resolved.

    A step takes (name) and gives (name, fdc_id or code, maybe food and match_type); without one its label becomes
    match_type, and ``no_match`` what is left.  What a step finds is stored before the next one runs.
    """
    left, out = cut(names.select("name").distinct()), None
    for label, step in steps:
        found = step(left)
        null = lambda t: F.lit(None).cast(t)
        of = lambda c, t, found=found, null=null: (F.col(c).cast(t) if c in found.columns else null(t)).alias(c)
        kind = F.col("match_type") if "match_type" in found.columns else F.lit(label)
        found = cut(found.select("name", of("fdc_id", "long"), of("code", "string"), of("food", "string"), kind.alias("match_type")))
        out = found if out is None else out.unionByName(found)
        left = left.join(found, "name", "left_anti")
    rest = left.select("name", F.lit(None).cast("long").alias("fdc_id"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("food"), F.lit("no_match").alias("match_type"))
    return rest if out is None else out.unionByName(rest)


def clean_names(names: DataFrame, proxies: DataFrame, brands: list[str], noise: list[str]) -> DataFrame:
    """names(name), proxies(local, proxy, display) -> each distinct name with cleaned, tag and display.

    A local name gives way to its proxy, with its brand or without; any other name loses brands and noise (patterns, in
    their order), unwraps brackets and is trimmed.  Patterns are a list that people keep; proxies are joined as a table, of one local name the least counts.
    """
    low = F.lower(F.trim("name"))
    bare = low
    for p in brands:
        bare = F.regexp_replace(bare, rf"(?i)^{p}\s+", "")
    df = names.select("name").distinct().withColumns({"_a": low, "_b": F.trim(bare)})
    p = proxies.groupBy("local").agg(F.min(F.struct("proxy", "display")).alias("p"))
    df = df.join(p.select(F.col("local").alias("_a"), F.col("p").alias("_pa")), "_a", "left").join(p.select(F.col("local").alias("_b"), F.col("p").alias("_pb")), "_b", "left")
    quiet = F.col("_b")
    for x in noise:
        quiet = F.regexp_replace(quiet, rf"(?i){x}", " ")
    # Most names have no noise; one look at all patterns together spares them the rest.
    quiet = F.when(F.col("_b").rlike("(?i)" + "|".join(f"(?:{x})" for x in noise)), quiet).otherwise(F.col("_b")) if noise else quiet
    quiet = F.btrim(F.regexp_replace(F.regexp_replace(quiet, r"\(([^)]+)\)", "$1"), r"\s{2,}", " "), F.lit(" .,_-"))
    hit = F.coalesce("_pa", "_pb")
    return df.select("name", F.coalesce(hit["proxy"], quiet).alias("cleaned"), F.when(hit.isNotNull(), "african_proxy").otherwise("cleaned").alias("tag"), F.coalesce(hit["display"], quiet).alias("display"))


def proxy_dimension(proxies: DataFrame, regions: DataFrame, default: str = "Africa") -> DataFrame:
    """One row a local name, with its region or the default."""
    return proxies.join(F.broadcast(regions), "local", "left").withColumn("region", F.coalesce("region", F.lit(default))).dropDuplicates(["local"])
