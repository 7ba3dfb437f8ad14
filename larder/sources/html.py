"""Recipe pages to recipes: structured data blocks, plugin markup, microdata, and the first that works."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import col, cooking_methods, entities_decoded, glyphs_expanded, yield_count
from larder.sources import markup

MOST_INGREDIENTS = 100


def plain(c) -> Column:
    return F.trim(F.regexp_replace(entities_decoded(F.regexp_replace(col(c), r"<[^>]+>", " ")), r"\s+", " "))


def plain_list(a: Column) -> Column:
    return F.slice(F.filter(F.transform(a, plain), lambda x: x.isNotNull() & (x != "")), 1, MOST_INGREDIENTS)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _first_text(v: Column, path: str) -> Column:
    """A string, or the first of a list of strings."""
    return F.coalesce(F.try_element_at(F.try_variant_get(v, path, "array<string>"), F.lit(1)), F.try_variant_get(v, path, "string"))


def jsonld(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, title, ingredients, servings, image) of the first Recipe node of the page's ld+json blocks.

    Lists and @graph are flattened; bad blocks and pages without such a node give no row.
    """
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    b = pages.select("url", F.posexplode(blocks).alias("block", "json")).withColumn("v", F.try_parse_json("json"))
    many = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    n = b.where("v is not null").select("url", "block", F.posexplode(many).alias("node", "v"))
    inner = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.array("v"))
    n = n.select("url", "block", "node", F.posexplode(inner).alias("sub", "v"))
    kinds = F.coalesce(F.try_variant_get("v", "$['@type']", "array<string>"), F.array(_text(F.col("v"), "$['@type']")))
    lines = plain_list(F.try_variant_get("v", "$.recipeIngredient", "array<string>"))
    image = F.coalesce(_text(F.col("v"), "$.image.url"), _first_text(F.col("v"), "$.image"), _text(F.col("v"), "$.image[0].url"))
    n = n.where(F.exists(kinds, lambda k: F.lower(k) == "recipe")).select("url", "block", "node", "sub", plain(_text(F.col("v"), "$.name")).alias("title"), lines.alias("ingredients"), yield_count(_first_text(F.col("v"), "$.recipeYield")).alias("servings"), image.alias("image"))
    first = n.where(F.size("ingredients") > 0).groupBy("url").agg(F.min_by(F.struct("title", "ingredients", "servings", "image"), F.struct("block", "node", "sub")).alias("r"))
    return first.select("url", "r.*")


PLUGIN_PARTS = ("amount", "unit", "name", "notes")
PLUGIN_RULES: dict[str, markup.Rule] = {"item": ("li", "class", "wprm-recipe-ingredient"), "title": (None, "class", "wprm-recipe-name"), "servings": (None, "class", "wprm-recipe-servings"), **{f"item/{p}": (None, "class", f"wprm-recipe-ingredient-{p}") for p in PLUGIN_PARTS}}


def _plugin_page(found: list, text: str) -> dict:
    lines = [" ".join(x for x in i.values() if x) for i in markup.items(found, "item", PLUGIN_PARTS) if i["name"]]
    first = lambda name: next((t for n, _, t in found if n == name), None)
    return {"title": first("title"), "ingredients": lines[:MOST_INGREDIENTS], "stated": first("servings")}


def wprm(pages: DataFrame) -> DataFrame:
    """pages(url, html): recipe-plugin list items: amount, unit, name and notes, joined; items without a name are dropped.

    Pages whose parts hold spans of their own go through a tree parser, all others through regular expressions.
    """
    nested = F.coalesce(F.col("html").rlike(r"(?is)wprm-recipe-(?:ingredient-(?:amount|unit|name|notes)|name|servings)[^>]*>[^<]*<span"), F.lit(False))
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*wprm-recipe-ingredient[\"\s][^>]*>(.*?)</li>"), F.lit(1))

    def part(item: Column, which: str) -> Column:
        return plain(F.regexp_extract(item, rf"(?is)wprm-recipe-ingredient-{which}[^>]*>(.*?)</span>", 1))

    lines = F.transform(F.filter(items, lambda i: part(i, "name") != ""), lambda i: F.concat_ws(" ", *(F.nullif(part(i, w), F.lit("")) for w in PLUGIN_PARTS)))
    title = plain(F.regexp_extract("html", r"(?is)wprm-recipe-name[^>]*>(.*?)</", 1))
    flat = pages.where(~nested).select("url", title.alias("title"), F.slice(lines, 1, MOST_INGREDIENTS).alias("ingredients"), yield_count(F.regexp_extract("html", r"(?is)wprm-recipe-servings[^>]*>(.*?)</", 1)).alias("servings"))
    deep = markup.over_pages(pages.where(nested), "url", PLUGIN_RULES, "title string; ingredients array<string>; stated string", _plugin_page)
    both = flat.unionByName(deep.select("url", F.coalesce("title", F.lit("")).alias("title"), "ingredients", yield_count("stated").alias("servings")))
    return both.where(F.size("ingredients") > 0)


# How a site with structured lists marks their parts.
SITE_PARTS = ("quantity", "unit", "name")
SITE_RULES: dict[str, markup.Rule] = {"title": ("h1", None, None), "servings": (None, "data-ingredient-serving-size", None), "item": ("li", "class", "mm-recipes-structured-ingredients__list-item"), **{f"item/{p}": (None, f"data-ingredient-{p}", "true") for p in SITE_PARTS}, "steps": ("div", "class", "mm-recipes-steps__content"), "steps/p": ("p", None, None)}
LEAST_STEP = 20


def _site_page(found: list, text: str) -> dict:
    first = lambda name: next((t for n, _, t in found if n == name), "")
    stated = re.search(r"(?i)([0-9]+)\s+servings?", text)
    return {
        "title": first("title"),
        "servings": first("servings") or (stated[1] if stated else ""),
        "ingredients": [" ".join(x for x in i.values() if x) for i in markup.items(found, "item", SITE_PARTS)],
        "directions": " ".join(t for n, _, t in found if n == "steps/p" and len(t) > LEAST_STEP),
    }


def site_lists(pages: DataFrame, key: str = "url") -> DataFrame:
    """pages(key, html) -> (key, title, servings, ingredients, directions, cooking_methods) of a site's structured lists.

    Ingredients are quantity, unit and name with fractions written out; directions are steps of more than 20 characters.
    Pages without such lists give empty ones; a null page is an empty one.
    """
    out = markup.over_pages(pages, key, SITE_RULES, "title string; servings string; ingredients array<string>; directions string", _site_page)
    return out.withColumns({"ingredients": F.transform("ingredients", lambda x: F.trim(glyphs_expanded(x))), "cooking_methods": cooking_methods("directions")})


def microdata(pages: DataFrame) -> DataFrame:
    lines = plain_list(F.regexp_extract_all("html", F.lit(r"(?is)itemprop=[\"'](?:recipeIngredient|ingredients)[\"'][^>]*>(.*?)</"), F.lit(1)))
    return pages.select("url", plain(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"), lines.alias("ingredients")).where(F.size("ingredients") > 0)


def best(pages: DataFrame) -> DataFrame:
    """Every page with the first strategy that works, as status and recipe; ``no_recipe`` where none does."""
    found = None
    for rank, (label, f) in enumerate((("jsonld", jsonld), ("wprm", wprm), ("microdata", microdata))):
        one = f(pages).select("url", F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("strategy"), "title", "ingredients").alias("r"))
        found = one if found is None else found.unionByName(one)
    first = found.groupBy("url").agg(F.min_by("r", "r.rank").alias("r"))
    return pages.select("url").distinct().join(first, "url", "left").select("url", F.coalesce("r.strategy", F.lit("no_recipe")).alias("status"), "r.title", "r.ingredients")


def instructions(v: Column) -> Column:
    """Text of a recipe's instructions: one string, or a list of strings, steps or sections of steps."""
    steps = F.try_variant_get(v, "$.recipeInstructions", "array<variant>")
    one = lambda s: F.coalesce(F.array_join(F.transform(F.try_variant_get(s, "$.itemListElement", "array<variant>"), lambda x: _text(x, "$.text")), " "), _text(s, "$.text"), _text(s, "$"))
    return plain(F.coalesce(F.array_join(F.transform(steps, one), " "), _text(v, "$.recipeInstructions")))


def image_url(html) -> Column:
    """The page's og:image, whichever way round its attributes are, else twitter:image; null without either."""
    h = col(html)
    get = lambda p: F.nullif(F.regexp_extract(h, p, 1), F.lit(""))
    out = []
    for k in ("og:image", "twitter:image"):
        out += [get(rf"(?is)<meta[^>]*(?:property|name)=[\"']{k}[\"'][^>]*content=[\"']([^\"']+)"), get(rf"(?is)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*(?:property|name)=[\"']{k}[\"']")]
    return F.coalesce(*out)


def links(pages: DataFrame, slashes: int = 4, without: tuple[str, ...] = ("category", "tag", "author", "page")) -> DataFrame:
    """Distinct links of articles: with just so many slashes and none of the words between two of them."""
    href = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))).alias("link"))
    keep = (F.length("link") - F.length(F.replace(F.col("link"), F.lit("/"), F.lit("")))) == slashes
    for w in without:
        keep = keep & ~F.col("link").contains(f"/{w}/")
    return href.where(keep).distinct()


def listed(html, tag: str = "li") -> Column:
    """Plain text of each element of a kind, blanks dropped."""
    return F.filter(F.transform(F.regexp_extract_all(col(html), F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), plain), lambda x: x != "")
