"""Column expressions over names, lines, urls and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with a meaning in ingredient names.
MEASURE_UNITS = "cup cups tbsp tablespoon tablespoons tsp teaspoon teaspoons g kg oz ml l lb lbs pound pounds pinch clove cloves can cans slice slices piece pieces".split()
LEADING_UNITS = "cup cups tbsp tablespoon tablespoons tsp teaspoon teaspoons ml l g kg oz lb lbs gram grams kilogram kilograms pinch pinches dash clove cloves can cans slice slices piece pieces".split()
FILLER = "to taste optional for serving plus more needed and or of the a an into in with without from on at it its".split()
PREPARED = "chopped minced diced sliced crushed freshly roughly finely thinly thickly grated peeled rinsed drained divided halved quartered cubed cut soaked torn softened melted beaten mashed".split()
FORMS = {"fresh": "fresh", "powder": "powder", "powdered": "powder", "ground": "ground", "dried": "dried", "dry": "dried", "paste": "paste", "puree": "puree", "canned": "canned", "can": "canned", "tinned": "canned", "whole": "whole", "frozen": "frozen", "smoked": "smoked", "toasted": "toasted"}
SAME_PLURAL = ("couscous", "molasses", "bass")
COOKING = ["boil", "bake", "fry", "deep fry", "deep-fry", "steam", "grill", "roast", "simmer", "stew", "poach", "braise", "smoke", "toast", "saute", "sauté", "microwave", "pressure cook", "slow cook", "blend", "marinate", "broil", "knead", "stir-fry"]
GLYPHS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&frac12;": "½", "&frac14;": "¼", "&frac34;": "¾", "&ndash;": "–", "&amp;": "&"}


def lit_map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def standard_units(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"(?i)\b(tsps|tsp)\b", "teaspoon"), r"(?i)\b(tbsps|tbsp|tbs)\b", "tablespoon")


def paren_measure(c) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(c), r"\(([^)]*)\)", 1)), F.lit(""))


def without_parens(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"\([^)]*\)", ""), r"\s+", " "))


def measure_only(c) -> Column:
    """The leading quantity with its unit, null where either is missing."""
    unit = "|".join(sorted(MEASURE_UNITS, key=len, reverse=True))
    return F.nullif(F.regexp_extract(F.lower(col(c)), rf"^\s*((?:[0-9]+ [0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?) (?:{unit}))\b", 1), F.lit(""))


def url_key(c) -> Column:
    low = F.regexp_replace(F.lower(F.trim(col(c))), "/+$", "")
    return F.regexp_replace(F.regexp_replace(low, "^https?://", ""), r"^www\.", "")


def glyphs_expanded(c) -> Column:
    """Fraction characters as n/d; after a figure a blank comes between."""
    out = col(c)
    for g, v in GLYPHS.items():
        out = F.replace(F.regexp_replace(out, rf"(?<=[0-9]){g}", f" {v}"), F.lit(g), F.lit(v))
    return out


def entities_decoded(c) -> Column:
    out = col(c)
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def scraped_line(c) -> Column:
    """Without tags and entities; of two measures joined by a slash the first; of a range of a weight the lower end; single blanks."""
    out = entities_decoded(F.regexp_replace(col(c), r"<[^>]+>", " "))
    out = F.regexp_replace(out, r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(g|kg|ml|l)\s*/\s*\S+", "$1 $2")
    out = F.regexp_replace(out, r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*[-–]\s*[0-9]+(?:\.[0-9]+)?\s*(g|kg|ml|l)\b", "$1 $2")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def servings(c) -> Column:
    """``A TO B``: their middle, half to even; a dash: the lower; a loaf or cups: 8; 1 to 50: itself; else 4."""
    t = F.upper(F.trim(col(c)))
    lo, hi = (F.regexp_extract(t, r"([0-9]+)\s*TO\s*([0-9]+)", i).try_cast("int") for i in (1, 2))
    dash = F.regexp_extract(t, r"([0-9]+)\s*[–-]\s*[0-9]+", 1).try_cast("int")
    n = F.regexp_extract(t, r"([0-9]+)", 1).try_cast("int")
    return (
        F.when(lo.isNotNull(), F.bround((lo + hi) / 2, 0).cast("int"))
        .when(dash.isNotNull(), dash)
        .when(n.isNotNull() & (t.contains("LOAF") | t.contains("CUP")), 8)
        .when(n.between(1, 50), n)
        .otherwise(4)
    )


def yield_count(c) -> Column:
    """The first whole number of a stated yield."""
    return F.regexp_extract(col(c), r"([0-9]+)", 1).try_cast("int")


def singular(t: Column) -> Column:
    return (
        F.when(t.isin(*SAME_PLURAL), t)
        .when(t.endswith("ies") & (F.length(t) > 4), F.concat(t.substr(F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(t.endswith("oes") & (F.length(t) > 4), t.substr(F.lit(1), F.length(t) - 2))
        .when(t.endswith("s") & (F.length(t) > 3), t.substr(F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )


def name_tokens(c) -> Column:
    low = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"\([^)]*\)", " "), r"[^a-z\s-]", " ")
    return F.filter(F.split(low, r"\s+"), lambda t: t != "")


def base_ingredient(c) -> Column:
    drop = F.array(*(F.lit(w) for w in (*FORMS, *PREPARED, *LEADING_UNITS, *FILLER)))
    kept = F.transform(F.filter(name_tokens(c), lambda t: ~F.array_contains(drop, t)), singular)
    return F.array_join(F.filter(kept, lambda t: F.length(t) > 1), " ")


def form(c) -> Column:
    """The first word that names a form, as its form; null without one."""
    forms = lit_map(FORMS)
    return F.try_element_at(F.filter(F.transform(name_tokens(c), lambda t: F.try_element_at(forms, t)), lambda x: x.isNotNull()), F.lit(1))


def lookup_key(c) -> Column:
    return F.concat_ws("|", base_ingredient(c), form(c))


def cooking_methods(c) -> Column:
    low = F.lower(col(c))
    return F.array_join(F.array_sort(F.filter(F.array(*(F.lit(w) for w in COOKING)), lambda w: low.contains(w))), ", ")


def remainder_name(c) -> Column:
    t = F.regexp_replace(F.split_part(col(c), F.lit(","), F.lit(1)), r"(?i)\s+for\s+.*$", "")
    t = F.regexp_replace(t, r"(?i)\s+(to\s+taste|as\s+needed|if\s+desired|optional)$", "")
    return F.btrim(F.regexp_replace(t, r"\s{2,}", " "), F.lit(" .,"))


def confidence(c) -> Column:
    t = col(c)
    pct = F.regexp_extract(t, r"^fuzzy_(?:[a-z]+_)?([0-9]+)%$", 1).try_cast("int")
    return F.when(t == "manual_match", "high").when(t == "user_override", "custom").when(t.isin("usda_search", "wafct"), "medium").when(pct >= 85, "medium").when(pct.isNotNull(), "low").otherwise("none")


def source_of(c, domains: dict[str, str], default: str = "other") -> Column:
    low = F.lower(col(c))
    out = F
    for d, label in domains.items():
        out = out.when(low.contains(d), label)
    return out.otherwise(default)
