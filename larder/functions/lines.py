"""Ingredient lines to quantities, units, names and grams, as column expressions.

Unit tables are parameters: batch sources and single lines weigh some units differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import col, glyphs_expanded, lit_map, remainder_name

# Grams of units, grams of counted things, millilitres of volumes.
_SPOONS = {"tsp": 5.0, "teaspoon": 5.0, "teaspoons": 5.0, "tbsp": 15.0, "tablespoon": 15.0, "tablespoons": 15.0, "cup": 240.0, "cups": 240.0}
BATCH_UNITS = {**_SPOONS, "ml": 1.0, "l": 1000.0, "litre": 1000.0, "liter": 1000.0, "oz": 28.35, "pound": 454.0, "pounds": 454.0, "lb": 454.0, "lbs": 454.0}
BATCH_COUNTS = {"large": 150.0, "medium": 110.0, "small": 70.0, "clove": 4.0, "cloves": 4.0, "piece": 100.0, "pieces": 100.0, "slice": 30.0, "slices": 30.0, "punnet": 200.0, "bunch": 100.0, "sprig": 5.0, "sprigs": 5.0, "leaf": 2.0, "leaves": 3.0, "stalk": 40.0, "stalks": 40.0, "head": 200.0, "can": 400.0, "tin": 400.0, "packet": 7.0, "egg": 55.0, "eggs": 55.0}
LIVE_UNITS = {**_SPOONS, "g": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kilogram": 1000.0, "oz": 28.35, "ounce": 28.35, "ounces": 28.35, "lb": 453.6, "lbs": 453.6, "pound": 453.6, "pounds": 453.6, "ml": 1.0, "l": 1000.0, "litre": 1000.0, "ts": 5.0, "tbs": 15.0, "pinch": 0.35, "pinches": 0.35, "dash": 0.6, "dashes": 0.6, "drop": 0.05, "drops": 0.05}
LIVE_COUNTS = {"clove": 4.0, "cloves": 4.0, "piece": 100.0, "pieces": 100.0, "slice": 30.0, "slices": 30.0, "egg": 55.0, "eggs": 55.0, "bunch": 100.0, "head": 200.0, "large": 150.0, "medium": 110.0, "small": 70.0, "stalk": 40.0, "stalks": 40.0, "sprig": 5.0, "sprigs": 5.0, "can": 400.0, "cans": 400.0, "tin": 400.0, "tins": 400.0}
VOLUME_ML = {"ml": 1.0, "l": 1000.0, "litre": 1000.0, "liter": 1000.0, "tsp": 5.0, "teaspoon": 5.0, "teaspoons": 5.0, "ts": 5.0, "tbsp": 15.0, "tablespoon": 15.0, "tablespoons": 15.0, "tbs": 15.0, "cup": 240.0, "cups": 240.0}
TRAILING_UNITS = ("cloves", "clove", "pieces", "piece", "slices", "slice", "cans", "can", "tins", "tin", "stalks", "stalk", "sprigs", "sprig")
PARSE_UNITS = {**_SPOONS, "oz": 28.35, "ounce": 28.35, "ounces": 28.35, "pound": 454.0, "pounds": 454.0, "lb": 454.0, "lbs": 454.0, "g": 1.0, "gram": 1.0, "grams": 1.0, "ml": 1.0, "l": 1000.0, "kg": 1000.0, "clove": 4.0, "cloves": 4.0, "large": 150.0, "medium": 110.0, "small": 70.0, "can": 400.0, "cans": 400.0, "piece": 100.0, "pieces": 100.0, "slice": 30.0, "slices": 30.0, "bunch": 100.0, "head": 200.0, "heads": 200.0, "sprig": 5.0, "sprigs": 5.0, "pinch": 0.5, "dash": 0.5, "handful": 30.0, "package": 100.0, "packages": 100.0, "packet": 100.0, "packets": 100.0, "stalk": 40.0, "stalks": 40.0}

MIXED, FRACTION, PLAIN = r"([0-9]+)\s+([0-9]+)/([0-9]+)", r"([0-9]+)/([0-9]+)", r"([0-9]+(?:\.[0-9]*)?)"


def number(c, pattern_end: str = "") -> Column:
    """The number at the start: mixed, fraction or decimal; a zero denominator is no fraction."""
    t = col(c)
    g = lambda p, i: F.regexp_extract(t, rf"^\s*{p}{pattern_end}", i).try_cast("double")
    return F.coalesce(g(MIXED, 1) + F.try_divide(g(MIXED, 2), g(MIXED, 3)), F.try_divide(g(FRACTION, 1), g(FRACTION, 2)), g(PLAIN, 1))


def after_number(c) -> Column:
    t = col(c)
    return F.when(t.rlike(rf"^\s*{MIXED}") & (F.regexp_extract(t, rf"^\s*{MIXED}", 3).try_cast("int") != 0), F.regexp_replace(t, rf"^\s*{MIXED}\s*", "")).when(
        t.rlike(rf"^\s*{FRACTION}") & (F.regexp_extract(t, rf"^\s*{FRACTION}", 2).try_cast("int") != 0), F.regexp_replace(t, rf"^\s*{FRACTION}\s*", "")
    ).otherwise(F.regexp_replace(t, rf"^\s*{PLAIN}\s*", ""))


def first_word(c) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(col(c), r"^\s*(\S+)", 1)), F.lit(".,"))


def metric(value: Column, unit: Column) -> Column:
    return value.try_cast("double") * F.when(F.lower(unit).isin("kg", "l"), 1000.0).otherwise(1.0)


def extracted(df: DataFrame, raw: str = "raw", units: dict[str, float] = BATCH_UNITS, counts: dict[str, float] = BATCH_COUNTS) -> DataFrame:
    """df with grams_total and extraction_method: bracketed metric, leading metric, pounds, volume or weight unit, counted item; else no_match, or blank."""
    t = F.trim(glyphs_expanded(raw))
    inside = r"(?i)\(\s*([0-9.]+)\s*(g|ml|kg|l)\s*\)"
    start = r"(?i)^\s*([0-9.]+)\s*(g|ml|kg|l)\b"
    bracketed = F.coalesce(metric(F.regexp_extract(t, inside, 1), F.regexp_extract(t, inside, 2)), F.regexp_extract(t, r"(?i)\[\s*([0-9]+)-?g\s*\]", 1).try_cast("double"))
    leading = metric(F.regexp_extract(t, start, 1), F.regexp_extract(t, start, 2))
    word = first_word(after_number("_line"))
    quantity = number("_line")
    pounds = F.when(word.isin("lb", "lbs", "pound", "pounds"), quantity * 454)
    df = df.withColumn("_line", t).withColumns({"_b": bracketed, "_l": leading, "_p": pounds, "_u": quantity * F.try_element_at(lit_map(units), word), "_c": quantity * F.try_element_at(lit_map(counts), word)})
    method = F.when(F.coalesce("_line", F.lit("")) == "", "blank")
    for c, label in (("_b", "bracketed_metric"), ("_l", "leading_metric"), ("_p", "pound_conversion"), ("_u", "volume_unit"), ("_c", "count_estimate")):
        method = method.when(F.col(c).isNotNull(), label)
    df = df.withColumns({"grams_total": F.round(F.coalesce("_b", "_l", "_p", "_u", "_c").cast("decimal(20,8)"), 2).cast("double"), "extraction_method": method.otherwise("no_match")})
    return df.drop("_line", "_b", "_l", "_p", "_u", "_c")


def parsed_batch(df: DataFrame, raw: str = "raw", units: dict[str, float] = PARSE_UNITS, ranges: str = "none") -> DataFrame:
    """df with measure_only, grams and remainder.  A bracketed weight wins; a bare count has no grams.

    ranges: ``none``, or the characters that join two ends whose middle counts (``-`` or ``-–``).
    """
    t = F.trim(F.col(raw))
    inside = r"(?i)\(\s*([0-9.]+)\s*(g|ml|oz|ounces?|kg|lbs?|pounds?)\s*\)"
    table = lit_map(units)
    bracket = F.regexp_extract(t, inside, 1).try_cast("double") * F.try_element_at(table, F.lower(F.regexp_extract(t, inside, 2)))
    t = F.when(bracket.isNotNull(), F.trim(F.regexp_replace(t, r"\s*\([^)]*\)", ""))).otherwise(t)
    if ranges != "none":
        two = rf"^([0-9]+(?:\.[0-9]+)?)\s*[{ranges}]\s*([0-9]+(?:\.[0-9]+)?)"
        mid = (F.regexp_extract(t, two, 1).try_cast("double") + F.regexp_extract(t, two, 2).try_cast("double")) / 2
        t = F.when(mid.isNotNull(), F.concat(F.regexp_replace(mid.cast("string"), r"\.0$", ""), F.regexp_replace(t, two, ""))).otherwise(t)
    unit_re = "|".join(sorted(units, key=len, reverse=True))
    full = rf"(?i)^([0-9]+\s+[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]*)?)\s+({unit_re})\b\s*(.*)$"
    bare = r"^([0-9]+(?:\.[0-9]*)?|[0-9]+/[0-9]+)\s+(.*)$"
    df = df.withColumns({"_t": t, "_b": F.round(bracket.cast("decimal(20,8)"), 2).cast("double")})
    unit = F.lower(F.regexp_extract("_t", full, 2))
    grams = F.round((number(F.regexp_extract("_t", full, 1)) * F.try_element_at(table, unit)).cast("decimal(20,8)"), 2).cast("double")
    known, counted = F.col("_t").rlike(full), F.col("_t").rlike(bare)
    return df.withColumns({
        "measure_only": F.when(known, F.concat_ws(" ", F.regexp_extract("_t", full, 1), unit)).when(counted, F.regexp_extract("_t", bare, 1)).otherwise(""),
        "grams": F.coalesce("_b", F.when(known, grams)),
        "remainder": F.when(known, F.regexp_extract("_t", full, 3)).when(counted, F.regexp_extract("_t", bare, 2)).otherwise(F.col("_t")),
    }).drop("_t", "_b")


def parsed_live(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with qty, unit, volume_ml, name_raw and grams of a line as a person types it; a bare count weighs 150 g each."""
    units, counts, volumes = lit_map(LIVE_UNITS), lit_map(LIVE_COUNTS), lit_map(VOLUME_ML)
    t = F.trim(F.col(raw))
    df = df.withColumn("_t", F.trim(glyphs_expanded(t)))
    glued = r"(?i)^([0-9]+(?:\.[0-9]*)?)(g|kg|ml|l)\s+(.*)$"
    is_glued = F.col("_t").rlike(glued)
    df = df.withColumns({"_q": F.when(is_glued, F.regexp_extract("_t", glued, 1).try_cast("double")).otherwise(F.coalesce(number("_t"), F.lit(0.0))), "_rest": F.when(is_glued, F.regexp_extract("_t", glued, 3)).otherwise(after_number("_t")), "_u": F.when(is_glued, F.lower(F.regexp_extract("_t", glued, 2)))})
    word = first_word("_rest")
    is_unit = F.col("_u").isNull() & (F.try_element_at(units, word).isNotNull() | F.try_element_at(counts, word).isNotNull())
    df = df.withColumns({"_u": F.when(is_unit, word).otherwise(F.col("_u")), "_rest": F.when(is_unit, F.regexp_replace("_rest", r"^\s*\S+\s*", "")).otherwise(F.col("_rest"))})
    rest = F.trim(F.regexp_replace("_rest", r"(?i)^of\s", ""))
    name = F.when(rest == "", t).otherwise(F.trim(F.split_part(F.split_part(rest, F.lit(","), F.lit(1)), F.lit(" or "), F.lit(1))))
    name = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    leak = r"(?i)^([0-9]+(?:\.[0-9]*)?)\s*(oz|fl\s*oz|g|kg|ml|l)\s+"
    name = F.when(name.rlike(leak), F.regexp_replace(F.regexp_replace(name, leak, ""), r"(?i)^(can|tin|jar|bottle|bag|packet)\s+of\s+", "")).otherwise(name)
    df = df.withColumn("_n", name)
    last = F.lower(F.regexp_extract("_n", r"\s(\S+)$", 1))
    trailing = F.col("_u").isNull() & last.isin(*TRAILING_UNITS)
    df = df.withColumns({"_u": F.coalesce(F.when(trailing, last).otherwise(F.col("_u")), F.lit("")), "_n": F.when(trailing, F.regexp_replace("_n", r"\s+\S+$", "")).otherwise(F.col("_n"))})
    qty = F.when((F.col("_q") == 0) & F.try_element_at(units, F.col("_u")).isNotNull(), 1.0).otherwise(F.col("_q"))
    df = df.withColumn("qty", qty).withColumn("unit", F.col("_u")).withColumn("name_raw", F.coalesce("_n", F.lit("")))
    positive = F.col("qty") > 0
    volume = F.when(positive, F.col("qty") * F.try_element_at(volumes, F.col("unit")))
    weight = F.coalesce(F.try_element_at(units, F.col("unit")), F.try_element_at(counts, F.col("unit")), F.when(F.col("unit") == "", 150.0))
    return df.withColumn("volume_ml", volume).withColumn("grams", F.coalesce(volume, F.when(positive, F.col("qty") * weight))).drop("_t", "_q", "_rest", "_u", "_n")


def exploded(df: DataFrame, joined: str, sep: str = "|") -> DataFrame:
    """A row a line of the joined list: trimmed, blanks dropped, then numbered from 1."""
    parts = F.filter(F.transform(F.split(joined, rf"\Q{sep}\E"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(*(c for c in df.columns if c != joined), F.posexplode(parts).alias("_p", "raw")).withColumn("ingredient_index", F.col("_p") + 1).drop("_p")


def fallback_grams(actual, measure, units: dict[str, float] = BATCH_UNITS, counts: dict[str, float] = BATCH_COUNTS) -> Column:
    """``N g`` or ``N ml`` of the actual measure first, else quantity by unit of the plain one."""
    pattern = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(g|ml)\b"
    return F.coalesce(F.regexp_extract(col(actual), pattern, 1).try_cast("double"), number(measure) * F.try_element_at(lit_map({**units, **counts}), first_word(after_number(measure))))


__all__ = ["exploded", "extracted", "fallback_grams", "number", "parsed_batch", "parsed_live", "remainder_name"]
