"""Reading and writing the project's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.scoring import NUTRIENTS
from larder.sources.shared import exists, move, remove

SCRAPED = T.StructType([T.StructField(c, T.StringType()) for c in ("recipe_title", "servings", "ingredients", "cooking_methods", "source_url")])
NUTRIENT = "fdc_id bigint, nutrient_id int, amount double"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with a header, quoted commas and line feeds; blank is null.  Without a schema every column is a string.  A byte-order mark is no part of the first name."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def discover(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(source_url, ingredients) of those files that have an ingredients column and one with url in its name.

    paths: a folder, a pattern, or several paths.  Files are listed once and their first lines found in one pass; files of the same
    header are read together, so a plan has as many scans as there are headers.  Nothing that fits gives no row.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    out = spark.createDataFrame([], "source_url string, ingredients string")
    if not paths:
        return out
    first = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    heads = first.where("block = 0").groupBy("path").agg(F.min_by("value", "n").alias("head"))
    for head, own in heads.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("head").collect():  # names of files, as the listing has them
        names = [c.strip('"').lower() for c in head.lstrip("\ufeff").split(",")]
        if "ingredients" not in names or not any("url" in c for c in names):
            continue
        df = read_csv(spark, own)
        url = next(c for c in df.columns if "url" in c.lower())
        if "ingredients" in df.columns:
            out = out.unionByName(df.select(F.col(url).alias("source_url"), "ingredients"))
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def nutrient_prefilter(raw: DataFrame) -> DataFrame:
    """The six nutrients, with numbers for what can be read as numbers: no amount is 0, no id is no row."""
    df = raw.select(F.col("fdc_id").try_cast("bigint").alias("fdc_id"), F.col("nutrient_id").try_cast("int").alias("nutrient_id"), F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0)).alias("amount"))
    return df.where(F.col("nutrient_id").isin(*NUTRIENTS) & F.col("fdc_id").isNotNull())


def sitemap_urls(pages: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """Distinct urls of sitemap text that contain one of the keywords."""
    loc = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    return loc.where(F.exists(F.array(*(F.lit(k) for k in keywords)), lambda k: F.lower("url").contains(k))).distinct()


def food_table_clean(raw: DataFrame) -> DataFrame:
    """Rows of a printed food table as typed foods: bracketed values are values, traces are 0, marks for no data are null and then 0."""

    def value(c: str):
        v = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^\[(.*)\]$", "$1"), r"[*†‡§#].*$", "")))
        return F.when(v.isin("tr", "trace"), 0.0).when(v.isin("—", "-", "n.d.", "nd", "n/a", ""), None).otherwise(F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))

    numbers = ("energy_kcal", "protein_g", "fat_g", "carbohydrate_g", "sodium_mg")
    df = raw.select("code", F.trim("food_name_en").alias("food_name_en"), F.trim("food_name_fr").alias("food_name_fr"), *(value(c).alias(c) for c in numbers))
    df = df.where(F.col("code").rlike(r"^[0-9]{2}_[0-9]+") & (F.col("food_name_en") != "") & F.col("energy_kcal").isNotNull())
    return df.na.fill(0.0, list(numbers))


def replace_tables(frames: dict[str, DataFrame], database: str = "default", folder: str | None = None) -> dict[str, int]:
    """Puts tables in place of those of their names, and counts the rows of each in what was written.

    Every table is first written to a folder of its own, in ``folder`` or the warehouse; only when all are whole does the catalog point to
    them, and what it pointed to before goes last.  A failure before that leaves all tables as they were.  Frames may read the tables they replace.
    """
    spark = next(iter(frames.values())).sparkSession if frames else None
    made, out = {}, {}
    for name, df in frames.items():
        path = f"{folder or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made[name], out[name] = path, spark.read.schema(df.schema).parquet(path).count()
    for name, path in made.items():
        point(spark, f"{database}.{name}", path)
    return out


def point(spark: SparkSession, table: str, path: str) -> None:
    """Lets the catalog's table be the Parquet files at path, and removes those it was before."""
    old = None
    if spark.catalog.tableExists(table):
        detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        old = detail.get("Location")
        spark.sql(f"DROP TABLE {table}")
    spark.catalog.createTable(table, path=path, source="parquet")
    if old and old.rstrip("/") != path.rstrip("/"):
        remove(spark, old)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What ``write`` writes, in place of what path holds: beside it first, then renamed.  What was there goes last.

    A failure while writing leaves the old files; one between the two renames leaves them under the name of ``before``, and the
    next call puts them back first.
    """
    path = path.rstrip("/")
    before, new = f"{path}.before", f"{path}.{uuid.uuid4().hex}"
    if exists(spark, before):
        if exists(spark, path):
            remove(spark, before)
        else:
            move(spark, before, path)
    write(new)
    if exists(spark, path):
        move(spark, path, before)
    move(spark, new, path)
    remove(spark, before)


def overwrite(df: DataFrame, path: str) -> None:
    """df as Parquet in place of what path holds, which df may read."""
    swapped(df.sparkSession, path, lambda new: df.write.parquet(new))


def overwrite_csv(df: DataFrame, path: str) -> None:
    """df as CSV with a header in place of what path holds, which df may read."""
    swapped(df.sparkSession, path, lambda new: df.write.option("header", True).option("escape", '"').csv(new))
