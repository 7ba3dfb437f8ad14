"""Upkeep of dimension tables as sources are integrated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.shared import cut, forget

#: Counts of keys and ranges are sent around up to this many.
BROADCAST_ROWS = 100_000


def assign_ids(df: DataFrame, order: str, start: int, name: str) -> DataFrame:
    """Ids from start on, in that order, without moving all rows to one task: ranges of the order are numbered by themselves
    and shifted by how many rows come before them.  Rows of equal order are numbered in any order."""
    ranged = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").count()  # a row a partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = ranged.withColumn("_n", n).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.lit(start) + F.col("_before") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_before")


def ranked(df: DataFrame, key: str, order: list[Column], name: str, of: str | None = None) -> DataFrame:
    """df with each row's place among the rows of its key, from 1 on, and in ``of`` how many these are; a null key is a key.

    Ranges of (key, order) are ranked by themselves and shifted by what the key has in earlier ranges, so no task holds a key.
    """
    base = cut(df)
    # Stored in their order, rows are numbered by where they lie, and not moved once more for it.
    ranged = cut(base.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order))
    forget(base)
    ranged = ranged.withColumn("_n", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_n", 33))
    counts = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.count("*").alias("_c"), F.min("_n").alias("_first"))
    by = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_c").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("_key", "_p", "_first", before.alias("_before"), F.sum("_c").over(by).alias("_of")))  # a row a key and range
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    out = ranged.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    out = out.withColumn(name, (F.col("_before") + F.col("_n") - F.col("_first") + 1).cast("long"))
    return (out.withColumn(of, F.col("_of")) if of else out).drop("_part", "_n", "_before", "_key", "_p", "_of", "_first")


def get_or_create(names: DataFrame, master: DataFrame, key: str, order: str, id_name: str) -> DataFrame:
    """(key, id) of every distinct name: the master's id, or the next ones in order of first appearance."""
    seen = names.groupBy(key).agg(F.min(order).alias("_ord"))
    new = seen.join(master, key, "left_anti")
    top = master.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("_top"))
    made = assign_ids(new, "_ord", 1, "_place").crossJoin(top).select(key, (F.col("_top") + F.col("_place")).cast("long").alias(id_name))
    return seen.join(master, key).select(key, id_name).unionByName(made)


def mapping_for(names: DataFrame, known: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each distinct name is resolved once, and only if it isn't known."""
    distinct = names.distinct()
    known = known.distinct()
    return distinct.join(known, "name", "left_semi").withColumn("status", F.lit("reused")).unionByName(resolve(distinct.join(known, "name", "left_anti")))


def replace_rows(df: DataFrame, new: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.distinct(), key, "left_anti").unionByName(new)


def update_by_id(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key new has take its values, nulls as well; columns as they were."""
    fresh = new.select(key, F.struct(*(c for c in new.columns if c != key)).alias("_new"))
    out = df.join(fresh, key, "left")
    return out.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in new.columns and c != key else F.col(c) for c in df.columns))


def missing_ids(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.select(key).join(df, key, "left_anti")


def already_integrated(df: DataFrame, key: str, first_id: int) -> bool:
    """Whether the first id that an integration would write is there already."""
    return not df.where(F.col(key) == first_id).isEmpty()
