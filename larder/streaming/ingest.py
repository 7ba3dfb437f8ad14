"""New recipes as a stream of files: each micro-batch is analysed like a batch and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from larder.functions.text import url_key
from larder.operators.dimensions import assign_ids


def ingest(spark: SparkSession, folder: str, schema: StructType | str, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Files of (source_url, ...) under folder into a Parquet table of prepared rows with recipe_id.

    Rows of a url that the table has, or that came before in the batch, are left out, so files that repeat recipes and
    batches that run again add nothing.  Ids go on from the highest of the table.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = df.withColumn("url_key", url_key("source_url")).groupBy("url_key").agg(F.min(F.struct(*df.columns)).alias("r")).select("url_key", "r.*")
        try:
            have = spark.read.parquet(table)
            new = new.join(have, "url_key", "left_anti")
            top = have.agg(F.coalesce(F.max("recipe_id"), F.lit(0))).first()[0]
        except Exception as e:  # the table's first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            top = 0
        prepare(assign_ids(new, "url_key", top + 1, "recipe_id")).write.mode("append").parquet(table)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
