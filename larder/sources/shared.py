"""The folder that driver and executors share, and results kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-larder-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it has run; a query has it as it was when its plan was made.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored in the shared folder, its lineage cut.  The shuffles that it took are removed at once; Spark would wait for the driver to collect garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        own = df.select("*")
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return own.checkpoint()


def bare(df: DataFrame) -> DataFrame:
    """A cut df without what Spark knows of its columns: a union fails where that names columns that the df doesn't have."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


#: Input bytes of a pass, and passes at most.
PASS_BYTES, PASSES = 16 << 20, 4


def cut_in_passes(df: DataFrame, key: str) -> DataFrame:
    """cut(df) for a df whose rows of a key come from rows of that key: each pass works out its share of the keys, so that a share of the shuffles lies on disk at a time.

    A pass reads the input again; the filter on the key goes down to it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # what Spark doesn't know is as large as can be
    passes = min(PASSES, 1 + size // PASS_BYTES)
    out = None
    for i in range(passes):
        share = bare(cut(df.where(F.pmod(F.xxhash64(key), F.lit(passes)) == i) if passes > 1 else df))
        out = share if out is None else out.unionByName(share)
    return out


def forget(df: DataFrame) -> None:
    """The files of a cut df, which nothing reads any more, are removed; Spark would wait for the driver to collect garbage."""
    stored = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if stored.isDefined():
        remove(df.sparkSession, stored.get())


def files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = files(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = files(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = files(spark, old)
    if not fs.rename(p, files(spark, new)[1]):
        raise OSError(f"{old} could not be moved to {new}")
