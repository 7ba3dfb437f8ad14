"""What the corpus operators share: reading tables, words, shared folders, streams of Arrow rows, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.shared import cut, forget  # noqa: F401  the operators take them from here

#: Words are maximal runs of what isn't an ASCII blank; ``bytes.split()`` cuts at just these six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch: the JVM and the worker hold some copies of it at a time.
BATCH_BYTES = 4 << 20
#: Bytes of a generation's keys and values.  What the one before has is taken over when it is seen again, so frequent parts stay known.
REMEMBERED = 40 << 20
#: What an entry takes beside them, about.
ENTRY = 180


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded(spark: SparkSession) -> None:
    """Arrow batches of the session are bounded by bytes from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the columns named; any others of the input are left behind.

    The session's Arrow batches are bounded by bytes from here on: by rows alone, a batch of long texts wouldn't fit a worker.
    """
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-larder-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def without(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows whose doc_id is among ids; rows of a null doc_id stay.  ids are broadcast up to a number of 8-byte rows, else shuffled."""
    ids = cut(ids.select("doc_id").where("doc_id is not null").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "doc_id", "left_anti")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; what divides learning rows from held-out ones.  A null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def slices(batch: pa.RecordBatch, at_most: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    step = max(1, int(n * at_most / max(batch.nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, step)
    # Arrow keeps what was freed for later use; a worker beside others gives it back.
    pa.default_memory_pool().release_unused()


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict[str, list]]]:
    """Of batches sorted by key: each key with the lists of its rows' columns.  A key's rows must be few enough to hold."""
    now, held = None, None
    for batch in batches:
        cols = batch.to_pydict()
        keys = cols[key]
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held is not None and keys[start] == now:
                    for name, x in cols.items():
                        held[name].extend(x[start:i])
                else:
                    if held is not None:
                        yield now, held
                    now, held = keys[start], {name: x[start:i] for name, x in cols.items()}
                start = i
    if held is not None:
        yield now, held


class Remembered:
    """Two generations of what a worker has worked out, bounded by bytes."""

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.now: dict = {}
        self.before: dict = {}
        self.held = 0

    def joined(self, sequences: list[list], learn: Callable[[list], list[bytes]]) -> list[bytes]:
        """The values of each sequence of keys, put together; ``learn`` gives those of keys that neither generation knows."""
        if self.held > self.most:
            self.before, self.now, self.held = self.now, {}, 0
        found = [list(map(self.now.get, keys)) for keys in sequences]
        gaps = [[i for i, x in enumerate(values) if x is None] for values in found]
        new = {keys[i] for keys, own in zip(sequences, gaps, strict=True) for i in own}
        known = [k for k in new if k in self.before]  # an intersection would walk all that is remembered
        self.put(known, list(map(self.before.__getitem__, known)))
        if new := list(new.difference(known)):
            self.put(new, learn(new))
        for keys, values, own in zip(sequences, found, gaps, strict=True):
            for i in own:
                values[i] = self.now[keys[i]]
        return [b"".join(values) for values in found]

    def values(self, keys: list, learn: Callable[[list], list[bytes]]) -> list[bytes]:
        """The values of keys, each of which is there once."""
        if self.held > self.most:
            self.before, self.now, self.held = self.now, {}, 0
        found = list(map(self.now.get, keys))
        gaps = [i for i, x in enumerate(found) if x is None]
        for i in gaps:
            found[i] = self.before.get(keys[i])
        new = [i for i in gaps if found[i] is None]
        if new:
            for i, x in zip(new, learn([keys[i] for i in new]), strict=True):
                found[i] = x
        self.put([keys[i] for i in gaps], [found[i] for i in gaps])
        return found

    def put(self, keys: list, values: list[bytes]) -> None:
        self.now.update(zip(keys, values, strict=True))
        self.held += sum(map(len, keys)) + sum(map(len, values)) + ENTRY * len(keys)


_OWN: dict = {}


def own(key, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one thing, since workers outlive stages; asking for another lets go of it."""
    if key not in _OWN:
        _OWN.clear()
        gc.collect()
        _OWN[key] = make()
    give_back()  # once a task: what the one before has freed
    return _OWN[key]


def give_back() -> None:
    """Memory that this worker has freed goes back to its machine, where the C library can say so."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to, for each node of an edge between two nodes.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until the edges stop changing.  Each step is one
    aggregation and one join on the node; a node with very many edges is summed before the shuffle and split by the join.
    Null ends and loops are left out; an empty input gives an empty result.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        e = cut(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct()).distinct()
