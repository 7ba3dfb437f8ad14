"""The prefix trie of conversations, by z-fast tries.

A conversation's prefix of d turns is known by a fingerprint of 128 bits: the exclusive or of two hashes of each turn's digest
with its place.  A task inserts its conversations, a batch at a time, into a compacted trie.  Of a node, which covers the
depths (low, high], a dictionary knows the fingerprint at its handle, the depth in that range that most twos divide; a
binary search over such depths leads from the root to the node at which a conversation leaves the trie in as many steps as
its length has bits.  Edges are then expanded to a row for each depth, and Spark sums the rows of equal fingerprints.

What a node's subtree sums to needs no walk through the trie.  Say that a node belongs to the smallest conversation through it; then
a conversation owns the end of its path, and whatever it owns is below every node on the rest of the path.  So conversations are
weighted by what they own and a second pass sums these weights.

Nothing needs a conversation in one piece: turns are numbered by ranges with offsets and travel in chunks of bounded length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import WORD, bounded, cut, partitions

#: Turns of a chunk (more than a conversation takes from another), turns of a batch that a task makes a trie of, and ids of a bin whose ends are put together.
CHUNK, BATCH, BIN = 1024, 200_000, 65_536
#: Nodes of so many children that their owners are sent to all tasks, at most, and the least number of children for that.
MANY, HOT = 100_000, 100
NODES = "a long, b long, pa long, pb long, depth long, words long, n long, owner long"
SUMS = "a long, b long, weight long, leaves long"


def fattest(low: int, high: int) -> int:
    """Of the numbers in (low, high], the one that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of sequences that are known by the fingerprints of their prefixes.

    A sequence starts at some depth, below a prefix that no node of this trie describes; sequences of the same start share a root.
    """

    def __init__(self):
        self.handles: dict[tuple, int] = {}
        self.edges: dict[tuple, int] = {}  # by the fingerprint one below the parent's depth
        self.low, self.high, self.up, self.path, self.ends = [], [], [], [], []

    def add(self, low: int, high: int, up: int, path: Path) -> int:
        self.low.append(low)
        self.high.append(high)
        self.up.append(up)
        self.path.append(path)
        self.ends.append([])
        node = len(self.low) - 1
        if high > low:
            self.handles[path.at(fattest(low, high))] = node
            self.edges[path.at(low + 1)] = node
        return node

    def exit(self, p: Path, root: int) -> int:
        """The deepest node whose handle is a prefix of p, found by halving the range at fat depths."""
        node, low, high = root, p.start, p.end
        while low < high:
            f = fattest(low, high)
            found = self.handles.get(p.at(f))
            if found is None:
                high = f - 1
            else:
                node, low = found, self.high[found]
        return node

    def insert(self, p: Path) -> None:
        key = ("root", *p.at(p.start))
        root = self.handles.get(key)
        if root is None:
            root = self.handles[key] = self.add(p.start, p.start, -1, p)
        node = self.exit(p, root)
        if self.agrees(node, p):
            if self.high[node] == p.end:
                self.ends[node].append(p.row)
                return
            child = self.edges.get(p.at(self.high[node] + 1))
            if child is None:
                self.ends[self.add(self.high[node], p.end, node, p)].append(p.row)
                return
            node = child
            if self.agrees(node, p):  # p ends here: with turns left, the search would have found this node
                self.ends[node].append(p.row)
                return
        # p leaves the edge of this node: below the depth up to which they agree the node stays as it is.
        low, high = self.low[node], min(self.high[node], p.end)
        other = self.path[node]
        same, far = low + 1, high
        while same < far:
            half = (same + far + 1) // 2
            if other.at(half) == p.at(half):
                same = half
            else:
                far = half - 1
        del self.handles[other.at(fattest(low, self.high[node]))]
        top = self.add(low, same, self.up[node], other)
        self.low[node], self.up[node] = same, top
        self.handles[other.at(fattest(same, self.high[node]))] = node
        self.edges[other.at(same + 1)] = node
        if same == p.end:
            self.ends[top].append(p.row)
        else:
            self.ends[self.add(same, p.end, top, p)].append(p.row)

    def agrees(self, node: int, p: Path) -> bool:
        """Whether all that the node covers is a prefix of p."""
        h = self.high[node]
        return h <= p.end and self.path[node].at(h) == p.at(h)


class Path:
    """A row's sequence: its prefixes of start to end turns."""

    __slots__ = ("a", "b", "end", "row", "start")

    def __init__(self, row: int, start: int, a: list[int], b: list[int]):
        self.row, self.start, self.end, self.a, self.b = row, start, start + len(a) - 1, a, b

    def at(self, depth: int) -> tuple[int, int, int, int]:
        """Sequences that start at different depths may pass the same prefix; they are kept apart."""
        i = depth - self.start
        return self.start, depth, self.a[i], self.b[i]


def tries(batch: pa.RecordBatch, most: int = BATCH):
    """For each trie of a batch of chunks: the trie, its rows' fingerprints one after another, and where each row's begin."""
    start = batch.column("start").to_numpy()
    lists = {c: batch.column(c) for c in ("a", "b")}
    lengths = np.diff(lists["a"].offsets.to_numpy())
    row = 0
    while row < len(start):
        size = np.cumsum(lengths[row:] + 1)
        end = row + max(1, int(np.searchsorted(size, most, "right")))
        prints = {}
        begin = np.concatenate([[0], size[: end - row]])
        for c, before in (("a", "pa"), ("b", "pb")):
            flat = np.empty(begin[-1], np.int64)
            heads = batch.column(before).to_numpy()[row:end]
            own = lists[c].slice(row, end - row).flatten().to_numpy()
            first = np.zeros(len(flat), bool)
            first[begin[:-1]] = True
            flat[first], flat[~first] = heads, own
            # The running exclusive or of all rows, less what it was before each row.
            running = np.bitwise_xor.accumulate(flat)
            skip = np.concatenate([[0], running[begin[1:-1] - 1]])
            prints[c] = running ^ np.repeat(skip, np.diff(begin))
        trie = ZFastTrie()
        for i in range(row, end):
            x, y = begin[i - row], begin[i - row + 1]
            trie.insert(Path(i, int(start[i]), prints["a"][x:y].tolist(), prints["b"][x:y].tolist()))
        yield trie, prints, begin, row
        row = end


def expanded(pieces: DataFrame, weights: bool) -> DataFrame:
    """A row for each depth that a node of a task's tries covers, with the sums over the conversations below it."""

    def run(batches):
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if weights:
                heavy, leaf = batch.column("weight").to_numpy(), batch.column("leaf").to_numpy()
            words = batch.column("w")
            for trie, prints, begin, row in tries(batch):
                size = len(trie.low)
                n, owner, total, leaves = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
                for k, rows in enumerate(trie.ends):
                    if rows:
                        n[k], owner[k] = len(rows), ids[rows].min()
                        if weights:
                            total[k], leaves[k] = heavy[rows].sum(), leaf[rows].sum()
                for k in sorted(range(size), key=trie.high.__getitem__, reverse=True):
                    up = trie.up[k]
                    if up >= 0:
                        n[up] += n[k]
                        owner[up] = min(owner[up], owner[k])
                        total[up] += total[k]
                        leaves[up] += leaves[k]
                # Depth 0 is a node; the root of a later chunk is one of the chunk before.
                low = np.array([x - (u < 0 and h == 0) for x, u, h in zip(trie.low, trie.up, trie.high, strict=True)])
                high = np.array(trie.high)
                base = np.array([begin[p.row - row] - p.start for p in trie.path])
                times = high - low
                node = np.repeat(np.arange(size), times)
                depth = np.arange(len(node)) - np.repeat(np.cumsum(times) - times, times) + low[node] + 1
                at = base[node] + depth
                a, b = prints["a"][at], prints["b"][at]
                if weights:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, total[node], leaves[node])], ["a", "b", "weight", "leaves"])
                    continue
                before = np.where(depth > 0, at - 1, at)
                flat = words.slice(row, len(begin) - 1).flatten().to_numpy()
                # Words stand beside turns, fingerprints also before the first.
                last = np.concatenate([[0], flat])[np.where(depth > 0, at - np.array([p.row - row for p in trie.path])[node], 0)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, prints["a"][before], prints["b"][before], depth, last, n[node], owner[node])], [x.split()[0] for x in NODES.split(", ")])

    return pieces.mapInArrow(run, SUMS if weights else NODES)


def numbered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, digest, words) with i, the place in the conversation from 0.

    Ranges of turns are numbered where they lie.  A conversation that an earlier range began is the first of its range, so there
    is at most one offset a partition to send around.
    """
    seen = turns.withColumn("seen", F.monotonically_increasing_id())  # parts equal rows, which may follow each other in any order
    dealt = cut(seen.repartitionByRange(partitions(turns.sparkSession), "conv_id", "turn", "digest", "seen").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = before.where("before is not null").select("conv_id", "part", "before")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest", "seen")) - 1
    return dealt.withColumn("place", place).join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "words")


def rebuilt(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Chunks of the rebuilt conversations: (conv_id, chunk, start, a, b, w, pa, pb, last).

    a and b hold two hashes of each turn, w its words; pa and pb are the fingerprint of the ``start`` turns before them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    chunk = F.floor(F.col("i") / CHUNK).cast("long").alias("chunk")
    own = cut(numbered(turns).groupBy("conv_id", chunk).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "words"))).alias("own")))
    head = own.where((F.col("chunk") == 0) & (F.col("conv_id") % block == 0)).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    base = F.col("conv_id") - F.col("conv_id") % block
    both = own.withColumn("base", base).join(head, "base", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    given = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("own", 1, 0))
    first = F.concat(F.col("given"), F.slice("own", F.col("h") + 1, F.size("own")))
    rest = F.when(F.col("chunk") == 0, first).otherwise(F.col("own"))
    start = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("chunk") * CHUNK - F.col("h") + F.size("given")).cast("long")
    both = both.withColumn("given", given).select("conv_id", "chunk", start.alias("start"), rest.alias("turns"))
    place = lambda j: F.col("start") + j.cast("long")
    both = both.select(
        "conv_id",
        "chunk",
        "start",
        F.transform("turns", lambda t, j: F.xxhash64(place(j), t.digest)).alias("a"),
        F.transform("turns", lambda t, j: F.xxhash64(t.digest, place(j), F.lit("b"))).alias("b"),
        F.transform("turns", lambda t: t.words).alias("w"),
    )
    along = Window.partitionBy("conv_id").orderBy("chunk")
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    earlier = lambda c: F.coalesce(F.bit_xor(whole(c)).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return both.select("*", earlier("a").alias("pa"), earlier("b").alias("pb"), F.lead("chunk").over(along).isNull().alias("last"))


def ends(pieces: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of each node at which conversations end.

    Ids are joined within bins of BIN consecutive numbers, which hold no more than so many; a digest then takes a node's bins one
    after another and keeps none of them.
    """
    whole = lambda c, before: F.aggregate(c, F.col(before), lambda x, y: x.bitwiseXOR(y)).alias(c)
    last = pieces.where("last").select(whole("a", "pa"), whole("b", "pb"), "conv_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    bins = last.groupBy("a", "b", F.floor(F.col("conv_id") / BIN).alias("bin")).agg(text.alias("ids"))

    def run(batches):
        now = digest = None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield rows(out)
        if now is not None:
            yield rows([(*now, digest.hexdigest())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["a", "b", "ends_sha256"])

    return bins.repartition(partitions(pieces.sparkSession), "a", "b").sortWithinPartitions("a", "b", "bin").select("a", "b", "ids").mapInArrow(run, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> a row for each node of the trie of rebuilt conversations.

    Turns go by number, null first, and turns of one number by the MD5 of "<characters of role>:<role><text>".  Rows without a
    conv_id are no conversation; null roles and texts are empty; repeated rows are turns each; other columns are left behind; an
    empty table gives no row, not even a root.
    """
    bounded(conversations.sparkSession)
    pieces = cut(rebuilt(conversations))
    both = expanded(pieces, False).groupBy("a", "b")
    nodes = cut(both.agg(*(F.min(c).alias(c) for c in ("pa", "pb", "depth", "words")), F.max(F.struct("pa", "pb", "depth", "words")).alias("most"), F.sum("n").alias("n"), F.min("owner").alias("owner")))
    # A fingerprint that stood for two prefixes would have two parents, unless these already shared one.
    if not nodes.where("most <> struct(pa, pb, depth, words)").isEmpty():
        raise ValueError("two prefixes share a fingerprint")

    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    value = (F.col("n") - 1) * F.col("words")
    full = nodes.drop("most").join(children, ["a", "b"], "left").na.fill(0, ["n_children"]).withColumn("value", value).withColumn("block", F.floor(F.col("depth") / CHUNK))
    # What a conversation owns from each of its nodes on: within blocks of depths, and in the blocks after.
    blocks = full.groupBy("owner", "block").agg(F.sum("value").alias("value"), F.min("depth").alias("top"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    down = Window.partitionBy("owner").orderBy(F.desc("block"))
    all_ = Window.partitionBy("owner")
    blocks = cut(blocks.select("owner", "block", F.coalesce(F.sum("value").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("after"), F.sum("value").over(all_).alias("weight"), F.min("top").over(all_).alias("top"), F.max("leaf").over(all_).alias("leaf"), (F.row_number().over(down) == 1).alias("one")))
    within = F.sum("value").over(Window.partitionBy("owner", "block").orderBy(F.desc("depth")))
    full = cut(full.withColumn("within", within).join(blocks.select("owner", "block", "after", "weight", "top"), ["owner", "block"]))

    weights = blocks.where("one").select(F.col("owner").alias("conv_id"), "weight", "leaf")
    heavy = pieces.select("conv_id", "start", "a", "b", "pa", "pb", "w").join(weights, "conv_id", "left").na.fill(0, ["weight", "leaf"])
    sums = expanded(heavy, True).groupBy("a", "b").agg(F.sum("weight").alias("below"), F.sum("leaves").alias("n_leaves"))

    # Below the first node that a conversation owns, parents are its own as well.  Fewer than MANY nodes have more than one in
    # MANY of all nodes as children; these are sent around, so that the join has no key of many rows.
    parent = F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent")
    many = F.col("n_children") > max(HOT, nodes.count() // MANY)
    tops = full.where("depth = top and depth > 0").select("a", "b", "pa", "pb").join(F.broadcast(full.where(many).select(*parent)), ["pa", "pb"], "left")
    tops = tops.where("parent is not null").unionByName(tops.where("parent is null").drop("parent").join(full.where(~many).select(*parent), ["pa", "pb"])).select("a", "b", "parent")
    out = full.join(sums, ["a", "b"]).join(ends(pieces), ["a", "b"], "left").join(tops, ["a", "b"], "left")
    return out.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        (F.col("below") - F.col("weight") + F.col("within") + F.col("after")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
