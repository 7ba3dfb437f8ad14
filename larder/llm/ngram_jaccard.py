"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its distinct word shingles, as 64-bit hashes.  Two documents whose sets have a Jaccard
similarity of t or more share a token among the first ``n - ceil(t * n) + 1`` of each, under *every* total order of all
tokens.  Three orders are used:

1. rarest first by a fixed-size count sketch of the whole corpus, then by hash, so that tokens of common passages come last;
2. and 3. two independent orders by hash.

Order 1 finds candidates by one shuffle of prefix tokens.  Documents of equal sets are one representative beforehand.
Tokens of at most ``BUCKET`` representatives give pairs, which the positional bound prunes; more frequent ones only tie
their documents to the smallest of them.  The clusters of these ties are compared in blocks of bounded size, cut by set
size and hash.  There a pair must share prefix tokens under all three orders before its exact intersection is counted.  A
block emits a spanning forest of its links, so no group's pairs are ever written out, and no link is lost.

Rows that share a doc_id are one node, but each text of it is a member of its own, placed by the size of its own set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, cut, forget, own, partitions, runs, slices, texts

#: Cells of the count sketch; a corpus of very many tokens tells common ones better with more.
CELLS = 1 << 22
#: Representatives of a token that are paired outright.
BUCKET = 128
#: A block's rows are about this many documents or tokens.
BLOCK_DOCS, BLOCK_TOKENS = 512, 400_000
#: Members are sent to the texts up to this many of them and of their places in blocks together; beyond it both are shuffled.
BROADCAST_ROWS = 400_000
#: Prefix tokens are shuffled in up to so many passes, each over this many of them or its share of more, so that a share lies on disk at a time.
PASSES, PASS_TOKENS = 4, 2_000_000
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Words(dict):
    """A word's hash, kept for words seen before; emptied when it is large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def worker_words() -> Words:
    return own("words", Words)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * A
    return x ^ (x >> np.uint64(29))


def shingles(text: str, k: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words together where there are fewer."""
    ws = text.encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h[:k]), np.uint64)
    for j in range(min(k, len(h))):
        out = mixed(out * C + h[j : j + n] + B)
    return np.unique(out)


def rarest_first(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order 1 of tokens: by their rank in the sketch, then by hash."""
    return (rank[s % CELLS].astype(np.uint64) << np.uint64(59)) | (s >> np.uint64(5))


def prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: (doc_id, n, signature of the set); kind 1: (cell of the sketch, count), summed over a task."""

    def run(batches):
        words, cells = worker_words(), np.zeros(CELLS, np.int32)
        for batch in (s for b in batches for s in slices(b, 8 << 20)):
            sets = [shingles(t, k, words) for t in batch.column("text").to_pylist()]
            ns = [len(s) for s in sets]
            sigs = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            np.add.at(cells, (np.concatenate(sets) % CELLS).astype(np.int64), 1)
            yield rows([0] * len(ns), batch.column("doc_id"), ns, sigs)
        # A task tells of the cells that stand out in it, and at cell -1 how many tokens it has seen.
        full = np.flatnonzero(cells >= max(2, 4 * cells.sum() / CELLS))
        yield rows([1], [-1], [int(cells.sum())], [None])
        yield rows([1] * len(full), full, cells[full], [None] * len(full))

    def rows(kind, a, n, sig):
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), a if isinstance(a, pa.Array) else pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.string())], ["kind", "a", "n", "sig"])

    return docs.mapInArrow(run, "kind int, a long, n long, sig string")


def link_clusters(docs: DataFrame, k: int = 3, percent: int = 90, bucket: int = BUCKET, block_docs: int = BLOCK_DOCS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links of ``percent`` per cent similarity lead to.  Null or blank texts have
    no shingle and link with nothing; rows of a null doc_id keep a null component and link with nothing; rows that share
    a doc_id are one node.  Other columns are left behind; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    made = cut(profiles(docs, k))
    sets = made.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "sig")
    total = made.where("kind = 1 and a = -1").agg(F.sum("n")).first()[0] or 0
    common = max(16, 4 * total // CELLS)
    # There are fewer cells than CELLS / 4 with so many tokens; their ranks are CELLS bytes at every size of the corpus.
    cells = made.where("kind = 1 and a >= 0").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= common).toPandas()
    rank = np.zeros(CELLS, np.uint8)
    if len(cells):
        rank[cells.a.to_numpy()] = np.clip(1 + np.log2(cells.n.to_numpy() / common), 0, 15)
    rank = spark.sparkContext.broadcast(rank)

    reps = sets.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    reps = cut(reps)

    def first_tokens(batches):
        words = worker_words()
        for batch in (s for b in batches for s in slices(b, 8 << 20)):
            ids, ns, lasts, tokens = [], [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(t, k, words)
                if i is None or not len(s):
                    continue
                p = prefix(len(s), percent)
                ids.append(i)
                ns.append(len(s))
                key = rarest_first(s, rank.value)
                first = np.argsort(key, kind="stable")[:p]
                lasts.append(int(key[first[-1]]))
                tokens.append(s[first].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(lasts, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["doc", "n", "last", "tokens"])

    # A row for each document is joined with the representatives; only what stays becomes a row for each token.
    rows = docs.mapInArrow(first_tokens, "doc long, n long, last long, tokens array<long>")
    listed = cut(rows.join(reps.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi"))
    passes = min(PASSES, 1 + total * (100 - percent) // 100 // PASS_TOKENS)
    rows = None
    for i in range(passes):
        own_tokens = listed.select("doc", "n", "last", F.posexplode("tokens").alias("at", "token")).where(F.pmod("token", F.lit(passes)) == i).withColumn("at", F.col("at") + 1)
        shared = own_tokens.groupBy("token").agg(F.count("*").alias("k"), F.min("doc").alias("pivot")).where("k > 1")
        found = cut(own_tokens.join(shared, "token"))
        rows = found if rows is None else rows.union(found)
    forget(listed)
    hot = rows.where(F.col("k") > bucket)
    ties = hot.where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    allowed = hot.groupBy("doc").agg(F.count("*").alias("hot"))
    cold = rows.where(F.col("k") <= bucket).select("token", "doc", "at", "n", "last").join(allowed, "doc", "left").na.fill(0, ["hot"])
    x, y = (cold.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "at", "n", "last", "hot"))) for s in "xy")
    pairs = x.join(y, "token").where(f"doc_x < doc_y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)")
    pairs = pairs.groupBy("doc_x", "doc_y").agg(F.count("*").alias("s"), F.max("at_x").alias("at_x"), F.max("at_y").alias("at_y"), *(F.first(c).alias(c) for c in ("n_x", "n_y", "last_x", "last_y", "hot_x", "hot_y")))
    shared_most = "s + least(hot_x, hot_y)"
    # Of the tokens after the last shared one, no more can be shared than either document has left.
    pairs = pairs.where(f"({shared_most} + least(n_x - at_x, n_y - at_y)) * {100 + percent} >= {percent} * (n_x + n_y)")
    # A prefix token of the document whose prefix ends first is in the other's prefix, or not in the other at all.
    n = "IF(last_x <= last_y, n_x, n_y)"
    pairs = pairs.where(f"({n} - ({n} - ceil({percent} * {n} / 100) + 1) + {shared_most}) * {100 + percent} >= {percent} * (n_x + n_y)")
    cluster = components(ties.union(pairs.select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b"))))

    # Of one id, each size of a set is a member; texts of equal size share its place.
    sizes = reps.select(F.col("rep").alias("node"), "n").distinct()
    links = compare(docs, cut(cluster.join(sizes, "node")), rank, k, percent, block_docs, broadcast_rows)
    rep = cut(sets.join(reps.select("sig", "rep"), "sig", "left"))
    # An id whose texts have different representatives ties these together.
    mixed_ids = rep.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most")
    several = rep.join(mixed_ids, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    component = components(links.union(several))
    rep = rep.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    return rep.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def compare(docs: DataFrame, members: DataFrame, rank, k: int, percent: int, block_docs: int, broadcast_rows: int) -> DataFrame:
    """Links (a, b) that join what is similar within each cluster of members(node, component, n): a spanning forest of each block."""
    spark = docs.sparkSession
    band = F.floor(F.log("n") / (1.005 * float(np.log(100 / percent)))).cast("int") if percent < 100 else F.col("n").cast("int")
    members = members.withColumn("band", band)
    whole = members.groupBy("component").agg(F.count("*").alias("all"), F.sum("n").alias("tokens"))
    sizes = members.groupBy("component", "band").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    sizes = sizes.select("component", "band", F.ceil(F.greatest(F.col("docs") / block_docs, F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("parts"))
    above = sizes.select("component", (F.col("band") - 1).alias("band"), F.col("parts").alias("parts_above"))
    below = sizes.select("component", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_below"))
    small = whole.where((F.col("all") <= block_docs) & (F.col("tokens") <= BLOCK_TOKENS)).select("component", F.lit(True).alias("one"))
    m = members.join(small, "component", "left").join(sizes, ["component", "band"]).join(above, ["component", "band"], "left").join(below, ["component", "band"], "left")
    m = m.na.fill(0, ["parts_above", "parts_below"]).withColumn("part", F.pmod(F.xxhash64("node", "n"), F.col("parts")).cast("int"))
    # Blocks: parts i <= j of a band, and each part with each of the next band.  side 0 and 1 are compared with each other, 2 within.
    within = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("band").alias("d"), F.least(j, "part").alias("i"), F.greatest(j, "part").alias("j"), F.lit(0).alias("step"), F.when(j == F.col("part"), 2).when(F.col("part") < j, 0).otherwise(1).alias("side")))
    up = F.when(F.col("parts_above") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("parts_above") - 1, F.lit(0))), lambda j: F.struct(F.col("band").alias("d"), F.col("part").alias("i"), j.alias("j"), F.lit(1).alias("step"), F.lit(0).alias("side"))))
    down = F.when(F.col("parts_below") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("parts_below") - 1, F.lit(0))), lambda j: F.struct((F.col("band") - 1).alias("d"), j.alias("i"), F.col("part").alias("j"), F.lit(1).alias("step"), F.lit(1).alias("side"))))
    only = F.array(F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("step"), F.lit(2).alias("side")))
    none = F.slice(only, 1, 0)
    places = F.when(F.col("one"), only).otherwise(F.concat(within, F.coalesce(up, none), F.coalesce(down, none)))
    places = F.transform(places, lambda p: F.struct(F.xxhash64("component", p.d, p.i, p.j, p.step).alias("block"), p.side.alias("side")))
    m = cut(m.groupBy(F.col("node").alias("doc_id")).agg(F.collect_list(F.struct("n", places.alias("at"))).alias("places")))
    weight = m.agg(F.count("*") + F.coalesce(F.sum(F.aggregate("places", F.lit(0), lambda total, x: total + F.size(x.at))), F.lit(0))).first()[0]
    if weight <= broadcast_rows:
        m = F.broadcast(m)
    # A repeated text comes once for each row; equal ids are one node, so repeats do no harm.
    placed = docs.join(m, "doc_id")

    def tokens(batches):
        words = worker_words()
        for batch in (s for b in batches for s in slices(b, 8 << 20)):
            out = []
            for i, t, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places")), strict=True):
                s = shingles(t, k, words)
                raw = s.tobytes()
                out += [(p["block"], p["side"], i, raw) for own in places if own["n"] == len(s) for p in own["at"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "side", "doc", "tokens"])

    def linked(batches):
        for _, rows in runs((s for b in batches for s in slices(b, 8 << 20)), "block"):
            if out := forest(rows["side"], rows["doc"], [np.frombuffer(x, np.uint64) for x in rows["tokens"]], percent, rank.value):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    placed = placed.select("doc_id", "text", "places").mapInArrow(tokens, "block long, side int, doc long, tokens binary")
    return cut(placed.repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(linked, "a long, b long"))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left with right sets, by products of 0/1 matrices over slabs of the shared tokens."""
    lens = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), lens)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    doc, column = doc[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    total, width = np.zeros((len(left), len(right)), np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(sets), width), np.float32)
        m[doc[lo:hi], column[lo:hi] - at] = 1
        total += m[left] @ m[right].T
    return total


def forest(side: list[int], ids: list[int], sets: list[np.ndarray], percent: int, rank: np.ndarray) -> list[tuple[int, int]]:
    side, n = np.array(side), np.array([len(s) for s in sets])
    left = np.flatnonzero(side != 1)
    right = left if (side == 2).all() else np.flatnonzero(side == 1)
    if not len(left) or not len(right) or len(ids) < 2:
        return []
    small, large = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
    ok = 100 * small >= percent * large
    if left is right:
        ok &= np.triu(np.ones_like(ok), 1)
    for order in (lambda s: rarest_first(s, rank), *(lambda s, m=m: mixed(s * m) for m in ORDERS)):  # a shared token in the prefix under each order
        if not ok.any():
            return []
        firsts = []
        for s in sets:
            p = prefix(len(s), percent)
            key = order(s)
            firsts.append(s[np.argpartition(key, p - 1)[:p]] if p < len(s) else s)
        ok &= overlaps(firsts, left, right) > 0
    if not ok.any():
        return []
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = np.argwhere(ok)
    if len(at) > 2 * len(ids):
        shared = overlaps(sets, left, right)
        both = np.add.outer(n[left], n[right])
        at = np.argwhere(ok & ((100 + percent) * shared.astype(np.int64) >= percent * both))
        sure = True
    else:
        sure = False
    for u, v in at:
        i, j = left[u], right[v]
        a, b = root(ids[i]), root(ids[j])
        if a != b and (sure or (100 + percent) * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= percent * (n[i] + n[j])):
            parent[max(a, b)] = min(a, b)
    return [(i, r) for i in parent if (r := root(i)) != i]
