"""Pairs of similar strings, by an exact index of their characters.

A string's bag counts its characters: those most frequent in the table apart, all others together.  Strings are put in an order
in which like bags stand close, and runs of that order form the nodes of a tree, each with the least and the most of
every counter.  Two nodes can hold a similar pair only if their boxes have enough characters in common; the join
starts from two bounded sets of nodes and goes down a level at a time, an equi-join on the parents that keeps the pairs of
children that still can.  At the leaves the boxes are the bags themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import similarity
from larder.operators.dimensions import assign_ids
from larder.sources.shared import cut

#: Counters of a bag, nodes that the join starts from at most on each side, and children of a node as a power of two.
COUNTERS, TOP, FANOUT = 32, 1024, 3


def bag(s: Column, alphabet: list[str]) -> Column:
    counts = [F.length(s) - F.length(F.translate(s, c, "")) for c in alphabet]
    rest = F.length(s)
    for n in counts:
        rest = rest - n
    return F.array(*counts, rest)


def fits(threshold: float) -> Column:
    """Whether boxes (a_low, a_high) and (b_low, b_high) can hold a pair of the threshold's similarity.

    Of two strings the common subsequence is no longer than what their bags share, and what they don't share must be deleted
    or inserted.
    """
    t = threshold / 100
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, c: n + c)
    shared = total(F.zip_with("a_high", "b_high", lambda x, y: F.least(x, y)))
    low, high = total(F.col("a_low")) + total(F.col("b_low")), total(F.col("a_high")) + total(F.col("b_high"))
    # What one box has at least is more than the other can have.
    apart = total(F.zip_with("a_low", "b_high", lambda x, y: F.greatest(x - y, F.lit(0)))) + total(F.zip_with("b_low", "a_high", lambda x, y: F.greatest(x - y, F.lit(0))))
    return (shared >= t * low / 2 - 1e-9) & (apart <= (1 - t) * high + 1e-9)


def nodes(leaves: DataFrame, level: int) -> DataFrame:
    """(side, node, low, high) of a level of the tree over leaves(side, node, low, high)."""
    out = leaves.select("side", "node", "low", "high")
    for _ in range(level):
        g = out.groupBy("side", F.shiftright("node", FANOUT).alias("node"))
        box = lambda f, c: F.array(*(f(F.get(c, F.lit(i))) for i in range(COUNTERS))).alias(c)
        out = g.agg(box(F.min, "low"), box(F.max, "high"))
    return out


def side(df: DataFrame, which: str) -> DataFrame:
    return df.where(F.col("side") == which).select(F.col("node").alias(which), F.col("low").alias(f"{which}_low"), F.col("high").alias(f"{which}_high"))


def candidates(strings: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of distinct strings(side, s), side a or b and s not empty: leaves(side, node, s, ...) and the pairs (a, b) of nodes whose bags allow the threshold."""
    chars = strings.select(F.explode(F.split("s", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    top = chars.orderBy(F.desc("n"), "c").limit(COUNTERS - 1).collect()
    alphabet, count = [r.c for r in top], strings.count()
    padded = alphabet + [""] * (COUNTERS - 1 - len(alphabet))
    # Like bags stand close where strings are ordered by whether they have more than the mean of the most frequent character, then of the next.
    each = strings.withColumn("low", bag(F.col("s"), padded))
    bits = [F.when(F.get("low", F.lit(i)) > r.n / max(count, 1), "1").otherwise("0") for i, r in enumerate(top)]
    each = each.withColumn("_o", F.concat(*bits, F.lpad(F.length("s").cast("string"), 9, "0"), "s", "side") if bits else F.col("s"))
    leaves = cut(assign_ids(each, "_o", 0, "node").select("side", "node", "s", "low", F.col("low").alias("high")))

    level = 0
    while count >> (FANOUT * level) > TOP - 2:
        level += 1
    ok = fits(threshold)
    at = nodes(leaves, level)
    # At most TOP nodes a side.
    pairs = cut(side(at, "a").join(F.broadcast(side(at, "b")), ok).select("a", "b"))
    while level > 0:
        level -= 1
        at = nodes(leaves, level)
        a = side(at, "a").withColumn("_pa", F.shiftright("a", FANOUT))
        b = side(at, "b").withColumn("_pb", F.shiftright("b", FANOUT))
        down = pairs.select(F.col("a").alias("_pa"), F.col("b").alias("_pb")).join(a, "_pa")
        pairs = cut(down.join(b, (down["_pb"] == b["_pb"]) & ok).select("a", "b"))
    return leaves, pairs


def similar(names: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """names(name), keys(key) -> (name, key, similarity) of each distinct pair whose token-sort similarity reaches the threshold, above 0.

    Null strings and those without a word are similar to none.
    """
    n = names.select("name", similarity.sorted_tokens("name").alias("s")).where("s <> ''").distinct()
    k = keys.select("key", similarity.sorted_tokens("key").alias("t")).where("t <> ''").distinct()
    strings = cut(n.select(F.lit("a").alias("side"), "s").distinct().union(k.select(F.lit("b"), "t").distinct()))
    leaves, pairs = candidates(strings, threshold)
    of = lambda which, c: leaves.where(F.col("side") == which).select(F.col("node").alias(which), F.col("s").alias(c))
    scored = pairs.join(of("a", "s"), "a").join(of("b", "t"), "b").select("s", "t", similarity.ratio("s", "t").alias("similarity"))
    return scored.where(F.col("similarity") >= threshold).join(n, "s").join(k, "t").select("name", "key", "similarity")
