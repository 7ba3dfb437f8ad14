"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with up to ``k = floor(rate * n)`` edits.  Cut into k + 1 pieces, at least one piece
then stands in the text unchanged.  One automaton holds the pieces of a block of items; its exact hits say which stretch of
the text may hold which item, and Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import own, slices, texts

RATE, MIN_CHARS = 0.05, 25
#: Characters of items that one pass over the documents carries.
BLOCK_CHARS = 8 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece): the k + 1 pieces, even but for one character."""
    n = int(rate * len(item)) + 1
    cuts = [len(item) * j // n for j in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(item: str, text: str) -> int:
    """The least edit distance of item to any substring of text (Myers, 1999)."""
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    pv, nv, score, best = ones, 0, m, m
    for c in text:
        x = at.get(c, 0) | nv
        d = (((x & pv) + pv) ^ pv) | x
        hn, hp = pv & d, nv | (ones & ~(pv | d))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            best = min(best, score)
        x = hp << 1 & ones
        nv, pv = x & d, (hn << 1 & ones) | (ones & ~(x | d))
    return best


class Items:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.rate = items, rate
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for j, (_, item) in enumerate(items):
            for offset, piece in pieces(item, rate):
                places.setdefault(piece, []).append((j, offset))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str) -> dict[int, int]:
        """item_id -> the least distance, for the items that text has within their budgets."""
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (n, where) in self.automaton.iter(text):
            for j, offset in where:
                item = self.items[j][1]
                k = int(self.rate * len(item))
                start = last - n + 1 - offset
                a, b = max(0, start - k), start + len(item) + k
                own = windows.setdefault(j, [])
                # Hits come by their ends, so starts may step back by a piece's length at most.
                if own and a <= own[-1][1]:
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        found: dict[int, int] = {}
        for j, own in windows.items():
            item_id, item = self.items[j]
            k = int(self.rate * len(item))
            for a, b in own:
                part = text[a:b]
                d = 0 if item in part else distance(item, part)
                if d <= k:
                    found[item_id] = min(d, found.get(item_id, d))
        return found


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance): the benchmark items that each document holds within a budget of rate edits a character.

    Texts are compared in lower case with runs of white space as one space.  distance is the least over all substrings of
    the whole text.  Null texts and items, null item ids, and items of fewer than min_chars characters match nothing; a
    document row gives one row for each item id, and repeated rows repeat it.  Items are carried in blocks of a bounded
    size, each a pass over the documents; other columns are left behind; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    # createDataFrame() would start Python workers of another kind, which stay beside those of the operators.
    out = spark.range(0).select(*(F.lit(None).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("item_id", "long"), ("distance", "int"))))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        own = [(i, n) for i, t in own if len(n := normal(t)) >= min_chars]
        out = out.union(one_pass(docs, spark.sparkContext.broadcast(own), rate))
    # An item id of several texts may be in several blocks.
    return out if blocks <= 1 else out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def one_pass(docs: DataFrame, items, rate: float) -> DataFrame:
    def run(batches):
        own("decontamination", bool)  # lets go of what another operator has kept in this worker
        held = Items(items.value, rate) if items.value else None
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            out = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in (held.search(t).items() if held else ())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance"])

    return docs.mapInArrow(run, "doc_id long, item_id long, distance int")
