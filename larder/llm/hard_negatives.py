"""Hard negatives for training embeddings, by cover trees over norm-augmented candidates.

Candidates are cut into blocks as they lie; each block becomes a cover tree.  One more coordinate gives all candidates of a block
the same norm, so that distance and inner product order them alike.  A node has a centre, which is its own first child,
children further apart than half its covering radius, and every descendant within that radius r; the inner product of an
anchor q with any of these lies within |q| r of that with the centre.  The descent takes the node of the highest bound
first, skips nodes outside every window that still wants rows, and verifies leaves by exact integer products.

Anchors are a stated query set: they pass through the driver a bounded number at a time, and each round of them meets every
block where it lies; only each task's best rows are shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import cut, partitions

#: Candidates of a tree, rows a task gathers to sort by label before it cuts blocks, and anchors of a round.
BLOCK, GATHER, ANCHORS = 2048, 16_384, 20_000
#: Anchors that meet a tree's first level in one product.
TOGETHER = 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1
TREE = "width int, x array<bigint>, starts array<int>, ids array<bigint>, labels array<bigint>, center array<int>, radius array<double>, first array<int>, last array<int>"
_TREE = pa.schema([("width", pa.int32()), ("x", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("center", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of x with the vector or the columns q; those past a long are the nearest long."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * x.shape[1]
    if most < 1 << 53:
        return np.rint(x.astype(float) @ q.astype(float)).astype(np.int64)
    return np.clip(x.astype(object) @ q.astype(object), LEAST, MOST).astype(np.int64)


class CoverTree:
    """Distinct vectors x with the rows (ids, labels) that hold each, by id; node 0 is the root, a node without children a leaf."""

    def __init__(self, x, starts, ids, labels, center, radius, first, last):
        self.x, self.starts, self.ids, self.labels = x, starts, ids, labels
        self.center, self.radius, self.first, self.last = center, radius, first, last

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> CoverTree:
        x, place = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, place.ravel()))
        starts = np.searchsorted(place.ravel()[order], np.arange(len(x) + 1)).astype(np.int32)
        f = x.astype(float)
        squares = (f * f).sum(1)
        top = squares.max(initial=0)
        y = np.column_stack([f, np.sqrt(top - squares)])
        tiny = 1e-12 * top  # what the rounding of a squared distance may hide

        def away(points: np.ndarray, c: int) -> np.ndarray:
            return np.sqrt(np.maximum(2 * (top - y[points] @ y[c]), 0) + tiny)

        center, radius, first, last = [0], [0.0], [0], [0]
        waiting = [(0, np.arange(len(x)))]
        for node, points in waiting:  # level by level, so that a node's children stand side by side
            near = away(points, center[node])
            radius[node] = near.max()
            own, chosen = np.zeros(len(points), np.int32), [center[node]]
            while len(chosen) < len(points) and (near.max() > radius[node] / 2 or radius[node] <= np.sqrt(tiny)):
                # Where rounding hides all distances, every point becomes a child.
                c = points[near.argmax()] if radius[node] > np.sqrt(tiny) else next(p for p in points if p not in chosen)
                d = away(points, c)
                closer = d < near
                closer[points == c] = True
                near = np.where(closer, d, near)
                near[points == c] = 0
                own[closer] = len(chosen)
                chosen.append(int(c))
            first[node], last[node] = len(center), len(center) + len(chosen)
            for i, c in enumerate(chosen):
                mine = points[own == i]
                if len(mine) > 1:
                    waiting.append((len(center), mine))
                center.append(c)
                radius.append(0.0)
                first.append(0)
                last.append(0)
        return cls(x, starts, ids[order], labels[order], np.array(center, np.int32), np.array(radius), np.array(first, np.int32), np.array(last, np.int32))

    def columns(self) -> list[list]:
        return [[self.x.shape[1]], [self.x.ravel()], [self.starts], [self.ids], [self.labels], [self.center], [self.radius], [self.first], [self.last]]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Iterator[CoverTree]:
        for i in range(batch.num_rows):
            width, x, *rest = (batch.column(c)[i] for c in _TREE.names)
            yield cls(x.values.to_numpy().reshape(-1, width.as_py()), *(c.values.to_numpy() for c in rest))

    def rows(self, vector: int, label: int, same: bool, own: int, most: int) -> list[int]:
        """The least ids, at most so many, of a vector's rows of the label, without own, or of the rows of other labels."""
        a, b = self.starts[vector], self.starts[vector + 1]
        ids, labels = self.ids[a:b], self.labels[a:b]
        fits = (labels == label) & (ids != own) if same else labels != label
        return ids[fits][:most].tolist()

    def search(self, queries: Queries, which: np.ndarray) -> None:
        """Offers this tree's rows to the windows of the queries named."""
        width = self.x.shape[1]
        kids = slice(self.first[0], self.last[0])
        for a in range(0, len(which), TOGETHER):
            some = which[a : a + TOGETHER]
            q = fitted(queries.vectors[some], width)
            scores = products(self.x[self.center[kids]], q.T)
            for j, i in enumerate(some):
                self.descend(queries, i, q[j], scores[:, j])

    def descend(self, queries: Queries, i: int, q: np.ndarray, scores: np.ndarray) -> None:
        wants = queries.wants[i]
        norm = float(np.sqrt((q.astype(float) ** 2).sum()))
        waiting: list[tuple[float, float, int]] = []
        node = 0
        while True:
            kids = np.arange(self.first[node], self.last[node])
            reach = self.radius[kids] * norm
            reach += (reach > 0) * (1 + 1e-9 * (reach + np.abs(scores)))  # rounding never hides a row
            low = min(w.least for w in wants)
            keep = (scores + reach >= low) & (scores - reach <= max(w.high for w in wants))
            leaf = self.last[kids] == 0
            if (found := keep & leaf).any():
                self.verify(queries, i, self.center[kids[found]], scores[found])
            for k in np.flatnonzero(keep & ~leaf).tolist():
                heapq.heappush(waiting, (-float(scores[k] + reach[k]), float(scores[k] - reach[k]), int(kids[k])))
            while waiting:
                up, down, node = heapq.heappop(waiting)
                if any(-up >= w.least and down <= w.high for w in wants):
                    break
            else:
                return
            scores = products(self.x[self.center[self.first[node] : self.last[node]]], q)

    def verify(self, queries: Queries, i: int, vectors: np.ndarray, scores: np.ndarray) -> None:
        order = np.argsort(-scores, kind="stable")
        vectors, scores = vectors[order], scores[order]
        for w in queries.wants[i]:
            for k in range(int(np.searchsorted(-scores, -w.high)), len(scores)):
                s = int(scores[k])
                if s < w.least:
                    break
                w.offer(s, self.rows(int(vectors[k]), queries.labels[i], queries.same, queries.ids[i], w.most))


class Wanted:
    """The first rows, by score and then id, of those whose score lies between low and high."""

    __slots__ = ("best", "high", "least", "most")

    def __init__(self, low: int, high: int, most: int):
        self.least, self.high, self.most = low, high, most
        self.best: list[tuple[int, int]] = []

    def offer(self, score: int, ids: list[int]) -> None:
        if ids:
            self.best = sorted([*self.best, *((-score, i) for i in ids)])[: self.most]
            if len(self.best) == self.most:
                self.least = max(self.least, -self.best[-1][0])


class Queries:
    def __init__(self, ids: list[int], labels: list[int], vectors: np.ndarray, wants: list[list[Wanted]], same: bool):
        self.ids, self.labels, self.vectors, self.wants, self.same = ids, labels, vectors, wants, same


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of another width: what lacks counts as 0, what has no counterpart is multiplied by 0."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def matrix(vectors: list) -> np.ndarray:
    out = np.zeros((len(vectors), max(1, max(map(len, vectors), default=1))), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def candidates(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: v has floor(256 x) for each component, labels of ids divisible by 7 are the next of ten.

    Rows without an id, a label or a vector, or with a null or non-finite component, take none.
    """
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label").cast("long")
    rows = embeddings.where(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("v"))


def trees(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each cover tree of at most ``block`` rows; a task sorts what it gathers by label, so that most trees hold few labels."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            held.clear()
            ids, labels, v = t["vec_id"].to_numpy(), t["label"].to_numpy(), t["v"].to_pylist()
            order = np.argsort(labels, kind="stable")
            for a in range(0, len(order), block):
                mine = order[a : a + block]
                tree = CoverTree.build(matrix([v[i] for i in mine]), ids[mine], labels[mine])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(tree.columns(), _TREE.types, strict=True)], schema=_TREE)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GATHER:
                yield from flush()
        if held:
            yield from flush()

    return rows.repartition(partitions(rows.sparkSession)).mapInArrow(run, TREE)


def best(forest: DataFrame, ids: list[int], labels: list[int], vectors: np.ndarray, windows: list[list[tuple[int, int]]], most: int, same: bool) -> DataFrame:
    """(anchor, window, id, score): for each anchor's windows the best rows of each task's trees; anchor and window are positions in the lists."""
    sent = forest.sparkSession.sparkContext.broadcast((ids, labels, vectors, windows))

    def run(batches):
        ids, labels, vectors, windows = sent.value
        queries = Queries(ids, labels, vectors, [[Wanted(a, b, most) for a, b in w] for w in windows], same)
        of_label = np.array(labels)
        open_ = np.array([bool(w) for w in windows], bool)
        for batch in batches:
            for tree in CoverTree.of(batch):
                has = np.unique(tree.labels)
                # Rows of another label than the only one of a tree are none of the tree's.
                fits = np.isin(of_label, has) if same else ~np.isin(of_label, has) if len(has) == 1 else np.ones(len(of_label), bool)
                tree.search(queries, np.flatnonzero(fits & open_))
        found = [(i, k, n, -s) for i, w in enumerate(queries.wants) for k, x in enumerate(w) for s, n in x.best]
        for a in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[a : a + 50_000], strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "window", "id", "score"])

    each = forest.mapInArrow(run, "anchor int, window int, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", place).where(F.col("rank") <= most)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its first positives, the first negatives in the window of the positive's score.

    Each row of such an id is an anchor of its own; rows of the anchor's id aren't its positives, and repeated rows are
    candidates each.  Vectors of different lengths are compared as if filled up with zeros; a score past a long is the nearest long.
    A window is low to high percent of the positive's score, so one of a negative score is empty.  No anchors, no rows.
    """
    spark = embeddings.sparkSession
    rows = candidates(embeddings)
    forest = cut(trees(rows, block))
    out = []
    for some in batched(cut(rows.where(F.col("vec_id") % every == 0)).toLocalIterator(), anchors):
        ids, labels, vectors = [r.vec_id for r in some], [r.label for r in some], matrix([r.v for r in some])
        found = best(forest, ids, labels, vectors, [[(LEAST, MOST)]] * len(ids), positives, True).collect()
        own: list[list[tuple[int, int]]] = [[] for _ in ids]
        for r in sorted(found, key=lambda r: (r.anchor, r["rank"])):
            own[r.anchor].append((r.id, r.score))
        windows = [[(-(-low * s // 100), high * s // 100) for _, s in x] for x in own]
        named = spark.createDataFrame([(i, k, ids[i], p, s) for i, x in enumerate(own) for k, (p, s) in enumerate(x)], "anchor int, window int, anchor_id long, positive_id long, positive_score long")
        # named has at most ``anchors`` times ``positives`` rows.
        new = best(forest, ids, labels, vectors, windows, negatives, False).join(F.broadcast(named), ["anchor", "window"])
        out.append(new.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    result = spark.createDataFrame([], RESULT)
    for new in out:
        result = result.union(new if len(out) == 1 else cut(new))
    return result
