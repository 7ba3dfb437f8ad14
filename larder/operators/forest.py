"""Random forests of any size: tasks that each grow some of the trees over all rows, by their bins.

A row is a byte for each feature (its bin among quantiles of the training rows), a byte for its class and one for its part; rows of
such bytes travel in chunks, and a task takes them all, a tenth of what the table is.  Trees grow a level at a time from counts of
(node, bin, class), so a task holds its rows, where they stand, and a bounded number of counts, and no tree ever reaches the driver.
Rows weigh by their class; bootstrap samples are Poisson counts, splits gain in Gini impurity, as in MLlib.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.shared import cut

BINS = 32
#: Rows that are worked on at a time, and counts held at a time.
BLOCK, CELLS = 1 << 18, 1 << 21
#: Arrays beyond this many bytes lie in a file of the task's own.
IN_MEMORY = 256 << 20
#: A class that the training rows don't have.
UNKNOWN = 255


@dataclass(frozen=True)
class Trees:
    """How trees grow: a number of them, their depth, how many features a split sees, the least rows of a node."""

    trees: int
    depth: int
    subset: str = "sqrt"
    least: int = 1


@dataclass(frozen=True)
class Job:
    """Trees first to last of a unit, over the rows of all parts but the one held out."""

    unit: int
    first: int
    last: int
    how: Trees
    held: int


@dataclass(frozen=True)
class Rows:
    """Chunks (seq, n, x, ids, labels) of binned rows, with ids and labels of those held out; the classes' names and weights; ends of bins."""

    chunks: DataFrame
    n: int
    labels: list[str]
    weights: list[float]
    edges: list[list[float]]


def subset_size(name: str, n: int) -> int:
    return {"sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3), "all": n, "auto": math.ceil(math.sqrt(n))}[name]


def edges_of(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Of each feature, upper ends of the bins but the last."""
    found = df.agg(*(F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 10_000).alias(c) for c in features)).first()
    return [sorted(set(found[c] or [])) for c in features]


def binned(df: DataFrame, part: str, features: list[str], weights: dict[str, float], edges: list[list[float]], held: int | None = None, key: str = "recipe_id") -> Rows:
    """df(key, label, part, features) in chunks."""
    labels = sorted(weights)

    def run(batches):
        context, i = TaskContext.get(), 0
        place = {x: k for k, x in enumerate(labels)}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.empty((b.num_rows, len(features) + 2), np.uint8)
            for j, c in enumerate(features):
                x[:, j] = np.searchsorted(edges[j], b.column(c).to_numpy(zero_copy_only=False), side="left")
            names = b.column("label").to_pylist()
            x[:, -2] = [place.get(t, UNKNOWN) for t in names]
            x[:, -1] = b.column(part).to_numpy(zero_copy_only=False)
            seq = ((context.partitionId() if context else 0) << 32) + i
            i += 1
            own = np.flatnonzero(x[:, -1] == held) if held is not None else []
            ids = pa.array([b.column(key).take(pa.array(own, pa.int64())).to_pylist()], pa.list_(b.schema.field(key).type))
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([b.num_rows], pa.int64()), pa.array([x.tobytes()], pa.binary()), ids, pa.array([[names[i] for i in own]], pa.list_(pa.string()))], ["seq", "n", "x", "ids", "labels"])

    kind = df.schema[key].dataType.simpleString()
    chunks = cut(df.select(key, "label", F.col(part).cast("int").alias(part), *features).mapInArrow(run, f"seq long, n long, x binary, ids array<{kind}>, labels array<string>"))
    return Rows(chunks, chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], labels, [weights[x] for x in labels], edges)


def array(n: int, kind) -> np.ndarray:
    """Zeros; many of them lie in a file that goes with the array."""
    if n * np.dtype(kind).itemsize <= IN_MEMORY:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


def blocks(n: int) -> Iterator[slice]:
    return (slice(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK))


@dataclass
class Tree:
    """Nodes in the order of levels: what they split on (left is 0 at a leaf, right comes after left) and the classes' shares."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    shares: np.ndarray
    importance: np.ndarray

    def votes(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds each row's shares."""
        at, open_ = np.zeros(len(x), np.int32), np.arange(len(x))
        if self.left[0] == 0:
            open_ = open_[:0]
        while len(open_):
            n = at[open_]
            n = self.left[n] + (x[open_, self.feature[n]] > self.bin[n])
            at[open_] = n
            open_ = open_[self.left[n] > 0]
        out += self.shares[at]


def grown(x: np.ndarray, held: int, weights: np.ndarray, how: Trees, rng: np.random.Generator) -> Tree:
    """x: rows of bins, class and part."""
    wide, width, k = x.shape[1], x.shape[1] - 2, len(weights)
    flat, subset = x.reshape(-1), subset_size(how.subset, width)
    at, bag, n = array(len(x), np.int64 if flat.size >= 1 << 31 else np.int32), array(len(x), np.uint8), 0
    for s in blocks(len(x)):
        drawn = rng.poisson(1.0, s.stop - s.start)
        own = np.flatnonzero((drawn > 0) & (x[s, -1] != held) & (x[s, -2] != UNKNOWN))
        at[n : n + len(own)], bag[n : n + len(own)] = (own + s.start) * wide, drawn[own]
        n += len(own)
    node = array(n, np.int32)
    total = np.zeros((1, k))
    for s in blocks(n):
        total[0] += np.bincount(flat[at[s] + width], bag[s], k)
    feature, split_bin, left, counts = [np.zeros(1, np.int8)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)], [total]
    importance, made, first = np.zeros(width), 1, 0  # of the last level, first is the first node
    open_ = np.flatnonzero((total > 0).sum(1) > 1)
    for _ in range(how.depth):
        m = len(open_)
        if not m:
            break
        total = counts[-1][open_]
        seen = np.argsort(rng.random((m, width)), axis=1)[:, :subset].astype(np.int32)
        gain, best, cut_at, best_left = np.zeros(m), np.zeros(m, np.int8), np.zeros(m, np.uint8), np.zeros((m, k))
        most = max(1, CELLS // (BINS * k))
        for low in range(0, m, most):
            high = min(m, low + most)
            for j in range(subset):
                h = np.zeros((high - low) * BINS * k)
                for s in blocks(n):
                    nd, a, c = node[s], at[s], bag[s]
                    if m > most:
                        own = np.flatnonzero((nd >= low) & (nd < high))
                        nd, a, c = nd[own], a[own], c[own]
                    cell = ((nd - low) * BINS + flat[a + seen[nd, j]]) * k + flat[a + width]
                    h += np.bincount(cell, c, len(h))
                h = h.reshape(-1, BINS, k).cumsum(1)[:, :-1]
                here = total[low:high]
                rows, whole = here.sum(1), here * weights
                mass = whole.sum(1)
                fits = h.sum(2)
                fits = (fits >= how.least) & (rows[:, None] - fits >= how.least)
                lw = h * weights
                rw = whole[:, None] - lw
                score = (lw**2).sum(2) / np.maximum(lw.sum(2), 1e-300) + (rw**2).sum(2) / np.maximum(rw.sum(2), 1e-300)
                score[~fits] = -np.inf
                b = score.argmax(1)
                line = np.arange(high - low)
                new = score[line, b] / mass - (whole**2).sum(1) / mass**2
                better = np.flatnonzero(new > gain[low:high] + 1e-12)
                gain[low + better], best[low + better], cut_at[low + better] = new[better], seen[low + better, j], b[better]
                best_left[low + better] = h[better, b[better]]
        split = gain > 0
        np.add.at(importance, best[split], gain[split] * (total[split] * weights).sum(1))
        rank = np.cumsum(split) - 1
        ids = open_[split]
        feature[-1][ids], split_bin[-1][ids] = best[split], cut_at[split]
        left[-1][ids] = made + 2 * np.arange(len(ids))
        children = np.stack([best_left[split], total[split] - best_left[split]], 1).reshape(-1, k)
        first, made = made, made + len(children)
        feature.append(np.zeros(len(children), np.int8))
        split_bin.append(np.zeros(len(children), np.uint8))
        left.append(np.zeros(len(children), np.int32))
        counts.append(children)
        opens = ((children > 0).sum(1) > 1) & (children.sum(1) >= 2 * how.least)
        open_ = np.flatnonzero(opens)
        place = np.cumsum(opens) - 1
        kept = 0
        for s in blocks(n):  # what stays moves to the front
            nd, a, c = node[s], at[s], bag[s]
            child = 2 * rank[nd] + (flat[a + best[nd]] > cut_at[nd])
            own = np.flatnonzero(split[nd])
            own = own[opens[child[own]]] if len(children) else own[:0]
            end = kept + len(own)
            at[kept:end], bag[kept:end], node[kept:end] = a[own], c[own], place[child[own]]
            kept = end
        n = kept
    mass = np.concatenate(counts) * weights
    shares = (mass / np.maximum(mass.sum(1, keepdims=True), 1e-300)).astype(np.float32)
    return Tree(np.concatenate(feature), np.concatenate(split_bin), np.concatenate(left), shares, importance / max(importance.sum(), 1e-300))


def worked(rows: Rows, jobs: list[list[Job]], result, schema: str, seed: int) -> DataFrame:
    """Each list of jobs is a task's: result(x, chunks(seq, from, to), job, trees) gives its record batches."""
    width, weights, n = len(rows.edges) + 2, np.array(rows.weights), rows.n

    def task(group, x, chunks):
        for job in jobs[group]:
            trees = (grown(x, job.held, weights, job.how, np.random.default_rng([seed, job.unit, i])) for i in range(job.first, job.last))
            yield from result(x, chunks, job, trees)

    def run(batches):
        group, x, chunks, at = None, None, [], 0
        for b in batches:
            for g, seq, data in zip(*(b.column(c).to_pylist() for c in ("group", "seq", "x")), strict=True):
                if g != group:
                    if group is not None:
                        yield from task(group, x, chunks)
                    group, x, chunks, at = g, array(n * width, np.uint8).reshape(n, width), [], 0
                own = np.frombuffer(data, np.uint8).reshape(-1, width)
                x[at : at + len(own)] = own
                chunks.append((seq, at, at + len(own)))
                at += len(own)
        if group is not None:
            yield from task(group, x, chunks)

    sent = rows.chunks.select(F.explode(F.sequence(F.lit(0), F.lit(len(jobs) - 1))).alias("group"), "seq", "x")
    return sent.repartitionByRange(len(jobs), "group").sortWithinPartitions("group", "seq").mapInArrow(run, schema)


def tasks(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def shared_out(how: Trees, held: int, n: int) -> list[list[Job]]:
    """A unit's trees over up to n tasks."""
    n = max(1, min(n, how.trees))
    ends = [how.trees * i // n for i in range(n + 1)]
    return [[Job(0, a, b, how, held)] for a, b in zip(ends, ends[1:], strict=False)]


def held_votes(x: np.ndarray, held: int, trees, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows held out, and their votes."""
    places = np.flatnonzero(x[:, -1] == held)
    out = np.zeros((len(places), k), np.float32)
    for t in trees:
        for s in blocks(len(places)):
            t.votes(x[places[s]], out[s])
    return places, out


def voted(x: np.ndarray, chunks: list, job: Job, trees, k: int) -> Iterator[pa.RecordBatch]:
    """Votes on the held out rows of each chunk that has some."""
    places, out = held_votes(x, job.held, trees, k)
    for seq, a, b in chunks:
        lo, hi = np.searchsorted(places, (a, b))
        if lo < hi:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([out[lo:hi].tobytes()], pa.binary())], ["seq", "votes"])


VOTES = "seq long, votes binary"


def predictions(rows: Rows, how: Trees, held: int, seed: int, key: str = "recipe_id") -> DataFrame:
    """(key, label, predicted) of the rows held out; the trees vote where they have grown and go."""
    k = len(rows.labels)
    return most_voted(rows, worked(rows, shared_out(how, held, tasks(rows.chunks)), lambda x, chunks, job, trees: voted(x, chunks, job, trees, k), VOTES, seed), key)


def most_voted(rows: Rows, votes: DataFrame, key: str) -> DataFrame:
    """The class of the most votes, the first of those with as many."""
    k, labels = len(rows.labels), rows.labels
    kind = rows.chunks.schema["ids"].dataType.elementType.simpleString()

    def said(ids, names, sums):
        if sums is not None:
            yield pa.RecordBatch.from_arrays([ids, names, pa.array([labels[i] for i in np.argmax(sums, 1)], pa.string())], [key, "label", "predicted"])

    def most(batches):
        ids = names = sums = None
        for b in batches:
            for i, more in enumerate(b.column("votes").to_pylist()):
                if more is None:  # comes first of its chunk
                    if ids is not None:
                        yield from said(ids, names, sums)
                    ids, names, sums = b.column("ids")[i].values, b.column("labels")[i].values, None
                else:
                    sums = np.frombuffer(more, np.float32).reshape(-1, k) + (0.0 if sums is None else sums)
        if ids is not None:
            yield from said(ids, names, sums)

    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    both = rows.chunks.where(F.size("ids") > 0).select("seq", none("binary", "votes"), "ids", "labels")
    both = both.unionByName(votes.select("seq", "votes", none(f"array<{kind}>", "ids"), none("array<string>", "labels")))
    both = both.repartition("seq").sortWithinPartitions("seq", F.col("votes").isNotNull(), F.xxhash64("votes"))
    return both.mapInArrow(most, f"{key} {kind}, label string, predicted string")


TREE = "tree int, feature binary, bin binary, left binary, shares binary"


def trees_of(rows: Rows, how: Trees, held: int, seed: int) -> DataFrame:
    """A row a tree, for those who keep a forest."""

    def kept(x, chunks, job, trees):
        for i, t in enumerate(trees, job.first):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (t.feature, t.bin, t.left, t.shares))], ["tree", "feature", "bin", "left", "shares"])

    return worked(rows, shared_out(how, held, tasks(rows.chunks)), kept, TREE, seed)


def votes_of(rows: Rows, trees: DataFrame, held: int, groups: int) -> DataFrame:
    """Votes of kept trees on the rows held out; a task has some of the trees and takes the chunks one by one."""
    k, width = len(rows.labels), len(rows.edges) + 2

    def run(batches):
        group, own = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["group"] != group:
                    group, own = r["group"], []
                if r["x"] is None:
                    shares = np.frombuffer(r["shares"], np.float32).reshape(-1, k)
                    own.append(Tree(np.frombuffer(r["feature"], np.int8), np.frombuffer(r["bin"], np.uint8), np.frombuffer(r["left"], np.int32), shares, np.empty(0)))
                elif own:
                    x = np.frombuffer(r["x"], np.uint8).reshape(-1, width)
                    yield from voted(x, [(r["seq"], 0, len(x))], Job(0, 0, 0, None, held), own, k)

    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    sent = rows.chunks.select(all_groups, "seq", "x").unionByName(trees.withColumn("group", F.col("tree") % groups), allowMissingColumns=True)
    return sent.repartitionByRange(groups, "group").sortWithinPartitions("group", F.col("x").isNotNull(), "tree", "seq").mapInArrow(run, VOTES)


def importances(rows: Rows, how: Trees, held: int, seed: int) -> list[float]:
    """Of each feature: what its splits gain, as a share of each tree's and then of all."""

    def summed(x, chunks, job, trees):
        total = sum(t.importance for t in trees)
        yield pa.RecordBatch.from_pydict({"first": [job.first], "v": [total.tolist()]})

    found = worked(rows, shared_out(how, held, tasks(rows.chunks)), summed, "first long, v array<double>", seed).collect()
    total = np.sum([r.v for r in sorted(found, key=lambda r: r.first)], axis=0)
    return (total / max(total.sum(), 1e-300)).tolist()


def confusions(rows: Rows, sets: list[Trees], folds: int, seed: int, at_least: int = 1) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """Of each set of parameters and fold: (class, predicted class) and how many rows of the fold have them."""
    k = len(rows.labels)

    def counted(x, chunks, job, trees):
        places, out = held_votes(x, job.held, trees, k)
        pairs, n = np.unique(x[places, -2].astype(np.int64) * k + out.argmax(1), return_counts=True)
        yield pa.RecordBatch.from_pydict({"unit": [job.unit] * len(n), "fold": [job.held] * len(n), "y": (pairs // k).tolist(), "p": (pairs % k).tolist(), "n": n.tolist()})

    jobs = sorted((Job(i, 0, how.trees, how, f) for i, how in enumerate(sets) for f in range(folds)), key=lambda j: -j.how.trees * j.how.depth)
    n = min(len(jobs), max(at_least, tasks(rows.chunks)))
    dealt = [jobs[i::n] for i in range(n)]
    out: dict = {}
    for r in worked(rows, dealt, counted, "unit long, fold long, y long, p long, n long", seed).collect():
        out.setdefault((r.unit, r.fold), {})[r.y, r.p] = r.n
    return out
