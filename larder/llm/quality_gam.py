"""Quality by a generalised additive model with pairwise interactions.

Shallow trees over one binned statistic at a time are boosted in turn, round after round; their leaves are added up into one
lookup table a statistic.  Then the pairs that the residuals speak for get small two-dimensional tables in the same way.  A
score is a sum of looked-up numbers, added for whole columns at once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, remainder, slices, texts
from larder.llm.robust_outliers import counts

NAMES = ("n_words", "word_length", "symbols", "repeated_lines", "repeated_words", "line_length", "capitals", "variety", "digits", "stops", "non_ascii", "longest_word")
#: Labelled rows that the fit takes, evenly by a hash of the id.
MAX_TRAIN = 50_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 40, 6, 0.1


def statistics(text: str) -> list[float]:
    n, chars, symbols, dup, repeated, lines, upper, distinct = counts(text)
    words, size = max(n, 1), max(chars, 1)
    return [
        float(np.log1p(n)),
        chars / words,
        symbols / size,
        dup / max(lines, 1),
        repeated / words,
        float(np.log1p(words / max(lines, 1))),
        upper / size,
        float(np.log(max(distinct, 1) / words) / np.log(words + 1)),
        sum(map(text.count, "0123456789")) / size,
        sum(map(text.count, ".,;:!?")) / words,
        (len(text.encode("utf-8", "surrogatepass")) - len(text)) / size,
        float(np.log1p(max(map(len, text.split()), default=0))),
    ]


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 1.0) -> np.ndarray:
    """A value for each bin: the leaves of a tree of that depth on the sums of gradients g and weights h."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), -1)
        if gain.max() > 1e-9:
            at = int(gain.argmax()) + 1
            value[:at], value[at:] = tree(g[:at], h[:at], depth - 1, least), tree(g[at:], h[at:], depth - 1, least)
    return value


def quad(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a two-dimensional histogram into four by one threshold a side, and its gain."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, value = 0.0, np.zeros_like(g)
    a, b = gc[:-1, :-1], hc[:-1, :-1]
    parts = [(a, b), (gc[:-1, -1:] - a, hc[:-1, -1:] - b), (gc[-1:, :-1] - a, hc[-1:, :-1] - b)]
    parts.append((gc[-1, -1] - sum(p[0] for p in parts), hc[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    best = float(gain[i, j])
    value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = (x[i, j] / (y[i, j] + 1) for x, y in parts)
    return value, best


class Gam:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = self.bins(x)
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        logit = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-logit))
                step = RATE * tree(np.bincount(bins[:, f], y - p, len(table)), np.bincount(bins[:, f], p * (1 - p), len(table)))
                table += step
                logit += step[bins[:, f]]
        coarse = self.coarse(bins)
        p = 1 / (1 + np.exp(-logit))
        self.pairs = sorted(combinations(range(x.shape[1]), 2), key=lambda c: -quad(*self.histograms(coarse, c, y - p, p * (1 - p)))[1])[:PAIRS]
        self.pair_tables = [np.zeros((COARSE, COARSE)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for c, table in zip(self.pairs, self.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-logit))
                step = RATE * quad(*self.histograms(coarse, c, y - p, p * (1 - p)))[0]
                table += step
                logit += step[coarse[:, c[0]], coarse[:, c[1]]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)])

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        return np.column_stack([bins[:, f] * COARSE // (len(c) + 1) for f, c in enumerate(self.cuts)])

    @staticmethod
    def histograms(coarse: np.ndarray, c: tuple[int, int], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = coarse[:, c[0]] * COARSE + coarse[:, c[1]]
        return tuple(np.bincount(at, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (g, h))

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        coarse = self.coarse(bins)
        logit = self.base + sum(t[bins[:, f]] for f, t in enumerate(self.tables)) + sum(t[coarse[:, a], coarse[:, b]] for (a, b), t in zip(self.pairs, self.pair_tables, strict=True))
        return 1 / (1 + np.exp(-logit))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: int = 0, folds: int = 5, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs(doc_id, text, ...) -> a row for each: doc_id, held_out, score, predicted.

    Labels(doc_id, quality) are learned from documents outside the held-out fold, of which at most about max_train go to
    the fit.  Null texts count as empty; null labels are left out; without labels every score is 0.5.  Repeated rows and
    null ids are rows like any other; other columns are left behind; an empty table gives an empty result.
    """
    spark = docs.sparkSession

    def run(batches):
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    found = cut(texts(docs).mapInArrow(run, "doc_id long, x array<double>"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y is not null").where(remainder(F.col("doc_id"), folds) != fold)
    n = marks.count()
    taken = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * max_train // max(n, 1))
    seen = found.join(taken, "doc_id").orderBy("doc_id", "y").toPandas()
    gam = Gam(np.array(seen["x"].tolist()), seen["y"].to_numpy(float)) if len(seen) else None
    gam = spark.sparkContext.broadcast(gam)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(NAMES))
            s = gam.value.score(x) if gam.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = found.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
