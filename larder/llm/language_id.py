"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word is the bag of its character n-grams, hashed to a fixed number of rows of an embedding; a text is the mean of
its subwords' rows, classified by a linear layer.  Both are trained together by stochastic gradient descent in numpy.  A
temperature, fitted on rows kept from training, makes scores probabilities; a text whose best one is below the threshold
learned from the same rows is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import remainder, slices, texts

ROWS, DIMS, SIZES = 4096, 16, (1, 2, 3, 4)
#: Documents of a language that the fit takes, evenly by a hash of the id.
PER_LANG = 400
#: Tokens that a task remembers.
FULL = 500_000
EPOCHS, RATE, BATCH = 40, 2.0, 32
UNKNOWN = "und"
P = np.uint64(0x9E3779B97F4A7C15)


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token, row) of every n-gram of the tokens' runs of letters, in lower case; a mark at either end of a run counts as a character."""
    chars = np.frombuffer("\n".join(["", *tokens, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, which = np.unique(chars, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()])[which]
    a = np.where(letter, chars, 0).astype(np.uint64)
    token = np.cumsum(chars == 10) - 1
    owners, rows = [], []
    for n in SIZES:
        m = max(0, len(a) - n + 1)
        inside = np.ones(m, bool)
        for j in range(1, n - 1):
            inside &= letter[j : j + m]
        if n == 1:
            inside, owner = letter[:m], token[:m]
        elif n == 2:
            inside, owner = letter[:m] | letter[1 : 1 + m], np.where(letter[:m], token[:m], token[1 : 1 + m])
        else:
            owner = token[1 : 1 + m]
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h + a[j : j + m]) * P
        h = h[inside]
        rows.append(((h ^ (h >> np.uint64(31))) * P >> np.uint64(40)).astype(np.int64) % ROWS)
        owners.append(owner[inside])
    return np.concatenate(owners), np.concatenate(rows)


class Known(dict):
    """token -> its row in a table of sums; the table has a limited size and starts again when it is full."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights
        self.table = np.zeros((FULL + 60_000, weights.shape[1] + 1))

    def learn(self, tokens: list[str]) -> None:
        owner, rows = grams(tokens)
        out = self.table[len(self) : len(self) + len(tokens)]
        for c in range(self.weights.shape[1]):
            out[:, c] = np.bincount(owner, self.weights[rows, c], len(tokens))
        out[:, -1] = np.bincount(owner, minlength=len(tokens))
        self.update(zip(tokens, range(len(self), len(self) + len(tokens)), strict=True))

    def sums(self, text: str) -> np.ndarray:
        """The summed weights of all subwords, and how many there are."""
        total, tokens = np.zeros(self.table.shape[1]), text.split()
        for i in range(0, len(tokens), 50_000):
            part = tokens[i : i + 50_000]
            if len(self) > FULL:
                self.clear()
            if new := [t for t in dict.fromkeys(part) if t not in self]:
                self.learn(new)
            total += self.table[list(map(self.__getitem__, part))].sum(0)
        return total


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], seed: int = 0):
        """x: for each text the share of each row."""
        r = np.random.default_rng(seed)
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(v) for v in langs])
        order = r.permutation(len(y))
        kept = order[: len(y) // 5] if len(y) >= 50 else order[:0]
        learn = order[len(kept) :]
        e, w, b = r.normal(0, 0.1, (ROWS, DIMS)), r.normal(0, 0.1, (DIMS, len(self.langs))), np.zeros(len(self.langs))
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for i in range(0, len(learn), BATCH):
                own = learn[i : i + BATCH]
                mean = x[own] @ e
                p = softmax(mean @ w + b)
                p[np.arange(len(own)), y[own]] -= 1
                p /= len(own)
                back = p @ w.T
                w -= rate * mean.T @ p
                b -= rate * p.sum(0)
                e -= rate * x[own].T @ back
            r.shuffle(learn)
        self.weights, self.bias = e @ w, b
        logits = x[kept] @ self.weights + b
        self.temperature, self.reject_below = 1.0, 0.5
        if len(kept):
            grid = np.geomspace(0.2, 5, 25)
            loss = [-np.log(softmax(logits / t)[np.arange(len(kept)), y[kept]] + 1e-9).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            p = softmax(logits / self.temperature)
            right = p.max(1)[p.argmax(1) == y[kept]]
            self.reject_below = float(min(0.9, max(1.2 / len(self.langs), np.quantile(right, 0.01)))) if len(right) else 0.5

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        return softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(docs: DataFrame, fold: int, folds: int, per_lang: int) -> Model | None:
    """From text and non-null lang of documents outside the held-out fold; per_lang documents of each language at most, about."""
    rows = texts(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null").where(remainder(F.col("doc_id"), folds) != fold)
    share = {r["lang"]: min(1.0, per_lang / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return None
    chance = F.create_map(*(F.lit(v) for pair in sorted(share.items()) for v in pair))[F.col("lang")]
    taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * chance)

    def bags(batches):
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            at, share = [], []
            for t in batch.column("text").to_pylist():
                n = np.bincount(grams(t.split())[1], minlength=ROWS)
                at.append(np.flatnonzero(n).astype(np.int32))
                share.append((n[n > 0] / max(n.sum(), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["doc_id", "lang", "at", "share"])

    seen = taken.mapInArrow(bags, "doc_id long, lang string, at array<int>, share array<float>").where("size(at) > 0").toPandas()
    if not len(seen):
        return None
    seen["first"] = [tuple(v[:8]) for v in seen["at"]]
    seen = seen.sort_values(["doc_id", "lang", "first"])  # the fit doesn't depend on the order of partitions
    x = np.zeros((len(seen), ROWS), np.float32)
    for i, (at, share) in enumerate(zip(seen["at"], seen["share"], strict=True)):
        x[i, at] = share
    return Model(x, list(seen["lang"]))


def languages(docs: DataFrame, fold: int = 1, folds: int = 3, per_lang: int = PER_LANG, reject: bool = True) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> a row for each: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is ``und`` (score 0) for a text without any letter, a null one too, and where nothing could be learned; with
    ``reject`` also for a text whose best probability is below the learned threshold.  Without it such a text keeps its best
    language and is only marked in ``rejected``.  Repeated rows and null ids are rows like any other; other columns are left
    behind; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, fold, folds, per_lang))

    def run(batches):
        known = Known(model.value.weights) if model.value else None
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            langs, scores, rejected = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), [True] * batch.num_rows
            if known is not None:
                sums = np.array([known.sums(t) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, -1)
                p = model.value.probabilities(sums)
                for i in np.flatnonzero(sums[:, -1]):
                    scores[i] = p[i].max()
                    rejected[i] = bool(scores[i] < model.value.reject_below)
                    if not (reject and rejected[i]):
                        langs[i] = model.value.langs[int(p[i].argmax())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    out = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == fold).alias("held_out"), "lang_pred", "score", "rejected")
