"""Quality rules with robust multivariate outliers.

Base rules are plain limits on a text's counts.  Texts that pass are described by a vector of transformed statistics, and each
(language, source) gets a minimum-covariance-determinant estimate of its centre and scatter: from several starts,
concentration steps go on to the three quarters of the documents that lie nearest; after two steps the start of the least
determinant goes on alone, until its determinant falls no more.  A document is rejected when its Mahalanobis distance from
its group is beyond ``LIMIT``.

Documents are never gathered: a step sums counts, vectors and products over bins of the distance, which is a fixed number of
rows a group, and only these go to the step's numpy.  Estimates are a few numbers a group; they are sent to the documents up to
a counted number of groups.  A scatter of six statistics has 21 entries, which fewer than ``MIN_GROUP`` documents
don't settle; such groups use their language's estimate, and small languages that of all documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import BLANKS, cut, own, slices, texts

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 0.5
#: Share of a group that a concentration step goes on with, steps from every start, and how many there are at most from the best.
SHARE, FIRST_STEPS, STEPS = 0.75, 2, 8
#: A logarithm of the determinant that falls by less has settled.
SETTLED = 0.01
#: Estimates up to this number, of some 400 bytes each, are sent to the documents.
BROADCAST_ROWS = 50_000
MIN_GROUP = 100
#: Distances are in standard deviations of a Gaussian core; text statistics have longer tails, and clean texts must stay.
LIMIT = 5.0
#: Bins of the distance, and their width.
BINS, WIDTH = 512, 0.025
FEATURES = ("word_length", "symbols", "repeated_words", "repeated_lines", "capitals", "variety")
#: No statistic is held to be steadier than this: a group without a single symbol doesn't make one symbol an outlier.
FLOOR = np.array([0.05, 0.055, 0.13, 0.18, 0.06, 0.08])

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
EXTRA = "n_lines long, n_upper long, n_distinct long"


def counts(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            seen = Counter(grams)
            last = -1  # the last word that is covered
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + 2 - max(last, i - 1)
                    last = i + 2
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(set(words)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in f"{COUNTS}, {EXTRA}".split(", ")]

    def run(batches):
        own("counts", dict)  # nothing is kept here, and what another operator kept goes
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            found = [counts(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *cols], ["doc_id", "lang", "source", *names])

    return docs.mapInArrow(run, f"doc_id long, lang string, source string, {COUNTS}, {EXTRA}")


def vector() -> list[Column]:
    """The transformed statistics, in the order of FEATURES: logarithms of ratios and square roots of shares, which steady their spread."""
    n = F.greatest("n_words", F.lit(1))
    share = lambda a, b: F.sqrt(F.col(a) / b)
    return [
        F.log((F.col("word_chars") + 1) / n),
        share("n_symbols", F.greatest("word_chars", F.lit(1))),
        share("n_repeat_words", n),
        share("n_dup_lines", F.greatest("n_lines", F.lit(1))),
        share("n_upper", F.greatest("word_chars", F.lit(1))),
        F.log(F.col("n_distinct") / n) / F.log(n + 1),  # how fast new words come, at any length
    ]


def key(*cols: str) -> Column:
    """A group's key; a null is a value of its own, unlike any text."""
    return F.concat_ws("/", *(F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.regexp_replace(c, "([\\\\/])", "\\\\$1"))) for c in cols))


P = len(FEATURES)
XS = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i, j in PAIRS]
#: An estimate: from which start, of how many documents, centre, the lower triangle of the inverse scatter, and the logarithm of the scatter's determinant.
ESTIMATE = "grp string, start int, docs long, centre array<double>, inverse array<double>, det double"


def distance2() -> Column:
    d = [F.col(x) - F.col("centre")[i] for i, x in enumerate(XS)]
    return sum((F.col("inverse")[k] * d[i] * d[j] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(XS)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS)]


def estimate(grp: str, start: int, docs: int, centre: np.ndarray, scatter: np.ndarray) -> dict:
    whole = scatter + np.diag(FLOOR**2)
    inverse = np.linalg.inv(whole)
    return {"grp": grp, "start": start, "docs": docs, "centre": centre.tolist(), "inverse": [float(inverse[i, j]) for i, j in PAIRS], "det": float(np.linalg.slogdet(whole)[1])}


def near(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows with their group's estimates, which are broadcast up to a counted number of them."""
    return rows.join(F.broadcast(estimates) if estimates.count() <= BROADCAST_ROWS else estimates, "grp")


def starts(rows: DataFrame) -> DataFrame:
    """Three starts a group, from histograms of 1/64 of a unit, which are a bounded number of rows a group and statistic:
    medians with the spread of absolute deviations from them, the same spread for all statistics, and the fullest bins with the spread around them."""
    bins = F.array(*(F.floor(F.col(x) * 64).cast("int") for x in XS))
    hist = rows.select("grp", F.posexplode(bins).alias("i", "bin")).groupBy("grp", "i", "bin").count()

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, spread, mode, around = (np.zeros(P) for _ in range(4))
        for i, rows_ in pdf.groupby("i"):
            rows_ = rows_.sort_values("bin")
            at, n = rows_["bin"].to_numpy() / 64 + 1 / 128, rows_["count"].to_numpy()
            centre[i] = at[np.searchsorted(n.cumsum(), n.sum() / 2)]
            wide = np.array([n[(at > x - 0.05) & (at < x + 0.05)].sum() for x in at])
            mode[i] = at[wide.argmax()]
            for middle, out in ((centre, spread), (mode, around)):
                away = np.abs(at - middle[i])
                order = np.argsort(away, kind="stable")
                out[i] = 1.4826 * away[order][np.searchsorted(n[order].cumsum(), n.sum() / 2)]
        grp, docs = pdf["grp"].iloc[0], int(pdf["count"].sum()) // P
        return pd.DataFrame([estimate(grp, 0, docs, centre, np.diag(spread**2)), estimate(grp, 1, docs, centre, np.eye(P) * (spread**2).mean()), estimate(grp, 2, docs, mode, np.diag(around**2))])

    return hist.groupBy("grp").applyInPandas(of, ESTIMATE)


def start(rows: DataFrame) -> DataFrame:
    """The start from medians alone."""
    return starts(rows).where("start = 0")


def concentrate(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One step: the mean and scatter of the SHARE of each group that lies nearest, by whole bins of the distance."""
    bins = F.least(F.floor(F.sqrt(F.greatest(distance2(), F.lit(0.0))) / WIDTH), F.lit(BINS - 1)).cast("int")
    binned = near(rows, now.drop("docs", "det")).groupBy("grp", "start", bins.alias("bin")).agg(*sums())

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy()
        inner = pdf.iloc[: int(np.searchsorted(n.cumsum(), SHARE * n.sum())) + 1]
        total = inner[["n", *MOMENTS]].sum()
        centre = np.array([total[f"s{i}"] for i in range(P)]) / total["n"]
        scatter = np.zeros((P, P))
        for i, j in PAIRS:
            scatter[i, j] = scatter[j, i] = total[f"s{i}_{j}"] / total["n"] - centre[i] * centre[j]
        # The nearest three quarters of a Gaussian are narrower than the whole; this factor makes up for it (Croux and Haesbroeck, 1999).
        return pd.DataFrame([estimate(pdf["grp"].iloc[0], int(pdf["start"].iloc[0]), int(n.sum()), centre, scatter * CONSISTENCY)])

    return binned.groupBy("grp", "start").applyInPandas(of, ESTIMATE)


def least_determinant(rows: DataFrame) -> DataFrame:
    """rows(grp, x...) -> the estimate of each group."""
    now = cut(starts(rows))
    for _ in range(FIRST_STEPS):
        now = cut(concentrate(rows, now))
    best = cut(now.groupBy("grp").agg(F.min_by(F.struct(*now.columns), F.struct("det", "start")).alias("e")).select("e.*"))
    for _ in range(STEPS):
        more = cut(concentrate(rows, best))
        both = best.select("grp", F.struct(*best.columns).alias("old")).join(more.select("grp", F.struct(*more.columns).alias("new")), "grp")
        fell = F.col("new.det") < F.col("old.det")
        state = cut(both.select(F.when(fell, F.col("new")).otherwise(F.col("old")).alias("e"), (F.col("new.det") < F.col("old.det") - SETTLED).alias("on")))
        best = state.select("e.*")
        if not state.where("on").count():
            break
    return best


def consistency(share: float, p: int) -> float:
    """share / P(chi2(p + 2) <= the share quantile of chi2(p)), by sums of the even-dimensional closed form."""
    assert p % 2 == 0

    def below(x: float, dims: int) -> float:
        term, total = np.exp(-x / 2), 0.0
        for i in range(dims // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - total

    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid, p) < share else (lo, mid)
    return share / below(lo, p + 2)


CONSISTENCY = consistency(SHARE, P)


def judge(docs: DataFrame, limit: float = LIMIT, min_group: int = MIN_GROUP) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) -> a row for each: doc_id, the counts, base_failed, distance, kept.

    Null texts count as empty and fail the base rules, as all texts of fewer than 50 words do; distance is null for what
    fails them.  A null language or source is a group of its own.  Repeated rows are judged as rows, null ids too; other
    columns are left behind; an empty table gives an empty result.
    """
    docs = texts(docs, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    found = cut(statistics(docs).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or n_repeat_words > {MAX_REPEATED} * n_words")))
    passed = found.where("not base_failed").select("lang", "source", *(x.alias(name) for x, name in zip(vector(), XS, strict=True)))
    levels = [key("lang", "source"), F.concat(key("lang"), F.lit("/*")), F.lit("*")]
    rows = cut(passed.select(F.explode(F.array(*levels)).alias("grp"), *XS))
    large = cut(least_determinant(rows).where(F.col("docs") >= min_group).select("grp", "centre", "inverse"))
    few = large.count() <= BROADCAST_ROWS
    out = found.withColumns({name: x for name, x in zip(XS, vector(), strict=True)})
    picked = []
    for i, level in enumerate(levels[:2]):
        level_own = large.select(F.col("grp").alias(f"g{i}"), F.struct("centre", "inverse").alias(f"e{i}"))
        out = out.join(F.broadcast(level_own) if few else level_own, level == F.col(f"g{i}"), "left")
        picked.append(F.col(f"e{i}"))
    if everything := large.where("grp = '*'").first():
        picked.append(F.struct(*(F.array(*map(F.lit, everything[c])).alias(c) for c in ("centre", "inverse"))))
    out = out.withColumn("e", F.coalesce(*picked)).withColumns({"centre": F.col("e.centre"), "inverse": F.col("e.inverse")})
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(F.greatest(distance2(), F.lit(0.0)))))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
