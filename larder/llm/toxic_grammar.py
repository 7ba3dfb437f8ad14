"""Toxicity by a weighted finite-state pattern grammar.

A text's words become symbols: insult, threat, target, negation, reported speech, the halves of insults and threats of
several words, end of a clause, anything else.  Transducers are composed into one machine over these symbols.  That of
insults makes one of "waste ... space", that of threats one of "will ... hurt"; those of targets, negation and reported
speech pass their input on, marked with what they know about the clause so far.  That of targets also reads the clause from
its end, for "idiots like you".  What comes out at an insult or a threat is a matched clause pattern, such as "insult,
directed, not negated, not reported".  A document's score is the logistic of the weights of its patterns, which start from
the grammar's own weights and are fitted to the learning labels; by its own weights no bare word makes a document toxic.

The lexicon grows by what the learning labels show, in any language: words and stems that toxic documents hold more often
than clean ones, by smoothed log-odds.  The surest of them are arcs of an insult; the others weigh by how far their number
in a document, as words and as different words, exceeds what clean documents hold.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, remainder, slices, texts

# The lexicon, by symbol.
LEXICON = {
    "I": "idiot moron loser scum trash clown stupid worthless disgusting pathetic imbecile dumb dumbass bastard asshole bitch retard filth vermin scumbag dirtbag jerk fool idiotic moronic dummkopf trottel arschloch abschaum wertlos dreckig idiote imbécile crétin connard salaud minable ordure imbécil estúpido inútil basura gilipollas cabrón asqueroso",
    "T": "kill murder strangle stab shoot töten umbringen erschießen tuer étrangler matar apuñalar",
    "Y": "you your you're u he she they him her them his their these those people guys everyone du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes vosotros ellos ellas",
    "N": "not never no isn't aren't wasn't don't doesn't didn't won't can't nobody neither nor without nicht nie kein keine pas jamais aucun aucune nunca jamás ningún ninguna",
    "R": "said says say saying wrote writes claimed claims quoted quote quotes reported called calls according sagte schrieb behauptete dit écrit déclaré dijo escribió según",
    "H": "piece waste sack bag pile stück haufen morceau tas pedazo montón",
    "D": "shit crap garbage dirt dung rubbish space oxygen dreck müll scheiße merde mierda",
    "M": "will shall must should gonna going want wants i'll we'll they'll he'll she'll werde werden wirst vais va voy vamos",
    "V": "hurt beat destroy smash burn bury crush hunt hang break verprügeln verbrennen frapper brûler golpear quemar",
}
SYMBOL = {w: s for s, words in LEXICON.items() for w in words.split()}
#: How many words a target, a negation or the first half of an insult or a threat reaches on.
REACH = {"Y": 6, "N": 3, "H": 3, "M": 4}
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.;!?\n]")
#: The grammar's own weights in logits: what the fit starts from and is drawn back to.
OWN = {"none": -2.5, "I": 3.0, "T": 1.5, "directed": 1.5, "negated": -1.5, "reported": -1.0, "again": 1.0, "excess": 0.3}
#: A feature counts a pattern up to this many times.
MOST = 3
MAX_PATTERNS = 20_000
#: Lengths of a stem in characters; a learned word is its characters and END.
STEM, END = range(3, 9), "$"
#: What is learned stands in MIN_DOCS toxic documents, and its log-odds less ERRORS standard errors reach LEAST; from log-odds of SURE on it is an arc of an insult.
LEAST, SURE, ERRORS, MIN_DOCS = float(np.log(3)), float(np.log(150)), 3, 5
MAX_STEMS = 100_000
#: Steps of the excess of learned words in a document.
LEVELS = 15


class Transducer:
    """States are any hashable values; step(state, symbol) -> (state, output).  Symbols are tuples: a kind, then marks."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out goes into the other."""

        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = other.step(state[1], middle)
            return (a, b), out

        return Transducer((self.start, other.start), step)


def halves(first: str, second: str, kind: str) -> Transducer:
    """A symbol of the first kind and one of the second, at most REACH[first] words on in one clause, make one of ``kind``; alone they are anything else."""

    def step(left, x):
        if x[0] == "E":
            return 0, x
        if x[0] == first:
            return REACH[first], ("O",)
        if x[0] == second:
            return max(0, left - 1), (kind if left else "O",)
        return max(0, left - 1), x

    return Transducer(0, step)


def harm() -> Transducer:
    """Insults and threats, of one word or of several."""
    return halves("H", "D", "I").then(halves("M", "V", "T"))


def within_reach(kind: str, mark: str) -> Transducer:
    """Marks an insult or threat that stands at most REACH[kind] words after a word of that kind, in one clause."""

    def step(left, x):
        if x[0] == "E":
            return 0, x
        if x[0] == kind:
            return REACH[kind], x
        return max(0, left - 1), (*x, mark) if left and x[0] in "IT" else x

    return Transducer(0, step)


def in_clause(kind: str, mark: str) -> Transducer:
    """Marks an insult or threat anywhere after a word of that kind in the clause."""

    def step(seen, x):
        if x[0] == "E":
            return False, x
        return seen or x[0] == kind, (*x, mark) if seen and x[0] in "IT" else x

    return Transducer(False, step)


PATTERNS = [(k, *(m for m, on in zip(("directed", "negated", "reported"), marks, strict=True) if on)) for k in "IT" for marks in product((0, 1), repeat=3)]


def tables(t: Transducer) -> tuple[list[dict[str, int]], list[dict[str, int]]]:
    """The composed machine written out: next state and pattern number by state and symbol."""
    number, queue, step, out = {t.start: 0}, deque([t.start]), [], []
    while queue:
        state = queue.popleft()
        go, put = {}, {}
        for s in (*LEXICON, "E", "O"):
            to, x = t.step(state, (s,))
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            go[s] = number[to]
            if x in PATTERNS:
                put[s] = PATTERNS.index(x)
        step.append(go)
        out.append(put)
    return step, out


#: A pattern's number when its target follows.
TOWARDS = [PATTERNS.index((k, "directed", *(m for m in marks if m != "directed"))) for k, *marks in PATTERNS]
STEP, OUT = tables(harm().then(within_reach("Y", "directed")).then(within_reach("N", "negated")).then(in_clause("R", "reported")))


def lexical(w: str) -> str | None:
    return SYMBOL.get(w) or ("I" if w[-1] == "s" and SYMBOL.get(w[:-1]) == "I" else None) or ("E" if w in ".;!?\n" else None)


def stems(w: str) -> list[str]:
    """What could be learned of a word: its beginnings and, with END, the word."""
    return [w[:k] for k in STEM if k <= len(w)] + [w + END]


class Learned:
    """Learned words and stems: "I" for an arc of an insult, "S" for evidence; and how many words and different words of S there are in one of clean documents."""

    def __init__(self, arcs: dict[str, str] | None = None, rates: tuple[float, float] = (0.0, 0.0)):
        self.arcs, self.rates, self.known = arcs or {}, rates, {}

    def symbol(self, w: str) -> str:
        s = self.known.get(w)
        if s is None:
            s = lexical(w) or next((self.arcs[x] for x in stems(w) if x in self.arcs), "O")
            if len(self.known) > 200_000:
                self.known.clear()
            if len(w) < 50:
                self.known[w] = s
        return s

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def excess(k: int, n: int, rate: float) -> int:
    """By how much k of n words exceed their rate: twice the root of the Poisson log-likelihood ratio, in whole steps up to LEVELS."""
    mean = n * rate
    return min(LEVELS, int(2 * np.sqrt(k * np.log(k / mean) - k + mean))) if k > mean else 0


def clauses(kinds: list[str]) -> Counter[int]:
    """How often each of PATTERNS comes out of a sequence of symbols."""
    out, state = [], 0
    for at, s in enumerate(kinds):
        if s in OUT[state]:
            out.append((at, OUT[state][s]))
        state = STEP[state][s]
    seen: Counter[int] = Counter()
    for at, p in out:
        ahead = kinds[at + 1 : at + 1 + REACH["Y"]]
        if "E" in ahead:
            ahead = ahead[: ahead.index("E")]
        seen[TOWARDS[p] if "Y" in ahead else p] += 1
    return seen


def evidence(text: str, learned: Learned) -> tuple[list[int], int]:
    """How often each of PATTERNS is matched, up to MOST, then the excess of learned words and of different learned words; and how many matches there are, of which an excess is one."""
    words = TOKEN.findall(text.lower().replace("’", "'"))
    count = Counter(words)
    kind = {w: learned.symbol(w) for w in count}
    seen: Counter[int] = Counter()
    if not {"I", "T", "D", "V"}.isdisjoint(kind.values()):  # no other symbol makes the machine put out a pattern
        seen = clauses([kind[w] if kind[w] != "S" else "O" for w in words])
    more = [0, 0]
    if found := [w for w, s in kind.items() if s == "S"]:
        ends = [w for w, s in kind.items() if s == "E"]
        n = (len(words) - sum(count[w] for w in ends), len(count) - len(ends))
        more = [excess(k, m, rate) for k, m, rate in zip((sum(count[w] for w in found), len(found)), n, learned.rates, strict=True)]
    return [min(MOST, seen[i]) for i in range(len(PATTERNS))] + more, seen.total() + any(more)


def patterns(text: str) -> list[int]:
    """How often each of PATTERNS is matched by the lexicon alone, up to MOST."""
    return evidence(text, Learned())[0][: len(PATTERNS)]


def stem_counts(marked: DataFrame, only: set[str] | None = None) -> DataFrame:
    """marked(text, y) -> (y, stem, docs, words, different) summed over tasks: documents, words and different words of each stem (of ``only``), not counting the lexicon; the null stem has the sums of all words."""
    only = marked.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches):
        docs, words, different = sums = Counter(), Counter(), Counter()
        known: dict[str, list[str]] = {}

        def flush():
            keys = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in sums)],
                ["y", "stem", "docs", "words", "different"],
            )
            for c in sums:
                c.clear()

        for batch in (s for b in batches for s in slices(b, 4 << 20)):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                count = {w: n for w, n in Counter(TOKEN.findall(text.lower().replace("’", "'"))).items() if w not in ".;!?\n"}
                docs[y, None] += 1
                words[y, None] += sum(count.values())
                different[y, None] += len(count)
                here = set()
                for w, n in count.items():
                    if (own := known.get(w)) is None:
                        own = [] if lexical(w) or len(w) > 50 else [x for x in stems(w) if only is None or x in only.value]
                        if len(known) > 100_000:
                            known.clear()
                        if len(w) <= 50:
                            known[w] = own
                    for x in own:
                        words[y, x] += n
                        different[y, x] += 1
                        here.add((y, x))
                docs.update(here)
                if len(docs) > 300_000:
                    yield from flush()
        yield from flush()

    made = marked.select("text", "y").mapInArrow(run, "y int, stem string, docs long, words long, different long")
    return made.groupBy("y", "stem").agg(*(F.sum(c).alias(c) for c in ("docs", "words", "different")))


def learn(marked: DataFrame, max_stems: int = MAX_STEMS) -> Learned:
    """marked(text, y) -> what labels add to the lexicon: of the max_stems words and stems that most toxic documents hold, those of enough log-odds, of nested ones the most telling."""
    bad = stem_counts(marked.where("y = 1")).where(F.col("stem").isNull() | (F.col("docs") >= MIN_DOCS))
    bad = bad.orderBy(F.col("stem").isNull().desc(), F.desc("docs"), "stem").limit(max_stems + 1).toPandas()
    if len(bad) < 2:
        return Learned()
    own = {x.stem: x for x in bad.itertuples() if isinstance(x.stem, str)}
    good = {x.stem if isinstance(x.stem, str) else None: x for x in stem_counts(marked.where("y <> 1"), set(own)).toPandas().itertuples()}
    if None not in good:
        return Learned()
    all_bad, all_good = int(bad.different[bad.stem.isna()].iloc[0]), int(good[None].different)
    told = []
    for stem, x in own.items():
        a, b = x.different + 0.5, (good[stem].different if stem in good else 0) + 0.5
        odds = np.log(a / max(1, all_bad)) - np.log(b / max(1, all_good))
        if odds - ERRORS * np.sqrt(1 / a + 1 / b) >= LEAST:
            told.append((-a * odds, -len(stem), stem, "I" if odds >= SURE else "S"))
    arcs: dict[str, str] = {}
    within = set()
    for _, _, stem, symbol in sorted(told):
        before = {stem[:k] for k in STEM if k < len(stem)}
        if stem not in within and before.isdisjoint(arcs):
            arcs[stem] = symbol
            within |= before
    weak = [good[x] for x, s in arcs.items() if s == "S" and x in good]
    return Learned(arcs, ((sum(x.words for x in weak) + 1) / max(1, good[None].words), (sum(x.different for x in weak) + 1) / max(1, all_good)))


def design(x: np.ndarray) -> np.ndarray:
    """Constant, each pattern present, how many matches there are after the first; both excesses, and what they are over a third of the steps."""
    x, more = x[:, : len(PATTERNS)], x[:, len(PATTERNS) :]
    return np.column_stack([np.ones(len(x)), x > 0, np.minimum(x.sum(1), 4) - (x.sum(1) > 0), more, np.maximum(more - LEVELS // 3, 0)])


def own_weights() -> np.ndarray:
    return np.array([OWN["none"], *(OWN[k] + sum(OWN[m] for m in marks) for k, *marks in PATTERNS), OWN["again"], OWN["excess"], OWN["excess"], 0, 0])


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: float = 0.2) -> np.ndarray:
    """Logistic regression of labels y with counts n, drawn towards the grammar's own weights; Newton steps."""
    d, own = design(x), own_weights()
    w = own.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        hess = d.T @ (d * (n * np.maximum(p * (1 - p), 1e-6))[:, None]) + prior * np.eye(len(w))
        step = np.linalg.solve(hess, d.T @ (n * (y - p)) - prior * (w - own))
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: int = 1, folds: int = 3, max_patterns: int = MAX_PATTERNS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text, ...) -> a row for each: doc_id, held_out, score, predicted, matches.

    Labels(doc_id, toxic) are learned from documents outside the held-out fold: first words and stems, from all of them,
    then weights, as counts of equal pattern vectors, of which the max_patterns most frequent go to the fit.  matches counts
    patterns and, as one, an excess of learned words.  Null texts count as empty and get the score of no match; null labels
    are left out; without any label the grammar's own weights and lexicon hold.  Repeated rows and null ids are rows like
    any other; other columns are left behind; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y is not null").where(remainder(F.col("doc_id"), folds) != fold)
    few = marks.count() <= broadcast_rows
    marked = texts(docs.where(remainder(F.col("doc_id").cast("long"), folds) != fold)).join(F.broadcast(marks) if few else marks, "doc_id").select("text", "y")
    # Texts are shuffled and stored for a second reading only where the labels are too many to be sent to the texts.
    learned = spark.sparkContext.broadcast(learn(marked if few else cut(marked)))
    wide = len(PATTERNS) + 2

    def run(batches):
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            x = [evidence(t, learned.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v for v, _ in x], pa.list_(pa.int32())), pa.array([n for _, n in x], pa.int64())], ["doc_id", "x", "matches"])

    found = cut(texts(docs).mapInArrow(run, "doc_id long, x array<int>, matches long"))
    seen = found.where(remainder(F.col("doc_id"), folds) != fold).join(marks, "doc_id").groupBy("x", "y").count().orderBy(F.desc("count"), "x", "y").limit(max_patterns).toPandas()
    w = fit(np.array(seen["x"].tolist()).reshape(len(seen), wide), seen["y"].to_numpy(float), seen["count"].to_numpy(float)) if len(seen) else own_weights()
    w = spark.sparkContext.broadcast(w)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), int).reshape(batch.num_rows, wide)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-design(x) @ w.value))), batch.column("matches")], ["doc_id", "score", "matches"])

    out = found.mapInArrow(score, "doc_id long, score double, matches long")
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches")
