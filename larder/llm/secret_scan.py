"""Secrets in texts: fixed patterns, and values in credential contexts that would take many guesses.

How many guesses a value takes is found by dynamic programming over its cheapest segmentation: into words of the corpus
(by rank) and common passwords, dates, repeats of a unit, walks over neighbouring keys or the alphabet, and characters
that must be tried out.  A value beside a word such as "password" or "token", or inside a url's user part, is a secret if even
the cheapest segmentation takes ``min_bits``; "the password is required" is not, since its value is a word.

Spark counts the words of every document once; the ``words`` most frequent ones are what a guesser's list holds.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, own, slices, texts

KINDS = ("assign", "access", "hex", "guess")
#: Words of the corpus that a guesser tries; the list is broadcast, so this bounds it.
WORDS = 20_000
SHORTEST, LONGEST = 3, 20
MIN_BITS = 34.0
#: Distinct words that a task holds before it sends what it has counted.
HELD = 200_000

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A whole run, as the plain pattern takes it; one that is too short isn't matched to be dropped again.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Each match of ASSIGN, and each of CONTEXT, holds one of these in lower case.
KEYS = ("passw", "secret", "token", "api")
GATE = ("pass", "kennwort", "contrase", "pwd", "secret", "token", "bearer", "api", "access", "credential", "private key", "schlüssel")

# Words beside credentials, in four languages, and what stands between them and the value.
CONTEXT_WORDS = "password passwd passphrase passcode passwort kennwort contraseña pwd secret token bearer api_key api-key apikey access_key credential credentials".split()
CONTEXT_PHRASES = ("mot de passe", "api key", "access key", "private key", "clave secreta", "geheimer schlüssel")
CONTEXT = re.compile(rf"""(?i)(?<![^\W_])(?:{"|".join(map(re.escape, (*CONTEXT_PHRASES, *CONTEXT_WORDS)))})["'`]?(?:\x20{{0,8}}(?::=|=>|->|[:=])\x20{{0,8}}|\x20(?:is|was|ist|war|es|era|est|était)\x20|(?<=bearer)\x20)["'`]?([^\s"'`<>]+)""")
URL = re.compile(r"(?i)(?<![a-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
TRAILING = ".,;:!?)]}"

# Passwords that head every guesser's list.
COMMON = "123456 password 12345678 qwerty 123456789 letmein admin welcome monkey dragon football iloveyou master sunshine princess shadow superman login abc123 changeme secret trustno1 passw0rd hello freedom whatever example test sample default none null true false required your xxxx".split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("430157$@", "aeoistsa")
DATE = re.compile(
    r"(?:(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])"
    r"|(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}"
    r"|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12][0-9]|3[01])\3(?:19|20)[0-9]{2})"
)
YEAR = re.compile(r"(?:19|20)[0-9]{2}")
DATE_BITS, YEAR_BITS = math.log2(365 * 200), math.log2(200)
START_KEYS, TURN_BITS = math.log2(94), math.log2(6)
#: Bits of another segment: a guesser doesn't know how many there are.
JOIN = 1.0


def neighbours() -> dict[str, set[str]]:
    """Keys beside each other in a row or, as rows are shifted, above each other; and letters and digits in order."""
    out: dict[str, set[str]] = {}
    at = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    for a, (r, x) in at.items():
        out[a] = {b for b, (s, y) in at.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= (1 if r == s else 0.6)}
    for row in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for a, b in zip(row, row[1:], strict=False):
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


NEAR = neighbours()


def character_bits(value: str) -> float:
    """Bits of a character that must be tried out.  A value of letters in one case is as unsure as unknown words are."""
    letters = value.isalpha() and (value.islower() or value.isupper() or value.istitle())
    if letters:
        return 2.6
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 32 * any(not c.isalnum() for c in value)
    return math.log2(max(size, 10))


def walk_bits(piece: str) -> float:
    """Bits of a walk over keys: where it starts, how long it is, and each place where its step changes."""
    steps = [ord(b) - ord(a) for a, b in zip(piece, piece[1:], strict=False)]
    places = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    moves = [(places[b][0] - places[a][0], places[b][1] - places[a][1]) if a in places and b in places else s for a, b, s in zip(piece, piece[1:], steps, strict=False)]
    turns = min(sum(x != y for x, y in zip(moves, moves[1:], strict=False)), sum(x != y for x, y in zip(steps, steps[1:], strict=False)))
    return START_KEYS + math.log2(len(piece)) + TURN_BITS * turns


class Guesser:
    """What it costs to guess a value, in bits, by its cheapest segmentation."""

    def __init__(self, ranked: Iterable[str]):
        #: Bits by word: its rank, common passwords first.
        self.bits = {w: math.log2(i + 2) for i, w in reversed(list(enumerate(dict.fromkeys((*COMMON, *ranked)))))}

    def word(self, piece: str) -> float | None:
        """Bits of a word: one more for capitals, two more for figures in place of letters."""
        low = piece.lower()
        found = self.bits.get(low)
        if found is not None:
            return found + (low != piece)
        plain = low.translate(LEET)
        found = self.bits.get(plain) if plain != low else None
        return None if found is None else found + 2 + (low != piece)

    def segments(self, value: str) -> Iterator[tuple[int, int, float, str]]:
        """(start, end, bits, kind) of each piece a guesser may take at once, by start.

        A walk and a run of repeats are taken as far as they go; a repeat's unit has up to four characters, each tried out.
        """
        n, one = len(value), character_bits(value)
        low = value.lower()
        walk = [1] * n
        for i in range(n - 2, -1, -1):
            if low[i + 1] in NEAR.get(low[i], ()):
                walk[i] = walk[i + 1] + 1
        again = []
        for p in range(1, 5):
            run = [0] * (n + 1)
            for i in range(n - p - 1, -1, -1):
                run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
            again.append(run)
        for i in range(n):
            yield i, i + 1, one, "try"
            for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
                bits = self.word(value[i:j])
                if bits is not None:
                    yield i, j, bits, "word"
            if value[i].isdigit():
                if m := DATE.match(value, i):
                    yield i, m.end(), DATE_BITS + (m.end() - i > 8), "date"
                if m := YEAR.match(value, i):
                    yield i, m.end(), YEAR_BITS, "date"
            if walk[i] >= 3 and (i == 0 or walk[i - 1] == 1 or walk[i] == 3):
                yield i, i + walk[i], walk_bits(low[i : i + walk[i]]) + (low[i : i + walk[i]] != value[i : i + walk[i]]), "walk"
            for p, run in enumerate(again, 1):
                times = 1 + run[i] // p
                if times >= 2 and p * times >= 3:
                    yield i, i + p * times, one * p + math.log2(times), "repeat"

    def cost(self, value: str) -> float:
        """Bits of the cheapest segmentation; 0 of an empty value.  One pass in the order of starts, so memory grows with the value's length alone."""
        tried, known = ([math.inf] * (len(value) + 1) for _ in range(2))  # the least up to each place, by what stands before it
        known[0] = 0.0
        for a, b, bits, kind in self.segments(value):
            join = JOIN if a else 0.0
            if kind == "try":  # characters tried out one after another are one segment
                tried[b] = min(tried[b], bits + min(tried[a], known[a] + join))
            else:
                known[b] = min(known[b], bits + join + min(tried[a], known[a]))
        return min(tried[-1], known[-1])


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost matches that don't overlap, by kind; one that fails its test is dropped."""
    out, low = [], text.lower()
    if any(k in low for k in KEYS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def contexts(text: str) -> list[tuple[int, int]]:
    """Where values stand that a context calls credentials; closing marks of a sentence are none of theirs."""
    found, low = {}, text.lower()
    for m in (*(CONTEXT.finditer(text) if any(k in low for k in GATE) else ()), *(URL.finditer(text) if "://" in text else ())):
        a, b = m.span(1)
        while b > a and text[b - 1] in TRAILING:
            b -= 1
        if b - a >= 6:
            found[a] = max(b, found.get(a, 0))
    return sorted(found.items())


def spans(text: str, guesser: Guesser, min_bits: float = MIN_BITS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) by start, then kind as listed.  A value that costs min_bits is added, unless a span of a pattern holds it whole."""
    base = plain(text)
    out = [(k, a, b, None) for k, a, b in base]
    for a, b in contexts(text):
        if not any(x <= a and b <= y for _, x, y in base):
            bits = guesser.cost(text[a:b])
            if bits >= min_bits:
                out.append(("guess", a, b, bits))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def frequent_words(docs: DataFrame, words: int = WORDS) -> list[str]:
    """The words (letters only, in lower case) of all documents from the most frequent on, ties by the word.

    Those that occur at least so often that no more than ``words`` do: what comes to the driver has that bound, however many
    tasks have counted.
    """

    def count(batches):
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            for t in batch.column("text").to_pylist():
                held.update(t.lower().split())
                if len(held) > HELD:
                    yield rows()
        if held:
            yield rows()

    each = texts(docs).select("text").mapInArrow(count, "word string, n long")
    each = each.where(F.length("word").between(SHORTEST, LONGEST)).where(F.col("word").rlike(r"^\p{L}+$"))
    counts = cut(each.groupBy("word").agg(F.sum("n").alias("n")))
    alike = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(words).collect()
    least = None
    for r, total in zip(alike, accumulate(r.words for r in alike), strict=True):
        if total > words:
            break
        least = r.n
    return [] if least is None else [r.word for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()]


SPANS = "array<struct<kind: string, start: bigint, end: bigint, bits: double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))


def find_secrets(docs: DataFrame, words: int = WORDS, min_bits: float = MIN_BITS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, spans) of every row: kind, start and end in characters, and the bits of guessed values.

    Null texts count as empty; repeated rows and null ids are rows like any other; other columns are left behind; an empty
    table gives an empty result.  Texts are searched whole, however long.
    """
    ranked, tag = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, words)), uuid.uuid4().hex

    def run(batches):
        guesser = own(("guesser", tag), lambda: Guesser(ranked.value))
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            found = [[dict(zip(("kind", "start", "end", "bits"), x, strict=True)) for x in spans(t, guesser, min_bits)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of the patterns' spans, all spans joined, and how many values were added, with the most bits one took."""
    base = F.filter("spans", lambda s: s.kind != "guess")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess"), F.array_max(F.transform("spans", lambda s: s.bits)).alias("most_bits"))
