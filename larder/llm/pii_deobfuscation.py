"""Personal data by offset-preserving deobfuscation.

Each transducer rewrites a text and keeps, for every character it writes, where that came from: homoglyphs become ASCII and
invisible characters go, spelled digits become figures, "at"/"dot" disguises become signs.  The plain detectors then run
over the rewritten text, and what they find is mapped back to the source characters it was written from.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import own, slices, texts

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII ones, and digit words of four languages.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅοανρικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXIJSoavpiktABEZHIKMNOPTYX", strict=True))
DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    "oh": "0",
}
INVISIBLE = "­​‌‍⁠﻿"
SIGNS = {"․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹫": "@", " ": " ", " ": " "}
#: Fewer spelled digits in a row than this are prose, unless three dots make them an address.
SPELLED = 7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
# A match of IP can only start where a run of digits starts, so the lookbehind changes nothing but the time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
OUTSIDE = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\xb1\xb4-\xb8\xba-\xff]")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
RUN = re.compile(rf"(?i)(?<!\w)(?:(?:{_WORD}|[0-9]+|plus|dot|point|punkt|punto)(?:[\x20,-]{{1,3}}|(?=\.|\n|$)|(?!\w)))+")
PART = re.compile(rf"(?i){_WORD}|[0-9]+|plus|dot|point|punkt|punto")
AT = re.compile(r"(?i)\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?|\s(?:at)\s|@")
DOT = r"(?:\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\s(?:dot)\s|\.)"
HOST = re.compile(rf"(?i)[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+")
DOTS = re.compile(rf"(?i){DOT}")
HIDDEN_DOT = re.compile(rf"(?i){DOT.removesuffix('|\\.)')})")
OCTET_DOT = re.compile(rf"(?i){DOT.removesuffix(')')}|\s(?:point|punkt|punto)\s)")
OCTETS = re.compile(rf"(?<![0-9])[0-9]++(?:{OCTET_DOT.pattern.removeprefix('(?i)')}[0-9]++){{3}}", re.I)
# Each is necessary for an edit: of signs() a bracketed sign or a spelled dot, of spelled_digits() a digit word.
SIGN_GATE = re.compile(r"[(\[{<]\s?(?:at|@|dot|\.)\s?[)\]}>]|\s(?:dot|point|punkt|punto)\s")
TOKEN = re.compile(r"\w+")
DOT_WORDS = ("dot", "point", "punkt", "punto")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """An address has one @, so each @ has one place to start: the run of local characters before it, after the last address."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        # Characters looked at once aren't looked at again: the next run stops at this sign.
        at = text.find("@", max(at + 1, end))
    return out


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; a match that fails its test is dropped, without another try inside it."""
    out = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


class Traced:
    """A text and, for each of its characters, the source span it was written from."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Each edit replaces [a, b) by a string, all of whose characters come from the whole of [a, b)."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        return Traced("".join([*text, self.text[at:]]), np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]]))


_GLYPHS: dict[str, str | None] = {}


def glyph(c: str) -> str | None:
    """What c is rewritten to; None: it stays."""
    if c not in _GLYPHS:
        if len(_GLYPHS) > 100_000:
            _GLYPHS.clear()
        new = "" if c in INVISIBLE else SIGNS.get(c) or LOOKALIKES.get(c)
        if new is None:
            d = unicodedata.digit(c, None)
            folded = unicodedata.normalize("NFKC", c)
            new = str(d) if d is not None else folded if len(folded) == 1 and folded.isascii() else LOOKALIKES.get(folded)
        _GLYPHS[c] = new
    return _GLYPHS[c]


def homoglyphs(t: Traced) -> Traced:
    return t.rewritten([(m.start(), m.end(), new) for m in OUTSIDE.finditer(t.text) if (new := glyph(m[0])) is not None and new != m[0]])


def spelled_digits(t: Traced) -> Traced:
    edits = []
    for run in RUN.finditer(t.text):
        parts = list(PART.finditer(t.text, run.start(), run.end()))
        lows = [p[0].lower() for p in parts]
        if not any(x in DIGIT_WORDS for x in lows):
            continue
        new = [x if x.isdigit() else DIGIT_WORDS.get(x) or ("+" if x == "plus" else ".") for x in lows]
        if sum(len(x) for x in new if x.isdigit()) < SPELLED and not IP.search("".join(new)):
            continue
        for i, p in enumerate(parts):
            edits.append((p.start(), parts[i + 1].start() if i + 1 < len(parts) else p.end(), new[i]))
    return t.rewritten(edits)


def signs(t: Traced) -> Traced:
    edits, at = [], 0
    before = {d.end(): d for d in HIDDEN_DOT.finditer(t.text)}
    for m in AT.finditer(t.text):
        if m.start() < at or m.start() == 0 or t.text[m.start() - 1] not in LOCAL:
            continue
        host = HOST.match(t.text, m.end())
        if not host:
            continue
        dots = [d for d in DOTS.finditer(t.text, host.start(), host.end())]
        local, start = [], m.start()
        while start > at:
            while start > at and t.text[start - 1] in LOCAL:
                start -= 1
            d = before.get(start)
            if d is None or d.start() <= at or t.text[d.start() - 1] not in LOCAL:
                break
            local.append(d)
            start = d.start()
        if m[0].strip().lower() in ("at", "@") and all(d[0] == "." for d in dots) and not any(d[0].strip()[0] in "([{<" for d in local):
            continue  # "look at example.com" hides nothing
        edits += [(d.start(), d.end(), ".") for d in reversed(local)]
        edits.append((m.start(), m.end(), "@"))
        edits += [(d.start(), d.end(), ".") for d in dots]
        at = host.end()
    starts, ends = [a for a, _, _ in edits], [b for _, b, _ in edits]
    for m in OCTETS.finditer(t.text):
        i = bisect_left(starts, m.end())
        if i == 0 or ends[i - 1] <= m.start():
            edits += [(d.start(), d.end(), ".") for d in OCTET_DOT.finditer(t.text, m.start(), m.end()) if d[0] != "."]
    return t.rewritten(sorted(edits))


def disguised(text: str) -> Traced | None:
    """The rewritten text, or None where no transducer changes anything."""
    t = Traced(text)
    if not text.isascii() and OUTSIDE.search(text):
        t = homoglyphs(t)
    low = t.text.lower()
    if words := DIGIT_WORDS.keys() & set(TOKEN.findall(low)):
        if sum(low.count(w) for w in DOT_WORDS) >= 3 or sum(low.count(w) for w in (*words, *"0123456789")) >= SPELLED:
            t = spelled_digits(t)
    if SIGN_GATE.search(low):
        t = signs(t)
    return t if t.text is not text else None


def digit_words(text: str) -> int:
    return sum(w in DIGIT_WORDS for w in TOKEN.findall(text.lower()))


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, added) by kind, then start.  Spans that the rewritten text shows are added unless a plain one of their kind holds them.

    A plain number beside which one digit word stands stays as it is, since that is prose ("+1 (848) 555-1373. Un an").
    """
    base = plain(text)
    more = {}
    if (t := disguised(text)) is not None:
        for kind, found in plain(t.text).items():
            plain_ones = base[kind]
            starts = [x for x, _ in plain_ones]
            more[kind] = []
            for a, b in sorted({(int(t.start[a]), int(t.end[b - 1])) for a, b in found}):
                # Plain spans don't overlap, so those that meet this one stand side by side.
                i = max(0, bisect_right(starts, a) - 1)
                near = plain_ones[i : bisect_left(starts, b, i)]
                if not any(y > a and (x <= a and b <= y or digit_words(text[a:x] + " " + text[y:b]) == 1) for x, y in near):
                    more[kind].append((a, b))
    return [(k, a, b, added) for k in KINDS for a, b, added in sorted([(a, b, False) for a, b in base[k]] + [(a, b, True) for a, b in more.get(k, [])])]


SPANS = "array<struct<kind: string, start: bigint, end: bigint, added: boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def find_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, spans, masked): every row's personal data, and its text with each span as ``<kind>``.

    Null texts count as empty and stay null when masked; repeated rows and null ids are rows like any other; other columns
    are left behind; an empty table gives an empty result.
    """

    def run(batches):
        own("pii", bool)  # lets go of what another operator has kept in this worker
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            found, masked = [], []
            for t in batch.column("text").to_pylist():
                s = spans(t or "")
                found.append([dict(zip(("kind", "start", "end", "added"), x, strict=True)) for x in s])
                masked.append(mask(t, s) if s else t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS), pa.array(masked, pa.string())], ["doc_id", "spans", "masked"])

    texts(docs)  # for its bound on batches; here a null text stays null
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}, masked string")


def mask(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """Spans of different kinds may overlap; what overlaps is masked as one, under the kind that starts first."""
    out, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of find_spans(): n_<kind> and base_sha256 of the plain spans, spans and n_added of all."""
    base = F.filter("spans", lambda s: ~s.added)
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s.added)).cast("long").alias("n_added"))


def mask_texts(docs: DataFrame) -> DataFrame:
    """docs with every column, and each span of text as ``<kind>``; rows, nulls and column order stay."""
    texts(docs)
    order = docs.schema.names

    def run(batches):
        own("pii", bool)
        for batch in (s for b in batches for s in slices(b, 4 << 20)):
            new = [mask(t, s) if t is not None and (s := spans(t)) else t for t in batch.column("text").to_pylist()]
            at = order.index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 :]], order)

    return docs.mapInArrow(run, docs.schema)
