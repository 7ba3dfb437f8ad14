"""String similarity of pairs: normalised indel similarity by a bit-parallel longest common subsequence (Hyyrö, 2004).

The masks and the state of the recurrence are longs, so that it runs as column expressions: one word of 62 bits for
strings up to that length, and arrays of words with a carry between them beyond.  Callers compare distinct names, and only pairs that
share a token or that an index of their characters lets through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import col

#: Bits of a word; a sum of two words and a carry must fit a long.
BITS = 62
FULL = (1 << BITS) - 1


def sorted_tokens(c) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(col(c), r"\s+"), lambda t: t != "")), " ")


def masks(a: str) -> dict[str, int]:
    """Of each character of a the places, as bits; with lcs() the recurrence for single strings, of any length."""
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs(m: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of b and the string of n characters with masks m."""
    full = state = (1 << n) - 1
    for c in b:
        u = state & m.get(c, 0)
        state = (state + u | state - u) & full
    return n - state.bit_count()


def _whole(x: str, m: dict[str, int], y: str) -> float:
    return 200.0 * lcs(m, len(x), y) / (len(x) + len(y)) if x or y else 100.0


def _window(x: str, m: dict[str, int], y: str) -> float:
    if len(x) > len(y):
        return _window(y, masks(y), x)
    if not x:
        return 0.0 if y else 100.0
    return max(_whole(x, m, y[i : i + len(x)]) for i in range(len(y) - len(x) + 1))


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _with(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f's own functions name it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _bits(n: Column) -> Column:
    """The n lowest bits, n up to BITS."""
    return F.call_function("shiftleft", _long(1), n.cast("int")) - 1


def _mask(p: Column, c: Column, start: Column, n: Column) -> Column:
    """Where c stands among the n characters of p from start on."""
    places = F.filter(F.sequence(_long(0), F.greatest(n - 1, F.lit(0)).cast("long")), lambda i: F.get(p, (start + i).cast("int")) == c)
    return F.aggregate(places, _long(0), lambda x, i: x.bitwiseOR(F.call_function("shiftleft", _long(1), i.cast("int"))))


def _found(p: Column, text: Column) -> Column:
    """For each character of text its places in p, which has one to BITS characters."""
    places = F.transform(p, lambda x, i: F.call_function("shiftleft", _long(1), i))

    def known(bits: Column) -> Column:
        mask = lambda c: F.aggregate(F.zip_with(p, bits, lambda x, b: F.when(x == c, b).otherwise(_long(0))), _long(0), lambda x, b: x.bitwiseOR(b))
        return F.map_from_entries(F.transform(F.array_distinct(p), lambda c: F.struct(c, mask(c))))

    return _with(_with(places, known), lambda k: F.transform(text, lambda c: F.coalesce(F.try_element_at(k, c), _long(0))))


def _run(found: Column, n: Column, full: Column) -> Column:
    """The recurrence over the masks of a text's characters, full having the n lowest bits."""
    return n - F.bit_count(F.aggregate(found, full, lambda s, m: (s + s.bitwiseAND(m)).bitwiseOR(s.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)))


def _short(p: Column, text: Column) -> Column:
    """The common subsequence of arrays of characters, p of one to BITS."""
    return _with(_bits(F.size(p)), lambda full: _run(_found(p, text), F.size(p), full))


def _short_windows(p: Column, text: Column) -> Column:
    """The longest of text's windows of p's length; each character is looked up once for all of them."""
    n = F.size(p)
    z = F.struct(_found(p, text).alias("found"), _bits(n).alias("full"))
    return _with(z, lambda z: F.array_max(F.transform(F.sequence(F.lit(1), F.size(text) - n + 1), lambda i: _run(F.slice(z["found"], i, n), n, z["full"]))))


def _long_one(p: Column, text: Column) -> Column:
    """The same for p of any length above 0: states and masks are arrays of words, sums carry over to the next word."""
    n = F.size(p).cast("long")
    words = F.sequence(_long(0), F.floor((n - 1) / BITS))
    size = lambda k: F.least(n - k * BITS, _long(BITS))
    known = F.map_from_entries(F.transform(F.array_distinct(p), lambda c: F.struct(c, F.transform(words, lambda k: _mask(p, c, k * BITS, size(k))))))
    found = _with(known, lambda k: F.transform(F.filter(text, lambda c: F.array_contains(p, c)), lambda c: F.element_at(k, c)))
    start = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        def word(done: Column, k: Column) -> Column:
            s, x = F.get(state, k.cast("int")), F.get(m, k.cast("int"))
            total = s + s.bitwiseAND(x) + done["carry"]
            kept = total.bitwiseAND(_long(FULL)).bitwiseOR(s.bitwiseAND(F.bitwise_not(x))).bitwiseAND(_bits(size(k)))
            return F.struct(F.shiftright(total, BITS).alias("carry"), F.concat(done["out"], F.array(kept)).alias("out"))

        return F.aggregate(words, start, word)["out"]

    state = F.aggregate(found, F.transform(words, lambda k: _bits(size(k))), step)
    return n - F.aggregate(state, _long(0), lambda t, s: t + F.bit_count(s))


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of characters."""
    swap = F.size(a) > F.size(b)
    both = F.struct(F.when(swap, b).otherwise(a).alias("p"), F.when(swap, a).otherwise(b).alias("text"))
    return _with(both, lambda z: F.when(F.size(z["p"]) == 0, 0).when(F.size(z["p"]) <= BITS, _short(z["p"], z["text"])).when(F.size(z["p"]) > BITS, _long_one(z["p"], z["text"])))


def ratio(a, b) -> Column:
    """0 to 100: twice the common subsequence over both lengths; two empty strings are equal."""
    x, y = col(a), col(b)
    both = F.length(x) + F.length(y)
    return F.when(both == 0, 100.0).when(x == y, 100.0).when(both > 0, 200.0 * common(_characters(x), _characters(y)) / both)


def token_sort_ratio(a, b) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def ratio_bound(a, b) -> Column:
    """No pair of these lengths has a higher ratio; cheap, so it goes before the real one."""
    m, n = F.length(col(a)), F.length(col(b))
    return F.when(m + n == 0, 100.0).otherwise(200.0 * F.least(m, n) / (m + n))


def partial_ratio(a, b) -> Column:
    """The best ratio of the shorter string with any window of its length in the longer."""
    x, y = col(a), col(b)
    m, n = F.length(x), F.length(y)
    short, long = F.when(m > n, y).otherwise(x), F.when(m > n, x).otherwise(y)

    def best(z: Column) -> Column:
        p, text = z["p"], z["text"]
        wide = F.array_max(F.transform(F.sequence(F.lit(1), F.size(text) - F.size(p) + 1), lambda i: common(p, F.slice(text, i, F.size(p)))))
        return F.when(F.size(p) <= BITS, _short_windows(p, text)).otherwise(wide)

    least = F.least(m, n)
    found = _with(F.struct(_characters(short).alias("p"), _characters(long).alias("text")), best)
    return F.when((least == 0) & (m == n), 100.0).when(least == 0, 0.0).when(F.contains(long, short), 100.0).when(least > 0, 100.0 * found / least)
