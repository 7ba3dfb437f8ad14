import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import pii_deobfuscation as pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    """The definitions as they are written."""
    return {k: [m.span() for m in re.finditer(p, text) if passes(k, m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123459()%é\n", max_size=60))
def test_plain_as_defined(text):
    assert pii.plain(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="4@.+ о１​two e(at)dot", max_size=60))
def test_any_text_gives_whole_sorted_spans(text):
    found = pii.spans(text)
    assert [(k, a, b) for k, a, b, added in found if not added] == [(k, *s) for k in pii.KINDS for s in brute(text)[k]]
    assert found == sorted(found, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2]))
    assert all(0 <= a < b <= len(text) for _, a, b, _ in found)


def added(text):
    return [(k, text[a:b]) for k, a, b, new in pii.spans(text) if new]


def test_disguises():
    assert added("write to jоhn.doе@exаmple.com now") == [("email", "jоhn.doе@exаmple.com")]  # Cyrillic letters
    assert added("mail jane (at) example (dot) com please") == [("email", "jane (at) example (dot) com")]
    assert added("mail jane at example dot com please") == [("email", "jane at example dot com")]
    assert added("meet me at example.com") == []
    assert added("call plus one two zero two five five five zero one seven three now") == [("phone", "plus one two zero two five five five zero one seven three")]
    assert added("card ４５３９ １４８８ ０３４３ ６４６７.") == [("card", "４５３９ １４８８ ０３４３ ６４６７")]
    assert added("host 1​0.0.0.1 here") == [("ip", "1​0.0.0.1")]
    assert added("one or two of the three") == []


def test_disguises_that_leave_a_plain_fragment():
    assert added("to jоhn.smith@example.com now") == [("email", "jоhn.smith@example.com")]  # Cyrillic o; hn.smith@example.com is plain
    assert added("to user@example.cоm now") == [("email", "user@example.cоm")]
    assert added("host 10.0.0.1​23 here") == [("ip", "10.0.0.1​23")]
    assert added("call +1 555 555 77​13 now") == [("phone", "+1 555 555 77​13")]
    assert added("to a@b.co and １") == []
    assert added("vi. +1 (848) 555-1373 Un an oule") == []
    text = "to jоhn.smith@example.com or user@example.cоm, 10.0.0.1​23"
    assert pii.mask(text, pii.spans(text)) == "to <email> or <email>, <ip>"


def test_dot_disguises():
    for x in ("jane@example (dot) com", "jane@example dot com", "first dot last at example dot com", "first[.]last@example.com", "jane\tat\texample\tdot\tcom"):
        assert added(f"mail {x}") == [("email", x)]
    for x in ("192[.]168[.]1[.]1", "192 dot 168 dot 1 dot 1", "one dot two dot three dot four", "one dot one dot one dot one", "192.168[.]1.1"):
        assert added(f"host: {x}; up") == [("ip", x)]
    assert added("the dot a@b.co and 1 dot 2, look at example.com") == []
    assert added("one two dot three") == []


def test_over_a_table(spark, table):
    long = "x" * 200_000 + " a@b.co " + "9" * 100_000 + " +" * 5000
    rows = [(1, None), (2, ""), (3, "a@b.co and 1.2.3.4"), (4, long), (5, "mail jane (at) example (dot) com"), (5, "mail jane (at) example (dot) com"), (None, "+1 (017) 555-7713")]
    out = sorted((tuple(r) for r in pii.report(pii.find_spans(table(rows))).collect()), key=str)
    by = {r[0]: r for r in out}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert by[1][1:] == by[2][1:] == (0, 0, 0, 0, sha(""), "", 0)
    assert by[3][1:] == (1, 1, 0, 0, sha("email:0:6,ip:11:18"), "email:0:6,ip:11:18", 0)
    assert by[4][1:3] == (1, 0)
    assert by[5][1:] == (0, 0, 0, 0, sha(""), "email:5:32", 1)
    assert by[None][4] == 1
    assert len(out) == 7
    assert pii.find_spans(table([])).count() == 0
    masked = {r.doc_id: r.masked for r in pii.find_spans(table(rows)).collect()}
    assert masked[1] is None and masked[3] == "<email> and <ip>" and masked[5] == "mail <email>"


def test_fuzzed_masks():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choices(["a@b.co", "1.2.3.4", "+1 555 555 7713", " ", "4539148803436467", "word"], k=8))
        masked = pii.mask(text, pii.spans(text))
        assert masked == text or "<" in masked


def test_many_spans_take_no_longer_each():
    import time

    text = "c\u0430ll " + " ".join(f"a{i}@site{i}.org" for i in range(20_000))
    began = time.time()
    found = pii.spans(text)
    assert len(found) == 20_000 and time.time() - began < 3
