import base64
import hashlib
import subprocess
import sys

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import byte_bpe as bb

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\xa0ab'sé1,Z　", max_size=30))
def test_chunks_are_where_nothing_crosses(text):
    parts = bb.chunks(text)
    assert "".join(parts) == text
    c = bb.coder(PATH, PATTERN)
    assert [p for x in parts for p in c.pattern.findall(x)] == c.pattern.findall(text)


def test_as_the_library():
    c = bb.coder(PATH, PATTERN)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
    def check(texts):
        ids = c.encode(texts)
        assert [x.tolist() for x in ids] == [LIBRARY.encode_ordinary(t) for t in texts]
        assert c.decode(ids) == [t.encode() for t in texts]

    check()
    for long in ("ab" * 4000, "x" * 1000, " " * 3000, "é" * 700, "antidisestablishmentarianism" * 40):
        assert c.encode([long])[0].tolist() == LIBRARY.encode_ordinary(long)


def test_the_query_and_the_heap_agree():
    c = bb.coder(PATH, PATTERN)
    r = np.random.default_rng(0)
    pieces = ["".join(r.choice(list("etaonrish"), r.integers(1, 60))).encode() for _ in range(300)]
    assert c.contract(pieces) == [c.from_heap(p) for p in pieces]


def test_over_a_table(table):
    rows = [(1, None), (2, ""), (3, "Hello  world\n\nagain"), (3, "twice"), (None, "no id"), (5, "<|endoftext|> it's")]
    out = bb.decode(bb.encode(table(rows), PATH, PATTERN), PATH, PATTERN)
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in out.collect()), key=str)
    assert got == sorted(((i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    d = {r.doc_id: r for r in bb.digests(out).collect()}
    ids = LIBRARY.encode_ordinary(rows[-1][1])
    assert d[5].n_tokens == len(ids) and d[5].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and d[5].decoded_sha256 == hashlib.sha256(rows[-1][1].encode()).hexdigest()
    assert bb.encode(table([]), PATH, PATTERN).count() == 0


def test_long_pieces_take_bounded_rows(tmp_path, monkeypatch):
    tmp_path.chmod(0o500)
    monkeypatch.chdir(tmp_path)  # nothing may be written to the folder of the worker
    c = bb.Coder(PATH, PATTERN)
    r = np.random.default_rng(1)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9FA5, 90))) for _ in range(3000)]
    texts += ["".join(r.choice(list("abcXYZ019+/"), 3000)) for _ in range(3)] + ["etaoin" * 300, "=" * 5000, "ab" * 900 + "ba" * 900]
    assert [x.tolist() for x in c.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bb, "ROWS", 500)  # queries of a few rounds each
    pieces = [t.encode() for t in texts[-6:]] + [b"antidisestablishmentarianism" * 2, b"a"]
    assert c.contract(pieces) == [c.from_heap(p) for p in pieces]
    assert list(tmp_path.iterdir()) == []


def test_decoding_any_ids():
    c = bb.coder(PATH, PATTERN)
    r = np.random.default_rng(2)
    for _ in range(50):
        ids = [r.integers(-3, 50_300, r.integers(0, 400)) for _ in range(r.integers(0, 5))]
        back = {i: b for b, i in RANKS.items()}
        assert c.decode(ids) == [b"".join(back.get(int(i), b"") for i in x) for x in ids]


def test_both_ways_in_one_worker(table):
    rows = [(1, None), (2, ""), (3, "Hello  world\n\nagain"), (3, "twice"), (None, "no id")]
    two = bb.digests(bb.decode(bb.encode(table(rows), PATH, PATTERN), PATH, PATTERN)).collect()
    assert sorted(map(str, bb.digests(bb.round_trip(table(rows), PATH, PATTERN)).collect())) == sorted(map(str, two))
    assert bb.digests(bb.round_trip(table([]), PATH, PATTERN)).count() == 0


def test_very_long_pieces():
    c = bb.Coder(PATH, PATTERN)
    r = np.random.default_rng(2)
    for piece in (b"a" * 1_000_000, b"a" * 3_000_001, b"-=" * 300_000, bytes(r.choice(list(b"acgt"), 100_000)), bytes(r.choice(list(b"ab"), 500_000))):
        ids = np.array(c.contract([piece])[0])
        assert ids.tolist() == c.from_heap(piece)


def test_rounds_over_arrays_and_the_heap_agree(monkeypatch):
    monkeypatch.setattr(bb, "LONG", 40)
    c = bb.Coder(PATH, PATTERN)
    r = np.random.default_rng(3)
    pieces = ["".join(r.choice(list(a), r.integers(65, 300))).encode() for a in ("ab", "aaab", "acgt", "etaonrish", "-=", "0 ", "the", "ing tion") for _ in range(40)]
    assert [c.contract([p])[0] for p in pieces] == [c.from_heap(p) for p in pieces]


MEMORY = """
import re
import numpy as np
import pyarrow as pa
import public_tokenizers
from larder.llm import byte_bpe as bb

class Docs:
    def mapInArrow(self, run, schema):
        r = np.random.default_rng(4)
        words = np.array(["".join(r.choice(list("abcdefghijklmnop"), 7)) for _ in range(200_000)])
        file = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        bb.coder(*file)
        before = peak()
        texts = (pa.array([" ".join(r.choice(words, 300)) for _ in range(1700)]) for _ in range(3))
        list(run(pa.RecordBatch.from_arrays([pa.array(range(len(t))), t], ["doc_id", "text"]) for t in texts))
        print(peak() - before)

def peak():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

bb.texts = lambda docs: docs
bb.round_trip(Docs(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
"""


def test_a_worker_takes_little_memory():
    """Two workers stand beside an executor's JVM, whose heap the stages before have filled."""
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) < 200
