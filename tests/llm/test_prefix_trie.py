import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from larder.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, a long, depth int, words string"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple([*own.get(base, [])[:h], *t[h:]])
    members = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    for node, cs in members.items():
        below = [u for u in members if u[: len(node)] == node]
        words = lambda t: len([w for w in t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w])
        ended = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(node))))
        out.append(
            (
                min(cs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(cs),
                sum(len(u) == len(node) + 1 for u in below),
                sum(not any(w[: len(u)] == u and len(w) > len(u) for w in below) for u in below),
                sum((len(members[u]) - 1) * words(u[-1][1]) for u in below if u),
                hashlib.sha256(ended.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def got(spark, rows):
    return sorted(map(tuple, pt.prefix_trie(spark.createDataFrame([(*x, 1, 2, "w") for x in rows], SCHEMA)).collect()), key=str)


def made(seed, n, turns=6):
    r = random.Random(seed)
    kinds = [("system", "be kind"), ("user", "a b  c"), ("user", "d\te\n"), ("assistant", "x y z w"), (None, None), ("user", "")]
    rows = []
    for c in r.sample(range(-40, 3 * n), n):
        for t in range(r.randint(1, turns)):
            rows.append((c, r.choice((t, t, t, None)), *kinds[min(int(r.expovariate(0.9)), 5)]))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_prefix(spark, seed, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 4)
    monkeypatch.setattr(pt, "BIN", 7)
    rows = made(seed, 60)
    assert got(spark, rows) == brute(rows)


def test_long_conversation_copies_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 8)
    rows = [(c, t, "user", f"t{t}") for c in (3, 5, 7, 11, 20) for t in range(60)] + [(8, t, "user", f"t{t}" if t < 41 else "other") for t in range(60)]
    rows += [(None, 0, "user", "no conversation"), (40, None, None, None), (41, 0, "user", "é ü"), (41, 0, "user", "é ü"), (60, 1, "assistant", "long " * 20_000)]
    rows += [(1000 + c, 0, "user", "same") for c in range(40)]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    one = got(spark, [(21, 0, "user", "x")])
    assert one == brute([(21, 0, "user", "x")])


def test_exit_nodes_by_fat_search():
    r = random.Random(3)
    paths = []
    for row in range(400):
        a, b = [0], [0]
        for t in r.choices(range(3), k=r.randint(0, 40)):
            x = hash((len(a), t, 1)) & (2**62 - 1)
            a.append(a[-1] ^ x)
            b.append(b[-1] ^ hash((len(a), t, 2)) & (2**62 - 1))
        if row % 3 == 2:  # much shared with the one before
            k = r.randint(0, len(paths[-1].a) - 1)
            a, b = paths[-1].a[: k + 1], paths[-1].b[: k + 1]
        paths.append(pt.Path(row, 0, a, b))
    trie = pt.ZFastTrie()
    for p in paths:
        trie.insert(p)
    ended = {}
    for k, rows in enumerate(trie.ends):
        for i in rows:
            ended[i] = k
    for p in paths:
        k = ended[p.row]
        assert trie.high[k] == p.end and trie.path[k].at(p.end) == p.at(p.end)
        while k:  # the way up is the path
            assert trie.path[k].at(trie.high[k]) == p.at(trie.high[k])
            assert trie.low[k] == trie.high[trie.up[k]] < trie.high[k]
            assert trie.handles[p.at(pt.fattest(trie.low[k], trie.high[k]))] == k
            k = trie.up[k]
    # Each search takes as many lookups as the length has bits.
    asked = []
    trie.handles = type("Asked", (dict,), {"get": lambda self, key: asked.append(key) or dict.get(self, key)})(trie.handles)
    for p in paths:
        asked.clear()
        trie.exit(p, 0)
        assert len(asked) <= max(1, p.end).bit_length()


def test_batches_of_any_size():
    whole = pa.RecordBatch.from_pydict({"start": [0, 0, 5], "a": [[1, 2], [], [7]], "b": [[3, 4], [], [8]], "pa": [0, 0, 9], "pb": [0, 0, 9]})
    for most in (1, 3, 100):
        assert sum(sum(map(len, t.ends)) for t, *_ in pt.tries(whole, most)) == 3
