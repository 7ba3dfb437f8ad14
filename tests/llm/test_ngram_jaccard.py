import re

from larder.llm import ngram_jaccard as nj


def brute(rows, k=3, percent=90):
    """By the definition: every pair of sets, then the smallest id that links lead to."""
    sets = []
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((i, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_as_brute_force(table, near):
    rows = near(400)
    assert got(nj.link_clusters(table(rows))) == brute(rows)


def test_hot_buckets_small_blocks_and_shuffled_members(table, near):
    rows = near(300, seed=3)
    assert got(nj.link_clusters(table(rows), bucket=3, block_docs=6, broadcast_rows=0)) == brute(rows)


def test_edges(table):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c"), (7, "x " * 5000), (8, "x " * 9000), (9, "été É"), (10, "été é")]
    assert got(nj.link_clusters(table(rows))) == brute(rows)
    assert got(nj.link_clusters(table([(1, "a b c")] * 2))) == [(1, 1, 1)] * 2
    assert nj.link_clusters(table([])).count() == 0
    assert sorted(map(tuple, nj.link_clusters(table([(None, "a b c"), (3, "a b c")])).collect()), key=str) == [(3, 1, 3), (None, 1, None)]


def test_an_id_of_several_texts(table, near):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(1000))
    rows = [(1, a), (1, b), (2, a + " x"), *((10 + i, f"{a} y{i}") for i in range(12)), (40, b + " z"), (50, "c d e f"), (51, "c d e f"), (51, b)]
    for options in ({}, {"block_docs": 3}, {"block_docs": 3, "bucket": 2, "broadcast_rows": 0}):
        assert got(nj.link_clusters(table(rows), **options)) == brute(rows)
    rows = [(i % 90, t) for i, t in near(200, seed=11)]
    for options in ({}, {"block_docs": 4, "bucket": 3}):
        assert got(nj.link_clusters(table(rows), **options)) == brute(rows)
