import random

from larder.llm import decontamination as dc


def dp(item, text):
    """The textbook table: the least edit distance to any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        s[i : i + r.choice((0, 1, 1))] = r.choice(("", "q", "zz"))
    return "".join(s)


def test_distance():
    r = random.Random(1)
    for _ in range(300):
        item = "".join(r.choices("abc", k=r.randint(1, 80)))
        text = "".join(r.choices("abc", k=r.randint(0, 60))) + edited(r, item, r.randint(0, 9))
        assert dc.distance(item, text) == dp(item, text)


def test_as_brute_force(spark, table):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 9)))
    items = [(i, " ".join(word() for _ in range(r.randint(3, 25)))) for i in range(30)]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(r.randint(0, 40)))]
        for _ in range(r.choice((0, 1, 2))):
            parts += [edited(r, r.choice(items)[1], r.choice((0, 1, 2, 3, 5, 8))), " ".join(word() for _ in range(5))]
        docs.append((i, "\n".join(parts).upper() if i % 3 == 0 else "  ".join(parts)))
    items += [(90, None), (None, "x" * 60), (91, ""), (92, "short one")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    want = set()
    for d, t in docs:
        for i, s in items:
            if i is not None and len(n := dc.normal(s or "")) >= dc.MIN_CHARS and (k := dp(n, dc.normal(t))) <= int(dc.RATE * len(n)):
                want.add((d, i, k))
    assert len(want) > 40
    for options in ({}, {"block_chars": 700}):
        assert {tuple(r) for r in dc.matches(table(docs), bench, **options).collect()} == want


def test_edges(spark, table):
    bench = spark.createDataFrame([(1, "the same words again and again, " * 3), (1, "quite another text for the same id")], "item_id long, text string")
    out = dc.matches(table([(1, None), (2, ""), (3, "The same  words again and again, " * 900), (3, "so quite another text for the same id it is")]), bench)
    assert sorted(map(tuple, out.collect())) == [(3, 1, 0), (3, 1, 0)]
    assert dc.matches(table([]), bench).count() == 0
    assert dc.matches(table([(1, "a")]), bench.limit(0)).count() == 0


def test_no_rows_come_from_the_driver(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'some words' AS text")
    items = spark.range(1).selectExpr("id AS item_id", "'an item of more than twenty-five characters' AS text")
    for found in (dc.matches(docs, items), dc.matches(docs, items.limit(0))):
        assert found.schema.simpleString() == "struct<doc_id:bigint,item_id:bigint,distance:int>" and found.count() == 0
        assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
