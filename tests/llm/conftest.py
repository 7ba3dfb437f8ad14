import random

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def table(spark):
    """documents from (doc_id, text) pairs, with columns whose names clash with what operators use inside."""

    def make(rows):
        rows = [(i, t, "en", "s", 0, "x", 1) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string, component int")

    return make


@pytest.fixture
def near():
    """Texts in groups: originals, exact copies and copies with some words changed, some of them sharing a passage."""

    def make(n, seed=7, words=120):
        r = random.Random(seed)
        vocab = [f"w{i}" for i in range(400)]
        passage = " ".join(r.choices(vocab, k=60))
        out = []
        while len(out) < n:
            base = r.choices(vocab, k=r.randint(1, words))
            for _ in range(r.choice((1, 1, 2, 12))):
                w = list(base)
                for _ in range(r.choice((0, 1, 1, 2, 4))):
                    w[r.randrange(len(w))] = r.choice(vocab)
                t = " ".join(w)
                out.append(t + " " + passage if r.random() < 0.1 else t)
        return list(enumerate(out[:n]))

    return make
