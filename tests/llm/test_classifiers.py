import random
import zlib

import numpy as np

from larder.llm import language_id as li
from larder.llm import quality_gam as qg
from larder.llm import toxic_grammar as tg


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def names(text):
    return [tg.PATTERNS[i] for i, n in enumerate(tg.patterns(text)) for _ in range(n)]


def test_clause_patterns():
    assert names("You are an idiot") == [("I", "directed")]
    assert names("You are not an idiot") == [("I", "directed", "negated")]
    assert names("She said you are an idiot") == [("I", "directed", "reported")]
    assert names("She said so. Idiots") == [("I",)]
    assert names("I will kill the process. you") == [("T",)]
    assert names("They will kill you, idiot!") == [("T", "directed"), ("I", "directed")] or names("They will kill you, idiot!") == [("I", "directed"), ("T", "directed")]
    assert names("clowning around with trashy idiotsyncrasies") == []
    assert names("") == []


def test_composition_is_one_after_the_other():
    r = random.Random(1)
    parts = [tg.harm(), tg.within_reach("Y", "directed"), tg.within_reach("N", "negated"), tg.in_clause("R", "reported")]
    for _ in range(200):
        symbols = r.choices("ITYNREO", k=20)
        stream = [(s,) for s in symbols]
        for t in parts:
            state, out = t.start, []
            for x in stream:
                state, y = t.step(state, x)
                out.append(y)
            stream = out
        state, found = 0, []
        for s in symbols:
            found.append(tg.PATTERNS[tg.OUT[state][s]] if s in tg.OUT[state] else None)
            state = tg.STEP[state][s]
        assert found == [x if x in tg.PATTERNS else None for x in stream]


def test_toxicity(spark, table):
    r = random.Random(2)
    vocab = ["alpha", "beta", "gamma", "delta"]
    rows, marks = [], []
    for i in range(400):
        bad = r.random() < 0.3
        words = r.choices(vocab, k=30)
        for _ in range(3 * bad):
            words.insert(r.randrange(30), r.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad != (r.random() < 0.08)), int(bad)))
    labels = spark.createDataFrame([*marks, (5, None, None), (None, 1, 1)], "doc_id long, toxic int, score int")
    out = {x.doc_id: x for x in tg.toxicity(table(rows), labels).collect()}
    assert all(out[i].held_out == (fold(i, 3) == 1) and 0 <= out[i].score <= 1 and out[i].predicted == (out[i].score >= 0.7) for i, _ in rows)
    assert all(out[i].predicted == bad for i, _, bad in marks)
    # Without labels the grammar's own weights hold.
    alone = tg.toxicity(table([(1, None), (2, ""), (3, "You idiot"), (3, "You idiot"), (None, "fine")]), labels.limit(0)).collect()
    assert sorted((str(x.doc_id), x.predicted) for x in alone) == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("None", 0)]
    assert tg.toxicity(table([]), labels).count() == 0


def test_toxicity_beyond_the_lexicon(spark, table):
    r = random.Random(6)
    ends = ["ba", "co", "du", "fe", "gi", "ho", "ju", "ka", "lem", "nor"]
    plain = [a + b for a in ("mira", "sole", "tavo", "runi") for b in ends]
    rows, marks = [], []
    for i in range(900):
        bad = r.random() < 0.2
        words = r.choices(plain, k=r.randint(60, 400))
        if bad and i % 2:
            words.insert(5, "zlo")  # toxic by itself
        else:  # words of a stem, each in another form; clean documents hold some by chance
            for _ in range(max(4, len(words) // 30) if bad else r.random() < 0.2):
                words.insert(r.randrange(len(words)), "quarz" + r.choice(ends) + r.choice(ends))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    rows += [(1000, " ".join(plain) + " zlo"), (1001, " ".join(plain * 5)), (1002, " ".join(plain * 5) + " quarzbaco")]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    out = {x.doc_id: x for x in tg.toxicity(table(rows), labels).collect()}
    held = [(out[i].predicted, bad) for i, bad in marks if out[i].held_out]
    assert sum(p for p, bad in held if bad) >= 0.9 * sum(bad for _, bad in held) > 0
    assert sum(p for p, bad in held if not bad) <= 0.01 * len(held)
    assert [out[i].predicted for i in (1000, 1001, 1002)] == [1, 0, 0]
    learned = tg.learn(table(rows).join(labels.withColumnRenamed("toxic", "y"), "doc_id").select("text", "y"))
    assert learned.symbol("zlo") == "I" and learned.symbol("quarzxyz") in "IS" and learned.symbol("miraba") == "O" and learned.symbol("idiots") == "I"


def test_quality(spark, table):
    r = random.Random(3)
    rows, marks = [], []
    for i in range(600):
        good = r.random() < 0.6
        words = ["".join(r.choices("etaoinshr", k=r.randint(2, 8))) for _ in range(80)]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " | ".join(words)))
        marks.append((i, int(good != (r.random() < 0.08)), good))
    labels = spark.createDataFrame([*marks, (7, None, None), (None, 1, None)], "doc_id long, quality int, x boolean")
    out = {x.doc_id: x for x in qg.quality(table(rows), labels).collect()}
    assert all(out[i].held_out == (fold(i, 5) == 0) and out[i].predicted == (out[i].score >= 0.3) for i, _ in rows)
    held = [(out[i].predicted, good) for i, _, good in marks if out[i].held_out]
    assert np.mean([p == g for p, g in held]) > 0.97
    alone = qg.quality(table([(1, None), (2, ""), (2, "a"), (None, "x " * 40_000)]), labels.limit(0)).collect()
    assert sorted((str(x.doc_id), x.score) for x in alone) == [("1", 0.5), ("2", 0.5), ("2", 0.5), ("None", 0.5)]
    assert qg.quality(table([]), labels).count() == 0


def test_the_additive_model_adds_up():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    logit = 2 * (x[:, 0] > 0.5) - x[:, 1] ** 2 + 3 * ((x[:, 2] > 0) == (x[:, 3] > 0)) - 1
    y = (r.random(3000) < 1 / (1 + np.exp(-logit))).astype(float)
    gam = qg.Gam(x, y)
    assert (2, 3) in gam.pairs
    s = gam.score(x)
    assert np.corrcoef(np.log(s / (1 - s)), logit)[0, 1] > 0.9


def test_languages(spark):
    r = random.Random(4)
    sounds = {"aa": "kipu lomo tanu", "bb": "schrt zwerg brunft", "cc": "eau oui ment"}
    rows = [(i, " ".join("".join(r.choices(sounds[v].split(), k=2)) for _ in range(30)), v) for i in range(400) for v in [r.choice(list(sounds))]]
    rows += [(1000, None, "aa"), (1001, "12 34 ...", "aa"), (1002, "", None), (1003, "kipulomo", None), (1003, "zwergbrunft", None), (None, "ouieau", None)]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, lang string, score int")
    out = {}
    for x in li.languages(docs, reject=False).collect():
        out.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, out.values())) == len(rows)
    assert all(out[i][0].lang_pred == v for i, _, v in rows[:400])
    assert [out[i][0].lang_pred for i in (1000, 1001, 1002, None)] == ["und", "und", "und", "cc"]
    assert {x.lang_pred for x in out[1003]} == {"aa", "bb"}
    assert all(0 <= x.score <= 1 and x.held_out == (fold(x.doc_id, 3) == 1 if x.doc_id is not None else False) for xs in out.values() for x in xs)
    strange = docs.limit(400).union(spark.createDataFrame([(5000, "xq vw jx", None, 0)], docs.schema))
    again = {x.doc_id: x for x in li.languages(strange).collect()}
    assert again[5000].rejected == (again[5000].lang_pred == "und")
    assert li.languages(docs.limit(0)).count() == 0


def test_clauses_of_several_words_and_both_directions():
    assert names("idiots like you") == [("I", "directed")]
    assert names("you are a waste of space") == [("I", "directed")]
    assert names("there is space for a piece of cake") == []
    assert names("We will hurt you") == [("T", "directed")]
    assert names("the burn will heal") == []
    assert names("We pass idiot idea") == [("I",)]
    assert names("the idiot. You left") == [("I",)]


def test_no_bare_word_is_toxic_by_the_grammar_alone(spark, table):
    rows = [(1, "The idiot."), (2, "fool"), (3, "He killed the process: kill -9 worker"), (4, "You are a fool"), (5, "idiot " * 9)]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = {x.doc_id: x for x in tg.toxicity(table(rows), labels).collect()}
    assert [out[i].predicted for i in range(1, 5)] == [0, 0, 0, 1]
    assert out[5].matches == 9
