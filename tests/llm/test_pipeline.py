import hashlib
import random

import numpy as np
import public_tokenizers
from test_byte_bpe import LIBRARY
from test_decontamination import dp
from test_ngram_jaccard import brute as linked
from test_pii_deobfuscation import brute as plain
from test_robust_outliers import corpus

import corpus_pipeline
from larder.llm import decontamination as dc
from larder.llm import robust_outliers as ro

NAMES = ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE encoding and decoding"]


def test_run_as_a_plain_version(spark, tmp_path):
    r = random.Random(9)
    clean, junk = corpus(seed=9, n=150)
    items = [(i, " ".join(r.choices("lorem ipsum dolor sit amet tempor".split(), k=15))) for i in range(5)]
    rows = clean + junk
    rows += [(1000 + i, t + " more") for i, t in clean[:20]] + [(1100 + i, t) for i, t in clean[20:30]]
    rows += [(1200 + i, clean[30 + i][1] + " " + items[i % 5][1]) for i in range(10)]
    rows += [(1300 + i, clean[50 + i][1][:400] + " mail me@site.org or 10.1.2.3 " + clean[70 + i][1]) for i in range(10)] + [(1400, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == NAMES

    kept = {x.doc_id for x in ro.judge(docs).where("kept").collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in junk} - {1400}
    left = [(i, t) for i, t in rows if i in kept]
    left = [(i, dict(left)[i]) for i, _, c in linked(left, 5, 80) if i == c]
    left = [(i, t) for i, t in left if not any(dp(s, dc.normal(t)) <= int(dc.RATE * len(s)) for _, s in items)]
    want = {}
    for i, t in left:
        for (a, b), kind in sorted(((s, k) for k, ss in plain(t).items() for s in ss), reverse=True):
            t = t[:a] + f"<{kind}>" + t[b:]
        ids = LIBRARY.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {x.doc_id: tuple(x)[1:] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert len(got) < len(kept) and public_tokenizers.PATTERN


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "word " * 60, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
