from larder.llm import ngram_jaccard as nj


def test_passes_over_shares_of_the_tokens_find_the_same(table, near, monkeypatch):
    docs, stored = table(near(300, seed=5)), []
    got = lambda: sorted(tuple(r) for r in nj.link_clusters(docs, k=5, percent=80).collect())
    want = got()
    monkeypatch.setattr(nj, "PASS_TOKENS", 500)
    monkeypatch.setattr(nj, "cut", lambda df, cut=nj.cut: stored.append(out := cut(df)) or out)
    assert got() == want
    shares = [df for df in stored if df.columns[:2] == ["token", "doc"] and "pivot" in df.columns]
    assert len(shares) == nj.PASSES and all(df.count() for df in shares)
