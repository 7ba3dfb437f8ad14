from larder.llm import ngram_jaccard as nj


def test_op5_keeps_one_share_of_the_tokens_on_disk(table, near, monkeypatch):
    docs, gone = table(near(200, seed=9)), []
    got = lambda: sorted(tuple(r) for r in nj.link_clusters(docs).collect())
    want = got()
    monkeypatch.setattr(nj, "PASS_TOKENS", 200)
    monkeypatch.setattr(nj, "forget", lambda df, forget=nj.forget: gone.append(df.columns) or forget(df))
    assert got() == want and gone == [["doc", "n", "last", "tokens"]]
