from tidemark.llm import brown


def test_no_table_of_occurrences(spark, small, monkeypatch):
    """Occurrences outside the head, which take more room than the text, are never a table; every document still has its scores."""
    tags, written = [], brown.written
    monkeypatch.setattr(brown, "written", lambda df, tag: (tags.append(tag), written(df, tag))[1])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = brown.lm_scores(docs, classes=8, head=200, core=50, rounds=1).collect()
    assert "codes" in tags and "occurrences" not in tags
    assert len(rows) == docs.count() and all(r.score < 0 and 0 < r.n_known <= r.n_tokens for r in rows if r.n_tokens > 1 and not r.held_out)
