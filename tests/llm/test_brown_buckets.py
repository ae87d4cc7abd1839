import numpy as np
from test_brown import out_of, plain_scores, tokens

from tidemark.llm import brown


def test_words_meet_by_bucket(spark, small, monkeypatch):
    """Tables of words outside the head hold a row for each bucket, none for each word or link; many small chunks and buckets give the same scores."""
    tables, outer, classes = {}, brown.cluster_outer, {}
    written = brown.written

    def noted(df, tag):
        table = written(df, tag)
        if tag.startswith("outer"):
            tables[tag] = table.count()
        return table

    def seen(*args):
        found = outer(*args)
        classes.update((bytes(r["word"]), r["c"]) for r in found[0].collect())
        return found

    def head(*args, cluster=brown.cluster):
        found = cluster(*args)
        classes["head"] = found[0].tolist()
        return found

    for name, f in (("written", noted), ("cluster_outer", seen), ("cluster", head)):
        monkeypatch.setattr(brown, name, f)
    monkeypatch.setattr(brown, "CHUNK", 3000)
    monkeypatch.setattr(brown, "BUCKET", 1500)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(120)
    rows = docs.select("doc_id", "text").collect()
    got = brown.lm_scores(docs, classes=6, head=60, core=30).collect()
    counts = {}
    for r in rows:
        if not out_of(r.doc_id):
            for t in tokens(r.text):
                counts[t] = counts.get(t, 0) + 1
    common = sorted(counts.keys() - {b"\n"}, key=lambda w: (-counts[w], w))[:60]
    by_word = classes | dict(zip([b"\n", *common], classes["head"], strict=True))
    assert len(by_word) == len(counts) + 1
    assert np.allclose(sorted(plain_scores(rows, docs, by_word, 6)), sorted(r.score for r in got), atol=1e-6)
    words = len(counts) - 61
    assert tables and 3 < max(tables.values()) < words / 20
