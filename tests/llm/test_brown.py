import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import brown
from tidemark.llm.common import written


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def out_of(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def likelihood(pairs, classes, k):
    matrix = np.zeros((k, k))
    for (a, b), n in pairs.items():
        matrix[classes[a], classes[b]] += n
    f = brown._xlogx
    return matrix, f(matrix).sum() - f(matrix.sum(0)).sum() - f(matrix.sum(1)).sum()


def counted(pairs, classes, size, k):
    """Each unit's neighbours by side and class, and how often it follows itself."""
    counts = np.zeros((size, 2, k))
    for (a, b), n in pairs.items():
        if classes[a] >= 0:
            counts[b, 0, classes[a]] += n
        if classes[b] >= 0:
            counts[a, 1, classes[b]] += n
    return counts, np.array([float(pairs[u, u]) for u in range(size)])


def test_gains_are_differences_of_likelihood():
    for seed, k, size, many in ((4, 5, 12, 300), (6, 9, 60, 90)):
        rng = np.random.default_rng(seed)
        pairs = Counter(map(tuple, rng.integers(0, size, (many, 2)).tolist()))
        classes = rng.integers(0, k, size)
        matrix, _ = likelihood(pairs, classes, k)
        counts, twice = counted(pairs, classes, size, k)
        got = brown.gains(matrix, classes, counts, twice)
        best = brown.Moves(matrix).best(classes, counts, twice)
        for u in range(size):
            want = []
            for c in range(k):
                other = classes.copy()
                other[u] = c
                want.append(likelihood(pairs, other, k)[1])
            assert np.allclose(got[u] - got[u, 0], np.array(want) - want[0])
            assert want[best[u]] > max(want) - 1e-5 and (best[u] == classes[u] or want[best[u]] > want[classes[u]])


def test_units_without_a_class_join_the_best():
    rng = np.random.default_rng(8)
    k, size = 6, 40
    pairs = Counter(map(tuple, rng.integers(0, size, (500, 2)).tolist()))
    pairs[39, 1] = 30
    del pairs[39, 39]
    classes = rng.integers(0, k, size)
    classes[39] = -1
    others = Counter({p: n for p, n in pairs.items() if 39 not in p})
    matrix, _ = likelihood(others, classes, k)
    counts, twice = counted(pairs, classes, size, k)
    want = []
    for c in range(k):
        classes[39] = c
        want.append(likelihood(pairs, classes, k)[1])
    assert brown.Moves(matrix).best(np.array([-1]), counts[39:], np.zeros(1))[0] == int(np.argmax(want))


def test_exchange_finds_planted_classes_and_rises():
    rng = np.random.default_rng(9)
    kinds = np.arange(30) % 3
    table = np.zeros((30, 30))
    for a in rng.integers(0, 30, 20_000):
        b = rng.choice(np.flatnonzero(kinds == (kinds[a] + 1) % 3))
        table[a, b] += 1
    got = brown.exchange(table, 3, table.sum())
    assert len({(a, b) for a, b in zip(kinds, got, strict=True)}) == 3
    pairs = Counter({(a, b): table[a, b] for a in range(30) for b in range(30)})
    assert likelihood(pairs, got, 3)[1] > likelihood(pairs, np.arange(30) % 2, 3)[1]


def test_class_counts(spark):
    rng = np.random.default_rng(5)
    k, size = 4, 15
    pairs = Counter(map(tuple, rng.integers(0, size, (400, 2)).tolist()))
    classes = rng.integers(-1, k, size)
    table = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a long, b long, n long").repartition(3)
    links = brown.neighbours(table)
    want, twice = counted(pairs, classes, size, k)
    seen = set()
    for batch in links.toArrow().to_batches():
        units, counts, own = brown.class_counts(batch, classes, k)
        assert (counts == want[units]).all() and (own == np.where(classes[units] >= 0, twice[units], own)).all()
        seen |= set(units.tolist())
    assert seen == set(range(size))
    known = Counter({p: n for p, n in pairs.items() if min(classes[list(p)]) >= 0})
    assert (brown.class_pairs(links, classes, k) == likelihood(known, classes, k)[0]).all()


def plain_scores(rows, table, by_word, k):
    """Every text's score from its words, their counts and classes alone; None for a word without a class."""
    counts = Counter(t for r in rows if not out_of(r.doc_id) for t in tokens(r.text))
    total, kinds = sum(counts.values()), len(counts)
    matrix = np.zeros((k, k))
    for r in rows:
        if not out_of(r.doc_id):
            chain = [by_word[t] for t in [b"\n", *tokens(r.text)]]
            for a, b in zip(chain, chain[1:], strict=False):
                matrix[a, b] += 1
    share = [(matrix[:, c].sum() + 1) / (matrix.sum() + k) for c in range(k)]
    out, rare = [], 1 / (total + kinds + 1)
    for r in rows:
        score, before = 0.0, by_word.get(b"\n")
        for t in tokens(r.text):
            c = by_word.get(t)
            if c is None:
                score += math.log10(rare)
            else:
                follow = share[c] if before is None else (matrix[before, c] + 2 * share[c]) / (matrix[before].sum() + 2)
                score += math.log10((1 - rare) * 0.95 * follow * counts[t] / matrix[:, c].sum() + 0.05 * (counts[t] + 1) * rare)
            before = c
        out.append(score)
    return out


@pytest.mark.parametrize("case", ["whole", "all_in_head", "odd", "null_ids", "empty"])
def test_scores(spark, small, odd, empty, monkeypatch, case):
    """Counts and base scores against plain sums; scores against a plain reading of the classes that were found."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {}
    cluster, outer = brown.cluster, brown.cluster_outer

    def seen(*args, **options):
        found["head"] = cluster(*args, **options)
        return found["head"]

    def seen_outer(words, *rest):
        found["outer"] = outer(words, *rest)
        found["classes"] = {bytes(r["word"]): r["c"] for r in found["outer"][0].collect()}
        return found["outer"]

    monkeypatch.setattr(brown, "cluster", seen)
    monkeypatch.setattr(brown, "cluster_outer", seen_outer)
    few = docs.where("n_chars < 3000").orderBy("doc_id").limit(40)
    if case == "empty":
        assert brown.lm_scores(empty, classes=4).count() == 0
        return
    cases = {"whole": (docs, 2000, 100), "all_in_head": (few, 20_000, 50), "odd": (odd, 3, 2), "null_ids": (few.withColumn("doc_id", F.lit(None).cast("long")), 100, 50)}
    for table, head, core in [cases[case]]:
        rows = table.select("doc_id", "text").collect()
        counts = Counter(t for r in rows if not out_of(r.doc_id) for t in tokens(r.text))
        total, kinds = sum(counts.values()), len(counts)
        got = brown.lm_scores(table, classes=8, head=head, core=core).collect()
        want = [(r.doc_id, out_of(r.doc_id), len(tokens(r.text)), sum(t in counts for t in tokens(r.text)), total, round(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens(r.text)), 4)) for r in rows]
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in got)
        common = sorted(counts.keys() - {b"\n"}, key=lambda w: (-counts[w], w))[:head]
        by_word = dict(zip([b"\n", *common], found["head"][0].tolist(), strict=True)) | found.get("classes", {})
        assert by_word.keys() == counts.keys()
        scores = plain_scores(rows, table, by_word, 8)
        assert np.allclose(sorted(scores), sorted(r.score for r in got), atol=1e-6)
        if table is docs:
            new = [r for r in got if r.held_out]
            assert sum(r.score for r in new) > sum(r.base_score for r in new) + 0.05 * sum(r.n_tokens for r in new)


def test_rounds_only_rise(spark, small, monkeypatch):
    """The likelihood that each round keeps is no lower than the last's, and rounds end."""
    reached = []
    lower = brown.Rounds.lower

    def noted(self, now):
        back = lower(self, now)
        reached.append((self.tokens, self.reached[-1]))
        return back

    monkeypatch.setattr(brown.Rounds, "lower", noted)
    brown.lm_scores(spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 3000"), classes=12, head=400, core=60).count()
    assert len(reached) > 3
    assert all(b >= a for (i, a), (j, b) in zip(reached, reached[1:], strict=False) if i == j)


def test_classes_do_not_depend_on_partitions(spark):
    """Words outside the head get the same classes however their table is dealt."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'the a on'.split()[i % 3]} w{i % 97:02d}x{i % 5} w{(i * 7) % 89:02d}y" for i in rng.integers(0, 400, 30)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    codes = brown.coded(rows.repartition(3), [b"\n", b"the", b"a", b"on"])
    occurring = written(brown.occurrences(codes), "occurring")
    matrix = np.zeros((6, 6))
    for r in brown.head_pairs(codes, 4).collect():
        matrix[r.a, r.b] = r.n
    found = []
    for parts in (2, 9):
        words = brown.outer_words(occurring, np.arange(4), matrix).repartition(parts)
        table, _ = brown.cluster_outer(written(words, "outer"), occurring, matrix)
        found.append({bytes(r.word): r.c for r in table.collect()})
    assert found[0] == found[1] and len(set(found[0].values())) > 2


def test_words_outside_the_head_get_classes_by_exchange(spark):
    """Rare words of two kinds: only their neighbours tell them apart. Word counts and matrix against plain ones."""
    rng, k = np.random.default_rng(7), 7
    texts = [" ".join(f"the qq{i:03d}zzz runs a qq{i + 200:03d}zzz qq{i + 200:03d}zzz sleeps" for i in rng.integers(0, 200, 20)) for _ in range(40)]
    rows = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(2)
    head = [b"\n", b"the", b"runs", b"a", b"sleeps"]
    codes = brown.coded(rows, head)
    by_class, matrix = np.arange(5), np.zeros((k, k))
    for r in brown.head_pairs(codes, 5).collect():
        matrix[r.a, r.b] = r.n
    occurring = brown.occurrences(codes)
    words = written(brown.outer_words(occurring, by_class, matrix), "outer")
    counts = Counter(w for t in texts for w in tokens(t))
    assert {bytes(r.word): r.n for r in words.collect()} == {w: n for w, n in counts.items() if w not in head}
    table, after = brown.cluster_outer(words, occurring, matrix)
    of = {w: i for i, w in enumerate(head)} | {bytes(r.word): r.c for r in table.collect()}
    want = np.zeros((k, k))
    for t in texts:
        for a, b in zip([b"\n", *tokens(t)], tokens(t), strict=False):
            want[of[a], of[b]] += 1
    assert (after == want).all() and len(of) == len(counts)
    kinds = [{of[w] for w in of if w.startswith(b"qq") and (int(w[2:5]) < 200) == first} for first in (True, False)]
    assert not kinds[0] & kinds[1]
