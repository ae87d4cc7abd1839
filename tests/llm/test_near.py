import random
from collections import Counter, defaultdict

from tidemark.llm import near


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def brute(texts, similarity=0.8):
    """Pairs by an index of every shingle, and each text's component."""
    sets, index, root = list(map(grams, texts)), defaultdict(list), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for j, s in enumerate(sets):
        for i, n in Counter(i for g in s for i in index[g]).items():
            if n / (len(s) + len(sets[i]) - n) >= similarity:
                pairs.add((i, j))
                root[find(i)] = find(j)
        for g in s:
            index[g].append(j)
    return pairs, [find(i) for i in range(len(texts))]


def held_to_brute(docs):
    rows = docs.select("doc_id", "text").collect()
    pairs, roots = brute([r.text for r in rows])
    least = {}
    for r, k in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, least.get(k)) for r, k in zip(rows, roots, strict=True)), key=str)
    assert sorted(map(tuple, near.near_groups(docs).collect()), key=str) == want
    return pairs


def test_groups_against_brute_force(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len(held_to_brute(docs)) > 12
    held_to_brute(odd)
    assert near.near_groups(empty).count() == near.near_dedup(empty).count() == 0
    assert near.near_dedup(odd).columns == odd.columns


def test_copies_that_differ_in_many_bits_meet(spark):
    random.seed(3)
    rows = []
    for k in range(12):
        words = [f"w{random.randrange(5000)}" for _ in range(120)]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[random.randrange(120)] = f"new{len(rows)}"  # a chain: far ends are less alike than 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held_to_brute(docs)
    assert near.near_dedup(docs).count() == 12
