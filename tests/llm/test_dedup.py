import hashlib
import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import near, simhash
from tidemark.llm.common import components
from tidemark.llm.exact_dedup import exact_dedup, exact_groups


def az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_against_brute_force(spark, small, odd):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        rows = [(r.doc_id, az(r.text)) for r in docs.collect()]
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        got = exact_groups(docs).collect()
        assert len(got) == len(rows)
        keep = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}
        assert all((r.keep_id, r.group_size) == keep[r.text_sha256] for r in got)
        assert sorted(r.text_sha256 for r in got if r.kept) == sorted(keep)
        stay = exact_dedup(docs)
        assert stay.columns == docs.columns
        found = stay.collect()
        assert sorted(az(r.text) for r in found) == sorted(groups)
        whole = [str(r) for r in docs.collect()]
        assert all(str(r) in whole for r in found)  # extra columns come back as they were


def test_empty_tables(empty):
    assert exact_groups(empty).count() == exact_dedup(empty).count() == 0
    assert simhash.near_groups(empty).count() == simhash.near_dedup(empty).count() == 0


def brute_print(text):
    words = az(text).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def staying(docs, rows, roots):
    """Of each component the row with the least id, as text; rows that tie in id are equal in the fixtures, or their texts are copies."""
    best = {}
    for whole, r, k in zip(docs.collect(), rows, roots, strict=True):
        rank = (r.doc_id is None, r.doc_id or 0)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, str(whole))
    return [text for _, text in best.values()]


def test_repeated_ids_and_rows_leave_one_row(spark):
    t, u = "alpha beta gamma delta epsilon zeta " * 20, "one two three four five six " * 20
    docs = spark.createDataFrame([(3, t), (5, t), (5, "another text altogether"), (7, u), (7, u), (None, t), (None, "only without an id"), (None, "only without an id")], "doc_id long, text string")
    want = sorted([(3, t), (5, "another text altogether"), (7, u), (None, "only without an id")], key=str)
    for dedup in (simhash.near_dedup, near.near_dedup):
        assert sorted(map(tuple, dedup(docs).collect()), key=str) == want


def test_simhash_against_brute_force(spark, small, odd):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        rows = docs.select("doc_id", "text").collect()
        prints = [brute_print(r.text) for r in rows]
        parts = {}
        for r, p in zip(rows, brute_components(prints), strict=True):
            parts.setdefault(p, []).append(r.doc_id)
        want = sorted(((r.doc_id, f"{x:016x}", min((i for i in parts[p] if i is not None), default=None)) for r, x, p in zip(rows, prints, brute_components(prints), strict=True)), key=str)
        got = simhash.near_groups(docs)
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == want
        assert sorted(map(str, simhash.near_dedup(docs).collect())) == sorted(staying(docs, rows, brute_components(prints)))


def test_spark_hash_is_the_one_used(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("été one two")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("été one two".encode(), seed=42)


def test_links_lose_none_usual_and_crowded(spark):
    random.seed(5)
    seeds = [random.getrandbits(64) for _ in range(40)]
    prints = {0, 2**64 - 1}
    for s in seeds:
        for _ in range(12):
            x = s
            for _ in range(random.randint(0, 3)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for hot in (4096, 3):
        got = [tuple(r) for r in simhash.links(distinct, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_anchors_cover_and_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63, 500)
    anchor = simhash.home(x)
    assert np.bitwise_count((x ^ anchor) & (2**46 - 1)).max() <= 6
    row, near = simhash.anchors(x)
    assert np.bitwise_count((x[row] ^ near) & (2**46 - 1)).max() <= 8
    assert 60 < len(row) / len(x) < 100
    assert len(set(zip(row, near, strict=True))) == len(row)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}
