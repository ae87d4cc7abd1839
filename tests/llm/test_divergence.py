import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=30, top=50):
    """(lang, source, part, item, value, rank) by dictionaries and Python's whole numbers."""
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        held[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang, sources in held.items():
        kept = [w for w, n in sources.items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        p, whole = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in groups if o != s]
            terms = [(w, p[s][w] - whole[w]) for w in kept if groups[s][w] and p[s][w] > whole[w]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = rows(D.audit(docs))
    assert got == plain(docs.select("text", "lang", "source").collect()) and {r[2] for r in got} == {"pair", "term"}


EXTRA = "text string, lang string, source string, term string, n long, docs int, chunk int, _words array<string>, item string"


@pytest.fixture(scope="module")
def made(spark):
    """Nulls, empty and long texts, sources without terms, ties, a language with one source, one without kept terms, repeated rows, a hot source."""
    rng = np.random.default_rng(5)
    words = [*"alpha beta gamma delta Été été naïve 中文 zeta".split(), "İx", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(6))]
    texts = [(" ".join(words[int(i)] for i in rng.zipf(1.3, 30) % len(words)), "aa", f"s{'0' if rng.random() < 0.4 else rng.integers(1, 40)}") for _ in range(150)]
    texts += [(None, "aa", "quiet"), ("", "aa", None), ("42 --- 7", "aa", "signs"), ("only here only once", None, None), ("alpha " * 5, "lone", "one"), ("alpha " * 5, "lone", "one"), ("w" * 70_000 + " alpha", "aa", "long"), ("alpha " * 60_000, "aa", "s0")]
    texts += [("q z", "bb", "x"), ("z", "bb", "y"), (None, "bb", ""), ("q", "bb", None)]
    return spark.createDataFrame([(*t, "t", 1, 1, 1, ["w"], "i") for t in texts], EXTRA).repartition(3), texts


@pytest.mark.parametrize("how", [{}, {"chunk": 7, "block": 3, "at_once": 2}, {"chunk": 1, "block": 1, "at_once": 50}])
def test_odd_rows_in_any_layout(made, how):
    """However terms are cut to chunks, groups to blocks and rounds to jobs, the rows are the same."""
    docs, texts = made
    got = rows(D.audit(docs, least_docs=2, top=5, **how))
    want = plain(texts, 2, 5)
    assert got == want and max(r[5] for r in got if r[2] == "term") == 5
    assert {r[2] for r in got if r[0] == "lone"} <= {"term"}


def test_no_kept_terms_and_no_rows(made):
    docs, texts = made
    assert rows(D.audit(docs, least_docs=10_000)) == plain(texts, 10_000)
    none = D.audit(docs.limit(0))
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_every_two_blocks_meet_once():
    for blocks in (1, 2, 5, 8):
        seen = Counter(frozenset((b, (r - b) % blocks)) for r in range(blocks) for b in range(blocks) if (r - b) % blocks <= b)
        assert set(seen.values()) == {1} and len(seen) == blocks * (blocks + 1) // 2


def test_heaps_and_large_counts(spark):
    terms = pa.array(["a", "b", "c", "d"])
    assert D.top_terms(np.array([9, 5, 9, 1]), np.array([0, 1, 2]), np.array([4, 5, 4, 0]), terms, 2) == [(-5, 0), (-5, 2)]
    big = spark.createDataFrame([(8 * 10**17, 9 * 10**17, 10)], "n long, t long, v long").select(D._share(*map(D.F.col, "ntv"))).first()[0]
    assert big == 1 + 10**9 * (8 * 10**17 + 5) // (9 * 10**17 + 50)
