import hashlib
import re

import pytest

from tidemark.llm import decontaminate as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def hits(text, windows):
    """Hit word positions and items, by looking at every place for windows of every length."""
    w, at, ids = words(text), set(), set()
    for size in {len(k) for k in windows}:
        for a in range(len(w) - size + 1):
            if found := windows.get(tuple(w[a : a + size])):
                at |= set(range(a, a + size))
                ids |= found
    return len(w), at, ids


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        n, at, ids = hits(text, windows)
        out.append((doc, n, len(at), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(at)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_tables(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(D.contamination(docs, items))
    assert got == plain(docs.select("doc_id", "text").collect(), items.collect()) and any(r[5] for r in got)


ITEM = "One two, three four FIVE six seven eight nine ten eleven twelve"
TEXTS = [
    (1, f"before {ITEM.upper()} after"), (2, f"before {ITEM.upper()} after"), (3, "one two three four five six seven eight nine"), (4, "two-three-four-five-six seven eight nine ten eleven"),
    (5, None), (6, ""), (7, " \n\t"), (None, ITEM), (8, f"{ITEM} {ITEM}"), (8, f"{ITEM} {ITEM}"), (9, "x " * 3000 + ITEM + " tail" * 500), (10, "un été"), (11, "un ÉTÉ"), (12, "un été à Paris"),
    (13, "go"), (14, "the the the the the"), (15, "a a a a a a a a a a a a a"), (16, "one two"),
]
ITEMS = [(1, ITEM), (2, ITEM), (2, ITEM), (None, "one two"), (30, "Un été"), (4, "GO"), (5, "the the"), (6, "a " * 11), (7, None), (8, ""), (9, "never seen shingles at all"), (10, "?!")]
EXTRA = "doc_id long, text string, lang string, wid string, start int, _key string, _words string, item_id string, k int"


@pytest.fixture(scope="module")
def fixture(spark):
    docs = spark.createDataFrame([(i, t, None, "w", 1, "k", "x", "i", 2) for i, t in TEXTS], EXTRA).repartition(3)
    items = spark.createDataFrame([(i, t, "w", "k") for i, t in ITEMS], "item_id int, text string, wid string, _words string")
    return docs, items


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 600])
def test_odd_rows_and_short_items(fixture, block_bytes):
    """Items of one and two words, repeated and hot windows, equal texts, null ids; several blocks of windows give the same."""
    docs, items = fixture
    got = rows(D.contamination(docs, items, block_bytes=block_bytes))
    assert got == plain(TEXTS, ITEMS)
    assert D.contamination(docs, items, block_bytes=block_bytes).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_spans_and_what_stays(fixture):
    docs, items = fixture
    spans = {}
    for r in D.spans(docs, items).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    windows = {}
    for item, text in ITEMS:
        w = words(text)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(item))
    assert spans == {i: at for i, t in TEXTS if (at := hits(t, windows)[1])}
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in TEXTS if i is not None and not hits(t, windows)[1]]


def test_empty_tables(spark, fixture):
    docs, items = fixture
    none = D.contamination(docs, items.limit(0))
    assert rows(none) == plain(TEXTS, [])
    assert D.contamination(docs.limit(0), items).count() == 0 and D.decontaminated(docs.limit(0), items).count() == 0


def test_rarest_shingle_is_the_prefix(spark):
    docs = spark.createDataFrame([(i, "common common common " * 5 + ("common common rare" if i == 0 else "")) for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "common common common rare"), (2, "common common absent")], "item_id int, text string")
    sought = D.prefixes(docs, D.benchmark_windows(items)).collect()
    assert [(r.length, r.offset) for r in sought] == [(4, 1)]


def test_no_python_in_the_plan(fixture):
    docs, items = fixture
    plan = D.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
