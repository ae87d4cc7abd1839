import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import mixing, packing
from tidemark.llm.tokens import Encoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def check_packed(rows, docs, capacity=1024):
    tokenizer = Tokenizer.from_file(BYTES)
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n, least = check_packed(packing.best_fit(docs, BYTES).collect(), docs)
    assert n <= least * 1.02 + 1
    check_packed(packing.best_fit(odd, BYTES).collect(), odd)
    assert packing.best_fit(empty, BYTES).count() == 0


def test_solver_holds_every_piece_and_comes_near_the_bound():
    random.seed(2)
    for capacity, n, low, high in ((100, 5000, 1, 100), (64, 300, 20, 40), (1024, 20000, 1, 1024), (10, 7, 3, 3), (50, 1000, 17, 26)):
        histogram = {}
        for _ in range(n):
            x = random.randint(low, high)
            histogram[x] = histogram.get(x, 0) + 1
        plan = packing.solve(histogram, capacity)
        held = {}
        for config, times in plan:
            assert sum(a * b for a, b in config.items()) <= capacity
            for x, a in config.items():
                held[x] = held.get(x, 0) + a * times
        assert held == histogram
        descending, bins = sorted((x for x, k in histogram.items() for _ in range(k)), reverse=True), []
        for x in descending[:3000]:
            fits = [i for i, room in enumerate(bins) if room >= x]
            if fits:
                i = min(fits, key=lambda j: bins[j])
                bins[i] -= x
            else:
                bins.append(capacity - x)
        if n <= 3000:
            assert sum(t for _, t in plan) <= len(bins) * 1.03 + 1


def test_ids_by_rank_are_the_librarys(spark, small):
    random.seed(9)
    letters = "ab Z'sé  \n\t 1,.!İßΣ中\x1c\x85'll re|<>"
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 25))) for _ in range(3000)] + ["<|endoftext|>", "a  ", " \n a"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = Encoder(public_tokenizers.path(name))
        for _ in range(2):
            for text in texts:
                assert own.ids(text) == own.plain(text)


def plain_targets(sizes, weights, total, most=2.0):
    """Shares of total by weight, none above most times its size; the excess is shared again."""
    out, left, open_ = [0.0] * len(sizes), min(total, most * sum(sizes)), [i for i, s in enumerate(sizes) if s]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def test_targets_stop_at_twice_a_source(spark):
    rng = np.random.default_rng(4)
    for sizes in ([100, 10, 1000, 0], [0, 0], [], [5], rng.integers(0, 3000, 40).tolist(), (10 ** rng.uniform(0, 5, 30)).astype(int).tolist()):
        names = [None if i == len(sizes) - 1 else f"s{i:03d}" for i in range(len(sizes))]
        table = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes, strict=True)], "source string, words long, docs long").repartition(3)
        got = {r.source: r.target for r in mixing.targets(table, (3, 1, 2), 1.5).collect()}
        want = plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
        assert len(got) == len(names) and all(abs(got[n] - w) < 1e-6 for n, w in zip(names, want, strict=True))


def test_memory_of_a_fit_with_a_text_of_ten_million_words():
    """What is held grows with the sums, not with sums times sizes; the fit is exact all the same."""
    sizes = np.array([*range(1, 1201), 10_000_000])
    for counts, budget in ((np.full(1201, 50), 40_000_123), (np.append(np.ones(1200, np.int64), 2), 12_345_678)):
        tracemalloc.start()
        got = mixing.fit(sizes, counts, budget)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        reach = int((got * sizes).sum())
        assert peak < 200e6 and (got <= counts).all() and abs(reach - budget) <= (0 if counts[0] == 50 else 5_000_000)


def test_knapsack_is_nearest():
    import itertools

    random.seed(1)
    for _ in range(60):
        sizes = np.array(sorted(random.sample(range(1, 30), 3)))
        counts = np.array([random.randint(0, 3) for _ in sizes])
        budget = random.randint(0, int((sizes * counts).sum()))
        got = mixing.knapsack(sizes, counts, budget)
        assert (got <= counts).all()
        best = min(abs(sum(a * b for a, b in zip(c, sizes, strict=True)) - budget) for c in itertools.product(*(range(n + 1) for n in counts)))
        assert abs(int((got * sizes).sum()) - budget) == best


def test_mix(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for table in (docs, odd):
        rows = mixing.mix(table).collect()
        assert len(rows) == table.count()
        total = sum(r["size"] for r in rows)
        order = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
        sizes = [sum(r["size"] for r in rows if r.source == s) for s in order]
        goals = dict(zip(order, plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * total), strict=True))
        assert all(r.taken in (0, r["size"], 2 * r["size"]) and abs(r.target - goals[r.source]) < 1e-6 for r in rows)
        if table is docs:
            for s in order:
                assert abs(sum(r.taken for r in rows if r.source == s) - goals[s]) <= 0.05 * goals[s] + 25
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(table.repartition(3)).collect()))
        out = mixing.mixed(table)
        assert out.columns == table.columns
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0
    words = sum(len((r.text or "").encode().split()) for r in mixing.mixed(docs).collect())
    assert words == sum(r.taken for r in mixing.mix(docs).collect())


def test_takes_of_rows_with_null_or_repeated_ids_are_the_planned_ones(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "word " * 5 + f"w{i}", "abc"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    planned = mixing.mix(docs, share=0.5).collect()
    got = mixing.mixed(docs, share=0.5).collect()
    for source in "ab":
        words = sum(len(r.text.split()) for r in got if r.source == source)
        goal = next(r.target for r in planned if r.source == source)
        assert words == sum(r.taken for r in planned if r.source == source) and abs(words - goal) <= 6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(5), share=0.5).collect()))


def test_ids_are_the_librarys_own_special_tokens_included():
    rng = random.Random(12)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "a", "Bc", " ", "  ", "\n", "\t x", "é", "中文", "\u00a0", "don't", "12", "...", "x" * 70, "ẞ", "\u0301"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library, mine = Tokenizer.from_file(path), Encoder(path)
        for _ in range(3000):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
            assert mine.ids(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids), (name, text)


def test_mixed_takes_every_equal_row_by_itself(spark):
    docs = spark.createDataFrame([(None, "s", "one two three", k % 2) for k in range(10)] + [(k, "t", "word " * (k + 1), 0) for k in range(6)], "doc_id long, source string, text string, _size int")
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and {r._size for r in rows.where("source = 's'").collect()} <= {0, 1}
    plan = mixing.mix(docs).collect()
    for source, words in (("s", 3), ("t", None)):
        took = sum(len(r.text.split()) for r in rows.where(f"source = '{source}'").collect())
        assert took == sum(r.taken for r in plan if (r.doc_id is None) == (source == "s"))
        assert abs(took - next(r.target for r in plan if (r.doc_id is None) == (source == "s"))) <= (words or 6)
