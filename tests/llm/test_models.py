import zlib

import numpy as np

from tidemark.llm import quality, toxicity


def test_network_gradients_against_differences():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, mask = rng.normal(size=(5, 3, toxicity.SIZE)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])

    def loss():
        tables = {d: (x @ net.p[f"W{d}"] + net.p[f"c{d}"]).reshape(-1, 3 * toxicity.HIDDEN) for d in "fb"}
        logit = net.logits(tables, np.arange(mask.size).reshape(mask.shape), mask)
        return float((w * (np.logaddexp(0, logit) - y * logit)).sum())

    grads, _ = net.step(x, mask, y, w)
    for name, grad in grads.items():
        at = (0,) * net.p[name].ndim
        old, sides = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            sides.append(loss())
        net.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - grad[at]) < 0.02 * max(1, abs(grad[at]))


def test_scores_are_the_highest_window_alone():
    net = toxicity.Network(4)
    texts = [b"one two three".split(), [b"w%d" % (i * 7 % 50) for i in range(100)], [], [b"x"]]
    scorer = toxicity.Scorer(net)
    got = scorer.scores(texts, most=40)
    for words, score in zip(texts, got, strict=True):
        each = [scorer.scores([words[a : a + toxicity.WINDOW]])[0] for a in toxicity.starts(len(words))] if words else [0.0]
        assert abs(score - max(each)) < 1e-5
    assert toxicity.starts(100)[-1] + toxicity.WINDOW >= 100


def test_toxicity_of_held_out_documents(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    known = got.merge(labels.toPandas(), on="doc_id")
    for part, least in ((known.held_out, 0.7), (~known.held_out, 0.99)):  # 37 toxic texts teach, 14 are held out
        rank, toxic = known.score[part].rank(), known.toxic[part] == 1
        assert (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum()) > least
    few = labels.limit(60)
    assert toxicity.toxicity(odd, few).count() == 11
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.where("false")).collect()} == {0.0}


def test_weak_labels_find_the_reliable_labellers():
    rng = np.random.default_rng(2)
    truth, patterns, of = rng.random(4000) < 0.2, {}, {}
    for t in truth:
        pattern = 0
        for j in range(len(quality.LABELLERS)):
            right = rng.random() < (0.95 if j % 2 else 0.7)
            pattern = 3 * pattern + (0 if rng.random() < 0.3 else 2 if t == right else 1)
        patterns[pattern] = patterns.get(pattern, 0) + 1
        of.setdefault(pattern, []).append(t)
    posterior = quality.weak_labels(patterns)
    right = sum(int((posterior[p] > 0.5) == t) for p, ts in of.items() for t in ts)
    assert right / 4000 > 0.93


def test_quality_keeps_clean_documents(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    known = labels.toPandas().assign(kept=lambda x: x.doc_id.isin([r.doc_id for r in kept.select("doc_id").collect()]))
    assert known.kept[known.quality == 1].mean() > 0.97 and known.kept[known.quality == 0].mean() < 0.2
    got = quality.quality_filter(odd)
    assert got.columns == odd.columns and {3, 4, 5} <= {r.doc_id for r in got.select("doc_id").collect()}
    assert quality.quality_filter(empty).count() == 0


def test_every_byte_of_a_long_word_is_scored():
    net = toxicity.Network(5)
    scorer = toxicity.Scorer(net)
    clean, other = "中文字".encode() * 200, "坏人坏".encode()
    for at in (0, 39, 900, 1791):
        changed = clean[:at] + other + clean[at + 9 :]
        cut = {t for w in toxicity.pieces([changed]) for t in (w.strip(b"\n")[i : i + 3] for i in range(len(w.strip(b"\n")) - 2))}
        assert cut == {changed[i : i + 3] for i in range(len(changed) - 2)}
        x, y = (net.inputs(*toxicity.hashed(toxicity.pieces([w]))) for w in (clean, changed))
        assert abs(x - y).max() > 1e-3
    assert max(map(len, toxicity.pieces([clean]))) <= toxicity.PIECE + 2
    assert toxicity.pieces([b"short", b"a" * 38]) == [b"short", b"a" * 38]
    assert len(scorer.scores([[clean]])) == 1


def test_a_short_last_piece_has_grams():
    for n in range(36, 130):
        assert (toxicity.hashed(toxicity.pieces([b"x" * n]))[2] > 1).all()


def test_hashes_of_many_words_are_those_of_each():
    words = [b"a", b"(it's)", b"...", "é".encode(), b"x" * 37, *toxicity.pieces(["中文字".encode() * 30])]
    rows, grams, many = toxicity.hashed(words)
    parts = np.split(grams, np.cumsum(many)[:-1])
    for word, row, got in zip(words[:5], rows, parts, strict=False):
        bare = word.strip(toxicity.MARKS) or word
        padded = b"^" + bare + b"$"
        want = [zlib.crc32(padded[i : i + 3]) for i in range(len(padded) - 2)] + [zlib.crc32(padded[:5])]
        assert row == zlib.crc32(bare) % toxicity.WORD_ROWS and got.tolist() == [w % toxicity.CHAR_ROWS for w in want]
    assert len(parts) == len(words) and [len(x) for x in toxicity.hashed([])] == [0, 0, 0]


def plain_score(p, text):
    """A text's score from the network's numbers, a word and a number at a time."""
    words, best = text.lower().split(), None
    size = len(p["cf"]) // 3
    for a in range(0, max(1, len(words) - 16), 16) if words else ():
        xs = []
        for word in words[a : a + 32]:
            bare = word.strip(b".,;:!?()\"'") or word
            padded = b"^" + bare + b"$"
            grams = [zlib.crc32(padded[i : i + 3]) % (1 << 12) for i in range(max(1, len(padded) - 2))] + [zlib.crc32(padded[:5]) % (1 << 12)]
            xs.append(p["word"][zlib.crc32(bare) % (1 << 15)] + sum(p["char"][g] for g in grams) / len(grams))
        states = {}
        for d, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            h = np.zeros(size)
            for t in order:
                g, r = xs[t] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                z, s = 1 / (1 + np.exp(-(g[:size] + r[:size]))), 1 / (1 + np.exp(-(g[size : 2 * size] + r[size : 2 * size])))
                n = np.tanh(g[2 * size :] + s * r[2 * size :])
                h = (1 - z) * n + z * h
                states.setdefault(t, {})[d] = h
        both = [np.concatenate([states[t]["f"], states[t]["b"]]) for t in range(len(xs))]
        weight = np.exp([np.tanh(x) @ p["v"] for x in both])
        logit = sum(w * x for w, x in zip(weight / weight.sum(), both, strict=True)) @ p["o"] + p["b"][0]
        best = logit if best is None else max(best, logit)
    return 1 / (1 + np.exp(-best)) if words else 0.0


def test_scores_against_a_plain_forward_pass():
    rng = np.random.default_rng(8)
    net = toxicity.train([b"good kind words here".split(), b"bad foul words there!".split()] * 4, [0, 1] * 4, epochs=3)
    texts = [b" ".join(rng.choice([b"good", b"Foul,", b"(words)", b"x", b"damn", b"\xc3\xa9t\xc3\xa9", b"..."], n).tolist()) for n in (0, 1, 5, 31, 32, 33, 48, 49, 100, 200)]
    got = toxicity.Scorer(net).scores([t.lower().split() for t in texts])
    assert np.allclose(got, [plain_score(net.p, t) for t in texts], atol=1e-5)


def test_every_window_teaches_or_is_looked_at(monkeypatch):
    """In the first epochs each window of a text is stepped on, later each is scored to find the highest."""
    seen = {"step": 0, "logits": 0}

    def counted(name, place):
        old = getattr(toxicity.Network, name)

        def new(self, *args):
            seen[name] += args[place].shape[1]
            return old(self, *args)

        monkeypatch.setattr(toxicity.Network, name, new)

    counted("step", 1)
    counted("logits", 1)
    texts = [[b"w%d" % (i % 60) for i in range(n)] for n in (5, 40, 2000, 3000)]
    windows = sum(len(toxicity.starts(len(t))) for t in texts)
    assert windows > 300
    toxicity.train(texts, [0, 1, 0, 1], epochs=5)
    assert seen == {"step": toxicity.WHOLE * windows + 3 * (2 + 2 * 2), "logits": 3 * windows}


def test_weak_posteriors_against_a_plain_em():
    """Document by document, and labeller by labeller, with the same starting point and counts added."""
    rng, m = np.random.default_rng(4), len(quality.LABELLERS)
    votes = rng.choice(3, (300, m), p=[0.3, 0.55, 0.15])
    p = [0.9 if 2 in v else 0.05 for v in votes]
    for _ in range(200):
        rates = {}
        for junk in (0, 1):
            for j in range(m):
                weight = [q if junk else 1 - q for q in p]
                fine, bad = (sum(w for w, v in zip(weight, votes, strict=True) if v[j] == k) + add for k, add in ((1, 1.0 if junk else 9.0), (2, 1.0)))
                rates[junk, j] = {1: fine / (fine + bad), 2: bad / (fine + bad)}
        share = min(0.5, max(1e-4, sum(p) / len(p)))
        new = []
        for v in votes:
            odds = share / (1 - share)
            for j in range(m):
                if v[j]:
                    odds *= rates[1, j][v[j]] / rates[0, j][v[j]]
            new.append(odds / (1 + odds))
        p = new
    patterns, keys = {}, [sum(int(v[j]) * 3 ** (m - 1 - j) for j in range(m)) for v in votes]
    for k in keys:
        patterns[k] = patterns.get(k, 0) + 1
    got = quality.weak_labels(patterns)
    assert np.allclose([got[k] for k in keys], p, atol=1e-4)


def plain_shares(text):
    """The labellers' shares of a text, told one by one."""
    words = text.split()
    n, odd = len(words), lambda c: not c.isalnum()
    capital = sum(len([c for c in w if c.isalpha()]) > 1 and all(c.isupper() for c in w if c.isalpha()) for w in words)
    lags = [sum(words[i] == words[i - k] for i in range(k, n)) / n for k in (1, 2, 3)]
    return [lags[0], capital / n, sum(map(odd, "".join(words))) / len("".join(words)), sum(any(odd(a) and odd(b) for a, b in zip(w, w[1:], strict=False)) for w in words) / n, sum(all(map(odd, w)) for w in words) / n, max(words.count(w) for w in set(words)) / n, sum(lags)]


def test_votes_and_scores_against_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    weights, posterior = quality.fit(docs)
    got = {r.doc_id: r for r in quality.scored(docs).collect()}
    for r in docs.collect():
        if not (r.text or "").split():
            continue
        shares, n = plain_shares(r.text), len(r.text.split())
        pattern = 0
        for (_, junk, fine, least), share in zip(quality.LABELLERS, shares, strict=True):
            pattern = pattern * 3 + (0 if n < least else 2 if share > junk else 1 if share < fine else 0)
        odds = weights[-1] + sum(weights[quality.bucket("share " + x[0])] * s for x, s in zip(quality.LABELLERS, shares, strict=True))
        odds += sum(weights[quality.Words.described(w)[0]] for w in r.text.split()) / n
        assert abs(got[r.doc_id]._weak - posterior[pattern]) < 1e-9
        assert abs(got[r.doc_id]._junk - 1 / (1 + np.exp(-odds))) < 1e-6 and got[r.doc_id]._kept == (got[r.doc_id]._junk < quality.CUT)


def test_training_steps_downhill():
    """The scorer's loss falls, and its weights tell planted features."""
    rng = np.random.default_rng(3)
    rows = [np.array([k % 2, 2 + int(rng.integers(20))]) for k in range(400)]
    labels = np.array([0.95 if k % 2 else 0.05 for k in range(400)])
    weights = quality.train(rows, [np.ones(2)] * 400, labels)
    chance = [1 / (1 + np.exp(-(weights[r].sum() + weights[-1]))) for r in rows]
    assert min(chance[1::2]) > 0.8 and max(chance[::2]) < 0.2


def test_a_long_words_whole_shape_counts():
    assert quality.Words.described("a1" * 9 + "!?")[0] != quality.Words.described("a1" * 9 + "?!")[0]
