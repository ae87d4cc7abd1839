"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own hashed embedding plus the mean of its character trigrams' embeddings, so a
form not met in training still resembles its kin. A word of more than PIECE bytes (unspaced scripts,
long runs) enters as several words of at most PIECE bytes, neighbours sharing LAP, so that each of
its trigrams is read. Texts are scored in windows of WINDOW words, each
begun STRIDE words after the last; a text's score is its highest window's. Training takes at most
SAMPLE labelled rows (the least seeded hashes, half of them toxic where there are so many), never
held-out ones: in the first WHOLE epochs every window under its text's label, then only each text's
highest of all its windows (and, of texts not toxic, one more drawn by chance). Labels reach nothing but training. Held out are rows whose crc32(doc_id as text) mod 4 is 2.

Defined cases: null and empty texts score 0; a null id hashes as the empty text and has no label;
rows repeated in docs are each scored; texts of any length are scored whole; of several labels for an id any toxic one counts; without
labels every text scores the untrained model's 0.0; extra columns play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_words

WINDOW, STRIDE, SIZE, HIDDEN = 32, 16, 12, 8
PIECE, LAP = 38, 12
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 12
RARE, DROPPED, DECAY, PRIOR = 3, 0.1, 1e-4, 0.3
MARKS = b".,;:!?()\"'"
SAMPLE, EPOCHS, FEW, CUT, SEED, KNOWN = 2400, 10, 24_000, 0.3, 23, 200_000
WHOLE = 2  # epochs in which every window of a text teaches
CRC = np.zeros(256, np.uint32)
CRC[np.arange(256) ^ 0xFF] = [crc32(bytes([b])) ^ 0xFF000000 for b in range(256)]  # what a byte does to crc32


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def pieces(words: list[bytes]) -> list[bytes]:
    """The words, long ones cut into overlapping pieces; a line feed, which no word holds, marks a side where a word goes on."""
    if not words or max(map(len, words)) <= PIECE:
        return words
    out = []
    for word in words:
        if len(word) > PIECE:
            word = word.strip(MARKS) or word
        at = 0
        while at + PIECE < len(word):
            out.append((b"\n" if at else b"") + word[at : at + PIECE] + b"\n")
            at += PIECE - LAP
        out.append(b"\n" + word[at:] if at else word)
    return out


def crc32s(data: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """crc32 of data[at : at + size] for each place, many at once; sizes are small."""
    crc, size = np.full(len(at), 0xFFFFFFFF, np.uint32), np.broadcast_to(size, len(at))
    for i in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > i)
        crc[on] = CRC[(crc[on] ^ data[at[on] + i]) & 0xFF] ^ (crc[on] >> 8)
    return ~crc


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: their rows; the rows of their trigrams and first letters (bytes of UTF-8), ends marked, word by word; how many of these each has. Punctuation around a word is left off."""
    bare, padded = [], []
    for word in words:
        if b"\n" in word:  # a piece
            padded.append((word[1:] if word[:1] == b"\n" else b"^" + word).removesuffix(b"\n") + (b"" if word[-1:] == b"\n" else b"$"))
        else:
            word = word.strip(MARKS) or word
            padded.append(b"^" + word + b"$")
        bare.append(word)
    data, sizes = np.frombuffer(b"".join(padded), np.uint8), np.fromiter(map(len, padded), np.int64, len(padded))
    first, many = np.cumsum(sizes) - sizes, np.maximum(1, sizes - 2) + 1  # the last of a word's is its first letters
    last = np.cumsum(many) - 1
    at = np.arange(many.sum()) - np.repeat(last + 1 - many - first, many)
    length = np.minimum(3, np.repeat(sizes, many))
    at[last], length[last] = first, np.minimum(5, sizes)
    return np.fromiter(map(crc32, bare), np.int64, len(bare)) % WORD_ROWS, (crc32s(data, at, length) % CHAR_ROWS).astype(np.int64), many


def starts(n: int) -> range:
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; forward() on word inputs, backward() for their gradients."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        near = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": np.zeros((WORD_ROWS, SIZE), np.float32), "char": near(CHAR_ROWS, SIZE) * 0.3, "v": near(2 * HIDDEN), "o": near(2 * HIDDEN), "b": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": near(SIZE, 3 * HIDDEN), f"U{d}": near(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, rows: np.ndarray, grams: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Of words as hashed() gives them."""
        if not len(rows):
            return np.zeros((0, SIZE), np.float32)
        return self.p["word"][rows] + np.add.reduceat(self.p["char"][grams], np.cumsum(many) - many) / many[:, None].astype(np.float32)

    def run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, windows, HIDDEN) of one direction; gates: inputs times W plus c."""
        h, out, u = np.zeros((gates.shape[1], HIDDEN), np.float32), np.empty((*gates.shape[:2], HIDDEN), np.float32), self.p[f"U{d}"]
        full = mask.all(1)
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            r = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, s = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + s * r[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not full[t]:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, s, n, r[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        energy = np.where(mask, np.tanh(states) @ self.p["v"], -1e9)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        mean = (weight[:, :, None] * states).sum(0)
        return weight, mean, mean @ self.p["o"] + self.p["b"][0]

    def logits(self, tables: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows given as rows (time, windows) of tables of gates. Windows lie along the last axis, so that numpy's inner loops are long."""
        time, n = ids.shape
        states, full = np.empty((time, 2 * HIDDEN, n), np.float32), mask.all(1)
        for k, d in enumerate("fb"):
            u, h = np.ascontiguousarray(self.p[f"U{d}"].T), np.zeros((HIDDEN, n), np.float32)
            for t in range(time) if d == "f" else range(time - 1, -1, -1):
                gate, r = np.ascontiguousarray(tables[d][ids[t]].T), u @ h
                zs = _sigmoid(gate[: 2 * HIDDEN] + r[: 2 * HIDDEN])
                new = np.tanh(gate[2 * HIDDEN :] + zs[HIDDEN:] * r[2 * HIDDEN :])
                new += zs[:HIDDEN] * (h - new)
                h = new if full[t] else np.where(mask[t], new, h)
                states[t, k * HIDDEN : (k + 1) * HIDDEN] = h
        energy = np.where(mask, self.p["v"] @ np.tanh(states), np.float32(-1e9))
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        return self.p["o"] @ (weight[:, None] * states).sum(0) + self.p["b"][0]

    def step(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted cross-entropy: by parameter, and of x (time, windows, SIZE)."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(x @ self.p[f"W{d}"] + self.p[f"c{d}"], mask, d, kept[d]) for d in "fb"], 2)
        weight, mean, logit = self.pooled(states, mask)
        g = ((_sigmoid(logit) - labels) * weights).astype(np.float32)
        grads = {"b": np.array([g.sum()]), "o": g @ mean}
        d_mean = g[:, None] * self.p["o"]
        d_weight = (states * d_mean).sum(2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0))
        squashed = np.tanh(states)
        grads["v"] = np.einsum("tw,twh->h", d_energy, squashed)
        d_states = weight[:, :, None] * d_mean + d_energy[:, :, None] * self.p["v"] * (1 - squashed**2)
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            w, u, carry = self.p[f"W{d}"], self.p[f"U{d}"], np.zeros((x.shape[1], HIDDEN), np.float32)
            d_w, d_u, d_c = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32)
            for t, h, z, s, n, r in reversed(kept[d]):
                d_new = carry + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                on = mask[t][:, None]
                d_n = np.where(on, d_new * (1 - z) * (1 - n**2), 0)
                d_z = np.where(on, d_new * (h - n) * z * (1 - z), 0)
                d_s = d_n * r * s * (1 - s)
                d_gate, d_rec = np.concatenate((d_z, d_s, d_n), 1), np.concatenate((d_z, d_s, d_n * s), 1)
                d_w += x[t].T @ d_gate
                d_c += d_gate.sum(0)
                d_u += h.T @ d_rec
                d_x[t] += d_gate @ w.T
                carry = np.where(on, d_new * z, d_new) + d_rec @ u.T
            grads |= {f"W{d}": d_w, f"U{d}": d_u, f"c{d}": d_c}
        return grads, d_x


def train(texts: list[list[bytes]], labels: list[int], epochs: int | None = None, seed: int = SEED) -> Network:
    """AdaGrad over windows; toxic texts weigh PRIOR in all. There are EPOCHS, and more where texts are few, as fewer steps are made in each: FEW texts are gone over in all, but no text over 24 times.

    A word's own embedding is learnt if RARE texts or more hold it, else it stays zero and its
    trigrams speak for it. Words are dropped from a window by chance, so that no single one explains it.
    """
    net, rng, sums = Network(seed), np.random.default_rng(seed), {}
    texts = list(map(pieces, texts))
    vocabulary: dict[bytes, int] = {}
    epochs = epochs or min(24, max(EPOCHS, FEW // max(1, len(texts))))
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t], np.int64) for t in texts]
    words = hashed(list(vocabulary))
    ends = np.cumsum(words[2])
    common = np.bincount(np.concatenate([np.unique(c) for c in coded] or [[]]).astype(np.int64), minlength=len(ends)) >= RARE
    y = np.array(labels, np.float32)
    balance = np.where(y == 1, PRIOR / max(y.mean(), 0.02), (1 - PRIOR) / max(1 - y.mean(), 0.02)) if len(y) else y

    def apply(name: str, grad: np.ndarray, rows: np.ndarray | None = None, rate: float = 0.1) -> None:
        total = sums.setdefault(name, np.full_like(net.p[name], 1e-4))
        at = slice(None) if rows is None else rows
        total[at] += grad**2
        net.p[name][at] -= rate * grad / np.sqrt(total[at])

    def some(used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hashed words, those of these numbers."""
        many = words[2][used]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - ends[used], many)
        return words[0][used], words[1][at], many

    def laid(picked: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = np.zeros((WINDOW, len(picked)), np.int64), np.zeros((WINDOW, len(picked)), bool)
        for j, (i, a) in enumerate(picked):
            part = coded[i][a : a + WINDOW]
            ids[: len(part), j], mask[: len(part), j] = part, True
        return ids, mask

    def highest() -> list[int]:
        """Each text's highest window of all, some 4,000 windows at a time."""
        x = net.inputs(*words)
        gates = {d: x @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}
        best, top, held = np.full(len(coded), -np.inf), [0] * len(coded), []

        def score() -> None:
            ids, mask = laid(held)
            for (i, a), logit in zip(held, net.logits(gates, ids, mask).tolist(), strict=True):
                if logit > best[i]:
                    best[i], top[i] = logit, a
            held.clear()

        for i, code in enumerate(coded):
            for a in starts(len(code)):
                held.append((i, a))
                if len(held) >= 4000:
                    score()
        if held:
            score()
        return top

    for epoch in range(epochs):
        order = rng.permutation(len(coded)).tolist()
        if epoch < WHOLE:
            picked = [[(i, a) for a in starts(len(coded[i]))] for i in order]
        else:
            top = highest()
            drawn = [int(rng.integers(len(starts(len(coded[i]))))) for i in order]
            picked = [[(i, top[i])] if y[i] else [(i, top[i]), (i, starts(len(coded[i]))[k])] for i, k in zip(order, drawn, strict=True)]
        flat = [w for ws in picked for w in ws]
        share = np.array([1 / len(ws) for ws in picked for _ in ws], np.float32)
        for k in range(0, len(flat), 128):
            ids, mask = laid(flat[k : k + 128])
            mine = np.array([i for i, _ in flat[k : k + 128]])
            used, place = np.unique(ids, return_inverse=True)
            seen = (mask & (rng.random(ids.shape) >= DROPPED))[:, :, None]
            now = some(used)
            x = net.inputs(*now)[place.reshape(ids.shape)] * seen
            weights = balance[mine] * (share[k : k + 128] if epoch >= WHOLE else np.minimum(0.2, 2.4 * share[k : k + 128]))
            grads, d_x = net.step(x, mask, y[mine], weights)
            for name, grad in grads.items():
                apply(name, grad)
            d_word = np.zeros((len(used), SIZE), np.float32)
            np.add.at(d_word, place.ravel(), (d_x * seen).reshape(-1, SIZE))
            rows, at = np.unique(now[0][common[used]], return_inverse=True)
            if len(rows):
                total = DECAY * net.p["word"][rows]
                np.add.at(total, at, d_word[common[used]])
                apply("word", total, rows)
            rows, at = np.unique(now[1], return_inverse=True)
            total = DECAY * net.p["char"][rows]
            np.add.at(total, at, np.repeat(d_word / now[2][:, None], now[2], axis=0))
            apply("char", total, rows)
    return net


class Scorer:
    """Scores texts; a known word's gate inputs are kept in a table of KNOWN rows that starts anew when full."""

    def __init__(self, net: Network) -> None:
        self.net, self.rows = net, {}
        self.gates = {d: np.zeros((KNOWN, 3 * HIDDEN), np.float32) for d in "fb"}

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.rows))
        if new:
            first = len(self.rows)
            x = self.net.inputs(*hashed(new))
            for d in "fb":
                self.gates[d][first : first + len(new)] = x @ self.net.p[f"W{d}"] + self.net.p[f"c{d}"]
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))

    def scores(self, texts: list[list[bytes]], most: int = 16_384) -> np.ndarray:
        """Each text's highest window; a stretch of a text holds about `most` words, whole strides, and those that its last windows share with the next one."""
        most = max(1, most // STRIDE) * STRIDE
        best, held, of, size = np.full(len(texts), -np.inf), [], [], 0

        def flush() -> None:
            nonlocal held, of, size
            if held:
                flat = [w for ws in held for w in ws]
                if len(self.rows) + len(flat) > KNOWN:
                    self.rows.clear()
                rows, sizes = self.rows_of(flat), np.array(list(map(len, held)))
                windows = np.array([len(starts(n)) for n in sizes.tolist()])
                stretch = np.repeat(np.arange(len(held)), windows)
                ends, firsts = np.cumsum(sizes), np.cumsum(windows) - windows
                begin = (ends - sizes)[stretch] + STRIDE * (np.arange(len(stretch)) - firsts[stretch])
                places = begin + np.arange(WINDOW)[:, None]
                mask = places < ends[stretch]
                logits = self.net.logits(self.gates, rows[np.where(mask, places, begin)], mask)
                np.maximum.at(best, np.array(of)[stretch], logits)
            held, of, size = [], [], 0

        for i, words in enumerate(map(pieces, texts)):
            for a in range(0, max(1, len(words) - WINDOW + STRIDE), most) if words else ():
                held.append(words[a : a + most + WINDOW - STRIDE])
                of.append(i)
                size += len(held[-1])
                if size >= most:
                    flush()
        flush()
        return np.where(np.isfinite(best), _sigmoid(best), 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train in one task on at most about `sample` rows; their texts never pass through the driver."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    keyed = known.where("doc_id is not null").where(~held_out()).withColumn("chance", F.xxhash64(F.lit(SEED), "doc_id"))
    sizes = {r["toxic"]: r["n"] for r in keyed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    few = min(sizes[1], sample // 2)
    roof = {k: int(-(2**63) + 2**64 * min(1.0, n / sizes[k])) - 1 for k, n in ((1, few), (0, sample - few))}
    roof = {k: min(max(v, -(2**63)), 2**63 - 1) for k, v in roof.items()}
    picked = keyed.where(F.col("chance") <= F.when(F.col("toxic") == 1, F.lit(roof[1])).otherwise(F.lit(roof[0])))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["chance", "text"], kind="stable").drop_duplicates("chance")
        net = train([byte_words(t) for t in group["text"]], group["toxic"].tolist())
        return pd.DataFrame({"model": [pickle.dumps(net.p)]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(picked), "doc_id")  # picked: `sample` rows, more or less
    got = rows.select("text", "toxic", "chance").groupBy(F.lit("all")).applyInPandas(learn, "model binary").collect()
    if not got:
        return None
    net = Network()
    net.p = pickle.loads(got[0]["model"])
    return net


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    net = fit(docs, labels, sample)
    params = docs.sparkSession.sparkContext.broadcast(net.p if net else None)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if params.value is not None:
            own = Network()
            own.p = params.value
            scorer = Scorer(own)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                score = scorer.scores([byte_words(t.as_py()) for t in part.column(1)]) if scorer else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
