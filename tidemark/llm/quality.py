"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Labellers vote junk, fine or nothing on shares of a text (repeated words, capitals, symbols, ...).
Expectation-maximisation over all documents' vote patterns estimates each labeller's accuracy and
the share of junk; the posterior of a pattern labels its documents. A logistic scorer over hashed
word-shape features is trained on those labels, weighted by their certainty, over a bounded
documented sample (about SAMPLE rows, those with the least seeded hashes; rows equal in id and text
teach once), and its score decides for every document.

Defined cases: null and empty texts get no votes, score 0 and are kept, as nothing
speaks against them; null ids and repeated rows are scored like others; texts of any length are read
whole; extra columns of any name or type stay; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import free_names, written

SAMPLE, BUCKETS, EPOCHS, CUT, SEED = 4000, 1 << 14, 12, 0.7, 17
#: (share, above: junk, below: fine, least number of words)
LABELLERS = (
    ("twin", 0.2, 0.05, 10),  # words equal to the one before
    ("capital", 0.4, 0.15, 10),  # words of two letters or more, all capital
    ("symbol", 0.12, 0.07, 5),  # characters neither letter, digit nor space
    ("marked", 0.25, 0.08, 10),  # words with two symbols side by side
    ("lone", 0.15, 0.04, 10),  # words that are symbols only
    ("top", 0.3, 0.16, 40),  # the commonest word
    ("echo", 0.4, 0.2, 20),  # words equal to the one, two or three before, added up
)


KNOWN = 200_000


class Words:
    """What a word alone decides, kept by word in a table of at most KNOWN rows that starts anew when full.

    Columns: hashed shape, all-capital, two symbols side by side, symbols only, symbols, characters.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((KNOWN, 6), np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        if len(words) > KNOWN // 4:
            return np.concatenate([self.of(words[i : i + KNOWN // 4]) for i in range(0, len(words), KNOWN // 4)])
        if len(self.rows) + len(words) > KNOWN:
            self.rows.clear()
        at = list(map(self.rows.get, words))
        if None in at:
            new, first = list({w for w, i in zip(words, at, strict=True) if i is None}), len(self.rows)
            self.table[first : first + len(new)] = list(map(self.described, new))
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
            at = list(map(self.rows.get, words))
        return self.table[at]

    @staticmethod
    def described(word: str) -> tuple[int, bool, bool, bool, int, int]:
        core = word[:-1] if word[-1] in ".," else word
        if core.isalpha() and (core.islower() or core.istitle()):  # most words by far
            shape = "x" if core.islower() else "X" if len(core) == 1 else "Xx"
            return bucket(f"{shape}{word[len(core):]}~{min(len(word), 20)}"), False, False, False, len(word) - len(core), len(word)
        kinds = [("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c for c in word]
        odd = [not c.isalnum() for c in word]
        shape = "".join(a for a, b in itertools.zip_longest(kinds, kinds[1:]) if a != b) + f"~{min(len(word), 20)}"
        alpha = [c for c in word if c.isalpha()]
        return bucket(shape), len(alpha) > 1 and all(c.isupper() for c in alpha), any(a and b for a, b in itertools.pairwise(odd)), all(odd), sum(odd), len(word)


@lru_cache(maxsize=4096)
def bucket(feature: str) -> int:
    return crc32(feature.encode("utf-8", "replace")) % BUCKETS


SHARES = [bucket("share " + x[0]) for x in LABELLERS]
WORDS = Words()


def described(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The vote pattern (base 3, a digit for each labeller: 0 none, 1 fine, 2 junk), and hashed shares."""
    words = text.split()
    if not (n := len(words)):
        return 0, np.zeros(0, np.int64), np.zeros(0)
    known = WORDS.of(words)
    capital, marked, lone, odd, letters = known[:, 1:].sum(0).tolist()
    lags = [sum(map(eq, words, words[k:])) / n for k in (1, 2, 3)]
    shares = (lags[0], capital / n, odd / letters, marked / n, lone / n, max(Counter(words).values()) / n, sum(lags))
    pattern = 0
    for (_, junk, fine, least), share in zip(LABELLERS, shares, strict=True):
        pattern = 3 * pattern + (0 if n < least else 2 if share > junk else 1 if share < fine else 0)
    at, counts = np.unique(known[:, 0], return_counts=True)
    return pattern, np.concatenate((at, SHARES)), np.concatenate((counts / n, shares))


def weak_labels(patterns: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posterior of junk for each vote pattern, by expectation-maximisation over pattern counts."""
    m = len(LABELLERS)
    keys, weight = np.array(list(patterns), np.int64), np.array(list(patterns.values()), float)
    votes = np.stack([keys // 3 ** (m - 1 - j) % 3 for j in range(m)], 1)
    cast = votes[:, :, None] == np.array([1, 2])
    voiced = cast.any(2)
    junk = np.where(cast[:, :, 1].any(1), 0.9, 0.05)  # start: junk where anyone says so
    for _ in range(rounds):
        tables = []
        for p in (1 - junk, junk):
            by = (weight * p)[:, None, None] * cast
            prior = np.array([9.0, 1.0]) if p is not junk else np.array([1.0, 1.0])
            total = by.sum(0) + prior
            tables.append(np.log(total / total.sum(1, keepdims=True)))
        share = np.clip((weight * junk).sum() / max(weight.sum(), 1e-9), 1e-4, 0.5)
        odds = np.log(share / (1 - share)) + (cast * (tables[1] - tables[0])).sum((1, 2))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        new = np.where(voiced.any(1), new, share)
        if np.abs(new - junk).max(initial=0) < 1e-9:
            break
        junk = new
    return dict(zip(keys.tolist(), junk.tolist(), strict=True))


def train(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Logistic weights (the last is the bias) by AdaGrad; labels are posteriors, weighted by certainty."""
    weights, grads = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    certain = np.abs(2 * labels - 1)
    balance = np.where(labels > 0.5, 0.5 / max((labels > 0.5).mean(), 0.02), 0.5 / max((labels <= 0.5).mean(), 0.02)) if len(labels) else certain
    order = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            idx, x = rows[i], values[i]
            p = 1 / (1 + np.exp(-np.clip(weights[idx] @ x + weights[-1], -30, 30)))
            g = (p - labels[i]) * certain[i] * balance[i]
            for at, d in ((idx, g * x + 1e-5 * weights[idx]), (BUCKETS, g)):
                grads[at] += d * d
                weights[at] -= 0.3 * d / np.sqrt(grads[at])
    return weights


def vote_patterns(docs: DataFrame) -> DataFrame:
    """doc_id, chance (a seeded hash of id and text) and pattern of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = [described(t.as_py() or "")[0] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(patterns, pa.int64())], ["doc_id", "chance", "pattern"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("chance"), "text")
    return keyed.mapInArrow(run, "doc_id long, chance long, pattern long")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[int, float]]:
    """The scorer's weights and the posterior by vote pattern."""
    votes = written(vote_patterns(docs), "votes")
    patterns = {r["pattern"]: r["n"] for r in votes.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior = weak_labels(patterns)
    total = sum(patterns.values())
    roof = int(-(2**63) + 2**64 * min(1.0, sample / max(total, 1))) - 1
    chance = F.xxhash64(F.lit(SEED), "doc_id", "text")
    picked = docs.select(chance.alias("chance"), "text").where(F.col("chance") <= F.lit(min(roof, 2**63 - 1))).dropDuplicates(["chance"])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chance, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pattern, at, x = described(text.as_py() or "")
                if len(at):
                    out.append((chance, posterior[pattern], at, x))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chance", "label", "idx", "x"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chance", kind="stable")
        weights = train(list(group["idx"]), list(group["x"]), group["label"].to_numpy())
        used = np.flatnonzero(weights)
        return pd.DataFrame({"at": used, "weight": weights[used]})

    known = picked.mapInArrow(explain, "chance long, label double, idx array<int>, x array<double>")
    weights = np.zeros(BUCKETS + 1)
    for r in known.groupBy(F.lit("all")).applyInPandas(learn, "at long, weight double").collect():
        weights[r["at"]] = r["weight"]
    return weights, posterior


def scored(docs: DataFrame, sample: int = SAMPLE, cut: float = CUT, names: tuple[str, str, str] = ("_junk", "_weak", "_kept")) -> DataFrame:
    """docs with the score (0 to 1), the weak label's posterior and whether it stays, under three names that docs doesn't have."""
    weights, posterior = fit(docs.select("doc_id", "text"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            junk, weak = [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                pattern, at, x = described(text.as_py() or "")
                odds = weights[at] @ x + weights[-1] if len(at) else -30.0
                junk.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
                weak.append(posterior.get(pattern, 0.0))
            added = [pa.array(junk, pa.float64()), pa.array(weak, pa.float64()), pa.array([j < cut for j in junk], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    kinds = StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], DoubleType()), StructField(names[2], BooleanType())])
    return docs.mapInArrow(run, kinds)


def quality_filter(docs: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The rows of docs that the scorer does not reject, with docs' own columns."""
    names = tuple(free_names(docs, "junk", "weak", "kept"))
    return scored(docs, sample, cut, names).where(F.col(names[2])).select(*docs.columns)
