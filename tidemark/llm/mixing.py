"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met with whole passes over the source and a remaining budget below its size.
The remaining budget is filled from the source's histogram of exact lengths: the same share of every
length's documents, rounded down; then the largest that still fit, until what is left is below a few
of the longest and below REST; then a bounded knapsack over the documents left, exactly or as near as any choice
comes. The chosen number of each length goes to the documents first in a seeded order.

Defined cases: null text has size 0; a null source is a source of its own, last in order; null ids
and repeated rows are documents like others, each taken by itself; documents of size 0 are never counted on;
texts of any length count whole; extra columns of any name or type stay in mixed(); an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, content_hash, free_names, rank_within, text_of, written

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 11
#: Words that are left for the exact part at most, while documents that fit are left.
REST = 1 << 20


def targets(sources: DataFrame, weights: tuple, share: float, most: float = MOST) -> DataFrame:
    """sources (source, words, docs) with target: shares of share * all words by weight, none above most times its words; the excess is shared again.

    Sources are a table throughout. As some reach their roof, the unit that a weight is worth only rises, so each round
    needs three sums; these come to the driver, and rounds end when no more sources reach it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    named = written(sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn)), "sources")
    words = named.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    left, unit, known = min(share * words, most * words), 0.0, -1
    full = lambda u: (F.col("words") == 0) | (F.col("weight") * u > F.col("words") * most)
    while True:
        n, held, open_ = named.agg(F.count_if(full(unit)), F.sum(F.when(full(unit), F.col("words"))), F.sum(F.when(~full(unit), F.col("weight")))).first()
        if n == known or not open_:
            break
        known, unit = n, (left - most * (held or 0)) / open_
    return named.withColumn("target", F.when(full(unit), F.col("words") * most).otherwise(F.col("weight") * unit)).drop("weight")


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size come nearest to the budget (below on ties), at most counts of each.

    Of every sum up to the budget and half the largest size, the first step that reaches it is held (a size's count is
    split into powers of two), four bytes a sum and one to tell that it is reached, however many steps there are.
    """
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0 or not len(sizes):
        return taken
    roof = budget + int(sizes.max()) // 2 + 1  # else leaving a document out comes nearer
    reached, by = np.zeros(roof + 1, bool), np.full(roof + 1, -1, np.int32)
    reached[0] = True
    steps: list[tuple[int, int]] = []  # index, copies
    for i, (size, n) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        left, power = min(n, roof // size), 1
        while left > 0:
            a = min(power, left)
            new = np.flatnonzero(reached[: roof + 1 - a * size] & ~reached[a * size :]) + a * size
            by[new] = len(steps)
            reached[new] = True
            steps.append((i, a))
            left -= a
            power *= 2
        if reached[budget]:
            break
    below = budget - int(np.argmax(reached[budget::-1]))
    above = np.flatnonzero(reached[budget:])
    goal = budget + int(above[0]) if len(above) and above[0] < budget - below else below
    while goal:
        i, a = steps[by[goal]]
        taken[i] += a
        goal -= a * int(sizes[i])
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words come to the budget."""
    taken = np.zeros(len(sizes), np.int64)
    usable = np.flatnonzero((sizes > 0) & (counts > 0))
    if budget <= 0 or not usable.size:
        return taken
    size, count = sizes[usable], counts[usable]
    total = int((size * count).sum())
    got = np.minimum(count, (count * (budget / total)).astype(np.int64))
    left = budget - int((got * size).sum())
    floor = min(4 * int(size.max()), REST)
    for i in np.argsort(-size, kind="stable"):
        if left <= floor:
            break
        more = min(int(count[i] - got[i]), max(0, left - floor) // int(size[i]))
        got[i] += more
        left -= more * int(size[i])
    got += knapsack(size, count - got, left)
    taken[usable] = got
    return taken


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, and the columns of carry, which also order ties.

    Neither documents nor lengths nor sources come to the driver; a source's lengths meet in one task.
    """
    sized = docs.withColumn("size", F.regexp_count(text_of(), F.lit(WORD)).cast("long")).withColumn("_row", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sized = written(sized.select("doc_id", "source", "size", "_row", *carry), "sizes")
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    goals = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")), weights, share, most)
    rows = goals.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    told = histogram.join(goals.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        words, target = int(group["words"].iloc[0]), float(group["target"].iloc[0])
        passes = int(target // words) if words else 0
        extra = fit(group["size"].to_numpy(), group["n"].to_numpy(), round(target - passes * words))
        return pd.DataFrame({"source": group["source"], "size": group["size"], "passes": passes, "extra": extra, "source_size": words, "target": target})

    chosen = told.select("source", "size", "n", "words", "target").groupBy("source").applyInPandas(plan, "source string, size long, passes long, extra long, source_size long, target double")
    chosen = chosen.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "passes", "extra", "source_size", "target")
    ranked = rank_within(sized, ["source", "size"], [F.col("_row"), F.col("doc_id")], rows, ties=[F.col(c) for c in carry])
    joined = ranked.join(chosen, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    taken = F.col("size") * (F.col("passes") + (F.col("rank") < F.col("extra")).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *carry)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' own columns.

    Every row has a key, written with the table before the plan is made, by which its takes come back:
    rows equal in id, source and size are taken each by itself. Among such rows a hash of all columns
    says which come first, so only rows equal in everything change places.
    """
    content, key, times, copy = free_names(docs, "content", "key", "times", "copy")
    keyed = written(docs.withColumns({content: content_hash(docs), key: F.monotonically_increasing_id()}), "keyed")
    plan = mix(keyed.select("doc_id", "source", "text", content, key), **options, carry=(content, key)).where("taken > 0")
    plan = plan.select(key, F.expr("taken div size").cast("int").alias(times))
    return keyed.join(plan, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
