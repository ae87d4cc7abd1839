"""Small states kept by key: clamped counters and saved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import free_mark


def clamped_counter(steps: DataFrame, keys: list[str], order: list[str], step: str, block: Column) -> DataFrame:
    """Adds n: the running sum of step by key that never falls below zero.

    n is the running sum less its least value so far (or 0). Both are made in blocks of a key's order
    (block rises with the order, for instance a day): a hot key's rows meet only by block, and blocks
    only as one row each.
    """
    m = free_mark(steps)
    b, run, low, total, least, base, floor = (m + x for x in ("b", "s", "low", "total", "least", "base", "floor"))
    rows = steps.withColumn(b, block)
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn(run, F.sum(step).over(inside))
    sums = sums.withColumn(low, F.min(run).over(inside))
    totals = rows.groupBy(*keys, b).agg(F.sum(step).alias(total))
    lows = sums.groupBy(*keys, b).agg(F.min(run).alias(least))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.join(lows, [*keys, b]).withColumn(base, F.coalesce(F.sum(total).over(before), F.lit(0)))
    blocks = blocks.withColumn(floor, F.coalesce(F.min(F.col(base) + F.col(least)).over(before), F.lit(0))).drop(total, least)
    joined = sums.join(blocks, [*keys, b])
    now = F.col(base) + F.col(run)
    lowest = F.least(F.lit(0), F.col(floor), F.col(base) + F.col(low))
    return joined.select(*steps.columns, (now - lowest).cast("long").alias("n"))


def totals(rows: DataFrame, counters: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows' keys with the sum of their counters, 0 if none."""
    sums = counters.groupBy(key).agg(F.sum(n).alias("total"))
    return rows.select(key).join(sums, key, "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))


def insert_absent(saved: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """saved, and of new the rows whose key it has not."""
    return saved.unionByName(new.join(saved.select(key), key, "left_anti").select(*saved.columns))


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with new's rows in place of its own of the same key."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*stored.columns))


def newest_first(added: str, tie: str) -> list[Column]:
    return [F.col(added).desc_nulls_last(), F.col(tie)]


def deleted(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the keys that are gone."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}
