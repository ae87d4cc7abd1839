"""Attempt lockout: each attempt moves a key's state; the moves of blocks of attempts are composed, then applied.

A key's state before an attempt is its failures so far, or locked until a time. Attempts lie sorted by key and time
over ranges, cut to blocks of at most BLOCK rows. A block's map says, for each number of failures on entry, the
state on exit; and as a lock that has run out counts as no failures, an entry that is locked until u is the entry without
failures at the block's first attempt from u on, so the map also has the exits from every such place (a lock from before the block ends within its first
lock_s seconds), equal neighbours as one. One row for each block then gives all entry states of a key, and each block is told by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import written

BLOCK = 20_000
#: A state: failures so far, and the time until which the key is locked (null: it is not).
STATE = "failures int, until double"
MAP = f"key string, block long, fresh array<struct<{STATE}>>, froms array<double>, exits array<struct<{STATE}>>"


def step(state: tuple[int, float | None], at: float, success: bool, most: int, lock_s: float) -> tuple[tuple[int, float | None], str]:
    """One attempt: the next state, and what became of the attempt."""
    failures, until = state
    if until is not None and at < until:
        return state, "ignored"
    if success:
        return (0, None), "success"
    if failures + 1 >= most:
        return (0, at + lock_s), "locked"
    return (failures + 1, None), "failed"


def block_map(at: np.ndarray, ok: np.ndarray, most: int, lock_s: float) -> tuple[list, list, list]:
    """Exits by failures on entry; and for entries locked until u, the times up to which u leads to which exit.

    Read from the end: the exit from an attempt is the exit from the next, or, where it locks, from the first one after the lock.
    """
    n = len(at)
    after = np.maximum(np.searchsorted(at, at + lock_s), np.arange(n) + 1)  # the first attempt that isn't ignored
    last = [(f, None) for f in range(most)]  # exits from behind the block's end
    fresh: list = [None] * (n + 1)  # exits without failures, by place
    fresh[n], rows = last[0], last
    for i in range(n - 1, -1, -1):
        if ok[i]:
            rows = [rows[0]] * most
        else:
            locked = fresh[after[i]] if after[i] < n else (0, float(at[i] + lock_s))
            rows = [*rows[1:], locked]
        fresh[i] = rows[0]
    froms, exits = [], []
    for i in range(min(n, int(np.searchsorted(at, at[0] + lock_s)) + 1)):  # locked until u, which is at most at[0] + lock_s: enters at the first attempt from u on
        if exits and exits[-1] == fresh[i]:
            froms[-1] = float(at[i])
        else:
            froms.append(float(at[i]))
            exits.append(fresh[i])
    return rows, froms, exits


def moved(state: tuple[int, float | None], fresh: list, froms: list, exits: list) -> tuple[int, float | None]:
    """The state on exit of a block, by its map."""
    failures, until = state
    if until is None:
        return fresh[failures]
    at = int(np.searchsorted(froms, until))
    return exits[at] if at < len(froms) else state


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, a table each."""
    last, parts = None, []
    for batch in batches:
        told = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        starts = [i for i in range(len(told)) if not i or told[i] != told[i - 1]]
        for i, j in zip(starts, [*starts[1:], len(told)], strict=True):
            if parts and told[i] != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = told[i]
            parts.append(batch.slice(i, j - i))
    if parts:
        yield pa.Table.from_batches(parts)


def _cut(rows: DataFrame, block: int) -> DataFrame:
    """rows sorted over ranges of key and time, with block: numbers that rise in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = first + (seen + np.arange(batch.num_rows)) // block
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "block"])

    ordered = rows.repartitionByRange("key", "at", "tie").sortWithinPartitions("key", "at", "tie")
    return ordered.mapInArrow(run, "key string, at double, tie long, success boolean, block long")


def lockout(attempts: DataFrame, key: str, at: str, tie: str, success: str, most: int = 5, lock_s: float = 60.0, block: int = BLOCK) -> DataFrame:
    """key, tie, result (success, failed, locked, ignored) of every attempt, in the order of at (seconds) and tie.

    Equal keys, times and ties are told in any order of theirs. Null keys are one key; a null success is a failure;
    an attempt without a time comes before all others. No task holds more than a block's rows, or the maps of one key's blocks one by one.
    """
    rows = attempts.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(at).cast("double"), F.lit(float("-inf"))).alias("at"), F.col(tie).cast("long").alias("tie"), F.coalesce(F.col(success), F.lit(False)).alias("success"))
    rows = written(_cut(rows, block), "attempts")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ["key", "block"]):
            fresh, froms, exits = block_map(part["at"].to_numpy(), part["success"].to_numpy(), most, lock_s)
            told = [dict(zip(("failures", "until"), s, strict=True)) for s in fresh], froms, [dict(zip(("failures", "until"), s, strict=True)) for s in exits]
            kind = pa.list_(pa.struct([("failures", pa.int32()), ("until", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array([part["key"][0].as_py()], pa.string()), pa.array([part["block"][0].as_py()], pa.int64()), *(pa.array([x], t) for x, t in zip(told, (kind, pa.list_(pa.float64()), kind), strict=True))], ["key", "block", "fresh", "froms", "exits"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), (0, None)
        for batch in batches:
            found = []
            for own, fresh, froms, exits in zip(*(batch.column(c).to_pylist() for c in ("key", "fresh", "froms", "exits")), strict=True):
                if own != last:
                    last, state = own, (0, None)
                found.append(state)
                pairs = lambda states: [(s["failures"], s["until"]) for s in states]
                state = moved(state, pairs(fresh), froms, pairs(exits))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array([s[0] for s in found], pa.int32()), pa.array([s[1] for s in found], pa.float64())], ["key", "block", "failures", "until"])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), (0, None)
        for batch in batches:
            found = []
            for own, number, t, ok, failures, until in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "at", "success", "failures", "until")), strict=True):
                if (own, number) != last:
                    last, state = (own, number), (failures, until)
                state, result = step(state, t, ok, most, lock_s)
                found.append(result)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tie"), pa.array(found, pa.string())], ["key", "tie", "result"])

    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "at", "tie")
    by_block = written(dealt.mapInArrow(maps, MAP).repartition("key").sortWithinPartitions("key", "block").mapInArrow(entries, f"key string, block long, {STATE}"), "entries")
    entry = by_block.withColumnsRenamed({"key": "_key", "block": "_block"})
    met = rows.join(entry, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))).drop("_key", "_block")
    return met.repartition("key", "block").sortWithinPartitions("key", "block", "at", "tie").mapInArrow(results, "key string, tie long, result string")
