"""Best-fit packing: a configuration linear program over the length histogram.

A configuration is one filling of a sequence. The covering program (as few sequences as possible,
every length covered) is solved by multiplicative weights: a length's price starts in proportion to
it, falls as its coverage runs ahead of the round's goal and rises as it lags; each round a knapsack
dynamic program prices, for every lagging length, the best configuration that holds it. Rounding
takes whole sequences of each configuration; the rest is filled best-fit, largest first, a batch of
equal fillings at a time. Only the histogram (at most one row per length) and the configurations are
on the driver; pieces get their sequence from their rank within their length.

Defined cases: null text is empty (its end id only); a document longer than the capacity is cut from
its end, so the first piece may be shorter; repeated rows are packed each; null ids are packed too;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, written
from .tokens import encoder

CAPACITY, END_ID, ROUNDS, RATE = 1024, 2, 40, 2.0

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of every piece."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer_path).ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = ids(text.as_py() or "") + end
                n = len(coded) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = coded[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(columns, kinds, strict=True))[: 5 + with_ids]], names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + ", ids binary" * with_ids)


def price(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each room 0..capacity, and the length put in last (0: none)."""
    capacity = len(values) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        filled = best[:room][::-1] + values[1 : room + 1]
        k = int(filled.argmax())
        if filled[k] > best[room - 1]:
            best[room], last[room] = filled[k], k + 1
        else:
            best[room], last[room] = best[room - 1], 0
    return best, last


def _filling(last: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while room > 0:
        if length := int(last[room]):
            out[length] = out.get(length, 0) + 1
        room -= length or 1
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[dict[int, int], int]]:
    """Configurations and their multiplicities, which together hold every piece exactly once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    present = np.flatnonzero(counts)
    chosen: dict[tuple, float] = {}
    covered = np.zeros(capacity + 1)
    for k in range(1, rounds + 1):
        goal = k / rounds
        share = np.divide(covered, counts, out=np.ones(capacity + 1), where=counts > 0)
        values = np.where((counts > 0) & (share < 1), np.arange(capacity + 1) * np.exp(-rate * np.clip(share - goal, -1, 1)), 0)
        _, last = price(values)
        for length in present[::-1]:
            if (lack := goal * counts[length] - covered[length]) <= 0:
                continue
            config = _filling(last, capacity - int(length))
            config[int(length)] = config.get(int(length), 0) + 1
            times = lack / config[int(length)]
            key = tuple(sorted(config.items(), reverse=True))
            chosen[key] = chosen.get(key, 0) + times
            for x, a in config.items():
                covered[x] += a * times
    left, plan = counts.copy(), []
    for key, times in sorted(chosen.items(), key=lambda x: (-sum(a * b for a, b in x[0]), x[0])):
        whole = min(int(times), *(int(left[x]) // a for x, a in key))
        if whole > 0:
            plan.append((dict(key), whole))
            for x, a in key:
                left[x] -= a * whole
    while (rest := np.flatnonzero(left)).size:
        room, config = capacity, {}
        free = left.copy()
        while room and (fits := np.flatnonzero(free[: room + 1])).size:
            x = int(fits[-1])
            a = min(int(free[x]), room // x)
            config[x], free[x], room = a, 0, room - a * x
        whole = min(int(left[x]) // a for x, a in config.items())
        plan.append((config, whole))
        for x, a in config.items():
            left[x] -= a * whole
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ... with 1 <= length <= capacity) with sequence_id and offset.

    pieces is read more than once: pass a table or a written result.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, base, before = [], 0, dict.fromkeys(histogram, 0)
    for config, times in solve(histogram, capacity):
        at = 0
        for length, a in sorted(config.items(), reverse=True):
            slots.append((length, before[length], a, base, at))
            before[length] += a * times
            at += a * length
        base += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0].astype(np.float64) * span + table[:, 1]
        assert keys.max(initial=0) < 2**53
        for batch in batches:
            at = batch.schema.get_field_index
            length, rank = batch.column(at("length")).to_numpy(), batch.column(at("rank")).to_numpy()
            slot = table[np.searchsorted(keys, length.astype(np.float64) * span + np.minimum(rank, span - 1), "right") - 1] if len(rank) else table[:0]
            nth = rank - slot[:, 1]
            done = [pa.array(slot[:, 3] + nth // np.maximum(slot[:, 2], 1)), pa.array(slot[:, 4] + nth % np.maximum(slot[:, 2], 1) * length)]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + done, [batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    ranked = rank_within(pieces, ["length"], [F.col("doc_id"), F.col("piece")], sum(histogram.values()))
    ranked = ranked.select(*pieces.columns, "rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)
