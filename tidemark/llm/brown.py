"""LM scoring: class-based bigrams whose word classes come from exchange clustering.

Words are what white space leaves, A-Z lower-cased; every document ends with one end token, which is
also what its first word follows. The vocabulary and its counts cover all training documents and are
a table. Texts are cut into words twice: for the vocabulary, and for the table of codes that all
later steps read: chunks of texts, in which the HEAD commonest words (and the end) are numbers and others
places in the chunk's list of words. Those others are dealt to buckets by their hash, about BUCKET occurrences each.

Every training word gets its class by exchange, that is, by moving to the class that raises the
class bigrams' log-likelihood most, until a round gains less than GAIN for each training token:

1. the CORE commonest words, one after another, in one task (at most CORE * CORE pair counts);
2. the head: each word first joins the class that fits its neighbours in the core; then in each round every
   word says whether it would move, and those that would do so one after another, in one task. Pair counts are
   a table dealt by word, which no round shuffles;
3. every other word by its neighbours' classes, all against the classes as the round found them. A bucket's words, their head
   neighbours and their links to words of other buckets are one row; a round sends classes along the links, from bucket to bucket.

A round that does not raise the likelihood is taken back, and half as many words move in the next.

P(word | before) = (1 - u) (1 - MIX) P(class | class before) count / class count + MIX (count + 1) / (N + V + 1)
for a word with a count, and u = 1 / (N + V + 1) for any other: together they make 1. The head's words, their
classes and class pairs are bounded by parameters and go to every task. A word without a class (not in
training) is followed by each class as often as the whole text holds it. Defined cases: null text is empty
(its end token only); a null id hashes as the empty text; repeated rows count and score each; texts of any
length are read whole; extra columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_words, dropped, released, written

CLASSES, HEAD, CORE, MIX = 64, 30_000, 2_048, 0.05
GAIN = 5e-3
MOST = 8  # changes of a count by up to so many are looked up
END = b"\n"  # no word holds white space
CHUNK, BUCKET = 600_000, 400_000  # about so many words in a chunk; occurrences outside the head in a bucket
CODED = "chunk long, ids array<long>, held array<boolean>, sizes binary, codes binary, words binary, dealt binary"
_CODED = [x.split()[0] for x in CODED.split(", ")]


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def vocabulary(training: DataFrame) -> DataFrame:
    """word (UTF-8) and n over all training texts and their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(byte_words(text.as_py()))
                counts[END] += 1
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


class _Places(dict):
    """A head word's place; other words get -1, -2 and so on as they come."""

    def __init__(self, head: list[bytes]) -> None:
        super().__init__(zip(head, count()))
        self.heads = len(head)

    def __missing__(self, word: bytes) -> int:
        self[word] = code = self.heads - len(self) - 1
        return code


def coded(rows: DataFrame, head: list[bytes], buckets: int = 8) -> DataFrame:
    """A row for each chunk of texts: ids and held (of its documents), sizes (their numbers of codes), codes (32-bit numbers: a head
    word's place, -1 - i for the chunk's other word i; a text's last is the end), words (the other words, each once, joined by
    ends) and dealt (how many of them each bucket has; they stand by bucket, which is their hash's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, places, parts, held = TaskContext.get().partitionId() << 33, _Places(head), [], 0

        def out() -> pa.RecordBatch:
            ids, out_of, codes = zip(*parts, strict=True)
            words = list(places)[len(head) :]
            bucket = (hashes(words) >> np.uint64(20)) % np.uint64(buckets)
            order, flat = np.argsort(bucket, kind="stable"), np.concatenate(codes)
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words))
            flat[flat < 0] = -1 - rank[-1 - flat[flat < 0]]
            dealt = np.bincount(bucket.astype(np.int64), minlength=buckets)
            blobs = [np.array([len(x) for x in codes], "<i4").tobytes(), flat.tobytes(), END.join([words[i] for i in order.tolist()]), dealt.astype("<i4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([out_of], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in blobs)], _CODED)

        for batch in batches:
            for text, doc_id, out_of in zip(batch.column(1), batch.column(0), batch.column(2), strict=True):
                words = byte_words(text.as_py())
                words.append(END)
                parts.append((doc_id.as_py(), out_of.as_py(), np.fromiter(map(places.__getitem__, words), np.int32, len(words))))
                held += len(words)
                if held > CHUNK:
                    yield out()
                    chunk, places, parts, held = chunk + 1, _Places(head), [], 0
        if parts:
            yield out()

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, CODED)


def _array(column: pa.Array, i: int, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def _joined(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """A chunk's codes in training, after one end (0)."""
    learnt = ~batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
    flat = _array(batch.column("codes"), i)[np.repeat(learnt, _array(batch.column("sizes"), i))]
    return np.concatenate((np.zeros(1, np.int32), flat))


def head_pairs(codes: DataFrame, size: int) -> DataFrame:
    """(a, b, n): how often head word b follows head word a. Every text ends as the one before it does, so a chunk is one chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                chain = _joined(batch, i).astype(np.int64)
                keys.append((chain[:-1] * size + chain[1:])[(chain[:-1] >= 0) & (chain[1:] >= 0)])
                held += len(keys[-1])
                if held > 4_000_000:
                    yield out()
                    keys, held = [], 0
        yield out()

    pairs = codes.select("held", "sizes", "codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.selectExpr(f"pair div {size} AS a", f"pair % {size} AS b", "n")


def neighbours(pairs: DataFrame) -> DataFrame:
    """u, cells (32-bit numbers: 2 * v + 1 for unit v after u, 2 * v before) and counts (64-bit) of every unit: at most two cells for each unit."""
    both = pairs.select("a", "b", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    before = F.col("side") == 0
    cell = 2 * F.when(before, F.col("a")).otherwise(F.col("b")) + F.col("side")
    dealt = both.select(F.when(before, F.col("b")).otherwise(F.col("a")).alias("u"), cell.cast("int").alias("cell"), "n").repartition("u").sortWithinPartitions("u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []

        def out(units: list, lists: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), *(pa.array([x[i].tobytes() for x in lists], pa.binary()) for i in (0, 1))], ["u", "cells", "counts"])

        for batch in batches:
            u, cell, n = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.diff(u, prepend=u[0] - 1)) if len(u) else []
            units, lists = [], []
            for i, j in zip(starts, [*starts[1:], len(u)], strict=True):
                if held is not None and u[i] != held:
                    units.append(held)
                    lists.append([np.concatenate(x) for x in zip(*parts, strict=True)])
                    parts = []
                held = u[i]
                parts.append((cell[i:j], n[i:j]))
            yield out(units, lists)
        if held is not None:
            yield out([held], [[np.concatenate(x) for x in zip(*parts, strict=True)]])

    return dealt.mapInArrow(run, "u long, cells binary, counts binary")


def _flat(cells: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of cells and counts in binary: each one's list, cell and count."""
    sizes = pc.binary_length(cells).to_numpy(zero_copy_only=False) // 4
    cell, n = (np.frombuffer(b"".join(x.to_pylist()), kind) for x, kind in ((cells, "<i4"), (counts, "<i8")))
    return np.repeat(np.arange(len(cells)), sizes), cell.astype(np.int64), n


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(matrix: np.ndarray) -> float:
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def gains(matrix: np.ndarray, own: np.ndarray, counts: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Change of the class bigrams' log-likelihood for each unit (a row) and class that it, taken out, could be put in.

    counts: by unit, side (0 before, 1 after) and class of its neighbours, pairs with itself (twice) included
    in its own class. A column's common part is left out.
    """
    at, before, after = np.arange(len(own)), counts[:, 0], counts[:, 1]
    x, y, t = before.copy(), after.copy(), twice[:, None]
    x[at, own] -= twice
    y[at, own] -= twice
    diagonal, to, from_ = np.tile(np.diag(matrix), (len(own), 1)), matrix.sum(0) - after, matrix.sum(1) - before
    diagonal[at, own] += twice - before[at, own] - after[at, own]
    to[at, own] += twice - before.sum(1)
    from_[at, own] += twice - after.sum(1)
    to, from_ = np.maximum(to + y, 0), np.maximum(from_ + x, 0)  # wherever the unit goes, its neighbours' classes regain its counts
    diagonal = np.maximum(diagonal, 0)
    put = np.zeros(before.shape)
    for mine, other, m, w in ((before, after, matrix, x), (after, before, matrix.T, y)):
        near = np.argsort(-w, axis=1, kind="stable")[:, : int((w > 0).sum(1).max(initial=0))]  # a rare unit has few neighbouring classes
        rows, n = m[near], np.take_along_axis(w, near, 1)[:, :, None]
        rows[at, :, own] -= np.take_along_axis(mine, near, 1)
        i, j = np.nonzero(near == own[:, None])
        rows[i, j] -= other[i]
        rows[i, j, own[i]] += twice[i]
        rows = np.maximum(rows, 0)  # below only in a sweep, whose counts are as of its start
        put += (_xlogx(rows + n) - _xlogx(rows)).sum(1)
    corner = _xlogx(diagonal + x + y + t) + _xlogx(diagonal) - _xlogx(diagonal + x) - _xlogx(diagonal + y)
    return put + corner - _xlogx(to + x.sum(1, keepdims=True) + t) + _xlogx(to) - _xlogx(from_ + y.sum(1, keepdims=True) + t) + _xlogx(from_)


class Moves:
    """The best class of many units, classes staying as they are in matrix.

    Taking a unit out of its class changes that class's column and row only. All other cells add up changes that
    are looked up; cells of that row, which a unit with neighbours in its own class meets, are mended one by one.
    """

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix, self.k = matrix, len(matrix)
        self.sums = (matrix.sum(0), matrix.sum(1))  # to, from
        self.sides = np.stack([matrix, matrix.T])  # by side, a neighbour's class and the unit's
        self.f = _xlogx(self.sides)
        steps = np.arange(MOST + 1)[:, None, None, None]
        self.table = (_xlogx(self.sides + steps) - self.f).reshape(-1, self.k)

    def _changes(self, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
        few = np.minimum(n, MOST).astype(np.int64)
        out = self.table[few * 2 * self.k + cell]
        many = np.flatnonzero(n > MOST)
        if len(many):
            rows = self.sides.reshape(-1, self.k)[cell[many]]
            out[many] = _xlogx(rows + n[many, None]) - self.f.reshape(-1, self.k)[cell[many]]
        return out

    def put(self, own: np.ndarray, counts: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """gains() of these units but for what a unit's classes share; own -1: in no class yet."""
        n, k = len(own), self.k
        placed = np.flatnonzero(own >= 0)
        home, t = own[placed], np.where(own >= 0, twice, 0.0)
        if t.any():
            counts = counts.copy()
            for side in (0, 1):
                counts[placed, side, home] -= t[placed]
        unit, cell = np.nonzero(counts.reshape(n, 2 * k))
        x, put = counts.reshape(n, 2 * k)[unit, cell], np.zeros((n, k))
        for a in range(0, n, 256):
            i, j = np.searchsorted(unit, (a, a + 256))
            if i < j:
                first = np.flatnonzero(np.diff(unit[i:j], prepend=-1))
                put[unit[i:j][first]] = np.add.reduceat(self._changes(cell[i:j], x[i:j]), first)
        i, c = np.nonzero((counts.min(1) > 0) | (t > 0)[:, None])
        a, b, d = counts[i, 0, c], counts[i, 1, c], np.diag(self.matrix)[c]
        put[i, c] += _xlogx(d + a + b + t[i]) + _xlogx(d) - _xlogx(d + a) - _xlogx(d + b)
        for side in (0, 1):
            beside = placed[counts[placed, side, home] > 0]
            i, c = np.nonzero(counts[beside, 1 - side])
            i = beside[i]
            v, m = counts[i, side, own[i]], self.sides[side][own[i], c]
            less = np.maximum(m - counts[i, 1 - side, c], 0)
            put[i, c] += _xlogx(less + v) - _xlogx(less) - _xlogx(m + v) + _xlogx(m)
        totals = counts.sum(2) + t[:, None]
        pair, which = np.unique(totals, axis=0, return_inverse=True)
        cost = sum(_xlogx(s + pair[:, side, None]) - _xlogx(s) for side, s in enumerate(self.sums))
        put -= cost[which.ravel()]
        away = (own[unit] >= 0) & (cell % k != own[unit])
        mine = self.sides.reshape(-1, k)[cell[away], own[unit[away]]]
        back = np.bincount(unit[away], _xlogx(mine) - _xlogx(np.maximum(mine - x[away], 0)), n).astype(float)[placed]
        d = np.diag(self.matrix)[home]
        back += _xlogx(d) - _xlogx(np.maximum(d - counts[placed, 0, home] - counts[placed, 1, home] - t[placed], 0))
        put[placed, home] = back - sum(_xlogx(s[home]) - _xlogx(np.maximum(s[home] - totals[placed, side], 0)) for side, s in enumerate(self.sums))
        return put

    def best(self, own: np.ndarray, counts: np.ndarray, twice: np.ndarray) -> np.ndarray:
        if not len(own):
            return own.copy()
        put, at = self.put(own, counts, twice), np.arange(len(own))
        best = put.argmax(1)
        return np.where((own >= 0) & (put[at, best] <= put[at, own] + 1e-6), own, best)


def _move(matrix: np.ndarray, own: int, counts: np.ndarray, twice: float) -> int:
    """A unit's best class; matrix takes its move. counts: by side and class of its neighbours."""
    put = gains(matrix, np.array([own]), counts[None], np.array([twice]))[0]
    new = int(put.argmax())
    if put[new] <= put[own] + 1e-6:
        return own
    x, y = counts.copy()
    x[own] -= twice
    y[own] -= twice
    for c, sign in ((own, -1), (new, 1)):
        matrix[:, c] += sign * x
        matrix[c] += sign * y
        matrix[c, c] += sign * twice
    return new


def exchange(table: np.ndarray, k: int, tokens: float) -> np.ndarray:
    """Classes of the units of a table of pair counts: each in turn moves to its best class, until a sweep gains little."""
    size = len(table)
    classes, reached = np.arange(size) % k, []
    member = np.eye(k)[classes]
    sums = np.stack([table.T @ member, table @ member], 1)  # by unit, side and neighbours' class
    matrix = member.T @ sums[:, 1]
    while len(reached) < 2 or reached[-1] - reached[-2] >= GAIN * tokens / 2:
        for u in range(size):
            own = int(classes[u])
            new = _move(matrix, own, sums[u], float(table[u, u]))
            if new != own:
                for side, w in enumerate((table[u], table[:, u])):
                    sums[:, side, own] -= w
                    sums[:, side, new] += w
                classes[u] = new
        reached.append(likelihood(matrix))
    return classes


def core_classes(pairs: DataFrame, size: int, k: int) -> np.ndarray:
    """Classes of the first `size` units by their pairs with each other, found in one task that holds size * size counts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((size, size))
        table[group["a"], group["b"]] = group["n"]
        return pd.DataFrame({"u": np.arange(size), "c": exchange(table, k, table.sum())})

    classes = np.arange(size) % k
    inner = pairs.where((F.col("a") < size) & (F.col("b") < size)).select("a", "b", "n")
    for r in inner.groupBy(F.lit("all")).applyInPandas(run, "u long, c long").collect():
        classes[r["u"]] = r["c"]
    return classes


def class_counts(batch: pa.RecordBatch, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of neighbours(): the units, their neighbours by side and class (those of class -1 left out), and how often each follows itself."""
    units = batch.column(0).to_numpy()
    of, cell, n = _flat(batch.column(1), batch.column(2))
    v, side = cell >> 1, cell & 1
    c = classes[v]
    known = c >= 0
    counts = np.bincount((of * 2 + side)[known] * k + c[known], n[known], len(units) * 2 * k).reshape(-1, 2, k)
    same = (v == units[of]) & (side == 1)
    return units, counts, np.bincount(of[same], n[same], len(units))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def class_pairs(links: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often each class follows each, over rows of neighbours()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for part in _slices(batches):
            units, counts, _ = class_counts(part, classes, k)
            at = np.flatnonzero(classes[units] >= 0)
            np.add.at(total.T, classes[units[at]], counts[at, 0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["cell", "n"])

    return _matrix(links.mapInArrow(run, "cell long, n long"), k)


def _matrix(cells: DataFrame, k: int) -> np.ndarray:
    """Summed (cell, n) rows, at most k * k of them."""
    out = np.zeros(k * k)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


class Rounds:
    """Whether to go on, and which part of the units may move: one in `parts`, in turn."""

    def __init__(self, tokens: float) -> None:
        self.parts, self.tokens, self.turn, self.reached = 1, tokens, 0, []

    def lower(self, now: float) -> bool:
        """Takes note of a likelihood; True if it's no higher than the last, whose classes are to come back."""
        if self.reached and now <= self.reached[-1]:
            self.parts *= 2
            return True
        self.reached.append(now)
        return False

    def over(self) -> bool:
        """Whether the last round gained little, or even a small part's moves lose."""
        return self.parts > 8 or len(self.reached) > 1 and self.reached[-1] - self.reached[-2] < GAIN * self.tokens

    def movers(self, mixed: np.ndarray) -> np.ndarray:
        """Of units numbered at random, those of this turn."""
        return (mixed & (self.parts - 1)) == self.turn % self.parts


def _sweep(classes: np.ndarray, matrix: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Over units (u, c to go to, counts) in their order: each moves as the classes by then would have it; one without a class goes to c."""
    k = len(matrix)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        now, group = matrix.copy(), group.sort_values("u")
        to = [c if classes[u] < 0 else _move(now, int(classes[u]), x[:-1].reshape(2, k), x[-1]) for u, c, x in zip(group["u"], group["c"], map(np.frombuffer, group["counts"]), strict=True)]
        return pd.DataFrame({"u": group["u"], "c": to})

    return run


def cluster(pairs: DataFrame, size: int, k: int = CLASSES, core: int = CORE, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's class, and how often each class follows each. rounds: how many at most, else until they gain little."""
    core = min(core, size)
    links = written(neighbours(pairs), "neighbours")
    classes = np.concatenate([core_classes(pairs, core, k), np.full(size - core, -1, np.int64)])
    mixed = np.random.default_rng(size).integers(0, 64, size)
    going, kept = None, None
    for turn in count():
        matrix, placing = class_pairs(links, classes, k), bool((classes < 0).any())
        if not placing:
            going = going or Rounds(matrix.sum())
            if going.lower(likelihood(matrix)):
                classes, matrix = kept
            if going.over() or rounds is not None and turn > rounds:
                dropped(links)
                return classes, matrix
            kept = classes, matrix
        movers = classes < 0 if placing else going.movers(mixed)

        def willing(batches: Iterator[pa.RecordBatch], classes=classes, matrix=matrix, movers=movers) -> Iterator[pa.RecordBatch]:
            moves = Moves(matrix)
            for part in _slices(batches):
                units, counts, twice = class_counts(part, classes, k)
                new = moves.best(classes[units], counts, twice)
                at = np.flatnonzero((new != classes[units]) & movers[units])
                full = np.concatenate([counts[at].reshape(-1, 2 * k), twice[at, None]], 1)
                yield pa.RecordBatch.from_arrays([pa.array(units[at]), pa.array(new[at]), pa.array([x.tobytes() for x in full], pa.binary())], ["u", "c", "counts"])

        wishes = links.mapInArrow(willing, "u long, c long, counts binary")
        # At most a row for each unit. One after another, so that not all of them fill the same class at once.
        moves = wishes.groupBy(F.lit("all")).applyInPandas(_sweep(classes, matrix), "u long, c long").collect()
        classes = np.where(classes < 0, np.arange(size) % k, classes)
        for r in moves:
            classes[r["u"]] = r["c"]
        if going:
            going.turn += 1
    raise AssertionError


def _best(moves: Moves, own: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], twice: np.ndarray) -> np.ndarray:
    """moves.best() of words by their entries (word, side * k + class, how many). Words with the same two neighbours in all are asked once."""
    size, cells = len(own), 2 * moves.k
    key, n = np.unique(entries[0] * cells + entries[1], return_inverse=True)
    of, cell, n = key // cells, key % cells, np.bincount(n, entries[2], len(key))
    bounds = np.searchsorted(of, np.arange(size + 1))
    total = np.bincount(of, n, size)
    pair = np.flatnonzero((total == 2) & (np.diff(bounds) == 2) & (twice == 0))
    same = ((own[pair] + 1) * cells + cell[bounds[pair]]) * cells + cell[bounds[pair] + 1]
    _, first, alike = np.unique(same, return_index=True, return_inverse=True)
    asked = np.ones(size, bool)
    asked[pair] = False
    asked[pair[first]] = True
    new = np.empty(size, np.int64)
    at = np.flatnonzero(asked)
    for part in (at[i : i + 2500] for i in range(0, len(at), 2500)):
        lengths = bounds[part + 1] - bounds[part]
        here = np.repeat(bounds[part] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        counts = np.bincount(np.repeat(np.arange(len(part)), lengths) * cells + cell[here], n[here], len(part) * cells).reshape(-1, 2, moves.k)
        new[part] = moves.best(own[part], counts, twice[part].astype(float))
    new[pair] = new[pair[first]][alike]
    return new


def _binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """flat[bounds[i] : bounds[i + 1]] as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def occurrences(codes: DataFrame) -> DataFrame:
    """What _chunks() cuts the occurrences of words outside the head from; there is no table of these."""
    return codes.select("chunk", "held", "sizes", "codes", "words", "dealt")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows of occurrences(): chunk, its words outside the head, their buckets, and where they occur in training, in order: at (which of them), before and next (codes)."""
    for batch in batches:
        for i in range(batch.num_rows):
            chain, dealt = _joined(batch, i), _array(batch.column("dealt"), i)
            at = np.flatnonzero(chain < 0)  # never a text's last code, which is the end
            if len(at):
                yield batch.column("chunk")[i].as_py(), batch.column("words")[i].as_py().split(END), np.repeat(np.arange(len(dealt)), dealt), -1 - chain[at], chain[at - 1], chain[at + 1]


OUTER = "bucket int, word binary, n long, c int, cells binary, counts binary"


def outer_words(occurring: DataFrame, by_class: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """OUTER of every training word outside the head: its count and its head neighbours (cell: side * k + class; 16-bit; counts
    of 32 bits); c is the class that fits these best. A word in four starts in a class by its hash: words of unlike kinds would
    else fill a class without head words alike, and none would gain by leaving it. Words are gathered by bucket.
    """
    k = len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, bucket, at, before, after in _chunks(batches):
            n, sides = np.bincount(at, minlength=len(words)), []
            for side, beside in enumerate((before, after)):
                inside = np.flatnonzero(beside >= 0)
                sides.append((at[inside], by_class[beside[inside]] + side * k))
            of, cell = (np.concatenate(x) for x in zip(*sides, strict=True))
            order = np.argsort(of, kind="stable")
            near, cell = np.bincount(of, minlength=len(words)), cell[order].astype("<u2")
            cuts, used = np.cumsum(near), np.flatnonzero(n)
            ends = np.flatnonzero(np.diff(bucket[used], append=-1)) + 1
            starts = np.append(0, ends[:-1])
            rows = []
            for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
                some = used[i:j]
                rows.append((int(bucket[some[0]]), END.join([words[x] for x in some.tolist()]), n[some].astype("<i4").tobytes(), near[some].astype("<i4").tobytes(), cell[cuts[some[0]] - near[some[0]] : cuts[some[-1]]].tobytes()))
            columns = zip(*rows, strict=True)
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["bucket", "words", "n", "near", "cells"])

    def gathered(table: pa.Table) -> pa.Table:
        places, which, n, of, cells = {}, [], [], [], []
        for row in table.to_pylist():
            words = row["words"].split(END)
            at = np.array([places.setdefault(w, len(places)) for w in words])
            which.append(at)
            n.append(np.frombuffer(row["n"], "<i4"))
            of.append(np.repeat(at, np.frombuffer(row["near"], "<i4")))
            cells.append(np.frombuffer(row["cells"], "<u2").astype(np.int64))
        words, size = list(places), len(places)
        key, many = np.unique(np.concatenate(of) * 2 * k + np.concatenate(cells), return_counts=True)
        of, cell, u = key // (2 * k), key % (2 * k), hashes(words)
        c = _best(Moves(matrix), np.full(size, -1), (of, cell, many), np.zeros(size))
        bounds = np.searchsorted(of, np.arange(size + 1))
        c = np.where((np.diff(bounds) > 0) & ((u >> np.uint64(13)) & np.uint64(3) > 0), c, (u % np.uint64(k)).astype(np.int64))
        n = np.bincount(np.concatenate(which), np.concatenate(n), size).round().astype(np.int64)
        lists = [_binaries(cell.astype("<u2"), bounds), _binaries(many.astype("<i4"), bounds)]
        return pa.Table.from_arrays([pa.array(np.full(size, table.column("bucket")[0].as_py()), pa.int32()), pa.array(words, pa.binary()), pa.array(n), pa.array(c, pa.int32()), *lists], [x.split()[0] for x in OUTER.split(", ")])

    dealt = occurring.mapInArrow(run, "bucket int, words binary, n binary, near binary, cells binary")
    return dealt.groupBy("bucket").applyInArrow(gathered, OUTER)


#: A bucket of words: each one's count, class, hash bits, head neighbours (as in OUTER) and how often it follows itself; of links with words
#: outside the head, before (0) and after (1), the word (own) and the buckets that these are in (to: buckets, then how many links
#: each), by bucket, chunk and place; near: the classes of these; sums: its part of the class pairs.
BUCKETS = "bucket int, words binary, n binary, c binary, mix binary, bounds binary, cells binary, counts binary, twice binary, own0 binary, to0 binary, own1 binary, to1 binary, near0 binary, near1 binary, sums binary"
TOLD = BUCKETS + ", source int, side int"  # a bucket (source -1), or classes (c) for its links on a side from the bucket source
_BUCKETS, _TOLD = ([x.split()[0] for x in y.split(", ")] for y in (BUCKETS, TOLD))
_KINDS = {"n": "<i8", "c": "<u2", "mix": "u1", "cells": "<u2", "near0": "<u2", "near1": "<u2", "sums": "<i8"}


def _bucket(row: dict) -> dict:
    return {x: np.frombuffer(v, _KINDS.get(x, "<i4")) if isinstance(v, bytes) and x != "words" else v for x, v in row.items()}


def _rows(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    pack = lambda v: v.tobytes() if isinstance(v, np.ndarray) else v
    return pa.RecordBatch.from_arrays([pa.array([pack(r.get(x)) for r in rows], pa.int32() if x in ("bucket", "source", "side") else pa.binary()) for x in names], names)


def _entries(b: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of head neighbours, then of those outside the head: the word, side * k + class, and how many."""
    yield np.repeat(np.arange(len(b["c"])), np.diff(b["bounds"])), b["cells"].astype(np.int64), b["counts"].astype(np.int64)
    own = np.concatenate((b["own0"], b["own1"])).astype(np.int64)
    yield own, np.concatenate((b["near0"].astype(np.int64), b["near1"].astype(np.int64) + k)), np.ones(len(own), np.int64)


def cluster_outer(state: DataFrame, occurring: DataFrame, matrix: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """bucket, word, n and the class found, c, of state's words (outer_words()), and how often each class follows each; matrix: the head's own pairs.

    Words stay in their buckets. A round sends a bucket's classes along its links, in an order that both ends know: two bytes a link.
    """
    k, spark = len(matrix), state.sparkSession

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bucket, a chunk's links in order: for both sides the word (of words) and the other's bucket; same: words that follow themselves."""
        for chunk, words, bucket, at, before, _ in _chunks(batches):
            led = np.flatnonzero(before < 0)
            ends = (at[led], -1 - before[led])  # a link's later word has its other before (0)
            rows, sides = [], []
            for side in (0, 1):
                mine, other = bucket[ends[side]], bucket[ends[1 - side]]
                order = np.argsort(mine, kind="stable")
                sides.append((ends[side][order], other[order], np.searchsorted(mine[order], np.arange(bucket[-1] + 2))))
            same = np.sort(at[led][ends[0] == ends[1]])
            for x in np.unique(bucket[np.concatenate(ends)]).tolist():
                own, to = zip(*((a[cuts[x] : cuts[x + 1]], b[cuts[x] : cuts[x + 1]]) for a, b, cuts in sides), strict=True)
                used = np.unique(np.concatenate(own))
                place = [np.searchsorted(used, o).astype("<i4").tobytes() for o in own]
                i, j = np.searchsorted(same, (used[0], used[-1] + 1))
                rows.append((x, chunk, END.join([words[w] for w in used.tolist()]), place[0], to[0].astype("<i4").tobytes(), place[1], to[1].astype("<i4").tobytes(), np.searchsorted(used, same[i:j]).astype("<i4").tobytes()))
            if rows:
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "words", "own0", "to0", "own1", "to1", "same"])

    def gathered(words: pa.Table, met: pa.Table) -> pa.Table:
        names = words.column("word").to_pylist()
        if not names:
            return pa.Table.from_batches([_rows([], _TOLD)])
        places, size = dict(zip(names, count())), len(names)
        own, to, same = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]), ([np.zeros(0, np.int32)], [np.zeros(0, np.int32)]), [np.zeros(0, np.int64)]
        for row in met.sort_by("chunk").to_pylist():
            at = np.array([places[w] for w in row["words"].split(END)])
            for side in (0, 1):
                own[side].append(at[np.frombuffer(row[f"own{side}"], "<i4")])
                to[side].append(np.frombuffer(row[f"to{side}"], "<i4"))
            same.append(at[np.frombuffer(row["same"], "<i4")])
        cells, counts = (b"".join(words.column(x).to_pylist()) for x in ("cells", "counts"))
        lengths = pc.binary_length(words.column("counts")).to_numpy() // 4
        b = {"bucket": words.column("bucket")[0].as_py(), "words": END.join(names), "cells": cells, "counts": counts, "bounds": np.append(0, np.cumsum(lengths)).astype("<i4")}
        b |= {"n": words.column("n").to_numpy(), "c": words.column("c").to_numpy().astype("<u2"), "mix": ((hashes(names) >> np.uint64(7)) & np.uint64(63)).astype("u1")}
        b["twice"] = np.bincount(np.concatenate(same), minlength=size).astype("<i4")
        for side in (0, 1):
            all_to = np.concatenate(to[side])
            b[f"own{side}"] = np.concatenate(own[side])[np.argsort(all_to, kind="stable")].astype("<i4")
            b[f"to{side}"] = np.concatenate(np.unique(all_to, return_counts=True)).astype("<i4")
        return pa.Table.from_batches([sent(b)])

    def sent(b: dict) -> pa.RecordBatch:
        """A bucket, and its classes for the other ends of its links."""
        out = [b | {"source": -1, "near0": None, "near1": None, "sums": None}]
        for side in (0, 1):
            to, many = b[f"to{side}"].reshape(2, -1)
            parts = np.split(b["c"][b[f"own{side}"]], np.cumsum(many)[:-1]) if len(many) else []
            out += [{"bucket": x, "source": b["bucket"], "side": 1 - side, "c": c} for x, c in zip(to.tolist(), parts, strict=True)]
        return _rows(out, _TOLD)

    def moved(buckets: DataFrame, now: np.ndarray, going: Rounds) -> DataFrame:
        """Every word meets the classes as the round found them, so how words are dealt to buckets doesn't matter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moves = Moves(now)
            for batch in batches:
                for i in range(batch.num_rows):
                    b = _bucket(batch.slice(i, 1).to_pylist()[0])
                    best = _best(moves, b["c"].astype(np.int64), tuple(np.concatenate(x) for x in zip(*_entries(b, k), strict=True)), b["twice"])
                    yield sent(b | {"c": np.where(going.movers(b["mix"]), best, b["c"]).astype("<u2")})

        return buckets.mapInArrow(run, TOLD)

    def told(sending: DataFrame) -> DataFrame:
        """Buckets with the classes of their links' other ends, and their sums."""

        def receive(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["source"])
            b = _bucket(rows[0])
            for side in (0, 1):
                b[f"near{side}"] = np.frombuffer(b"".join(r["c"] for r in rows[1:] if r["side"] == side), "<u2")
            total, c = np.zeros(k * k), b["c"].astype(np.int64)
            for (of, cell, n), sides in zip(_entries(b, k), ((0, 1), (1,)), strict=True):  # of links, the earlier end counts
                for side in sides:
                    on = cell // k == side
                    mine, other = c[of[on]], cell[on] % k
                    total += np.bincount(mine * k + other if side else other * k + mine, n[on], k * k)
            b["sums"] = total.round().astype("<i8")
            return pa.Table.from_batches([_rows([b], _BUCKETS)])

        return sending.groupBy("bucket").applyInArrow(receive, BUCKETS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += _array(batch.column(0), i, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in map(_bucket, batch.to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b["n"]), b["bucket"]), pa.int32()), pa.array(b["words"].split(END), pa.binary()), pa.array(b["n"]), pa.array(b["c"], pa.int32())], ["bucket", "word", "n", "c"])

    met = occurring.mapInArrow(links, "bucket int, chunk long, words binary, own0 binary, to0 binary, own1 binary, to1 binary, same binary")
    start = state.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(gathered, TOLD)
    buckets, going, kept = written(told(start), "outer-0"), None, None
    for turn in count():
        now = matrix + _matrix(buckets.select("sums").mapInArrow(sums, "cell long, n long"), k)
        going = going or Rounds(now.sum())
        if going.lower(likelihood(now)):
            dropped(buckets)
            buckets, now = kept
        elif kept:
            dropped(kept[0])
        if going.over():
            return buckets.select("bucket", "words", "n", "c").mapInArrow(opened, "bucket int, word binary, n long, c int"), now
        kept = buckets, now
        buckets = written(told(moved(buckets, now, going)), f"outer-{turn + 1}")
        going.turn += 1
        released(spark)
    raise AssertionError


def lm_scores(docs: DataFrame, classes: int = CLASSES, head: int = HEAD, core: int = CORE, rounds: int | None = None, mix: float = MIX) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    words = written(vocabulary(rows.where("not held_out")), "vocabulary")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = F.col("word") == F.lit(END)
    common = words.where(~end).orderBy(F.desc("n"), "word").limit(head).union(words.where(end)).collect()
    n_of = {bytes(r["word"]): r["n"] for r in common}
    dropped(words)
    first = [END, *sorted(n_of.keys() - {END}, key=lambda w: (-n_of[w], w))]
    counts = np.array([n_of.get(w, 0) for w in first], np.int64)
    codes = written(coded(rows, first, max(1, math.ceil((total - int(counts.sum())) / BUCKET))), "codes")
    released(docs.sparkSession)
    pairs = written(head_pairs(codes, len(first)), "pairs")
    by_class, matrix = cluster(pairs, len(first), classes, core, rounds)
    dropped(pairs)
    released(docs.sparkSession)
    known = occurrences(codes)  # cut anew from the codes wherever they are read: as a table they would take more room than the text
    found, matrix = cluster_outer(outer_words(known, by_class, matrix), known, matrix)
    released(docs.sparkSession)
    rare = 1 / (total + kinds + 1)
    share = (matrix.sum(0) + 1) / (matrix.sum() + classes)
    follow = np.vstack([(matrix + 2 * share) / (matrix.sum(1, keepdims=True) + 2), share])
    #: By class before (the last for none) and class: what a word's count is to be multiplied by.
    factor = (1 - rare) * (1 - mix) * follow / np.maximum(matrix.sum(0), 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's words outside the head, by bucket."""
        for batch in batches:
            for i in range(batch.num_rows):
                words, ends = batch.column("words")[i].as_py().split(END), np.cumsum(_array(batch.column("dealt"), i))
                bounds = [0, *ends.tolist()]
                asked = [(x, END.join(words[a:b])) for x, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in asked], pa.int32()), pa.array([batch.column("chunk")[i].as_py()] * len(asked), pa.int64()), pa.array([w for _, w in asked], pa.binary())], ["bucket", "chunk", "words"])

    def answer(words: pa.Table, asked: pa.Table) -> pa.Table:
        """Counts and classes of the words asked for; 0 and the number of classes for those not in training."""
        place = dict(zip(words.column("word").to_pylist(), count())).get
        n, c = (np.append(words.column(x).to_numpy(), none) for x, none in (("n", 0), ("c", classes)))
        found = [np.fromiter(map(place, w, repeat(-1)), np.int64, len(w)) for w in (x.split(END) for x in asked.column("words").to_pylist())]
        columns = [asked.column("chunk"), asked.column("bucket"), *(pa.array([x[at].astype(kind).tobytes() for at in found], pa.binary()) for x, kind in ((n, "<i8"), (c, "<u2")))]
        return pa.Table.from_arrays(columns, ["chunk", "bucket", "n", "c"])

    def scores(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        n, c = (np.frombuffer(b"".join(answers.column(x).to_pylist()), kind).astype(np.int64) for x, kind in (("n", "<i8"), ("c", "<u2")))
        n, c = np.concatenate((counts, n[::-1])), np.concatenate((by_class, c[::-1]))  # -1 - i is the chunk's other word i
        code, sizes = (_array(chunk.column(x), 0) for x in ("codes", "sizes"))
        n, c = n[code], c[code]
        own = np.log10(np.where(n > 0, factor[np.append(by_class[:1], c[:-1]), np.minimum(c, classes - 1)] * n + mix * (n + 1) * rare, rare))
        bounds = np.cumsum(sizes) - sizes  # no document is without its end
        sums = [np.add.reduceat(x, bounds) for x in ((n > 0).astype(np.int64), np.log10((n + 1) * rare), own)]
        ids, held = (chunk.column(x)[0].values for x in ("ids", "held"))
        return pa.Table.from_arrays([ids, held, pa.array(sizes.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(sizes), int(total))), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = codes.select("chunk", "words", "dealt").mapInArrow(ask, "bucket int, chunk long, words binary")
    answers = found.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, n binary, c binary")
    return codes.select("chunk", "ids", "held", "sizes", "codes").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
