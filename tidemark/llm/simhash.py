"""SimHash near-dedup by anchor points of a covering code.

A fingerprint has 64 bits. The anchors are the words of a code whose spheres cover all of them: two
perfect binary Golay codes (23 bits, radius 3) on bits 0-45, any value on the other 18 bits, so the
covering radius over the 46 bits is 6. Every distinct fingerprint is replicated to every anchor
within radius plus threshold on those bits (78 of 16.7 million on average at threshold 2). Two
fingerprints within the threshold both reach the anchor nearest to the smaller one, and only there
is their link made, so no link is lost or made twice.

Copies share one fingerprint and are folded before. An anchor that more than `hot` distinct
fingerprints reach is not compared as a block: its rows are dealt once more, each to itself and
every one-bit neighbour of itself (a code of radius 0; two fingerprints within two bits have such a
neighbour in common), where at most 65 can meet. Defined cases: null text counts as empty; a text
without words has fingerprint zero; texts of any length are read whole; null ids are ignored when a
component takes its least id, and a component of null ids only has a null id; repeated rows are in one
component; extra columns of any name or type stay in near_dedup(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, components, dropped, free_names, written

SEED, SHINGLE, THRESHOLD = 42, 3, 2
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the words' shingles, each occurrence counting once."""
    import xxhash

    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    counts, step = np.zeros(64, np.int64), 65_536
    for at in range(0, n, step):
        to = min(n, at + step)
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in spans], np.uint64, to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row, and key, a column of long numbers, if one is named."""
    keys = [F.col(key).cast("long")] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(byte_words(t.as_py()), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    return docs.select(F.col("doc_id").cast("long"), "text", *keys).mapInArrow(run, "doc_id long, fp long" + f", `{key}` long" * len(keys))


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the error patterns of weight 0-5 that have it, by weight, and where each weight ends."""
    bits = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        bits[i] = r
    masks = np.arange(1 << 23, dtype=np.int64)
    weight = np.bitwise_count(masks)
    masks = masks[weight <= 3 + THRESHOLD]
    syndrome = np.zeros(len(masks), np.int64)
    for i in range(23):
        syndrome ^= np.where(masks >> i & 1, bits[i], 0)
    order = np.lexsort((np.bitwise_count(masks), syndrome))
    starts = np.searchsorted(syndrome[order], np.arange(2049))
    return bits, masks[order], starts


def _syndrome(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i in range(23):
        out ^= np.where(words >> i & 1, bits[i], 0)
    return out


def home(prints: np.ndarray) -> np.ndarray:
    """The anchor nearest to each fingerprint, as a 46-bit number."""
    bits, masks, starts = _golay()
    low, high = prints & 0x7FFFFF, prints >> 23 & 0x7FFFFF
    return (low ^ masks[starts[_syndrome(low, bits)]]) | (high ^ masks[starts[_syndrome(high, bits)]]) << 23


def anchors(prints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within the covering radius plus the threshold."""
    bits, masks, starts = _golay()
    low, high = prints & 0x7FFFFF, prints >> 23 & 0x7FFFFF
    s, t = _syndrome(low, bits), _syndrome(high, bits)
    n, m = starts[s + 1] - starts[s], starts[t + 1] - starts[t]
    row = np.repeat(np.arange(len(prints)), n * m)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    x, y = masks[starts[s][row] + k // m[row]], masks[starts[t][row] + k % m[row]]
    near = np.bitwise_count(x) + np.bitwise_count(y) <= 6 + threshold
    row, x, y = row[near], x[near], y[near]
    return row, (low[row] ^ x) | (high[row] ^ y) << 23


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_prints = batch.column(0).to_numpy()
        for at in range(0, len(all_prints), 2000):
            prints = all_prints[at : at + 2000]
            row, anchor = anchors(prints)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[row])], ["anchor", "fp"])


def _flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64).view(np.int64)
    for batch in batches:
        all_prints = batch.column(0).to_numpy()
        for at in range(0, len(all_prints), 2000):
            prints = all_prints[at : at + 2000]
            yield pa.RecordBatch.from_arrays([pa.array((prints[:, None] ^ masks).ravel()), pa.array(np.repeat(prints, 65))], ["anchor", "fp"])


def _links(keys: np.ndarray, prints: np.ndarray, threshold: int, at_home: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: each row against those after it that have its key."""
    here, shift, a, b = np.arange(len(keys)), 1, [], []
    while len(here := here[here + shift < len(keys)]):
        here = here[keys[here] == keys[here + shift]]
        near = here[np.bitwise_count((prints[here] ^ prints[here + shift]).view(np.uint64)) <= threshold]
        x, y = np.minimum(prints[near], prints[near + shift]), np.maximum(prints[near], prints[near + shift])
        if at_home and len(x):  # made only at the anchor nearest to the smaller
            mine = home(x) == keys[near]
            x, y = x[mine], y[mine]
        a.append(x)
        b.append(y)
        shift += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (keys[:0], keys[:0])


def _compare(threshold: int, at_home: bool, hot: int):
    """Over partitions sorted by anchor: the links (a, b), or (fp, null) for each row of a crowded anchor.

    Holds one batch and at most `hot` rows of one anchor, never a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["a", "b"])

        for batch in batches:
            keys, prints = np.concatenate((keys, batch.column(0).to_numpy())), np.concatenate((prints, batch.column(1).to_numpy()))
            if crowded is not None:
                to = np.searchsorted(keys, crowded, "right")
                yield out(prints[:to], None)
                keys, prints, crowded = keys[to:], prints[to:], None if to < len(keys) else crowded
            while len(keys):
                firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                sizes = np.diff(np.append(firsts, len(keys)))
                many = np.flatnonzero(sizes > hot)
                to = firsts[many[0]] if len(many) else firsts[-1]
                yield out(*_links(keys[:to], prints[:to], threshold, at_home))
                keys, prints = keys[to:], prints[to:]
                if not len(many):
                    break
                yield out(prints[: sizes[many[0]]], None)
                crowded = keys[0]
                keys, prints = keys[sizes[many[0]] :], prints[sizes[many[0]] :]
                if len(keys):
                    crowded = None
        yield out(*_links(keys, prints, threshold, at_home))

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD, hot: int = 4096) -> DataFrame:
    """(a, b), a < b: distinct fingerprints (fp) that differ in at most threshold (1 or 2) bits."""
    if threshold not in (1, 2):
        raise ValueError("the anchors are laid out for thresholds 1 and 2")

    def met(rows: DataFrame, at_home: bool, most: int) -> DataFrame:
        return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(threshold, at_home, most), "a long, b long")

    found = written(met(distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long"), True, hot), "links")
    crowd = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    near = met(crowd.mapInArrow(_flips, "anchor long, fp long"), False, 65)
    return found.where("b is not null").unionByName(near).distinct()


def _labelled(prints: DataFrame, threshold: int, hot: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in prints."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(distinct, threshold, hot)).withColumnRenamed("node", "fp")
    rooted = distinct.join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def alike_rows(keyed: DataFrame, key: str, threshold: int = THRESHOLD, hot: int = 4096) -> DataFrame:
    """(a, b), written: the least row and each other one of every component, rows told apart by key, a column of long numbers."""
    prints = written(fingerprints(keyed, key=key), "prints")
    rooted = written(prints.join(_labelled(prints, threshold, hot), "fp").select(F.col(key).alias("b"), "root"), "rooted")
    found = written(rooted.join(rooted.groupBy("root").agg(F.min("b").alias("a")), "root").where("a < b").select("a", "b"), "alike")
    dropped(prints, rooted)
    return found


def near_groups(docs: DataFrame, threshold: int = THRESHOLD, hot: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least id reachable)."""
    prints = written(fingerprints(docs), "prints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(_labelled(prints, threshold, hot), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, threshold: int = THRESHOLD, hot: int = 4096) -> DataFrame:
    """One row of docs for each component, with docs' own columns: that with the least id (of equal ids any one, a null id only if there is no other)."""
    key = free_names(docs, "row")[0]
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    prints = written(fingerprints(keyed, key=key), "prints")
    met = prints.join(_labelled(prints, threshold, hot), "fp")
    stay = met.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("x")).select(F.col(f"x.{key}").alias(key))
    return keyed.join(stay, key, "left_semi").select(*docs.columns)
