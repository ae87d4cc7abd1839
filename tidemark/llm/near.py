"""The pipeline's near-duplicates: SimHash fingerprints that differ in at most two bits, found by operator 8's anchors
(simhash.alike_rows), and word shingles of SHINGLE words with an exact Jaccard similarity of SIMILARITY or more. Both kinds of links
make the components: nothing that operator 8 links is left apart, nor are copies whose fingerprints differ in more bits.

For the second kind texts are nodes; copies (by a 128-bit hash of their words, A-Z lower-cased) are one node. Candidates
share one of BANDS buckets, each made of ROWS least hashes of the text's shingles; a pair of
similarity s shares none by a chance of (1 - s^ROWS)^BANDS, 0.00005 at 0.8. A sketch of one byte for
each of BINS parts of the hash range tells how alike two candidates are, to within 0.02 or so for long texts
and nearly exactly for short ones; those of LIKELY or more are held against their shingles themselves.

First each bucket's texts are held against STARS of them. Then, in buckets where several components (of both kinds of links) are left,
every two texts of different components are: a bucket's largest component against the others' texts, and
these against each other, in blocks of at most BLOCK by BLOCK texts, dealt over all tasks. So no link that
matters to a component is left out, and a bucket of close copies is compared no more than STARS times a row.

A text of at most SHINGLE words is one shingle. Defined cases: null text counts as empty; all texts without
words are copies of each other; texts of any length are read whole; ids may be null or repeat, as rows are
told apart by a key of their own; a component's id is its least id, null if it has none; of a component the
row with the least id stays (of equal ids any one, a null id only if there is no other); extra columns of any
name or type stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, components, dropped, free_names, released, written
from .simhash import alike_rows

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 25, 5, 42
BINS, LIKELY, STARS, BLOCK = 512, 0.72, 3, 2048
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words' shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1))


def buckets(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A number for each band, of its rows' least hashes."""
    factors, mixers = (np.random.default_rng(SEED).integers(0, 2**64, (2, bands * rows), np.uint64) | np.uint64(1))
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * factors).min(0), out=least)
    return ((least ^ least >> np.uint64(32)) * mixers).reshape(bands, rows).sum(1, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte for each part of the hash range: of the least hash there, 0 for none."""
    at = np.searchsorted(hashes, _EDGES)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    there = (at < len(hashes)) & (np.diff(np.append(at, len(hashes))) > 0)
    return np.where(there, 1 + (least >> np.uint64(16)) % np.uint64(255), 0).astype(np.uint8)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches (last axis)."""
    either = (a | b) > 0
    return ((a == b) & either).sum(-1) / np.maximum(either.sum(-1), 1)


def sketches(keyed: DataFrame, key: str, shingle: int = SHINGLE) -> DataFrame:
    """row, copy_of (a hash of the words), buckets (as a list and in binary) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, keys, seen = [], [], []
            for text in batch.column(1):
                words = byte_words(text.as_py())
                hashes = shingles(words, shingle)
                nodes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(buckets(hashes).view(np.int64))
                seen.append(sketch(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(seen, pa.binary())], ["row", "copy_of", "buckets", "keys", "sketch"])

    return keyed.select(key, "text").mapInArrow(run, "row long, copy_of binary, buckets array<long>, keys binary, sketch binary")


class _Held:
    """Rows of the block that is being read; a block may go on in the next batch."""

    def __init__(self) -> None:
        self.key, self.parts = None, []

    def blocks(self, batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
        """The blocks that end in this batch; the first `width` columns are the key."""
        if not batch.num_rows:
            return
        keys = np.stack([batch.column(i).to_numpy() for i in range(width)], 1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if self.key is not None and self.key != keys[a].tolist():
                yield self.end()
            self.key = keys[a].tolist()
            self.parts.append(batch.slice(a, b - a))

    def end(self) -> pa.RecordBatch:
        whole = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        self.key, self.parts = None, []
        return whole


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of each bucket's texts and its first STARS by a hash, where the sketches are alike. Holds STARS rows and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, centres = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes, seen = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes(batch.column(2))
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            a, b = [], []
            for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
                if bucket != keys[i]:
                    bucket, centres = keys[i], []
                first = len(centres)
                centres += [(nodes[x], seen[x]) for x in range(i, min(j, i + STARS - first))]
                for k, (node, mark) in enumerate(centres):
                    rows = np.arange(max(i, i + k + 1 - first), j)
                    rows = rows[alike(seen[rows], mark) >= LIKELY]
                    a.append(np.full(len(rows), node))
                    b.append(nodes[rows])
            yield _pairs(a, b)

    dealt = members.repartition("bucket").sortWithinPartitions("bucket", F.xxhash64("node", "bucket"), "node")
    return dealt.select("bucket", "node", "sketch").mapInArrow(run, "a long, b long").distinct()


def rest_pairs(labelled: DataFrame) -> DataFrame:
    """(a, b) of any two texts of one bucket (bucket, node, root, keys, sketch) that have different roots, where the sketches are alike.

    A pair that shares several buckets comes from the first of them only: all of them hold several roots.
    """
    names = ["node", "root", "keys", "sketch"]
    by_root = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "root")).alias("x")
    of_bucket = by_root.groupBy("bucket").agg(most, (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    of_bucket = of_bucket.select("bucket", F.col("x.root").alias("main"), F.ceil(F.col("x.n") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("others") / BLOCK).cast("int").alias("tiles"))
    met = labelled.join(of_bucket, "bucket").withColumn("_h", F.xxhash64("node"))
    spot = lambda n: F.pmod("_h", F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    major = met.where("root = main").select("bucket", upto("tiles").alias("t"), spot("parts").alias("p"), F.lit(1).alias("side"), *names)
    minor = met.where("root <> main").withColumn("t", spot("tiles"))
    left = minor.select("bucket", "t", upto("parts").alias("p"), F.lit(0).alias("side"), *names)
    among = minor.select("*", upto("tiles").alias("u")).select("bucket", F.least("t", "u").alias("t"), (-1 - F.greatest("t", "u")).alias("p"), F.lit(0).alias("side"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def found(block: pa.RecordBatch) -> pa.RecordBatch:
            side, nodes, roots = (block.column(i).to_numpy() for i in (3, 4, 5))
            keys = np.frombuffer(b"".join(block.column(6).to_pylist()), np.int64).reshape(-1, BANDS)
            bucket, seen, a, b = block.column(0)[0].as_py(), _bytes(block.column(7)), [], []
            against = np.flatnonzero(side == 1) if side.any() else np.arange(len(side))
            for i in np.flatnonzero(side == 0):
                to = against if side.any() else against[i + 1 :]
                to = to[roots[to] != roots[i]]
                to = to[alike(seen[to], seen[i]) >= LIKELY]
                shared = keys[to] == keys[i]
                to = to[keys[to, shared.argmax(1)] == bucket]
                a.append(np.full(len(to), nodes[i]))
                b.append(nodes[to])
            return _pairs(a, b)

        for batch in batches:
            yield from map(found, held.blocks(batch, 3))
        if held.key is not None:
            yield found(held.end())

    dealt = major.unionByName(left).unionByName(among).repartition("bucket", "t", "p").sortWithinPartitions("bucket", "t", "p")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, keyed: DataFrame, key: str, similarity: float, shingle: int) -> DataFrame:
    """Of the pairs (a, b) those whose shingles are that similar."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(byte_words(t.as_py()), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(both / (len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = written(keyed.select(key, "text").join(needed, key, "left_semi").mapInArrow(cut, "node long, set binary"), "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("set").alias(f"set_{name}"))
    links = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(hold, "a long, b long"), "links")
    dropped(pairs, sets)
    return links


def rooted(docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, str, DataFrame]:
    """docs with a key of each row, written; the key's name; and (row, root) of every row, written."""
    key = free_names(docs, "row")[0]
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    same_prints = alike_rows(keyed, key)
    released(docs.sparkSession)
    sketched = written(sketches(keyed, key, shingle), "sketches")
    first = sketched.groupBy("copy_of").agg(F.min("row").alias("node"))
    rows = written(sketched.select("row", "copy_of").join(first, "copy_of").select("row", "node"), "rows")
    nodes = written(sketched.join(rows.where("row = node").select("row"), "row", "left_semi").select(F.col("row").alias("node"), F.explode("buckets").alias("bucket")), "buckets")
    several = nodes.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    members = nodes.join(several, "bucket", "left_semi").join(sketched.select(F.col("row").alias("node"), "keys", "sketch"), "node")
    members = written(members.select("bucket", "node", "keys", "sketch"), "members")
    by_print = same_prints.join(rows.where("row = node").select(F.col("row").alias("b")), "b", "left_semi").select("a", "b")  # a, a component's least row, is a node
    near = components(verified(star_pairs(members), keyed, key, similarity, shingle).unionByName(by_print))
    labelled = written(members.join(near, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), "keys", "sketch"), "labelled")
    more = verified(rest_pairs(labelled), keyed, key, similarity, shingle)
    root_of = lambda name: near.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    joined = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    far = components(joined).withColumnsRenamed({"node": "_x", "root": "_far"})
    at = rows.join(near, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    roots = written(at.join(far, F.col("root") == F.col("_x"), "left").select("row", F.coalesce("_far", "root").alias("root")), "roots")
    dropped(same_prints, sketched, rows, nodes, members, labelled)
    released(docs.sparkSession)
    return keyed, key, roots


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, component_id (least id reachable)."""
    keyed, key, roots = rooted(docs, similarity, shingle)
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(roots, "row")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return ids.join(least, "root").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component, with docs' own columns."""
    keyed, key, roots = rooted(docs, similarity, shingle)
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("_id")).join(roots, "row")
    stay = ids.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "row")).alias("x")).select(F.col("x.row").alias(key))
    return keyed.join(stay, key, "left_semi").select(*docs.columns)
