"""Document fingerprints: a Merkle tree over sections and paragraphs.

Sections are split at blank lines, paragraphs at line ends. A paragraph longer than a few dozen
words is split on at words chosen by their own hash, so that an edit moves no boundary but those it
touches. Leaves hash their exact bytes, separators included; a node hashes its children's digests.
Equal texts have equal roots, and descending only into branches that differ locates an edit.

The fingerprint string is the root, then for each leaf its digest and its length in code points: the
tree is rebuilt from it without the text. Likeness of two fingerprints is the share of code points
in leaves that both have (each as often as both have it), of the longer text's code points; 1 for
equal roots. Defined cases: null text is empty and two empty texts are equal; repeated ids are
ordered by a hash of the text; null ids come first; texts of any length are read whole; extra columns play
no part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import text_of

LEAF_WORDS, ROOT_BYTES, LEAF_BYTES = 8, 16, 5
SECTION, PARAGRAPH, WORD = re.compile(r".*?(?:\n[ \t]*\n+|\Z)", re.S), re.compile(r"[^\n]*\n+|[^\n]+\Z"), re.compile(r"\S*\s+|\S+\Z")


def leaves_of(paragraph: str) -> list[str]:
    """A paragraph's leaves: cut after words whose hash says so, after 4 * LEAF_WORDS at the latest."""
    words = WORD.findall(paragraph)
    if len(words) <= LEAF_WORDS:  # pairs, so that a short text's parts can be told apart
        return ["".join(words[i : i + 2]) for i in range(0, len(words), 2)]
    out, first = [], 0
    for i, word in enumerate(words):
        if xxh32_intdigest(word) % LEAF_WORDS == 0 or i - first >= 4 * LEAF_WORDS:
            out.append("".join(words[first : i + 1]))
            first = i + 1
    if first < len(words):
        out.append("".join(words[first:]))
    return out


def _digest(data: bytes, size: int) -> bytes:
    return blake2b(data, digest_size=size).digest()


def tree(text: str) -> list[list[list[tuple[str, int]]]]:
    """Sections of paragraphs of leaves; a leaf is its digest in hex and its length."""
    return [
        [[(_digest(leaf.encode("utf-8", "replace"), LEAF_BYTES).hex(), len(leaf)) for leaf in leaves_of(p)] for p in PARAGRAPH.findall(section)]
        for section in SECTION.findall(text) if section
    ]


def root(sections: list, text: str) -> str:
    """Nodes hash their children; the root also takes the whole text's length and hash, so equality is of texts."""
    nodes = [_digest(b"s" + b"".join(_digest(b"p" + "".join(d for d, _ in p).encode(), ROOT_BYTES) for p in s), ROOT_BYTES) for s in sections]
    return _digest(b"".join(nodes) + sha256(text.encode("utf-8", "replace")).digest(), ROOT_BYTES).hex()


def fingerprint(text: str) -> str:
    """root/section|section..., paragraphs by ';', leaves by ',' as digest and length in base 16."""
    sections = tree(text)
    return root(sections, text) + "/" + "|".join(";".join(",".join(f"{d}{n:x}" for d, n in p) for p in s) for s in sections)


def _leaves(print_: str) -> Counter:
    return Counter(x for x in re.split("[,;|]", print_.partition("/")[2]) if x)


def likeness(a: str, b: str) -> float:
    """Share of code points in leaves that both fingerprints have, of the longer text's."""
    if a[: 2 * ROOT_BYTES] == b[: 2 * ROOT_BYTES]:
        return 1.0
    x, y = _leaves(a), _leaves(b)
    length = lambda leaves: sum(int(k[2 * LEAF_BYTES :], 16) * n for k, n in leaves.items())
    most = max(length(x), length(y))
    return length(x & y) / most if most else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of every paragraph of a that b's section at that place doesn't hold."""
    there = [s.split(";") for s in b.partition("/")[2].split("|")]
    out = []
    for i, section in enumerate(a.partition("/")[2].split("|")):
        if i < len(there) and section == ";".join(there[i]):
            continue  # equal branches aren't descended into
        known = set(there[i]) if i < len(there) else set()
        out += [(i, j) for j, p in enumerate(section.split(";")) if p not in known]
    return out


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as much of the following text's start."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over partitions in id order, each ended by a copy of the row that follows it (own = false)."""
    held = None
    for batch in batches:
        out = []
        for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = text.as_py()
            now = (doc_id, text, fingerprint(text))
            if held is not None:
                before = edited(held[1], text)
                changed = fingerprint(before)
                out.append((held[0], len(held[1]), sha256(before.encode("utf-8", "replace")).hexdigest(), held[2], changed, likeness(held[2], changed), likeness(held[2], now[2])))
            held = now if own else None
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def compared(docs: DataFrame, rows_per_range: int = 4000, most_ranges: int = 50_000) -> DataFrame:
    """Every row's fingerprint against its edited text's and the next row's, by ascending id.

    Ranges are cut at id quantiles, read from the ids alone. An id (or null) that has more rows than a range
    is a range by itself, cut on by the hash that orders its rows. A range's least row also goes, marked as a
    copy, to the range before it (the first's to the last), so that no range waits for another. The driver
    holds a row for each range, some most_ranges at most (so ranges grow from that many times rows_per_range
    rows on); ranges are sorted by Spark, which spills, and read as they come.
    """
    from pyspark.ml.feature import Bucketizer

    spark, ids = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("_i"))
    total = ids.count()
    each = max(rows_per_range, -(-total // most_ranges))
    n = -(-total // each)
    cuts = set(ids.select(F.col("_i").cast("double").alias("_i")).approxQuantile("_i", [i / n for i in range(1, n)], 0.2 / n)) if n > 1 else set()
    heavy = [(r["_i"], -(-r["n"] // each)) for r in ids.groupBy("_i").agg(F.count("*").alias("n")).where(F.col("n") > each).collect() if r["_i"] is None or abs(r["_i"]) < 2**53]
    cuts |= {float(i + k) for i, _ in heavy if i is not None for k in (0, 1)}
    dealer = Bucketizer(splits=[float("-inf"), *(sorted(cuts) or [0.0]), float("inf")], inputCol="_id", outputCol="_bucket", handleInvalid="keep")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("doc_id").cast("double").alias("_id"))
    dealt_to = F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_bucket").cast("int") + 1)
    rows = dealer.transform(rows).select("doc_id", "text", F.xxhash64("text").alias("_tie"), dealt_to.alias("_bucket"))
    parts = spark.createDataFrame(heavy, "_h long, _parts int")
    rows = rows.join(F.broadcast(parts), F.col("doc_id").eqNullSafe(F.col("_h")), "left")  # at most a row for each range
    part = F.floor((F.col("_tie").cast("double") / 2.0**64 + 0.5) * F.col("_parts"))  # in the order of _tie
    rows = rows.withColumn("_part", F.coalesce(F.least(part, F.col("_parts") - 1), F.lit(0)).cast("int")).drop("_h", "_parts")
    least = F.min(F.struct("doc_id", "_tie")).alias("x")  # nulls are least
    firsts = sorted((r["_bucket"], r["_part"], r["x"]["doc_id"], r["x"]["_tie"]) for r in rows.groupBy("_bucket", "_part").agg(least).collect())
    if not firsts:
        return spark.createDataFrame([], RESULT)
    heads = spark.createDataFrame([(b, p, d, t, i, (i - 1) % len(firsts)) for i, (b, p, d, t) in enumerate(firsts)], "_b int, _p int, _d long, _t long, _range int, _before int")
    ranged = rows.join(F.broadcast(heads), (F.col("_bucket") == F.col("_b")) & (F.col("_part") == F.col("_p")))
    at_head = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_tie") == F.col("_t"))
    copies = ranged.where(at_head).dropDuplicates(["_range"]).select("doc_id", "text", "_tie", F.col("_before").alias("_range"), F.lit(False).alias("_own"))
    dealt = ranged.select("doc_id", "text", "_tie", "_range", F.lit(True).alias("_own")).unionByName(copies).repartitionById(len(firsts), F.col("_range"))
    return dealt.sortWithinPartitions(F.desc("_own"), "doc_id", "_tie").select("doc_id", "text", "_own").mapInArrow(_compare, RESULT)
