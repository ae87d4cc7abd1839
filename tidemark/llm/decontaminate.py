"""Benchmark decontamination: a prefix-filtered join of benchmark windows with the documents' shingles.

Native: DataFrame functions only. A window is WINDOW consecutive words of an item (all of them, if it has fewer).
It can occur in a text only where all of its shingles of SHINGLE words do, so its rarest one is a sufficient
prefix: shingles are counted over all documents, each window joins by its rarest, windows with one that never
occurs drop out, and what joins is held to length and position before the window's words are compared
themselves. Windows are taken in blocks of at most about BLOCK_BYTES, each sent to every task, so no document
word is shuffled; a larger benchmark only makes more blocks.

Words and positions are those of the text with A-Z lower-cased. Texts stand for their copies by MD5: matches of
equal texts fold into one before they meet.

Defined cases: null and empty texts have no words, and items without words no windows; a text may be of any
length; equal items count as one where they share an id, a null id counting as an empty one; repeated and null
document ids keep a row each; other columns are not read (decontaminated keeps them); an empty benchmark hits
nothing, and no documents give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, free_names, lower_az, text_of, written

WINDOW, SHINGLE = 10, 3
#: What stands between words, once A-Z are lower-cased: a word is a run of digits, letters and all beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows (or shingles) that one pass over the documents looks for.
BLOCK_BYTES = 24 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(text), BETWEEN), "")


def text_key(text: Column) -> Column:
    """What stands for all texts that are equal once lower-cased."""
    return F.unhex(F.md5(lower_az(text)))


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(k)))


def benchmark_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id (text), wid, window (its words), length, k (words a shingle) of every window of every item, each once."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(text_of()).alias("_words")).where(F.size("_words") > 0)
    starts = own.select("item_id", "_words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_words") - window + 1, F.lit(1)))).alias("_at"))
    cut = starts.select("item_id", F.slice("_words", F.col("_at"), window).alias("window"))
    return cut.select("item_id", F.md5(F.concat_ws(" ", "window")).alias("wid"), "window", F.size("window").alias("length"), F.least(F.size("window"), F.lit(shingle)).alias("k")).distinct()


def _at_words(docs: DataFrame, k: int) -> DataFrame:
    """_key, _words, _at, token: a row for each place where a shingle of k words begins. The words are not copied while the stage runs."""
    own = docs.select(text_key(text_of()).alias("_key"), words_of(text_of()).alias("_words"))
    # outer: else Spark infers a filter on the words' number and cuts every text once more for it
    placed = own.select("_key", "_words", F.posexplode_outer("_words").alias("_at", "_word")).where(F.col("_at") + k <= F.size("_words"))
    return placed.select("_key", "_words", "_at", _shingle(F.col("_words"), F.col("_at"), k).alias("token"))


def _blocks(table: DataFrame, size: Column, deal: str, block_bytes: int) -> list[DataFrame]:
    """table in blocks of about block_bytes, dealt by a hash; each may be broadcast."""
    blocks = max(1, math.ceil((table.agg(F.sum(size)).first()[0] or 0) / block_bytes))
    return [table.where(F.pmod(F.xxhash64(deal, F.lit(5)), F.lit(blocks)) == b) for b in range(blocks)]


def _kinds(table: DataFrame) -> list[int]:
    return sorted(r[0] for r in table.select("k").distinct().collect())  # at most SHINGLE


def prefixes(docs: DataFrame, windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """wid, window, length, k, token, offset: each window with the rarest of its shingles over docs; none whose shingles don't all occur."""
    once = windows.select("wid", "window", "length", "k").distinct()
    parts = []
    for k in _kinds(once):
        of_k = once.where(F.col("k") == k)
        placed = of_k.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("offset"))
        parts.append(placed.select("*", _shingle(F.col("window"), F.col("offset"), k).alias("token")))
    placed = written(reduce(DataFrame.unionByName, parts), "shingles")
    tokens = written(placed.groupBy("k", "token").agg(F.count("*").alias("n")), "tokens")
    counted = []
    for block in _blocks(tokens, F.lit(64), "token", block_bytes):
        for k in _kinds(block):
            sought = F.broadcast(block.where(F.col("k") == k).select("token"))  # at most block_bytes
            counted.append(_at_words(docs, k).select("token").join(sought, "token").groupBy("token").agg(F.count("*").alias("seen")).withColumn("k", F.lit(k)))
    counts = reduce(DataFrame.unionByName, counted)
    ranked = placed.join(counts, ["k", "token"], "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset", "window", "length", "k")).alias("p"))
    out = written(ranked.where("p.seen > 0").select("wid", "p.window", "p.length", "p.k", "p.token", "p.offset"), "prefixes")
    dropped(placed, tokens)
    return out


def occurrences(docs: DataFrame, sought: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_key, start (from 0), length, wid of every place in a distinct text of docs where a window of prefixes() occurs."""
    size = F.octet_length(F.concat_ws(" ", "window")) + 32 * F.col("length") + 128
    found = []
    for block in _blocks(sought, size, "wid", block_bytes):
        for k in _kinds(block):
            asked = F.broadcast(block.where(F.col("k") == k).select("wid", "window", "length", "token", "offset"))  # at most about block_bytes
            begin = F.col("_at") - F.col("offset")
            fits = (begin >= 0) & (begin + F.col("length") <= F.size("_words"))
            same = F.slice("_words", F.greatest(begin, F.lit(0)) + 1, F.col("length")) == F.col("window")
            met = _at_words(docs, k).join(asked, "token").where(fits).where(same)
            found.append(met.select("_key", begin.alias("start"), "length", "wid"))
    if not found:
        return docs.select(text_key(text_of()).alias("_key"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("wid")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found).distinct()


def merged_spans(found: DataFrame) -> DataFrame:
    """_key, start, stop, fresh: the occurrences of a text in order, fresh being how many of their words no earlier one covers."""
    ends = found.groupBy("_key", "start").agg((F.col("start") + F.max("length")).alias("stop"))
    before = Window.partitionBy("_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # of one text, as long as its words
    covered = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    return ends.select("_key", "start", "stop", F.greatest(F.col("stop") - covered, F.lit(0)).alias("fresh"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Occurrences (_key, start, length, wid) as a table, and which items have which window (wid, item_id)."""
    windows = written(benchmark_windows(items, window, shingle), "windows")
    if windows.isEmpty():
        return occurrences(docs, windows, block_bytes), windows.select("wid", "item_id")
    sought = prefixes(docs, windows, block_bytes)
    return written(occurrences(docs, sought, block_bytes), "occurrences"), windows.select("wid", "item_id")


def _by_text(found: DataFrame, holders: DataFrame) -> DataFrame:
    """_key, n_hit, items (sorted ids) of each distinct text with an occurrence."""
    hits = merged_spans(found).groupBy("_key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = found.select("_key", "wid").distinct().join(holders, "wid").groupBy("_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return hits.join(named, "_key")


def contamination(docs: DataFrame, items: DataFrame, **how: int) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    by_text = _by_text(*matches(docs, items, **how)).select("_key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    rows = docs.select("doc_id", text_key(text_of()).alias("_key"), F.size(words_of(text_of())).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return rows.join(by_text, "_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def spans(docs: DataFrame, items: DataFrame, **how: int) -> DataFrame:
    """doc_id, start, stop (word positions, stop excluded) of the stretches of hit words of each row of docs; stretches that touch are one."""
    parts = merged_spans(matches(docs, items, **how)[0])
    order = Window.partitionBy("_key").orderBy("start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("_run", F.sum((F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int")).over(order))
    runs = opened.groupBy("_key", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return docs.select("doc_id", text_key(text_of()).alias("_key")).join(runs, "_key").select("doc_id", "start", "stop")


def decontaminated(docs: DataFrame, items: DataFrame, **how: int) -> DataFrame:
    """The rows of docs, with docs' own columns, of texts that no window occurs in."""
    (key,) = free_names(docs, "key")
    hit = matches(docs.select("text"), items, **how)[0].select(F.col("_key").alias(key)).distinct()
    return docs.withColumn(key, text_key(text_of())).join(hit, key, "left_anti").select(*docs.columns)
