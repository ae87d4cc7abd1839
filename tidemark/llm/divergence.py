"""Source divergence audit: how each source of a language differs from the others and from the language, by exact term shares.

Shares: a language keeps the V terms that at least LEAST_DOCS of its documents hold; a group (language, source), and
the language, gives each kept term p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), all in whole numbers.

Systolic rotation: a language's kept terms are dealt to chunks of about CHUNK, its groups to blocks of about BLOCK.
In each chunk a block's sparse vectors (places, shares, and the share of all other places) are resident, and the
vectors of the other blocks come by in rounds of a tournament: in round r block i meets block (r - i) mod the number of
blocks, so every two blocks, and every block with itself, meet once; a meeting gives the differences for both
directions. ROUNDS rounds make one job, whose tables lie in the shared folder. A task holds one block and the
vectors that ROUNDS rounds bring it, in one chunk. The language's own vector makes the round too: there each
group keeps a heap of its TOP terms of the chunk, and only heaps meet for the last ranking.

Defined cases: null text, lang and source count as ''; a group whose documents have no kept term, or no term, has
the shares of count 0; a language without kept terms gives pairs of value 0 and no terms; a source alone in its
language has no pairs. Equal values are ranked by the item's UTF-8 bytes. Repeated rows each count; doc_id and other
columns are not read; no documents give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, lower_az, text_of, written

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
CHUNK, BLOCK, ROUNDS = 4096, 16, 8
#: What stands between terms: all ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A table of kept terms up to this size is sent to every task.
BROADCAST_BYTES = 16 << 20
FOUND = "lang string, source string, part string, item string, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) for every group and term; a null term for texts without any.

    A text's words are sorted, so a word is its document's first where the one before it differs: one pass counts both.
    """
    words = F.sort_array(F.array_remove(F.split(lower_az(text_of()), BETWEEN), ""))
    told = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), words.alias("_words"))
    placed = told.select("lang", "source", "_words", F.posexplode_outer("_words").alias("_at", "term"))
    first = (F.col("_at") == 0) | (F.get("_words", F.col("_at") - 1) != F.col("term"))
    return placed.select("lang", "source", "term", first.cast("int").alias("_first")).groupBy("lang", "source", "term").agg(F.count("term").alias("n"), F.sum("_first").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS, chunk: int = CHUNK) -> DataFrame:
    """lang, term, chunk, pos (its place in the chunk, by UTF-8) of the kept terms."""
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    kept = written(kept, "kept")
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = kept.join(sizes, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), "chunks").cast("int").alias("chunk"))
    out = written(dealt.withColumn("pos", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1), "terms")
    dropped(kept)
    return out


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH v)), beyond 64 bits too; 0 if there are no terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = wide(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTH * v)
    return F.when(v > 0, F.call_function("div", over, F.nullif(under, wide(F.lit(0)))) + 1).otherwise(F.lit(0).cast("long"))


def vectors(counts: DataFrame, terms: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The groups' vectors and the languages' (own is false: all places, with their terms), a row for each chunk."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    held = F.broadcast(terms) if size <= BROADCAST_BYTES else terms
    cells = written(counts.join(held, ["lang", "term"]).select("lang", "source", "chunk", "pos", "n"), "cells")
    chunks = terms.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"), F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("_t")).select("lang", "chunk", "width", F.col("_t.term").alias("terms"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"))
    groups = counts.select("lang", "source").distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = groups.join(blocks, "lang").join(of_lang, "lang", "left").join(sums, ["lang", "source"], "left").select(
        "lang", "source", "blocks", F.coalesce("v", none).alias("v"), F.coalesce("total", none).alias("total"))
    groups = written(groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), "groups")
    # a language without kept terms has one chunk without places
    spread = groups.join(chunks.select("lang", "chunk", "width"), "lang", "left").withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "width": F.coalesce("width", F.lit(0))})
    sparse = cells.join(groups.select("lang", "source", "v", "total"), ["lang", "source"]).groupBy("lang", "source", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("pos", _share(F.col("n"), F.col("total"), F.col("v")).alias("p")))).alias("_c"))  # at most a chunk's places
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    own = spread.join(sparse, ["lang", "source", "chunk"], "left").select(
        "lang", "chunk", "block", "source", F.lit(True).alias("own"), "width", _share(none, F.col("total"), F.col("v")).alias("p0"),
        F.coalesce(F.col("_c.pos"), empty("int")).alias("pos"), F.coalesce(F.col("_c.p"), empty("long")).alias("p"), empty("string").alias("terms"), "blocks")
    by_lang = groups.groupBy("lang", "blocks", "v").agg(F.sum("total").alias("total"))
    whole = cells.groupBy("lang", "chunk", "pos").agg(F.sum("n").alias("n")).join(by_lang, "lang")
    whole = whole.groupBy("lang", "chunk", "blocks").agg(F.sort_array(F.collect_list(F.struct("pos", _share(F.col("n"), F.col("total"), F.col("v")).alias("p")))).alias("_c"))
    language = whole.join(chunks, ["lang", "chunk"]).select(
        "lang", "chunk", F.lit(-1).alias("block"), F.lit("").alias("source"), F.lit(False).alias("own"), "width", F.lit(0).cast("long").alias("p0"),
        F.col("_c.pos").alias("pos"), F.col("_c.p").alias("p"), "terms", "blocks")
    out = written(own, "vectors"), written(language, "language")
    dropped(cells, groups)
    return out


def _dense(table: pa.Table, i: int) -> np.ndarray:
    row = np.full(table["width"][i].as_py(), table["p0"][i].as_py(), np.int64)
    row[table["pos"][i].values.to_numpy(zero_copy_only=False)] = table["p"][i].values.to_numpy(zero_copy_only=False)
    return row


def top_terms(shares: np.ndarray, places: np.ndarray, language: np.ndarray, terms: pa.Array, k: int) -> list[tuple[int, int]]:
    """(value, place) of the k places, of those given, where the group's share is most above the language's; ties by place, the terms' order."""
    over = places[shares[places] > language[places]]
    return heapq.nsmallest(k, zip((language[over] - shares[over]).tolist(), over.tolist(), strict=True))


def meeting(top: int):
    """What a block and those that come by give: differences for both directions, and each group's heap where the language comes."""

    def meet(residents: pa.Table, peers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("lang", "source", "part", "item", "value")}

        def tell(*row: object) -> None:
            for c, v in zip(out.values(), row, strict=True):
                c.append(v)

        if residents.num_rows:
            lang, names = residents["lang"][0].as_py(), residents["source"].to_pylist()
            home, shares = residents["block"][0].as_py(), np.stack([_dense(residents, i) for i in range(residents.num_rows)])
            for j in range(peers.num_rows):
                other = _dense(peers, j)
                if peers["own"][j].as_py():
                    name, alike = peers["source"][j].as_py(), peers["block"][j].as_py() == home
                    values = np.abs(shares - other).sum(1).tolist()
                    for mine, value in zip(names, values, strict=True):
                        if not alike or mine < name:  # within a block every two meet once
                            tell(lang, mine, "pair", name, value)
                            tell(lang, name, "pair", mine, value)
                else:
                    terms = peers["terms"][j].values
                    for i, mine in enumerate(names):
                        places = residents["pos"][i].values.to_numpy(zero_copy_only=False)
                        for less, at in top_terms(shares[i], places, other, terms, top):
                            tell(lang, mine, "term", terms[at].as_py(), -less)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return meet


def rounds(own: DataFrame, language: DataFrame, top: int = TOP, at_once: int = ROUNDS) -> Iterator[DataFrame]:
    """The tournament, at_once rounds a table: FOUND, values by chunk."""
    names = [c for c in own.columns if c != "blocks"]
    most = own.agg(F.max("blocks")).first()[0] or 0
    for first in range(0, most, at_once):
        own_rounds = F.sequence(F.lit(first), F.least(F.lit(first + at_once), "blocks") - 1)
        coming = own.where(F.col("blocks") > first).select(*names, "blocks", F.explode(own_rounds).alias("round")).withColumn("home", F.pmod(F.col("round") - F.col("block"), "blocks").cast("int"))
        coming = coming.where("home <= block").select(*names, "home")  # the other one of the two stays at home
        if not first:
            coming = coming.unionByName(language.select(*names, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("home")))
        at_home = own.where(F.col("blocks") > first).select(*names, F.col("block").alias("home"))
        met = at_home.groupBy("lang", "chunk", "home").cogroup(coming.groupBy("lang", "chunk", "home")).applyInArrow(meeting(top), FOUND)
        yield written(met, "met")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK, at_once: int = ROUNDS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank (from 1 within lang, source and part)."""
    counts = written(term_counts(docs), "counts")
    terms = kept_terms(counts, least_docs, chunk)
    own, language = vectors(counts, terms, block)
    dropped(counts)
    met = list(rounds(own, language, top, at_once))
    dropped(own, language)
    if not met:
        return docs.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    found = reduce(DataFrame.unionByName, met).groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")  # other sources of a language, or heaps
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
