"""Exact dedup: group by a 128-bit content hash, compare bytes, keep the largest document id.

Native: DataFrame functions only. Texts are equal when they are identical after lower-casing A-Z.
Defined cases: a null text counts as empty; a null id never wins while the group has another id;
rows repeated with one id and one text stay once, the one with the least hash of all columns; texts of
any length are hashed and compared whole; extra columns of any name or type play no other part and stay;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import content_hash, free_names, lower_az, text_of

HASH, DIGEST = "_hash128", "text_sha256"


def _hashed(docs: DataFrame) -> DataFrame:
    normal = lower_az(text_of())
    return docs.withColumn("_normal", normal).withColumn(HASH, F.unhex(F.md5("_normal"))).withColumn(DIGEST, F.sha2("_normal", 256))


def classes(docs: DataFrame) -> DataFrame:
    """One row per distinct text: _hash128, text_sha256, keep_id, group_size.

    Grouping by (hash, text) compares the bytes of a hash's texts, and the partial aggregate has
    folded a task's copies into one row before anything is shuffled. The digest tells the classes of
    a colliding hash apart; should both hashes collide, the query fails instead of merging texts.
    """
    own = _hashed(docs.select("doc_id", "text")).groupBy(HASH, "_normal").agg(F.max("doc_id").alias("_max"), F.count("*").alias("_n"))
    own = own.select(HASH, F.sha2("_normal", 256).alias(DIGEST), "_max", "_n")
    met = own.groupBy(HASH, DIGEST).agg(F.max("_max").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_texts"))
    same = F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")).otherwise(F.col("group_size"))
    return met.select(HASH, DIGEST, "keep_id", same.alias("group_size"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are folded by (text, id) first, so that repeated rows cannot heap up, and only hashes and
    ids meet the classes; a hot class's side of that join can be split.
    """
    rows = _hashed(docs.select("doc_id", "text")).groupBy(HASH, DIGEST, "doc_id").agg(F.count("*").alias("_copies"))
    joined = rows.join(classes(docs), [HASH, DIGEST])
    copies = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), DIGEST)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    hash_, digest, nth = free_names(docs, "hash", "digest", "nth")
    stay = classes(docs.select("doc_id", "text")).select(F.col(HASH).alias("_h"), F.col(DIGEST).alias("_d"), F.col("keep_id").alias("_keep"))
    stay = stay.withColumnsRenamed(dict(zip(("_h", "_d", "_keep"), kept := free_names(docs, "stay_hash", "stay_digest", "stay_id"), strict=True)))
    normal = lower_az(text_of())
    hashed = docs.withColumns({hash_: F.unhex(F.md5(normal)), digest: F.sha2(normal, 256)})
    same = (F.col(hash_) == F.col(kept[0])) & (F.col(digest) == F.col(kept[1])) & F.col("doc_id").eqNullSafe(F.col(kept[2]))
    once = Window.partitionBy(hash_, digest, "doc_id").orderBy(content_hash(docs))
    return hashed.join(stay, same, "left_semi").withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*docs.columns)
