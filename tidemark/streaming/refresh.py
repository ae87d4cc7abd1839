"""The merge of two feeds over refreshes: versioned results that follow each other, fenced by the batch's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merge import greedy_merge

FEED = ["scope", "id", "key", "age", "days", "corrects", "place"]


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that are whole: a result counts once its folder has Spark's mark of success."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/result")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/result/version=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def result(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The latest whole result, or a version's: scope, id, feed, place (batch and place in it; null for base's rows)."""
    own = _versions(spark, path)
    version = version if version is not None else max(own, default=-1)
    return spark.read.parquet(f"{path}/result/version={version}") if version in own else None


def refresh(base: DataFrame, batch: DataFrame, number: int, path: str) -> DataFrame:
    """Merge base, the feed rows kept in earlier batches and this batch's, in this order; write version `number` and what it changed.

    Reads the version before `number` only, so a batch that runs again after a failure writes what it wrote, and a batch
    older than the latest version changes nothing. A row kept in one batch shuts out the same person in later ones; a
    correction stays in force while it is kept itself, also over a base that still has its target.
    """
    spark = base.sparkSession
    own = _versions(spark, path)
    if own and number < own[-1]:
        return spark.read.parquet(f"{path}/changes/batch={number}") if number in own else batch.limit(0)
    before = max((v for v in own if v < number), default=None)
    sent = batch.select(*FEED[:-1], F.struct(F.lit(number).cast("long").alias("batch"), F.col("place").cast("long").alias("place")).alias("place"))
    if before is not None:
        sent = spark.read.parquet(f"{path}/feed/version={before}").unionByName(sent)
    merged = greedy_merge(base.select(*FEED[:-2], F.col("place").cast("long").alias("place")).withColumn("place", F.struct(F.lit(-1).cast("long").alias("batch"), F.col("place"))), sent)
    kept = sent.join(merged.where("feed").select("scope", "place"), ["scope", "place"], "left_semi")
    kept.write.mode("overwrite").parquet(f"{path}/feed/version={number}")
    rows = merged.select("scope", "id", "feed", "place")
    rows.write.mode("overwrite").parquet(f"{path}/result/version={number}")  # with its mark of success the version counts
    now = spark.read.parquet(f"{path}/result/version={number}")
    keys = ["scope", "id", "feed", "place"]
    old = spark.read.parquet(f"{path}/result/version={before}") if before is not None else now.limit(0)
    changes = now.join(old, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(now, keys, "left_anti").withColumn("change", F.lit("removed")))
    changes.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
    return spark.read.parquet(f"{path}/changes/batch={number}")


def refreshes(source: DataFrame, base_path: str, path: str) -> object:
    """A stream of feed rows (FEED), each batch merged over the base table as it is then."""

    def each(batch: DataFrame, number: int) -> None:
        refresh(batch.sparkSession.read.parquet(base_path), batch, number, path)

    return source.writeStream.foreachBatch(each)
