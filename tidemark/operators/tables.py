"""Tables in the folder that driver and executors share, and groups of rows that are linked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session (tests) gets a temporary folder, and a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def free_mark(*tables: DataFrame) -> str:
    """A beginning of names that no column of the tables has, in any case of letters."""
    taken, mark = {c.lower() for t in tables for c in t.columns}, "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return mark


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tidemark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _pointing_at_least(links: DataFrame, smaller: bool) -> DataFrame:
    """Each node's links moved to the least of the node and its neighbours: those to lesser nodes, or those to greater ones."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.where("b < a") if smaller else both
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    moved = met.select("m", F.col("b").alias("x")).unionByName(least.select("m", F.col("a").alias("x"))) if smaller else met.where("b > a").select("m", F.col("b").alias("x"))
    return moved.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the least node that links lead to) for every node of edges (a, b); the rounds grow with the logarithm of the longest chain."""
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last, links = now, written(_pointing_at_least(_pointing_at_least(links, False), True), "links")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def linked(rows: DataFrame, tokens: Column) -> DataFrame:
    """rows with group (a number): rows that share tokens, directly or through others, have one group.

    Tokens are linked, not rows: a row links its first token to its others, so a token that many rows
    hold is one node. Every row needs a token. Two tokens that share a 64-bit hash only make one group of two.
    """
    hashed, m = F.transform(tokens, lambda t: F.xxhash64(t)), free_mark(rows)
    own = rows.withColumn(f"{m}tokens", F.array_distinct(hashed))
    own = own.withColumn(f"{m}first", F.get(f"{m}tokens", F.lit(0)))
    edges = own.select(F.col(f"{m}first").alias("a"), F.explode(f"{m}tokens").alias("b")).where("a <> b")
    found = roots(edges).select(F.col("node").alias(f"{m}node"), F.col("root").alias(f"{m}root"))
    met = own.join(found, F.col(f"{m}first") == F.col(f"{m}node"), "left")
    return met.select(*rows.columns, F.coalesce(f"{m}root", f"{m}first").alias("group"))
