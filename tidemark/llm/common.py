"""What the training-data operators share: scratch tables, text helpers, ranks, components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster must set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/tidemark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """The mount path of a shared folder given as a path or a file: address."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: memory-mapped files need a folder mounted on every machine")
    return parts.path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables from written() that no result still to be computed reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more; long iterations would heap them up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once no result that reads them is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/tidemark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for temporary use that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def content_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all of a row's columns; those that hold maps, which have no hash, go in as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema)) if df.columns else F.lit(0).cast("long")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII takes the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def byte_words(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased, in UTF-8; bytes.split() and bytes.lower() know ASCII only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def rank_within(df: DataFrame, keys: list[str], order: list[Column], n_rows: int, block_rows: int = 20_000, ties: list[Column] | None = None) -> DataFrame:
    """Add rank (from 0, gapless) within equal keys, without bringing a key's rows together.

    Rows are dealt to hash blocks of about block_rows over the whole table; a rank is the place in
    the block plus the prefix sum of the key's earlier blocks. The order is by block, then order, then ties.
    """
    blocks = max(1, math.ceil(n_rows / block_rows))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(blocks)))
    by_block = Window.partitionBy(*keys, "_block").orderBy(*order, *(ties or []))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
        .select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_b"),
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ) if blocks > 1 else None
    ranked = dealt.withColumn("rank", F.row_number().over(by_block).cast("long") - 1)
    if bases is None:
        return ranked.drop("_block")
    match = F.col("_block") == F.col("_b")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return ranked.join(bases, match).withColumn("rank", F.col("rank") + F.col("_base")).drop("_block", "_b", "_base", *(f"_k_{k}" for k in keys))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) links: node, root, root being the least node reachable.

    Alternating large-star and small-star rounds; each round's links are a table in the shared
    folder. Nothing but a count and a checksum of a round reaches the driver.
    """
    def star(links: DataFrame, larger_only: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if larger_only:  # small star: a node and its smaller neighbours point at the least of them
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if larger_only:
            out = joined.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        else:
            out = joined.where("b > a").select(F.col("b").alias("x"), "m")
        return out.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()

    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:  # each round brings some node a lesser root; in practice the rounds grow with the logarithm of the nodes
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        links = written(star(star(links, False), True), "links")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
