"""Small state tables kept together: bucketed alike by id, changed in one commit, read as of the last one.

A commit writes the buckets that it changes as new files, then publishes one small manifest that names every bucket's
files; until that file is there the commit has not happened, so one that fails half way leaves all tables as they were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    """Tables (name to schema), each with a column id, under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.tables, self.buckets = spark, path, tables, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit, -1 before any."""
        found = self._fs.globStatus(self._path(f"{self.path}/manifest/*.json")) or []
        return max((int(f.getPath().getName()[:-5]) for f in found), default=-1)

    def _manifest(self, version: int) -> dict[str, dict[str, str]]:
        if version < 0:
            return {name: {} for name in self.tables}
        (text,) = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{version}.json").first()
        return json.loads(text)

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).parquet(*(f"{self.path}/{f}" for f in folders))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit (the last), from its buckets' files."""
        return self._read(name, sorted(set(self._manifest(self.version() if version is None else version)[name].values())))

    def bucket(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def commit(self, ids: DataFrame, change: dict[str, Callable[[DataFrame], DataFrame]]) -> int:
        """Apply each change to its table's rows in the buckets of ids, and publish all of them as one; the commit's number.

        A change gets the rows of those buckets, and may add or drop rows of ids only. Raises Conflict if another commit was published meanwhile.
        """
        version = self.version()
        manifest = self._manifest(version)
        touched = sorted(r[0] for r in ids.select(self.bucket(F.col("id"))).distinct().collect())  # at most `buckets`
        tag = uuid.uuid4().hex[:12]
        for name, apply in change.items():
            folders = [manifest[name][str(b)] for b in touched if str(b) in manifest[name]]
            rows = apply(self._read(name, folders)).withColumn("_bucket", self.bucket(F.col("id")))
            rows.repartition(len(touched) or 1, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}/{tag}")
            there = self._fs.globStatus(self._path(f"{self.path}/data/{name}/{tag}/_bucket=*")) or []
            now = {f.getPath().getName().split("=")[1] for f in there}
            manifest[name] = {b: f for b, f in manifest[name].items() if int(b) not in touched} | {b: f"data/{name}/{tag}/_bucket={b}" for b in now}
        self._publish(version + 1, manifest)
        return version + 1

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest under its number, which no other may hold: written aside, then renamed."""
        aside = self._path(f"{self.path}/manifest/.{version}-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"{self.path}/manifest/{version}.json")
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} is taken")

    def insert_absent(self, name: str, new: DataFrame) -> int:
        """Rows of new whose id the table doesn't have."""
        return self.commit(new.select("id"), {name: lambda old: old.unionByName(new.join(old.select("id"), "id", "left_anti"))})

    def upsert(self, name: str, new: DataFrame) -> int:
        return self.commit(new.select("id"), {name: lambda old: old.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)})

    def delete(self, ids: DataFrame) -> int:
        """Drop ids from all tables in one commit."""
        gone = ids.select("id").distinct()
        return self.commit(gone, {name: lambda old: old.join(gone, "id", "left_anti") for name in self.tables})
