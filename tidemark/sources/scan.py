"""Provinces as they answer: an outcome for each, and the last good copy where an answer is missing or broken."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.functions.text import slug
from tidemark.sources.feeds import PROVINCE_IN, flat, freshness, scan_status

ANSWER = "province string, code int, body string, fetched_ms long"
STATE = "province string, updated string, saved_ms long"


def file_answers(spark: SparkSession, provinces: DataFrame, folder: str, now_ms: int) -> DataFrame:
    """ANSWER for every row of provinces, from files named after them (folded) in a folder: 200 with the whole text, or 404 for no file."""
    own = provinces.select("province", slug(F.col("province")).alias("_code")).distinct()
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    texts = texts.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("_code"), F.col("value").alias("body"))
    met = own.join(texts, "_code", "left")
    return met.select("province", F.when(F.col("body").isNull(), 404).otherwise(200).alias("code"), "body", F.lit(now_ms).cast("long").alias("fetched_ms"))


def parsed(answers: DataFrame) -> DataFrame:
    """answers with province_in: what a good body holds, null if it isn't a JSON object."""
    whole = F.try_parse_json("body")
    good = (F.col("code") == 200) & F.startswith(F.schema_of_variant(whole), F.lit("OBJECT"))
    return answers.withColumn("province_in", F.when(good, F.from_json("body", PROVINCE_IN)))


def outcomes(answers: DataFrame, states: DataFrame) -> DataFrame:
    """province, status, sourced, updated (text), as_of for every answer; states: STATE of the last good copies.

    A good answer is ok. After any other the last good copy is shown, if there is one (cached); else 404 is a province without
    a source, no answer is offline, and a broken body or another code has failed. Only the last two leave nothing to merge into (sourced null).
    """
    saved = states.select("province", F.col("updated").alias("_u"), "saved_ms")
    met = parsed(answers).join(saved, "province", "left")
    good, cached = F.col("province_in").isNotNull(), F.col("saved_ms").isNotNull()
    code = F.when((F.col("code") == 200) & ~good, 500).otherwise(F.col("code"))
    status = scan_status(code, cached)
    updated = F.when(good, F.col("province_in.guncelleme")).when(cached, F.col("_u"))
    as_of = freshness(updated, F.when(good, F.col("fetched_ms")).otherwise(F.col("saved_ms")))
    sourced = F.when(status.isin("ok", "cached"), True).when(status == "no_source", False)
    return met.select("province", status.alias("status"), sourced.alias("sourced"), updated.alias("updated"), as_of.alias("as_of"))


def with_last_good(answers: DataFrame, copies: DataFrame, states: DataFrame) -> DataFrame:
    """Rows as feeds.flat has them, with status: those of good answers, and the copies' where the outcome is cached.

    copies: such rows with saved_ms; those of an older copy than the province's state are left out.
    """
    fresh = parsed(answers).where("province_in IS NOT NULL")
    fresh = flat(fresh.select(F.col("province_in").withField("il", F.col("province")).alias("p")).select("p.*")).withColumn("status", F.lit("ok"))
    shown = outcomes(answers, states).where("status = 'cached'").select("province")
    kept = copies.join(states.select("province", "saved_ms"), ["province", "saved_ms"], "left_semi").join(shown, "province", "left_semi").drop("saved_ms")
    return fresh.unionByName(kept.withColumn("status", F.lit("cached")))


def keep_good(answers: DataFrame, path: str) -> None:
    """Good answers as the provinces' last good copies: rows first, then the states that make them count; others' copies stay."""
    good = parsed(answers).where("province_in IS NOT NULL")
    rows = flat(good.select(F.col("province_in").withField("il", F.col("province")).alias("p")).select("p.*"))
    rows = rows.join(good.select("province", F.col("fetched_ms").alias("saved_ms")), "province")
    states = good.select("province", F.col("province_in.guncelleme").alias("updated"), F.col("fetched_ms").alias("saved_ms"))
    for name, table in (("rows", rows), ("states", states)):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("province").parquet(f"{path}/{name}")


def last_good(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The copies and their states that keep_good has written."""
    return tuple(spark.read.parquet(f"{path}/{name}").withColumn("province", F.col("province").cast("string")) for name in ("rows", "states"))


class Province(InputPartition):
    def __init__(self, province: str, address: str) -> None:
        self.province, self.address = province, address


class PollReader(DataSourceStreamReader):
    """Answers of every province once in each span of `age` seconds; an offset is the time at which a span begins.

    A restart in a span that is committed fetches nothing until the next, as the checkpoint has that offset already.
    """

    def __init__(self, options: dict) -> None:
        self.age_ms = int(float(options.get("age", "300")) * 1000)
        self.timeout = float(options.get("timeout", "15"))
        self.addresses = json.loads(options["addresses"])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"from_ms": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"from_ms": int(time.time() * 1000) // self.age_ms * self.age_ms}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Province(*x) for x in sorted(self.addresses.items())] if end["from_ms"] > start["from_ms"] else []

    def read(self, partition: Province) -> Iterator[tuple]:
        code, body = None, None  # no answer
        try:
            with urllib.request.urlopen(partition.address, timeout=self.timeout) as answer:
                code, body = answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            code = e.code
        except OSError:
            pass
        yield partition.province, code, body, int(time.time() * 1000)

    def commit(self, end: dict) -> None:
        pass


class PollSource(DataSource):
    """Stream of ANSWER rows: spark.readStream.format("province_poll"), options addresses (JSON: province to address), age and timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "province_poll"

    def schema(self) -> str:
        return ANSWER

    def streamReader(self, schema: object) -> PollReader:  # noqa: N802
        return PollReader(self.options)


def poll(spark: SparkSession, addresses: dict[str, str], age: float = 300, timeout: float = 15) -> DataFrame:
    """A stream of answers, each province asked again when its last answer is a span old."""
    spark.dataSource.register(PollSource)
    return spark.readStream.format("province_poll").option("addresses", json.dumps(addresses)).option("age", str(age)).option("timeout", str(timeout)).load()
