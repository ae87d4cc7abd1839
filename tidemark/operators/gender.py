"""How a person is addressed: martyr, baby, the record's own word, the name lists, the user's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE, sentence_case

#: Forms of address by code.
PREFIX = {"s": "Şehidimize ", "b": "Bebeğimize ", "e": "Merhuma ", "k": "Merhumeye "}


def first_name(name: Column) -> Column:
    return sentence_case(F.get(F.split(F.regexp_replace(name, f"^{SPACE}+", ""), f"{SPACE}+"), F.lit(0)))


def listed_gender(rows: DataFrame, name: str, male: DataFrame, female: DataFrame, into: str = "listed") -> DataFrame:
    """Adds the gender of the one list (column name each) that has the first name; null if both or none have."""
    lists = male.select("name", F.lit("e").alias("_g")).union(female.select("name", F.lit("k").alias("_g"))).distinct()
    one = lists.groupBy("name").agg(F.when(F.count("*") == 1, F.min("_g")).alias(into))
    return rows.withColumn("_first", first_name(F.col(name))).join(one.withColumnRenamed("name", "_first"), "_first", "left").drop("_first")


def with_choice(rows: DataFrame, choices: DataFrame, key: str = "id", into: str = "chosen") -> DataFrame:
    """Adds what the user chose for a row's id (choices: id, choice), null if nothing."""
    return rows.join(choices.select(F.col(key), F.col("choice").alias(into)), key, "left")


def resolved(martyr: Column, baby: Column, own: Column, listed: Column, chosen: Column) -> Column:
    return F.when(martyr, "s").when(baby, "b").otherwise(F.coalesce(own, listed, chosen))


def counter_label(code: Column, body: Column) -> Column:
    prefix = F.lit("")
    for k, v in PREFIX.items():
        prefix = F.when(code == k, v).otherwise(prefix)
    return F.concat(prefix, body)
