"""Reconciling two feeds: the same person, corrections, and the ordered merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import day_of
from tidemark.functions.text import name_key
from tidemark.operators.conflicts import AGE, DAYS, Merge
from tidemark.operators.tables import written


def band_matches(left: DataFrame, right: DataFrame, key: str, day: str, age: str, tie: str, days: int = DAYS, gap: int = AGE) -> DataFrame:
    """Per row of left with a match: its tie, how many rows of right are the same person, and the least of them.

    Equal key, ages at most gap apart (unknown ages match), days at most `days` apart. Right rows are
    folded to one for each key, day and age before they meet the left ones, which are folded alike; so a
    key that is hot on both sides makes as many pairs as it has days and ages, not rows.
    """
    folded = right.groupBy(F.col(key).alias("k"), F.col(day).alias("rd"), F.col(age).alias("rv")).agg(F.count("*").alias("n"), F.min(tie).alias("rid"))
    near = folded.withColumn("d", F.explode(F.sequence(F.date_sub("rd", days), F.date_add("rd", days))))
    asked = left.select(F.col(key).alias("k"), F.col(day).alias("d"), F.col(age).alias("v")).distinct()
    alike = F.col("v").isNull() | F.col("rv").isNull() | (F.abs(F.col("v") - F.col("rv")) <= gap)
    found = asked.join(near, ["k", "d"]).where(alike).groupBy("k", "d", "v").agg(F.sum("n").alias("matches"), F.min("rid").alias("first_match"))
    rows = left.select(F.col(key).alias("_k"), F.col(day).alias("_d"), F.col(age).alias("_v"), F.col(tie).alias("id"))
    return rows.join(found, (F.col("_k") == F.col("k")) & (F.col("_d") == F.col("d")) & F.col("_v").eqNullSafe(F.col("v"))).select("id", "matches", "first_match")


def replaced(base: DataFrame, corrections: DataFrame, key: str, target: str) -> DataFrame:
    """base without the rows that corrections name, and the corrections, those without a target row too."""
    gone = corrections.select(F.col(target).alias(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(corrections.drop(target))


def notice_days(*first: Column, last: Column) -> Column:
    """A notice's days as numbers: those of `first` that begin with a day; if none does, that of `last`."""
    own = F.array_compact(F.array(*(F.unix_date(day_of(c)) for c in first)))
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(F.unix_date(day_of(last)))))


def greedy_merge(base: DataFrame, feed: DataFrame, scopes: DataFrame | None = None, payload: str | None = None) -> DataFrame:
    """Rows of base, less those corrected, and rows of feed that are new: scope, id, place, feed (and payload).

    Both have id, place (unique within a scope and table; the feed's gives the order), scope, key, age
    (nullable), days (array of int), payload if it is named (a column of any type) and, feed only,
    corrects. scopes: the scopes that could be read, with or without rows of base; a feed row of any other
    is left out. By default these are base's scopes.

    A kept feed row can shut out later ones, so the order matters; what is kept is decided in rounds over
    many tasks (conflicts.Merge), whatever scope, person or id the rows share. A null id equals no other, and
    a null key is no one's. Payloads take no part in that: they join by scope and place.
    """
    known = base.select("scope").distinct() if scopes is None else scopes.select("scope").distinct()
    feed = feed.join(known, "scope", "left_semi")
    days = F.coalesce("days", F.array().cast("array<int>"))
    columns = ["scope", F.col("id").cast("string").alias("id"), "key", "age", days.alias("days")]
    kept = Merge(base.select(*columns), feed.select(*columns, "place", F.col("corrects").cast("string").alias("corrects"))).settle()
    last = kept.where("corrects IS NOT NULL").groupBy(F.col("scope").alias("_s"), F.col("corrects").alias("_c")).agg(F.max("place").alias("_at"))
    named = (F.col("scope") == F.col("_s")) & (F.col("id").cast("string") == F.col("_c"))
    out = ["scope", "id", "place", *([payload] if payload else [])]
    stays = base.select(*out).join(last, named, "left_anti").withColumn("feed", F.lit(False))
    turn = kept.select(F.col("scope").alias("_k"), F.col("place").alias("_p"))
    added = feed.select(*out).join(turn, (F.col("scope") == F.col("_k")) & (F.col("place") == F.col("_p")), "left_semi")
    later = named & (F.col("_at") > F.col("place"))  # corrected by one that came after it
    return stays.unionByName(added.join(last, later, "left_anti").withColumn("feed", F.lit(True)))


def merge_notices(base: DataFrame, feed: DataFrame, provinces: DataFrame) -> DataFrame:
    """The notices of base (as feeds.flat has them) and the new ones of feed (as feeds.feed_rows has them), in their districts.

    provinces: province and sourced, of each province whose scan gave a state to merge into. A feed notice
    goes behind the rows of its own district, or of the general section if it names none; a province without
    a source that gets one becomes sourced. Adds feed and sourced to base's columns.
    """
    fields = [c for c in base.columns if c not in ("province", "guncelleme", "section", "district", "district_no", "ordinal")]
    key = [F.col("province").alias("scope"), "id", name_key(F.col("ad_soyad")).alias("key"), F.col("yas").alias("age"), notice_days(F.col("vefat_tarihi"), F.col("namaz_tarihi"), F.col("defin_zamani"), last=F.col("liste_tarihi")).alias("days")]
    spot = F.struct("section", "district", F.col("ordinal").cast("long").alias("ordinal"))
    row = lambda df: F.struct("guncelleme", "section", "district", F.col("ordinal").cast("long").alias("ordinal"), *(F.col(c) for c in fields)).alias("row")
    named = F.nullif(F.col("ilce"), F.lit(""))
    sent = feed.withColumns({"guncelleme": F.lit(None).cast("string"), "section": F.when(named.isNull(), 1).otherwise(0), "district": named})
    place = lambda first: F.struct(F.lit(first).alias("first"), spot.alias("spot")).alias("place")
    at_feed = F.struct(F.lit(1).alias("first"), F.struct(F.lit(0).alias("section"), F.lit(None).cast("string").alias("district"), F.col("ordinal").cast("long").alias("ordinal")).alias("spot")).alias("place")
    own, more = written(base.select(*key, place(0), row(base)), "base"), written(sent.select(*key, at_feed, F.col("duzeltme_id").alias("corrects"), row(sent)), "feed")  # parsed once
    found = greedy_merge(own, more, provinces.select(F.col("province").alias("scope")), "row")
    found = written(found.select(F.col("scope").alias("province"), "feed", "row.*"), "merged")
    fed = found.groupBy("province").agg(F.bool_or("feed").alias("_fed"))
    ends = found.where("not feed").groupBy("province", "section", "district").agg((F.max("ordinal") + 1).alias("_end"))
    ends = ends.select(F.col("province").alias("_p"), F.col("section").alias("_s"), F.col("district").alias("_d"), "_end")
    same = (F.col("province") == F.col("_p")) & (F.col("section") == F.col("_s")) & F.col("district").eqNullSafe(F.col("_d"))
    placed = found.join(ends, same, "left").withColumn("ordinal", F.when(F.col("feed"), F.coalesce("_end", F.lit(0)) + F.col("ordinal")).otherwise(F.col("ordinal"))).drop("_p", "_s", "_d", "_end")
    state = provinces.join(fed, "province", "left").select("province", (F.col("sourced") | F.coalesce("_fed", F.lit(False))).alias("sourced"))
    return placed.join(state, "province")


def by_district(rows: DataFrame, *fields: str) -> DataFrame:
    """A province's notices as its districts hold them: province, section, district, notices (fields, in order) of every district that has some."""
    return rows.groupBy("province", "section", "district").agg(F.sort_array(F.collect_list(F.struct("ordinal", *fields))).alias("_n")).select("province", "section", "district", F.transform("_n", lambda n: n.dropFields("ordinal")).alias("notices"))
