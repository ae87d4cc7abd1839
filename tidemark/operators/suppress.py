"""Rows that must not be shown: excluded entities, and places and notices hidden in haste, in lists of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import slug
from tidemark.operators.tables import free_mark

#: kind is il, ilce ("province/district") or id.
HIDES = "kind string, value string"


def excluded(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def hides(spark: SparkSession, provinces: list[str], districts: list[str], ids: list[str]) -> DataFrame:
    """Settings' lists as a table."""
    return spark.createDataFrame([(k, v) for k, values in (("il", provinces), ("ilce", districts), ("id", ids)) for v in values], HIDES)


def hides_of(settings: DataFrame) -> DataFrame:
    """The lists of feeds.read_settings as a table."""
    parts = [settings.select(F.lit(k).alias("kind"), F.explode(f"acil_gizle.{k}").alias("value")) for k in ("il", "ilce", "id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _endings(key: Column) -> Column:
    """An id, and what follows each of its dashes."""
    parts = F.split(key, "-")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-")))


def _with_sides(rows: DataFrame, entries: DataFrame, province: str = "province", district: str = "district", key: str = "id", own: str = "ilce") -> tuple[DataFrame, str]:
    """rows with the sides (bits, 0 for none) of the entries (kind, value, sides) that hide them, and that column's name.

    Each kind is one join by equality, however many sides; of the ids only the rows' distinct ones are cut at their dashes.
    """
    mark = free_mark(rows)
    sides = lambda name: F.bit_or("sides").alias(f"{mark}{name}")
    named = F.coalesce(F.col(district), F.col(own)) if own.lower() in {c.lower() for c in rows.columns} else F.col(district)
    said = entries.where("value IS NOT NULL")
    place = F.concat(slug(F.substring_index("value", "/", 1)), F.lit("/"), slug(F.expr("substr(value, instr(value, '/') + 1)")))
    at = said.where("kind = 'il'").groupBy(slug(F.col("value")).alias(f"{mark}p")).agg(sides("il"))
    pairs = said.where("kind = 'ilce' AND contains(value, '/')").groupBy(place.alias(f"{mark}d")).agg(sides("ilce"))
    ids = said.where("kind = 'id'").groupBy(F.col("value").alias("ending")).agg(F.bit_or("sides").alias("sides"))
    told = rows.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct().select("id", F.explode(_endings(F.col("id"))).alias("ending"))
    hit = told.join(ids, "ending").groupBy(F.col("id").alias(f"{mark}k")).agg(sides("id"))
    out = rows.join(at, slug(F.col(province)) == F.col(f"{mark}p"), "left")
    out = out.join(pairs, F.concat(slug(F.col(province)), F.lit("/"), slug(named)) == F.col(f"{mark}d"), "left")
    out = out.join(hit, F.col(key) == F.col(f"{mark}k"), "left")
    il, ilce, by_id = (F.coalesce(f"{mark}{k}", F.lit(0)) for k in ("il", "ilce", "id"))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), il.bitwiseOR(ilce).bitwiseOR(by_id).alias(f"{mark}sides")), f"{mark}sides"


def hidden_by(rows: DataFrame, hidden: DataFrame, province: str = "province", district: str = "district", key: str = "id", own: str = "ilce") -> DataFrame:
    """Adds hidden: by province or "province/district" (folded alike), or by an id, whole or after a dash; hidden: HIDES.

    A row of the general section (district null) is hidden by the district that it names itself, in
    column `own` if rows have that. The lists are a table, so they may be as long as the rows.
    """
    out, sides = _with_sides(rows, hidden.select("kind", "value", F.lit(1).alias("sides")), province, district, key, own)
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(sides) > 0).alias("hidden"))


def hidden_flags(rows: DataFrame, provinces: list[str], districts: list[str], ids: list[str], **names: str) -> DataFrame:
    """hidden_by() with lists."""
    return hidden_by(rows, hides(rows.sparkSession, provinces, districts, ids), **names)


def shown(rows: DataFrame, provinces: list[str], districts: list[str], ids: list[str], **names: str) -> DataFrame:
    return hidden_flags(rows, provinces, districts, ids, **names).where("not hidden").drop("hidden")


def late_changes(rows: DataFrame, before: DataFrame, after: DataFrame, **names: str) -> DataFrame:
    """What settings that come late change of rows already loaded: the rows to withdraw or to bring back, with change (withdrawn, returned).

    Both lists meet the rows in one pass, each entry with the list that it's from; a row that entries of both hide is no change.
    """
    side = lambda hidden, n: hidden.select("kind", "value", F.lit(n).alias("sides"))
    out, sides = _with_sides(rows, side(before, 1).unionByName(side(after, 2)), **names)
    change = F.when(F.col(sides) == 2, "withdrawn").otherwise("returned")
    return out.where(F.col(sides).isin(1, 2)).select(*(F.col(f"`{c}`") for c in rows.columns), change.alias("change"))
