"""Whether something new has appeared: today's ids, the cheap gate, and the morning and noon decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import quiet
from tidemark.functions.text import locative


def todays_ids(rows: DataFrame, scope: str, today: Column | str, day: str = "day", key: str = "id", sources: DataFrame | None = None) -> DataFrame:
    """scope, id of the day's rows, the general section's too; of scopes that sources (scope, sourced) tells to have no source, none."""
    own = rows.where(F.col(day) == today).select(scope, key).distinct()
    return own if sources is None else own.join(sources.where("sourced").select(scope), scope, "left_semi")


def worth_looking(role: Column, now: Column, today: Column, allowed: Column, morning_day: Column, noon_day: Column) -> Column:
    """Allowed, not in quiet hours, and not done yet today; at noon only after the morning's."""
    first, second = ~morning_day.eqNullSafe(today), morning_day.eqNullSafe(today) & ~noon_day.eqNullSafe(today)
    return allowed & ~quiet(now) & F.when(role == "morning", first).otherwise(second)


def unseen(now: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of now whose keys seen has not."""
    return now.join(seen.select(*keys).distinct(), keys, "left_anti")


def decisions(rows: DataFrame, scope: str, day: str, key: str, is_morning: Column) -> DataFrame:
    """Per scope and day: n_morning, n_new (ids first there after the morning), morning and noon fired.

    The morning fires if it has rows; noon only after it, and only with ids that it had not.
    """
    by_id = rows.groupBy(scope, day, key).agg(F.max(is_morning.cast("int")).alias("_m"))
    both = by_id.groupBy(scope, day).agg(F.sum("_m").cast("long").alias("n_morning"), F.sum(1 - F.col("_m")).cast("long").alias("n_new"))
    return both.withColumn("morning", F.col("n_morning") > 0).withColumn("noon", (F.col("n_morning") > 0) & (F.col("n_new") > 0))


def alert_text(province: Column, district: Column) -> Column:
    place = F.when(F.coalesce(district, F.lit("")) == "", province).when(district == "Merkez", F.concat(province, F.lit(" Merkez"))).otherwise(district)
    return F.concat(locative(place), F.lit(" bugünkü cenaze ilanlarını göster"))
