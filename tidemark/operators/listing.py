"""Notices of a place and a day: scope, order, the strip of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import add_days, day_text, long_date, period_of
from tidemark.functions.text import sort_key
from tidemark.operators.tables import free_mark


#: What a martyr's and any other card begins with.
LABELS = ("Cenaze töreni", "Cenaze")


def funeral_day(prayer: Column, burial: Column, listed: Column, died: Column) -> Column:
    """The prayer's day; else the burial's if it is a day and nothing more; else the list's; else the death's; else empty."""
    return F.coalesce(prayer, F.when(burial.rlike(r"^\d{4}-\d{2}-\d{2}$"), burial), listed, died, F.lit(""))


def label(martyr: Column, day: Column, prayer_place: Column) -> Column:
    parts = [F.when(martyr, LABELS[0]).otherwise(LABELS[1]), long_date(day, short=True), period_of(prayer_place)]
    return F.concat_ws(" · ", *(F.nullif(p, F.lit("")) for p in parts))


def in_scope(rows: DataFrame, district: str | None, general: bool = False, martyr: str = "martyr") -> DataFrame:
    """All rows, or one district's with the general section's martyrs, and the rest of that section if the flag says so."""
    return rows if district is None else rows.where((F.col("district") == district) | ((F.col("section") == 1) & (F.col(martyr) | F.lit(general))))


def day_filled(rows: DataFrame, district: str | None, today: str, day: str = "day") -> DataFrame:
    """One row, filled: whether the scope has rows on a day. The general section counts in any scope, shown or not."""
    return in_scope(rows, district, general=True).where(F.col(day) == today).agg((F.count("*") > 0).alias("filled"))


def found(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """The first row with an id: districts in their order, then the general section; no row if none has it."""
    return rows.where(F.col(key) == id_).orderBy("section", F.col("district_no").asc_nulls_last(), "ordinal").limit(1)


def ranked(rows: DataFrame, by: list[str], martyr: str = "martyr", section: str = "section", district: str = "district", ordinal: str = "ordinal") -> DataFrame:
    """Adds section_rank and place: martyrs first, then districts, then the general section.

    Within these, districts come in Turkish order, the general section after them, and rows in input order.
    A place is the rank within one district's rows plus the rows of the parts before, so that no window
    holds more than a part.
    """
    m, rank = free_mark(rows), F.when(F.col(martyr), 0).when(F.col(section) == 0, 1).otherwise(2)
    keyed = rows.withColumns({"section_rank": rank, f"{m}part": F.when(F.col(section) == 0, F.col(district))})
    part, name = [*by, "section_rank", f"{m}part"], F.col(f"{m}part")
    before = Window.partitionBy(*by).orderBy("section_rank", name.isNull(), sort_key(name), name).rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy(*part).agg(F.count("*").alias(f"{m}n")).withColumn(f"{m}base", F.coalesce(F.sum(f"{m}n").over(before), F.lit(0)))
    bases = bases.select(*(F.col(c).alias(f"{m}b{c}") for c in part), f"{m}base")
    own = keyed.withColumn(f"{m}rank", F.row_number().over(Window.partitionBy(*part).orderBy(ordinal)))
    same = F.lit(True)
    for c in part:
        same &= F.col(c).eqNullSafe(F.col(f"{m}b{c}"))
    place = (F.col(f"{m}rank") + F.col(f"{m}base")).cast("long")
    return own.join(bases, same).select(*rows.columns, "section_rank", place.alias("place"))


def day_counts(rows: DataFrame, day: str = "day", by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, day).agg(F.count("*").alias("n"))


def date_strip(rows: DataFrame, today: str, back: int = 6, ahead: int = 2, day: str = "day") -> DataFrame:
    """offset, day, n: today and the days before, tomorrow always, later days only if they have rows."""
    first = F.to_date(F.lit(today))
    days = rows.sparkSession.range(-back, ahead + 1).select(F.col("id").alias("offset"), day_text(F.date_add(first, F.col("id").cast("int"))).alias("_day"))
    near = rows.where(F.col(day).between(day_text(F.date_sub(first, back)), day_text(F.date_add(first, ahead))))
    counts = day_counts(near, day)  # a dozen rows at most
    joined = days.join(F.broadcast(counts), F.col("_day") == F.col(day), "left")
    return joined.select("offset", F.col("_day").alias("day"), F.coalesce("n", F.lit(0)).alias("n")).where("offset <= 1 or n > 0")


def with_yesterday(rows: DataFrame, asked: DataFrame, day: str = "day", key: str = "key") -> DataFrame:
    """asked (key, day) with the day whose rows are shown: its own, or the day before if it has none and that has."""
    counts = rows.groupBy(F.col(key).alias("_k"), F.col(day).alias("_d")).agg(F.count("*").alias("_n"))
    own = asked.join(counts, (F.col(key) == F.col("_k")) & (F.col(day) == F.col("_d")), "left").select(asked["*"], F.coalesce("_n", F.lit(0)).alias("n_own"))
    own = own.withColumn("_before", add_days(F.col(day), -1))
    both = own.join(counts, (F.col(key) == F.col("_k")) & (F.col("_before") == F.col("_d")), "left").withColumn("n_before", F.coalesce("_n", F.lit(0)))
    shown = F.when(F.col("n_own") > 0, F.col(day)).when(F.col("n_before") > 0, F.col("_before"))
    return both.select(*asked.columns, "n_own", "n_before", shown.alias("shown_day"))


def empty_state(n: Column, day: Column, today: str) -> Column:
    """Why a day shows nothing: today, future or past; null if it has rows."""
    return F.when(n > 0, None).when(day == today, "today").when(day > today, "future").otherwise("past")


def page(rows: DataFrame, order: list[Column], size: int = 60, pages: int = 1) -> DataFrame:
    """The first pages of an order, with rank; only those rows meet in one place."""
    top = rows.orderBy(*order).limit(size * pages)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
