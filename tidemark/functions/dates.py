"""Days as ISO text, with roll-over; fixed UTC+3; Turkish day labels. today and now are always arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sentence_case, title_case, tr_lower

#: Names of months and days (Sunday first).
MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]
DAYS = ["Pazar", "Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi"]
ISO = r"^(\d{4})-(\d{2})-(\d{2})"
#: The prayers that a text may name.
PERIODS = "(sabah|öğle|ikindi|akşam|yatsı|cuma)"


def day_of(c: Column) -> Column:
    """The date that an ISO text begins with, months and days beyond their range rolled over; else null."""
    y, m, d = (F.regexp_extract(c, ISO, k).try_cast("int") for k in (1, 2, 3))
    return F.when(c.rlike(ISO), F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1))


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def add_days(c: Column, n: Column | int) -> Column:
    """The ISO text n days on; text that is no day stays as it is."""
    return F.coalesce(day_text(F.date_add(day_of(c), n)), c)


def turkey(ts: Column) -> Column:
    """Wall time at the fixed offset of three hours."""
    return F.from_utc_timestamp(ts, "+03:00")


def turkey_day(ts: Column) -> Column:
    return day_text(turkey(ts))


def turkey_hour(ts: Column) -> Column:
    return F.date_format(turkey(ts), "HH:mm")


def weekday(c: Column) -> Column:
    """0 for Sunday, as for text that is no day."""
    return F.coalesce(F.dayofweek(day_of(c)) - 1, F.lit(0))


def _number(x: Column) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(0))


def long_date(c: Column, short: bool = False) -> Column:
    """A year, a month or a day in words, as precise as the text; short leaves a day's year out."""
    c = F.coalesce(c, F.lit(""))
    parts = F.split(c, "-")
    year, month, day = (_number(F.get(parts, F.lit(k))) for k in range(3))
    name = F.get(F.array(*map(F.lit, MONTHS)), F.greatest(F.lit(0), F.least(F.lit(11), month - 1)))
    whole = F.concat_ws(" ", day.cast("string"), name)
    return (
        F.when(c == "", "").when(F.size(parts) == 1, year.cast("string")).when(F.size(parts) == 2, F.concat_ws(" ", name, year.cast("string")))
        .otherwise(whole if short else F.concat_ws(" ", whole, year.cast("string")))
    )


def day_label(c: Column) -> Column:
    return F.concat_ws(" ", long_date(c, short=True), F.get(F.array(*map(F.lit, DAYS)), weekday(c)))


def period_of(c: Column) -> Column:
    """The prayer named before the first dash, or empty."""
    return sentence_case(F.regexp_extract(tr_lower(F.substring_index(F.coalesce(c, F.lit("")), "-", 1)), PERIODS, 1))


def mosque_of(c: Column) -> Column:
    """What follows the first dash, or empty."""
    c = F.coalesce(c, F.lit(""))
    at = F.instr(c, "-")
    return F.when(at == 0, "").otherwise(F.trim(F.substr(c, at + 1)))


def period_and_mosque(c: Column) -> Column:
    """The two parts as they are shown."""
    c = F.coalesce(c, F.lit(""))
    return F.struct(sentence_case(F.trim(F.substring_index(c, "-", 1))).alias("period"), title_case(mosque_of(c)).alias("mosque"))


def next_slot(now: Column, hour: int) -> Column:
    """The next time that the clock shows the hour."""
    today = F.date_trunc("day", now) + F.make_interval(hours=F.lit(hour))
    return F.when(today > now, today).otherwise(F.date_trunc("day", now) + F.make_interval(days=F.lit(1), hours=F.lit(hour)))


def quiet(now: Column, start: int = 21, end: int = 7) -> Column:
    return (F.hour(now) >= start) | (F.hour(now) < end)


def ask_again(allowed: Column, put_off: Column, today: Column | str, days: int = 7) -> Column:
    """Whether a question put off may be asked again; never once it was answered."""
    today = F.lit(today) if isinstance(today, str) else today
    return allowed.isNull() & (F.coalesce(put_off, F.lit("")) .eqNullSafe("") | (today >= add_days(put_off, days)))


def day_bounds(current: Column, today: str, back: int, ahead: int) -> Column:
    """The first and last day that may be picked: today less back to today plus ahead, widened to hold the current day if it is one."""
    now, day = day_of(current), F.to_date(F.lit(today))
    first, last = F.date_sub(day, back), F.date_add(day, ahead)
    return F.struct(day_text(F.least(first, F.coalesce(now, first))).alias("first"), day_text(F.greatest(last, F.coalesce(now, last))).alias("last"))


def rolled_over(selected: Column, seen: Column, today: Column) -> Column:
    """The selected day after midnight: it follows today if it was today when last seen."""
    return F.when((today != seen) & selected.eqNullSafe(seen), today).otherwise(selected)
