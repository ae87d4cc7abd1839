"""Whether two place names mean the same place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

#: Words that say what kind of place it is, and words too common to tell places apart.
KINDS = "camii camisi cami mescidi mescit mahallesi mahalle mah koyu koy".split()
COMMON = "merkez yeni eski ulu buyuk kucuk orta asagi yukari cumhuriyet ilce belediye".split()


def place_words(c: Column) -> Column:
    words = F.split(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(KINDS))


def _ends(short: Column, long: Column) -> Column:
    return (F.size(short) <= F.size(long)) & (F.slice(long, F.size(long) - F.size(short) + 1, F.size(short)) == short)


def places_match(duty: Column, mosque: Column, quarter: Column, left_out: Column | None = None) -> Column:
    """Equal, one the end of the other, or a telling word of four letters in common."""
    g = place_words(duty)
    barred = place_words(left_out if left_out is not None else F.lit(None).cast("string"))
    telling = F.filter(F.array_except(g, barred), lambda w: (F.length(w) >= 4) & ~w.isin(COMMON))
    some = F.lit(False)
    for c in (mosque, quarter):
        a = place_words(c)
        some |= (F.size(a) > 0) & (_ends(a, g) | _ends(g, a) | F.arrays_overlap(telling, a))
    return (F.size(g) > 0) & F.coalesce(some, F.lit(False))


def _phrases(words: Column) -> Column:
    """The words from each place to the end, as texts; none of none."""
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(words)), 1, F.size(words)), lambda i: F.array_join(F.slice(words, i + 1, F.size(words)), " "))


def _marked(mark: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(mark), t))


def duty_tokens(duty: Column, left_out: Column | None = None) -> Column:
    """What a place of duty is found by: places_match holds if and only if it shares a token with place_tokens of the same places.

    e: a phrase that it ends with; w: all of it; t: a telling word.
    """
    g = place_words(duty)
    barred = place_words(left_out if left_out is not None else F.lit(None).cast("string"))
    telling = F.filter(F.array_except(g, barred), lambda w: (F.length(w) >= 4) & ~w.isin(COMMON))
    return F.array_distinct(F.concat(_marked("e", _phrases(g)), _marked("w", F.slice(_phrases(g), 1, 1)), _marked("t", telling)))


def place_tokens(*names: Column) -> Column:
    """What a notice's places are found by: e: all of one; w: a phrase that it ends with; t: a word of four letters."""
    parts = []
    for c in names:
        a = place_words(c)
        parts += [_marked("e", F.slice(_phrases(a), 1, 1)), _marked("w", _phrases(a)), _marked("t", F.filter(a, lambda w: F.length(w) >= 4))]
    return F.array_distinct(F.concat(*parts))
