"""What an officer sees and sends: notices of a place, forms, corrections, and small checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import day_of, period_and_mosque
from tidemark.functions.places import duty_tokens, place_tokens
from tidemark.functions.text import SPACE, bare, tr_lower, trimmed
from tidemark.operators.listing import funeral_day
from tidemark.operators.tables import free_mark

#: Notices of one place that meet officers in one block.
BLOCK = 4096


def of_place(rows: DataFrame, officers: DataFrame) -> DataFrame:
    """Automatic notices (none of officers or martyrs) that match an officer's place, with the officer's id.

    officers: officer, il, ilce, gorev_yeri. An officer without a province or place gets none; one without a district is
    shown all districts. Both sides are folded to what is told of a place and what is asked for; these are cut to tokens once
    and meet through an index of them, by province, district (or none) and token, each pair at the least token that it shares.
    Officers and notices then meet by the pair alone, a place's notices in blocks of BLOCK, so one place is many tasks.
    """
    c, text, m = F.col, lambda x: F.coalesce(x, F.lit("")), free_mark(rows, officers)
    asks, tells, block = f"{m}asks", f"{m}tokens_of", f"{m}block"
    asked_by = {f"{m}il": c("il"), f"{m}at": tr_lower(text(c("ilce"))), f"{m}duty": c("gorev_yeri"), f"{m}ilce": c("ilce")}
    told_by = {f"{m}province": c("province"), f"{m}district": tr_lower(text(c("district"))), f"{m}prayer": c("namaz_yeri_vakti"), f"{m}quarter": c("mahalle")}
    named = officers.where("coalesce(il, '') <> '' AND coalesce(gorev_yeri, '') <> ''").select(c("officer").alias(f"{m}officer"), F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in asked_by.items()))), 256).alias(asks), *(v.alias(k) for k, v in asked_by.items()))
    own = rows.where("section = 0 AND NOT gorevli AND NOT sehit").withColumn(tells, F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in told_by.items()))), 256))

    asked = named.select(asks, *asked_by).distinct().withColumn("asked", duty_tokens(c(f"{m}duty"), c(f"{m}ilce"))).select(asks, f"{m}il", f"{m}at", "asked", F.explode("asked").alias("token"))
    told = own.groupBy(tells, *(v.alias(k) for k, v in told_by.items())).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    told = told.withColumn("told", place_tokens(period_and_mosque(c(f"{m}prayer"))["mosque"], c(f"{m}quarter")))
    told = told.select("*", F.explode(F.array_distinct(F.array(c(f"{m}district"), F.lit("")))).alias("place")).select("*", F.explode("told").alias("token"))
    met = told.join(asked, (c(f"{m}province") == c(f"{m}il")) & (c("place") == c(f"{m}at")) & (told["token"] == asked["token"]))
    met = met.where(F.array_min(F.array_intersect("asked", "told")) == told["token"]).select(asks, tells, "blocks")

    sought = named.select(f"{m}officer", asks).join(met, asks).select(f"{m}officer", tells, F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias(block))
    sizes = told.select(tells, "blocks").distinct()
    dealt = own.join(sizes, tells).withColumn(block, F.pmod(F.xxhash64("id" if "id" in rows.columns else rows.columns[0]), "blocks").cast("int"))
    return dealt.join(sought, [tells, block]).select(c(f"{m}officer").alias("officer"), *rows.columns)


def correction_form(rows: DataFrame) -> DataFrame:
    """A form to correct each notice: its own fields, the day that it is listed under, period and mosque apart, and what it was."""
    c = F.col
    listed = funeral_day(c("namaz_tarihi"), c("defin_zamani"), c("liste_tarihi"), c("vefat_tarihi"))
    parts = period_and_mosque(c("namaz_yeri_vakti"))
    day = F.coalesce(c("namaz_tarihi"), F.when(day_of(listed).isNotNull(), F.substring(listed, 1, 10)))
    own = ["ad_soyad", "cinsiyet", "yas", "vefat_tarihi", "mahalle", "defin_yeri"]
    return rows.select(c("id").alias("duzeltme_id"), parts["mosque"].alias("orijinal_cami"), c("mahalle").alias("orijinal_mahalle"), *own, day.alias("namaz_tarihi"), parts["period"].alias("namaz_vakti"), parts["mosque"].alias("namaz_cami"))


def edit_form(rows: DataFrame, own_mosque: str = "gorev_yeri") -> DataFrame:
    """A form to edit each of an officer's own notices: period and mosque as they were stored, whether the mosque is another, whether the age is unknown."""
    stored = F.coalesce("namaz_yeri_vakti", F.lit(""))
    dash = F.instr(stored, "-")
    one_space = lambda x: F.nullif(F.regexp_replace(bare(x), f"{SPACE}+", " "), F.lit(""))
    period = one_space(F.when(dash == 0, stored).otherwise(F.substring_index(stored, "-", 1)))
    mosque = F.when(dash > 0, one_space(F.substr(stored, dash + 1)))
    return rows.withColumns({"namaz_vakti": period, "namaz_cami": mosque, "cami_diger": mosque.isNotNull() & ~mosque.eqNullSafe(F.col(own_mosque)), "yas_yok": F.col("yas").isNull()})


def prayer_text(period: Column, mosque: Column) -> Column:
    """Period and mosque as one text; a mosque without a period keeps its dash."""
    return F.when(mosque.isNotNull(), F.concat(F.coalesce(period, F.lit("")), F.lit("-"), mosque)).otherwise(period)


def patch(rows: DataFrame, kept: list[str], cleared: list[str], editing: Column) -> DataFrame:
    """What a form sends: fields as a map, without those that are empty; in an edit, empty fields of `cleared` go as null.

    The map says so by a key with a null value, so a field that is absent differs from one that is emptied.
    """
    entry = lambda c: F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
    sent = [F.when(F.col(c).isNotNull(), entry(c)) for c in kept] + [F.when(F.col(c).isNotNull() | editing, entry(c)) for c in cleared]
    return rows.withColumn("sent", F.map_from_entries(F.array_compact(F.array(*sent))))


def patched(rows: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the fields that a patch (key, sent) names; others stay as they are."""
    met = rows.join(patches.select(key, "sent"), key, "left")
    said = lambda c: F.coalesce(F.map_contains_key("sent", c), F.lit(False))
    return met.withColumns({c: F.when(said(c), F.try_element_at("sent", F.lit(c)).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in fields}).drop("sent")


def report_id(c: Column) -> Column:
    """The id under which a notice is reported: without the mark of where it came from."""
    return F.regexp_replace(c, "^(aile|gorevli)-", "")


def place_record(c: Column) -> Column:
    """province, district and place of a text joined by bars; bars within the place stay; null below two parts."""
    p = F.split(c, r"\|", 3)
    return F.when(F.size(p) >= 2, F.struct(F.get(p, F.lit(0)).alias("il"), F.get(p, F.lit(1)).alias("ilce"), F.coalesce(F.get(p, F.lit(2)), F.lit("")).alias("gorev_yeri")))


def consent_holds(record: Column, account: Column) -> Column:
    """Whether a stored consent, account and day joined by a bar, is this account's."""
    return F.coalesce(F.contains(record, F.lit("|")) & (F.substring_index(record, "|", 1) == F.coalesce(account, F.lit(""))), F.lit(False))


def words_in(c: Column) -> Column:
    return F.size(F.filter(F.split(bare(F.coalesce(c, F.lit(""))), f"{SPACE}+"), lambda w: w != ""))


def name_fits(c: Column) -> Column:
    """Two to five words."""
    return words_in(c).between(2, 5)


def code_fits(c: Column) -> Column:
    """Four digits."""
    return F.coalesce(c.rlike("^[0-9]{4}$"), F.lit(False))


def must_update(build: Column, least: Column) -> Column:
    """Whether a build is below the least that is allowed; build 0 (not known) and no information let all pass."""
    return F.coalesce((build > 0) & (build < least), F.lit(False))


def without_moral(text: Column, moral: Column) -> Column:
    """A story without its closing moral, where that has a field of its own."""
    told = F.coalesce(text, F.lit(""))
    cut = F.regexp_replace(F.regexp_replace(told, rf"(?s){SPACE}*Kıssadan hisse:.*$", ""), f"{SPACE}+$", "")
    return F.when(trimmed(moral).isNull(), told).otherwise(cut)
