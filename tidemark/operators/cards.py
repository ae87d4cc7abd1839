"""What cards and the panel say of a notice and of an account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import long_date, period_and_mosque
from tidemark.functions.text import bare, title_case, tr_upper
from tidemark.operators.listing import funeral_day, label

#: Badges of a card, the words before a martyr's name in the panel, and states of a notice and the mark of a correction there.
MARTYR, BABY, OUR_MARTYR = "ŞEHİT", "Bebek", "Şehidimiz"
STATES = {"yayinda": "Din görevlisi", "gizli": "Gizlendi", "iptal": "Kaldırıldı", "bekliyor": "Kontrolde", "red": "Yayımlanmadı"}
CORRECTED = "Düzeltildi"
#: Titles of officials and the phrase that each becomes behind a place.
TITLES = {
    "İmam-Hatip": "İmam Hatibi", "Müezzin-Kayyım": "Müezzin-Kayyımı", "Kur'an Kursu Öğreticisi": "Kur'an Kursu Öğreticisi", "Vaiz": "Vaizi",
    "Din Hizmetleri Uzmanı": "Din Hizmetleri Uzmanı", "Müftü Yardımcısı": "Müftü Yardımcısı",
}
#: An account's name, and the domain that it may end with.
ACCOUNT, DOMAIN = "^[a-z0-9._-]{3,40}$", "diyanet.gov.tr"


def _told(*parts: Column, between: str = " · ") -> Column:
    """The parts that are not empty, joined."""
    return F.concat_ws(between, *(F.nullif(p, F.lit("")) for p in parts))


def _looked_up(c: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for said, value in values.items():
        out = F.when(c == said, value).otherwise(out)
    return out


def notice_card(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, and a card's lines: badge, label, name, age, place, ceremony, prayer (a line each: period, mosque, day), burial (place, and where else).

    A martyr's badge and rank go before all else, and only martyrs have a ceremony; lines that would be empty are null, or left out of their list.
    """
    c, text = F.col, lambda x: F.coalesce(x, F.lit(""))
    martyr = F.coalesce(c("sehit"), F.lit(False))
    day = funeral_day(c("namaz_tarihi"), c("defin_zamani"), c("liste_tarihi"), c("vefat_tarihi"))
    parts = period_and_mosque(c("namaz_yeri_vakti"))
    listed = lambda *lines: F.filter(F.array(*lines), lambda x: x.isNotNull() & (x != ""))
    elsewhere = F.when(c("defin_il").isNotNull(), F.concat_ws(" / ", "defin_il", "defin_ilce"))
    return rows.select(
        *keys, F.when(martyr, MARTYR).when(F.coalesce(c("bebek"), F.lit(False)), BABY).alias("badge"), tr_upper(label(martyr, day, c("namaz_yeri_vakti"))).alias("label"),
        F.concat_ws(" ", F.when(martyr, c("rutbe")), c("ad_soyad")).alias("name"), F.concat(c("yas").cast("string"), F.lit(" yaş")).alias("age"),
        F.nullif(_told(title_case(c("mahalle")), text(c("ilce"))), F.lit("")).alias("place"), F.when(martyr, c("toren")).alias("ceremony"),
        listed(parts["period"], parts["mosque"], long_date(day, short=True)).alias("prayer"), listed(title_case(c("defin_yeri")), elsewhere).alias("burial"))


def panel_title(name: Column, martyr: Column, rank: Column) -> Column:
    """A notice's title in the panel; a martyr's with the rank, if it has one."""
    own = F.coalesce(name, F.lit(""))
    return F.when(F.coalesce(martyr, F.lit(False)), F.concat_ws(" ", F.lit(OUR_MARTYR), F.nullif(rank, F.lit("")), own)).otherwise(own)


def panel_status(state: Column, corrects: Column) -> Column:
    """A notice's state in words, and the mark of one that corrects another; an unknown state says nothing."""
    return _told(_looked_up(state, STATES), F.when(F.coalesce(corrects, F.lit("")) != "", CORRECTED))


def official_title(place: Column, title: Column) -> Column:
    """The head of an official's panel: a known title as a phrase behind the place, any other behind a dot."""
    phrase, said = _looked_up(title, TITLES), F.coalesce(title, F.lit(""))
    return F.when(phrase.isNotNull(), F.concat_ws(" ", place, phrase)).otherwise(_told(place, said))


ACCOUNT_IN = "durum string, ad_soyad string, il string, ilce string, gorev_yeri string, unvan string, kvkk_kabul string"


def account(body: Column) -> Column:
    """An account from its JSON: absent texts are empty (title and consent null), with approved and complete; null without a state."""
    a = F.from_json(body, ACCOUNT_IN)
    texts = {k: F.coalesce(a[k], F.lit("")) for k in ("durum", "ad_soyad", "il", "ilce", "gorev_yeri")}
    complete = (texts["ad_soyad"] != "") & (texts["il"] != "") & (texts["ilce"] != "") & (texts["gorev_yeri"] != "")
    told = F.struct(*(v.alias(k) for k, v in texts.items()), a["unvan"].alias("unvan"), a["kvkk_kabul"].alias("kvkk_kabul"), (texts["durum"] == "onayli").alias("approved"), complete.alias("complete"))
    return F.when(texts["durum"] != "", told)


def account_name(c: Column) -> Column:
    """The name of an account as it is typed, with or without the one domain, in lower case; null if it isn't 3 to 40 of the letters that are allowed."""
    low = F.lower(bare(c))
    at = F.instr(low, "@")
    name = F.when(at == 0, low).when(F.substr(low, at + 1) == DOMAIN, F.substring_index(low, "@", 1))
    return F.when(name.rlike(ACCOUNT), name)
