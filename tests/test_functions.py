import base64
import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import places as P
from tidemark.functions import text as X
from tidemark.operators import alerts, gender, listing, people


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_turkish_text(spark):
    s = F.lit("IĞDIR İli i̇")
    r = one(spark, low=X.tr_lower(F.lit("IĞDIR İLİ")), up=X.tr_upper(F.lit("ığdır ili")), fold=X.fold(F.lit("Çığlık ŞÖİ")), slug=X.slug(F.lit("Iğdır / Merkez 2")), title=X.title_case(F.lit("MERKEZ.KÖY mez. İÇİ")),
            sentence=X.sentence_case(F.lit("ÖĞLE namazı")), digits=X.arabic_digits(F.lit("120")), trim=X.trimmed(F.lit("\u00a0 x\u2003 ")), blank=X.trimmed(F.lit("  ")), address=X.map_address(F.lit("Ulu Cami"), F.lit(" "), F.lit("Van")), s=X.tr_lower(s), found=X.fold(s), key=X.name_key(F.lit(" Ali \u00a0 İNCE ")))
    assert (r.s, r.found, r.key) == ("ığdır ili i", "igdir ili i", "ali ince")
    assert (r.low, r.up, r.fold, r.slug) == ("ığdır ili", "IĞDIR İLİ", "ciglik soi", "igdirmerkez2")
    assert (r.title, r.sentence, r.digits, r.trim, r.blank) == ("Merkez. Köy Mezarlığı İçi", "Öğle namazı", "١٢٠", "x", None)
    assert r.address.endswith("query=Ulu%20Cami%2C%20Van")


@pytest.mark.parametrize(("name", "want"), [("Ordu", "Ordu’da"), ("Bartın", "Bartın’da"), ("Mersin", "Mersin’de"), ("Sinop", "Sinop’ta"), ("Kilis", "Kilis’te"), ("Düzce", "Düzce’de"), ("", "")])
def test_locative(spark, name, want):
    assert one(spark, x=X.locative(F.lit(name))).x == want


def test_sort_key_orders_as_the_alphabet(spark):
    names = ["Zara", "Şırnak", "Sivas", "Çorum", "Cizre", "Iğdır", "İzmir", "Ağrı", "Of", "Ödemiş", "a b", "ab", "", "qa", "a", "ân"]

    def key(n):
        low = n.replace("I", "ı").replace("İ", "i").lower()
        return [X.ORDER.index(c) if c in X.ORDER else 1000 + ord(c) for c in low]

    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.sort_key(F.col("n"))).collect()
    assert [r.n for r in rows] == sorted(names, key=key)


def test_dates(spark):
    r = one(spark, over=D.day_text(D.day_of(F.lit("2026-02-31"))), zero=D.day_text(D.day_of(F.lit("2026-00-10x"))), none=D.day_of(F.lit("31.02.2026")), more=D.add_days(F.lit("2026-12-31"), 1), same=D.add_days(F.lit("soon"), 1),
            local=D.turkey_day(F.lit(datetime(2026, 10, 8, 22, 30))), hour=D.turkey_hour(F.lit(datetime(2026, 10, 8, 22, 30))), sunday=D.weekday(F.lit("2026-10-11")), bad=D.weekday(F.lit("?")),
            year=D.long_date(F.lit("1938")), month=D.long_date(F.lit("1938-11")), day=D.long_date(F.lit("1938-11-10")), short=D.long_date(F.lit("1938-11-10"), short=True), label=D.day_label(F.lit("2026-10-08")), empty=D.long_date(F.lit(None).cast("string")),
            period=D.period_of(F.lit("ÖĞLE NAMAZI - Cuma Camii")), no=D.period_of(F.lit("yarın")), parts=D.period_and_mosque(F.lit("İKİNDİ - MERKEZ CAMİİ - AVLU")), mosque=D.mosque_of(F.lit("Öğle")), old=D.day_bounds(F.lit("2026-10-01"), "2026-10-08", 4, 0), near=D.day_bounds(F.lit("2026-10-08"), "2026-10-08", 1, 3), bare=D.day_bounds(F.lit("soon"), "2026-10-08", 1, 3))
    assert (r.over, r.zero, r.none, r.more, r.same) == ("2026-03-03", "2025-12-10", None, "2027-01-01", "soon")
    assert (r.local, r.hour, r.sunday, r.bad) == ("2026-10-09", "01:30", 0, 0)
    assert (r.year, r.month, r.day, r.short, r.label, r.empty) == ("1938", "Kasım 1938", "10 Kasım 1938", "10 Kasım", "8 Ekim Perşembe", "")
    assert (r.period, r.no, tuple(r.parts), r.mosque) == ("Öğle", "", ("İkindi", "Merkez Camii - Avlu"), "")
    assert (tuple(r.old), tuple(r.near), tuple(r.bare)) == (("2026-10-01", "2026-10-08"), ("2026-10-07", "2026-10-11"), ("2026-10-07", "2026-10-11"))


def test_clock(spark):
    at = lambda h, m=0: F.lit(datetime(2026, 10, 8, h, m))
    r = one(spark, a=D.next_slot(at(7), 8), b=D.next_slot(at(8), 8), late=D.quiet(at(21)), early=D.quiet(at(6, 59)), open=D.quiet(at(7)), ask=D.ask_again(lit(None).cast("boolean"), F.lit("2026-10-01"), "2026-10-08"),
            wait=D.ask_again(lit(None).cast("boolean"), F.lit("2026-10-02"), "2026-10-08"), done=D.ask_again(F.lit(True), lit(None), "2026-10-08"))
    assert (r.a, r.b) == (datetime(2026, 10, 8, 8), datetime(2026, 10, 9, 8))
    assert (r.late, r.early, r.open, r.ask, r.wait, r.done) == (True, True, False, True, False, False)


CASES = [
    ("Korgan Merkez Camii", "MERKEZ CAMİİ", None, None, True), ("Çitlice Camii", None, "Çitlice", None, True), ("Çitlice Camii", "Merkez Camii", None, None, False),
    ("Çitlice Camii", "Merkez Camii", "Çitlice Mahallesi", None, True), ("", "Merkez Camii", "Merkez", None, False), ("Çitlice Camii", None, None, None, False),
    ("Merkez Camii", "Korgan Merkez Camii", None, None, True), ("Ordu Merkez Camii", "Korgan Merkez Camii", None, None, False), ("Ulu Camii", "Yeni Camii", None, None, False),
    ("Tepe Köyü", "", "TEPE KÖYÜ", None, True), ("Çitlice Camii", "Çitlik Camii", None, None, False), ("Korgan Çitlice Camii", "Korgan Merkez Camii", None, "Korgan", False), ("Korgan Çitlice Camii", "Korgan Merkez Camii", None, None, True),
]


def test_places(spark):
    rows = spark.createDataFrame(CASES, "a string, b string, c string, d string, want boolean")
    got = rows.select("want", P.places_match(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_funeral_day_and_label(spark):
    n = lit(None)
    day = listing.funeral_day
    r = one(spark, a=day(F.lit("2026-10-08"), F.lit("2026-10-09"), n, n), b=day(n, F.lit("2026-10-09"), F.lit("2026-10-01"), n), c=day(n, F.lit("öğleden sonra"), F.lit("2026-10-01"), n), d=day(n, n, n, n),
            label=listing.label(F.lit(False), F.lit("2026-10-08"), F.lit("ÖĞLE - X")), martyr=listing.label(F.lit(True), F.lit(""), n))
    assert (r.a, r.b, r.c, r.d, r.label, r.martyr) == ("2026-10-08", "2026-10-09", "2026-10-01", "", "Cenaze · 8 Ekim · Öğle", "Cenaze töreni")


def test_gender_ladder(spark):
    names = ["Ali Veli", "AYŞE  Su", "Deniz X", "İlk Y", ""]
    make = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    rows = gender.listed_gender(make(*names), "name", make("Ali", "Deniz", "İlk"), make("Ayşe", "Deniz"))
    assert {r.name: r.listed for r in rows.collect()} == {"Ali Veli": "e", "AYŞE  Su": "k", "Deniz X": None, "İlk Y": "e", "": None}
    y, no, n = F.lit(True), F.lit(False), lit(None)
    r = one(spark, s=gender.resolved(y, y, F.lit("e"), n, n), b=gender.resolved(no, y, F.lit("e"), n, n), own=gender.resolved(no, no, F.lit("k"), F.lit("e"), n), c=gender.resolved(no, no, n, n, F.lit("k")), text=gender.counter_label(F.lit("e"), F.lit("x")), plain=gender.counter_label(n, F.lit("x")))
    assert tuple(r) == ("s", "b", "k", "k", "Merhuma x", "x")


def test_people(spark):
    s = F.lit("")
    n = F.lit(None).cast("string")
    jobs = F.array(F.lit(" Yazar"), F.lit("yazar"), F.lit("şair"))
    r = one(spark, two=people.blurb(jobs, F.lit("Vikipedi kaydı; Görev: İlk roman (1950) sahibi. Ödül aldı"), n, n, 3), same=people.blurb(jobs, F.lit("Yazarlık yaptı"), n, n), note=people.blurb(F.lit(None).cast("array<string>"), s, F.lit("Türk ressam (d. 1900)"), F.lit("wikidata_tr")),
            office=people.office(F.lit("basbakanlar"), n, F.lit("Türkiye'nin 12. başbakanı"), n), ordered=people.office(F.lit("cumhurbaskanlari"), F.lit("09"), n, n), none=people.office(F.lit("sanatcilar"), F.lit("9"), n, n),
            left=people.without_office(F.lit("Politikacı · 9. Cumhurbaşkanı olarak · Cumhurbaşkanıydı"), F.lit("9. Cumhurbaşkanı")), year=people.year_of(n), age=people.age_text(F.lit(70), F.lit(True)), spaced=people.blurb(F.array(F.lit("\u00a0imam\u00a0")), n, n, n))
    assert r.spaced == "İmam"
    assert (r.two, r.same, r.note) == ("Yazar, şair · İlk roman sahibi", "Yazar", "Ressam")
    assert (r.office, r.ordered, r.none, r.left, r.year, r.age) == ("12. Başbakan", "9. Cumhurbaşkanı", None, "Politikacı", "–", "~70")


def test_alert_texts(spark):
    r = one(spark, a=alerts.alert_text(F.lit("Ordu"), lit(None)), b=alerts.alert_text(F.lit("Ordu"), F.lit("Merkez")), c=alerts.alert_text(F.lit("Ordu"), F.lit("Fatsa")))
    assert [x.split(" bugün")[0] for x in r] == ["Ordu’da", "Ordu Merkez’de", "Fatsa’da"]


def test_small_columns(spark):
    day = F.lit("2026-10-08")
    r = one(spark, follows=D.rolled_over(F.lit("2026-10-07"), F.lit("2026-10-07"), day), stays=D.rolled_over(F.lit("2026-10-05"), F.lit("2026-10-07"), day), same=D.rolled_over(F.lit("2026-10-05"), day, day),
            filled=X.filled(F.lit("{0} ilçesi, {1} ilan"), F.lit("Fatsa"), F.lit(3)), pin=X.pin_hash(F.lit("s"), F.lit("1234")), digest=X.digest(F.lit("{}")))
    assert (r.follows, r.stays, r.same, r.filled) == ("2026-10-08", "2026-10-05", "2026-10-05", "Fatsa ilçesi, 3 ilan")
    assert r.pin == hashlib.sha256(b"s|1234").hexdigest() and r.digest == base64.urlsafe_b64encode(hashlib.sha256(b"{}").digest()).decode().rstrip("=")


def test_worth_looking(spark):
    at, y, n = lambda h: F.lit(datetime(2026, 10, 8, h)), F.lit(True), lit(None)
    day, look = F.lit("2026-10-08"), alerts.worth_looking
    r = one(spark, first=look(F.lit("morning"), at(8), day, y, n, n), again=look(F.lit("morning"), at(8), day, y, day, n), noon=look(F.lit("noon"), at(12), day, y, day, n), alone=look(F.lit("noon"), at(12), day, y, n, n),
            done=look(F.lit("noon"), at(12), day, y, day, day), late=look(F.lit("morning"), at(22), day, y, n, n), barred=look(F.lit("morning"), at(8), day, F.lit(False), n, n))
    assert tuple(r) == (True, False, True, False, False, False, False)


def test_panel_columns(spark):
    from tidemark.operators import panel

    r = one(spark, a=panel.prayer_text(F.lit("Öğle"), F.lit("Ulu Cami")), b=panel.prayer_text(lit(None), F.lit("Ulu Cami")), c=panel.prayer_text(F.lit("Öğle"), lit(None)), short=panel.place_record(F.lit("Ordu")), bars=panel.place_record(F.lit("Ordu|Fatsa|Ulu|Cami")),
            own=panel.consent_holds(F.lit("x|2026"), F.lit("x")), other=panel.consent_holds(F.lit("x|2026"), F.lit("y")), none=panel.consent_holds(lit(None), F.lit("y")), old=panel.must_update(F.lit(3), F.lit(4)), unknown=panel.must_update(F.lit(0), F.lit(4)),
            one=panel.name_fits(F.lit(" Ali ")), two=panel.name_fits(F.lit("Ali\u00a0Veli")), told=panel.without_moral(F.lit("Öykü. \n Kıssadan hisse: iyi ol\nhep"), F.lit("iyi ol")))
    assert (r.a, r.b, r.c, r.short, tuple(r.bars)) == ("Öğle-Ulu Cami", "-Ulu Cami", "Öğle", None, ("Ordu", "Fatsa", "Ulu|Cami"))
    assert (r.own, r.other, r.none, r.old, r.unknown, r.one, r.two, r.told) == (True, False, False, True, False, False, True, "Öykü.")
