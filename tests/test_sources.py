"""Outcomes and last good copies, hide lists of any length, late settings, the bucketed store, layouts and assets, cards and accounts."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import tr_upper
from tidemark.operators import cards, store, suppress
from tidemark.sources import feeds, scan


def province(name, *ids, updated="2026-10-08T10:00:00Z"):
    return json.dumps({"il": name, "guncelleme": updated, "ilceler": {"Merkez": [{"id": i, "ad_soyad": f"Kişi {i}"} for i in ids]}})


def test_a_broken_file_shows_its_old_copy(spark, tmp_path):
    at, snap = tmp_path / "now", f"file://{tmp_path}/snap"
    at.mkdir()
    wanted = spark.createDataFrame([(p,) for p in ("Ordu", "Iğdır", "Van", "Rize", "Muş")], "province string")
    for name, code in (("Ordu", "ordu"), ("Iğdır", "igdir"), ("Van", "van"), ("Rize", "rize")):
        (at / f"{code}.json").write_text(province(name, "1", "2"))
    first = scan.file_answers(spark, wanted, f"file://{at}", 1000)
    scan.keep_good(first, snap)
    copies, states = scan.last_good(spark, snap)
    assert {r.province: r.status for r in scan.outcomes(first, states.limit(0)).collect()} == {"Ordu": "ok", "Iğdır": "ok", "Van": "ok", "Rize": "ok", "Muş": "no_source"}
    (at / "igdir.json").write_text('{"il": "Iğdır", "ilceler": {"Mer')
    (at / "van.json").unlink()
    (at / "ordu.json").write_text(province("Ordu", "3"))
    (at / "rize.json").write_text("[1, 2]")
    second = scan.file_answers(spark, wanted, f"file://{at}", 2000)
    told = {r.province: (r.status, r.sourced) for r in scan.outcomes(second, states).collect()}
    assert told == {"Ordu": ("ok", True), "Iğdır": ("cached", True), "Van": ("cached", True), "Rize": ("cached", True), "Muş": ("no_source", False)}
    rows = {(r.province, r.id, r.status) for r in scan.with_last_good(second, copies, states).collect()}
    assert rows == {("Ordu", "3", "ok")} | {(p, i, "cached") for p in ("Iğdır", "Van", "Rize") for i in "12"}
    scan.keep_good(second, snap)
    copies, states = scan.last_good(spark, snap)
    (at / "ordu.json").unlink()
    rows = {(r.province, r.id) for r in scan.with_last_good(scan.file_answers(spark, wanted, f"file://{at}", 3000), copies, states).collect()}
    assert rows == {(p, i) for p in ("Iğdır", "Van", "Rize") for i in "12"} | {("Ordu", "3")}
    odd = spark.createDataFrame([("Ordu", None, None, 1), ("Van", 500, "x", 1), ("Bolu", None, None, 1), ("Uşak", 500, None, 1), ("Kars", 200, None, 1)], scan.ANSWER)
    assert {r.province: (r.status, r.sourced) for r in scan.outcomes(odd, states).collect()} == {"Ordu": ("cached", True), "Van": ("cached", True), "Bolu": ("offline", None), "Uşak": ("failed", None), "Kars": ("failed", None)}


def test_an_empty_good_answer_hides_its_old_rows(spark, tmp_path):
    """A province whose good copy holds no notices is cached as such: rows of the copy before don't come back."""
    snap = f"file://{tmp_path}/snap"
    answer = lambda body, at: spark.createDataFrame([("Van", 200, body, at)], scan.ANSWER)
    scan.keep_good(answer(province("Van", "1"), 1), snap)
    scan.keep_good(answer(province("Van"), 2), snap)
    copies, states = scan.last_good(spark, snap)
    missing = spark.createDataFrame([("Van", 404, None, 3)], scan.ANSWER)
    assert scan.with_last_good(missing, copies, states).count() == 0 and scan.outcomes(missing, states).first().status == "cached"


def test_a_hundred_thousand_hidden_ids(spark):
    rows = spark.range(1000).select(F.concat(F.lit("gorevli-a-"), "id").alias("id"), F.lit("Ordu").alias("province"), F.lit(None).cast("string").alias("district"), F.lit("Ünye").alias("ilce"), F.lit(1).alias("ending"), F.lit(2).alias("_hp"))
    many = spark.range(100_000).select(F.lit("id").alias("kind"), (F.col("id") * 7).cast("string").alias("value"))
    got = suppress.hidden_by(rows, many.unionByName(spark.createDataFrame([("id", "a-1"), ("id", None), ("ilce", "nothing"), ("ilce", "Van/Ünye")], suppress.HIDES)))
    assert got.columns == [*rows.columns, "hidden"] and got.count() == 1000
    assert {int(r.id[10:]) for r in got.where("hidden").collect()} == {1, *range(0, 1000, 7)}
    assert suppress.hidden_by(rows, suppress.hides(spark, [], ["ORDU/unye"], [])).where("hidden").count() == 1000


def test_late_settings_tell_changes_only(spark):
    rows = spark.createDataFrame([("x-1", "Ordu", "Fatsa"), ("x-2", "Ordu", "Ünye"), ("x-3", "Van", "Fatsa"), (None, "Van", None)], "id string, province string, district string")
    before, after = suppress.hides(spark, [], ["Ordu/Fatsa"], ["2", "1"]), suppress.hides(spark, ["Van"], [], ["1"])
    got = suppress.late_changes(rows, before, after)
    assert sorted((str(r.id), r.change) for r in got.collect()) == [("None", "withdrawn"), ("x-2", "returned"), ("x-3", "withdrawn")]
    assert suppress.late_changes(rows, before, before).count() == 0


SHAPES = {"saved": "id string, n int", "counters": "id string, kind string, n int", "choices": "id string, choice string"}


def test_one_commit_for_three_tables(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store", SHAPES, buckets=4)
    ids = [f"k{i}" for i in range(30)]
    s.insert_absent("saved", spark.createDataFrame([(i, 1) for i in ids], SHAPES["saved"]))
    s.upsert("counters", spark.createDataFrame([(i, k, 1) for i in ids for k in "ab"], SHAPES["counters"]))
    s.upsert("choices", spark.createDataFrame([(i, "e") for i in ids], SHAPES["choices"]))
    assert s.insert_absent("saved", spark.createDataFrame([("k1", 9), ("new", 9)], SHAPES["saved"])) == 3
    assert s.table("saved").where("n = 9").count() == 1 and s.table("saved").count() == 31
    gone = spark.createDataFrame([("k1",), ("k2",), ("never",)], "id string")
    real, calls = s._publish, []
    s._publish = lambda *a: (calls.append(a), 1 / 0)  # breaks off before the commit
    with pytest.raises(ZeroDivisionError):
        s.delete(gone)
    assert calls and [s.table(t).count() for t in SHAPES] == [31, 60, 30] and s.version() == 3
    s._publish = real
    s.delete(gone)
    assert [s.table(t).count() for t in SHAPES] == [29, 56, 28] and [s.table(t, 3).count() for t in SHAPES] == [31, 60, 30]
    other = store.Store(spark, f"file://{tmp_path}/store", SHAPES, buckets=4)
    other.version = lambda: 3  # has not seen the last commit
    with pytest.raises(store.Conflict):
        other.delete(gone)


def test_a_days_people_are_one_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("12-03", "01-09", "sanatcilar"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps([{"ad": name, "wikidata_id": "Q1", "vefat_tarihi": "1939-12-05"}]))
    feeds.write_people(feeds.read_people(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/people")
    day = feeds.people_of(spark, f"file://{tmp_path}/people", "12-03")
    assert [(r.ad, r.file) for r in day.collect()] == [("12-03", "12-03")]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "file" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert feeds.people_of(spark, f"file://{tmp_path}/people", "sanatcilar", "01-09").count() == 2


def test_assets(spark, tmp_path):
    (tmp_path / "adlar.json").write_text(json.dumps({"e": ["Ali", "Deniz"], "k": ["Ayşe", "Deniz"]}))
    assert sorted(map(tuple, feeds.read_names(spark, f"file://{tmp_path}/adlar.json").collect())) == [("Ali", "e"), ("Ayşe", "k"), ("Deniz", "e"), ("Deniz", "k")]
    (tmp_path / "haric.json").write_text('["Q1", "Q2", "Q1"]')
    assert sorted(r[0] for r in feeds.read_excluded(spark, f"file://{tmp_path}/haric.json").collect()) == ["Q1", "Q2"]
    found = spark.createDataFrame([("Q5", True), ("Q3", None), ("Q3", False)], "wikidata_id string, aday boolean")
    assert sorted(r[0] for r in feeds.excluded_ids(found, ["Q9"]).collect()) == ["Q3", "Q9"]
    (tmp_path / "dualar.json").write_text(json.dumps({"etiketler": {"t": "Konu"}, "bolumler": [{"k": "s", "ad": "S", "ikon": "i", "liste": [{"b": "Başlık", "ar": "", "e": ["t"], "gizli": 1}, {"b": "İki"}]}]}))
    rows, labels = feeds.read_prayers(spark, f"file://{tmp_path}/dualar.json")
    assert [(r.section, r.ordinal, r.b, r.ar, r.tags) for r in rows.orderBy("ordinal").collect()] == [("s", 0, "Başlık", None, ["t"]), ("s", 1, "İki", None, [])] and labels.first().label == "Konu"


def test_cards(spark):
    columns = "id string, ad_soyad string, sehit boolean, bebek boolean, rutbe string, yas int, mahalle string, ilce string, toren string, namaz_tarihi string, defin_zamani string, liste_tarihi string, vefat_tarihi string, namaz_yeri_vakti string, defin_yeri string, defin_il string, defin_ilce string"
    rows = spark.createDataFrame([
        ("1", "Ali Veli", True, True, "Er", 20, "KALE mah.", "Fatsa", "Tören alanı", "2026-10-08", None, None, "2026-10-07", "öğle-ULU CAMİİ", "köy mez.", "Van", "Edremit"),
        ("2", "Can", False, True, "Er", None, None, None, "x", None, "yarın", None, None, None, None, "Van", None),
    ], columns)
    a, b = cards.notice_card(rows, "id").orderBy("id").collect()
    assert (a.badge, a.label, a.name, a.age, a.place, a.ceremony) == ("ŞEHİT", "CENAZE TÖRENİ · 8 EKİM · ÖĞLE", "Er Ali Veli", "20 yaş", "Kale Mah. · Fatsa", "Tören alanı")
    assert a.prayer == ["Öğle", "Ulu Camii", "8 Ekim"] and a.burial == ["Köy Mezarlığı", "Van / Edremit"]
    assert (b.badge, b.label, b.name, b.age, b.place, b.ceremony, b.prayer, b.burial) == ("Bebek", "CENAZE", "Can", None, None, None, [], ["Van"])
    say = lambda *cs: tuple(spark.range(1).select(*(c.alias(str(k)) for k, c in enumerate(cs))).first())
    s = F.lit
    assert say(cards.panel_title(s("Can"), s(True), s("Er")), cards.panel_title(s("Can"), s(True), s("")), cards.panel_title(s(None), s(None), s("Er"))) == ("Şehidimiz Er Can", "Şehidimiz Can", "")
    assert say(cards.panel_status(s("gizli"), s("x")), cards.panel_status(s("?"), s("x")), cards.panel_status(s("red"), s(None)), cards.panel_status(s(None), s(""))) == ("Gizlendi · Düzeltildi", "Düzeltildi", "Yayımlanmadı", "")
    assert say(cards.official_title(s("Ulu Camii"), s("Vaiz")), cards.official_title(s("Ulu Camii"), s("Hoca")), cards.official_title(s("Ulu Camii"), s(None))) == ("Ulu Camii Vaizi", "Ulu Camii · Hoca", "Ulu Camii")
    assert say(*(cards.account_name(s(x)) for x in (" Ali.Kaya ", "ali@diyanet.gov.tr", "ali@x.org", "al", "a" * 41, "a@", None))) == ("ali.kaya", "ali", None, None, None, None, None)
    told = spark.createDataFrame([('{"durum": "onayli", "ad_soyad": "A", "il": "B", "ilce": "C", "gorev_yeri": "D"}',), ('{"durum": "kuyruk", "unvan": "Vaiz"}',), ('{"il": "B"}',), (None,), ("x",)], "j string").select(cards.account(F.col("j")).alias("a")).collect()
    assert (told[0].a.approved, told[0].a.complete, told[1].a.approved, told[1].a.complete, told[1].a.unvan, told[1].a.il) == (True, True, False, False, "Vaiz", "") and [r.a for r in told[2:]] == [None] * 3
    assert say(tr_upper(s("i"))) == ("İ",)
