import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, conflicts, listing, lockout, merge, panel, people, state, suppress
from tidemark.operators.tables import linked
from tidemark.plans import cases
from tidemark.plans import queries as plans
from tidemark.sources import feeds

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(cases.SQL))
def test_query_against_sql(spark, small, duck, name):
    got = plans.QUERIES[name](spark, small)
    want = duck.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_clamped_counter_in_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([1, -1])) for i in range(300)]
    want, n = {}, {"a": 0, "b": 0}
    for k, i, s in rows:
        n[k] = max(0, n[k] + s)
        want[i] = n[k]
    for width in (1, 7, 1000):
        got = state.clamped_counter(spark.createDataFrame(rows, "k string, i int, s int"), ["k"], ["i"], "s", F.floor(F.col("i") / width))
        assert {r.i: r.n for r in got.collect()} == want


def plain_merge(base, feed):
    """The rule told row by row over a whole scope: (id, key, age, days, corrects) in order, base first."""
    shown = [("base", n, *r) for n, r in enumerate(base)]
    for n, (i, key, age, days, corrects) in enumerate(feed):
        if i in [x[2] for x in shown]:
            continue
        if corrects is None:
            persons = [x for x in shown if x[3] == key and (age is None or x[4] is None or -1 <= age - x[4] <= 1)]
            if any(-2 <= mine - its <= 2 for x in persons for mine in days for its in x[5]):
                continue
        else:
            shown = [x for x in shown if x[2] != corrects]
        shown.append(("feed", n, i, key, age, days, corrects))
    return {(x[0], x[1]) for x in shown}


SCHEMA = "id string, place long, scope string, key string, age int, days array<int>"


def test_greedy_merge_against_a_plain_fold(spark):
    rng = random.Random(7)
    person = lambda p: (f"i{rng.randrange(60)}", p, f"s{rng.randrange(5)}", f"k{rng.randrange(6)}", rng.choice([None, 40, 41, 43, 60]), rng.sample(range(30), rng.randrange(3)))
    base = [r for r in map(person, range(60)) if r[2] != "s4"]
    feed = [(*person(p), f"i{rng.randrange(60)}" if rng.random() < 0.2 else None) for p in range(160)]
    told = spark.createDataFrame(base, SCHEMA), spark.createDataFrame(feed, SCHEMA + ", corrects string")
    for scopes in (None, ["s0", "s3", "s4"]):
        known = spark.createDataFrame([(x,) for x in scopes], "scope string") if scopes else None
        got = {(r.scope, "feed" if r.feed else "base", r.place) for r in merge.greedy_merge(*told, known).collect()}
        want = set()
        for scope in [f"s{k}" for k in range(5)]:
            mine = [(r[1], (r[0], *r[3:6], None)) for r in base if r[2] == scope]
            sent = [(r[1], (r[0], *r[3:7])) for r in feed if r[2] == scope and scope in (scopes or "s0 s1 s2 s3")]
            want |= {(scope, kind, (mine if kind == "base" else sent)[n][0]) for kind, n in plain_merge([x for _, x in mine], [x for _, x in sent])}
        assert got == want


def test_a_long_chain_is_one_group(spark):
    """Rows linked only by their neighbours: each corrects the row before."""
    feed = [(f"i{k}", k, "s", "k", None, [], f"i{k - 1}") for k in range(3000)]
    got = merge.greedy_merge(spark.createDataFrame([("x", 0, "s", "q", None, [])], SCHEMA), spark.createDataFrame(feed, SCHEMA + ", corrects string"))
    assert {r.id for r in got.collect()} == {"x", "i2999"}


def test_linked_settles_chains(spark):
    rows = spark.createDataFrame([(k, [f"t{k}", f"t{k + 1}"]) for k in range(5000)] + [(9000, ["other"])], "n int, tokens array<string>")
    got = linked(rows, F.col("tokens"))
    assert got.where("n < 5000").select("group").distinct().count() == 1 and got.select("group").distinct().count() == 2


def test_merge_query_against_a_plain_fold(spark, small):
    got = {("feed" if r.feed else "base", r.place) for r in plans.greedy_merge(spark, small).collect()}
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("d", F.unix_date(F.to_date("ts"))).collect()
    scopes = {}
    for e in sorted(events, key=lambda e: e.event_id):
        i = e.event_id
        is_feed = e.event_type not in ("purchase", "signup")
        row = (f"e{i % 4000}", str(int(e.value // 5)), i % 60 if i % 13 else None, [e.d], f"e{(i + 4) % 4000}" if is_feed and i % 17 == 0 else None)
        scopes.setdefault(e.user_id, ([], []))[is_feed].append((i, row))
    want = set()
    for base, feed in scopes.values():
        if base:
            want |= {(kind, (base if kind == "base" else feed)[n][0]) for kind, n in plain_merge([x for _, x in base], [x for _, x in feed])}
    assert got == want


TODAY = "2026-10-08"


def sent(i, name, ilce="Ünye", yas=None, vefat="2026-10-07", namaz=TODAY, **more):
    return {"id": i, "ad_soyad": name, "il": "Ordu", "ilce": ilce, "yas": yas, "vefat_tarihi": vefat, "namaz_tarihi": namaz, "namaz_yeri_vakti": "İkindi Namazını Müteakip-TEPE CAMİİ", "gorev_yeri": "Tepe Camii", "dogrulandi": True, **more}


def in_order(got):
    return sorted(got.collect(), key=lambda r: (r.section, r.district or "", r.ordinal))


def ordu(spark, tmp_path, feed, extra=(), sourced=True):
    """Ordu's notices after the merge, in order."""
    return in_order(ordu_table(spark, tmp_path, feed, extra, sourced))


def ordu_table(spark, tmp_path, feed, extra=(), sourced=True):
    own = [{"id": "ornek1", "ad_soyad": "Ahmet Örnekoğlu", "yas": 67, "vefat_tarihi": "2026-10-07", "namaz_tarihi": TODAY}, *extra]
    folder = tmp_path / f"{len(list(tmp_path.iterdir()))}"
    folder.mkdir()
    (folder / "ordu.json").write_text(json.dumps({"il": "Ordu", "ilceler": {"Ünye": own if sourced else []}}))
    (folder / "feed.json").write_text(feed if isinstance(feed, str) else json.dumps({"il": "Ordu", "kayitlar": feed}))
    base = feeds.read_provinces(spark, f"file://{folder}/ordu.json")
    return merge.merge_notices(base, feeds.read_feed(spark, f"file://{folder}/feed.json", TODAY), spark.createDataFrame([("Ordu", sourced)], "province string, sourced boolean"))


def test_notices_of_the_feed_join_their_districts(spark, tmp_path):
    rows = ordu(spark, tmp_path, [sent("g1", "Veli Tepeli", yas=80), sent("g2", "Kimi Kimsesiz", ilce=None), sent("g3", "Can Tez", ilce="Fatsa")])
    assert [(r.district, r.id, r.feed) for r in rows] == [("Fatsa", "gorevli-g3", True), ("Ünye", "ornek1", False), ("Ünye", "gorevli-g1", True), (None, "gorevli-g2", True)]
    officer = rows[2]
    assert officer.gorevli and officer.gorev_yeri == "Tepe Camii" and officer.ilce == "Ünye" and officer.sourced and "telefon" not in officer.asDict()


def test_the_same_person_or_id_is_shown_once(spark, tmp_path):
    rows = ordu(spark, tmp_path, [sent("ornek1", "Başka Ad"), sent("x2", "AHMET  ÖRNEKOĞLU", yas=68, namaz="2026-10-09"), sent("x3", "Ahmet Örnekoğlu", yas=40), sent("g9", "Hat Birleştirdi")],
                extra=[{"id": "gorevli-g9", "ad_soyad": "Hat Birleştirdi", "vefat_tarihi": "2026-10-07", "gorevli": True}])
    assert sorted(r.id for r in rows) == ["gorevli-g9", "gorevli-ornek1", "gorevli-x3", "ornek1"]


def test_a_correction_takes_its_targets_place(spark, tmp_path):
    rows = ordu(spark, tmp_path, [sent("d1", "Ahmet Örnekoğlu Doğru", duzeltme_id="ornek1"), sent("d2", "Ali Yok", duzeltme_id="hiç")])
    assert [r.id for r in rows] == ["gorevli-d1", "gorevli-d2"]


@pytest.mark.parametrize("feed", ["{bozuk", json.dumps({"kayitlar": "liste degil"}), "[]"])
def test_a_broken_feed_changes_nothing(spark, tmp_path, feed):
    assert [r.id for r in ordu(spark, tmp_path, feed)] == ["ornek1"]


def test_a_province_without_a_source_becomes_sourced(spark, tmp_path):
    rows = ordu(spark, tmp_path, [sent("g1", "Veli Tepeli", ilce="Merkez")], sourced=False)
    assert [(r.district, r.id, r.sourced) for r in rows] == [("Merkez", "gorevli-g1", True)]
    assert ordu(spark, tmp_path, [], sourced=False) == []


def test_the_feeds_window_and_whitelist(spark, tmp_path):
    table = ordu_table(spark, tmp_path, [sent("eski", "Çok Eski", namaz="2026-09-29"), sent("ileri", "Çok İleri", namaz="2026-10-13"), sent("t1", "Telefonlu Kişi", telefon="05320000000", basvuran="Hoca X")])
    assert [r.id for r in in_order(table)] == ["ornek1", "gorevli-t1"]
    told = feeds.as_json(table.where("feed"), "id").first()
    assert "0532" not in told.json and "Hoca" not in told.json and "Tepe Camii" in told.json


def test_lockout_against_a_loop(spark, small):
    got = {r.tie: r.result for r in plans.attempt_lockout(spark, small).collect()}
    states, want = {}, {}
    for e in sorted(spark.read.parquet(f"{small}/events.parquet").collect(), key=lambda e: (e.ts, e.event_id)):
        s = states.get(e.user_id, (0, None))
        states[e.user_id], want[e.event_id] = lockout.step(s, e.ts.timestamp(), e.event_type == "purchase", 5, 21_600.0)
    assert got == want and {"locked", "ignored", "success", "failed"} >= set(want.values())


def test_lockout_ladder():
    s, out = (0, None), []
    for at, ok in [(0, False)] * 4 + [(1, True)] + [(2, False)] * 5 + [(30, True), (62, True)]:
        s, r = lockout.step(s, at, ok, 5, 60)
        out.append(r)
    assert out == ["failed"] * 4 + ["success"] + ["failed"] * 4 + ["locked", "ignored", "success"]


def notice(i, **more):
    return {"id": i, "ad_soyad": f" Kişi {i} ", "vefat_tarihi": "2026-10-07", "namaz_tarihi": "2026-10-08", "kaynak_ad": "gizli", "telefon": "5", **more}


def test_feeds(spark, tmp_path):
    province = {"il": "Ordu", "guncelleme": "2026-10-08T10:00:00+03:00", "toplam": 3,
                "ilceler": {"Fatsa": [notice("1", yas="67", sehit=True, cinsiyet="Erkek"), notice("2", ad_soyad="  ")], "Ünye": []},
                "ilce_belirsiz": [notice(None, yas=67.9, aile="true"), notice("5", yas="67.5"), notice("6", yas=" 67\u00a0"), notice("7", yas=True), "text"], "il_disi": [notice("4", kaynak_turu="aile", il_disi_defin={"il": "Van", "ilce": " "})]}
    (tmp_path / "ordu.json").write_text(json.dumps(province))
    rows = feeds.read_provinces(spark, f"file://{tmp_path}/ordu.json")
    got = {r.id: r for r in rows.collect()}
    assert {k: got.pop(k).yas for k in "567"} == {"5": None, "6": 67, "7": None}
    assert set(got) == {"1", "Kişi None_2026-10-07", "4"} and not {"kaynak_ad", "telefon"} & set(rows.columns)
    a, b, c = got["1"], got["Kişi None_2026-10-07"], got["4"]
    assert (a.province, a.section, a.district, a.yas, a.sehit, a.cinsiyet, a.ad_soyad) == ("Ordu", 0, "Fatsa", 67, True, "e", "Kişi 1")
    assert (b.section, b.yas, b.aile, b.ordinal, c.ordinal, c.aile, c.defin_il, c.defin_ilce) == (1, 67, False, 0, 4, True, "Van", None)
    assert [listing.found(rows, "id", i).count() for i in ("1", "4", "nobody")] == [1, 1, 0]
    told = {r.id: json.loads(r.json) for r in feeds.as_json(rows, "id").collect()}
    assert told["4"]["il_disi_defin"] == {"il": "Van"} and "il_disi_defin" not in told["1"] and told["1"]["yas"] == 67 and "defin_il" not in told["4"]
    feeds.write_snapshot(rows, f"file://{tmp_path}/snap")
    kept = feeds.read_snapshot(spark, f"file://{tmp_path}/snap")
    assert kept.count() == 6 and suppress.shown(kept, [], ["Ordu/Fatsa"], ["4"]).count() == 4  # settings that come late hide what was kept
    assert alerts.todays_ids(rows.withColumn("day", listing.funeral_day(*(F.col(c) for c in ("namaz_tarihi", "defin_zamani", "liste_tarihi", "vefat_tarihi")))), "province", "2026-10-08").count() == 6
    assert feeds.current_only(rows, "province", "Van").count() == 0

    official = {"il": "Ordu", "kayitlar": [notice("x" * 40, kaynak_turu="aile"), notice("old", namaz_tarihi="2026-09-30"), notice("late", namaz_tarihi="2026-10-10T12:00"), notice(""), notice("bad", vefat_tarihi="dün")]}
    (tmp_path / "feed.json").write_text(json.dumps(official))
    found = feeds.read_feed(spark, f"file://{tmp_path}/feed.json", "2026-10-08").collect()
    assert [(r.id, r.gorevli, r.aile) for r in found] == [("gorevli-" + "x" * 32, True, False)]
    assert feeds.read_feed(spark, f"file://{tmp_path}/nothing.json", "2026-10-08").count() == 0

    (tmp_path / "12-03.json").write_text(json.dumps([{"ad": "A", "wikidata_id": "Q1", "vefat_tarihi": "1939-12-05", "vefat_yasi": 70, "meslek": ["yazar"], "sitelink": 3}, {"ad": "B", "wikidata_id": "Q2", "meslek": "imam\u00a0, Yazar", "sitelink_sayisi": "12", "vefat_yasi": "70.5", "turk": True}]))
    cards = people.card(feeds.read_people(spark, f"file://{tmp_path}/12-03.json"))
    shown, second = cards.orderBy("name").collect()
    assert (second.blurb, second.prominence, second.age, second.year) == ("İmam", 12, "–", "–")
    assert [[r.name for r in part.collect()] for part in people.by_nation(cards)] == [["B"], ["A"]]
    assert [[r.name for r in cards.orderBy(*order).collect()] for order in (people.by_prominence("prominence", "name", "name"), people.by_death("died", "name"), people.own_first("turkish", "prominence", "name"))] == [["B", "A"], ["A", "B"], ["B", "A"]]
    assert (shown.file, shown.year, shown.age, shown.blurb, shown.prominence, shown.turkish) == ("12-03", "1939", "70", "Yazar", 3, False)
    (tmp_path / "times.json").write_text(json.dumps({"ilceler": {"Ulus": {"2026-10-08": "05:10 06:40 12:30 15:40 18:10 19:30"}}}))
    assert feeds.read_prayer_times(spark, f"file://{tmp_path}/times.json").count() == 6


def test_hiding(spark):
    rows = spark.createDataFrame([("a-1", "Ordu", "Fatsa"), ("a-2", "Ordu", "Ünye"), ("3", "Iğdır", None), ("13", "Van", "Fatsa"), (None, "Van", None)], "id string, province string, district string")
    assert {r.id for r in suppress.shown(rows, ["IGDIR"], ["ordu/FATSA", "Van"], ["2"]).collect()} == {"13", None}
    assert suppress.shown(rows, [], [], []).count() == 5
    general = spark.createDataFrame([("1", "Ordu", None, "Fatsa"), ("2", "Ordu", "Ünye", "Fatsa"), ("3", "Ordu", None, None)], "id string, province string, district string, ilce string")
    assert sorted(r.id for r in suppress.shown(general, [], ["Ordu/Fatsa"], []).collect()) == ["2", "3"]


def test_order_and_states(spark):
    rows = spark.createDataFrame([("d", 1, False, 0, "Ünye"), ("d", 2, True, 1, None), ("d", 3, False, 1, None), ("d", 4, False, 0, "Çamaş"), ("d", 5, False, 0, "Fatsa")], "day string, ordinal int, martyr boolean, section int, district string")
    assert [r.ordinal for r in listing.ranked(rows, ["day"]).orderBy("place").collect()] == [2, 4, 5, 1, 3]
    assert [r.ordinal for r in listing.in_scope(rows, "Fatsa").orderBy("ordinal").collect()] == [2, 5]
    assert [r.ordinal for r in listing.in_scope(rows, "Fatsa", general=True).orderBy("ordinal").collect()] == [2, 3, 5]
    martyrs = spark.createDataFrame([("d", 1, True, 0, "Ünye"), ("d", 0, True, 1, None), ("d", 1, True, 0, "Çamaş"), ("d", 0, False, 0, "Of")], rows.schema)
    assert [(r.district, r.martyr) for r in listing.ranked(martyrs, ["day"]).orderBy("place").collect()] == [("Çamaş", True), ("Ünye", True), (None, True), ("Of", False)]
    assert [listing.day_filled(rows, d, t).first().filled for d, t in (("Of", "d"), ("Of", "e"), (None, "d"))] == [True, False, True]
    asked = spark.createDataFrame([("k", ""), ("k", "2026-02-31"), ("k", "2026-03-02")], "key string, day string")
    got = listing.with_yesterday(spark.createDataFrame([("k", "2026-03-02")], "key string, day string"), asked).collect()
    assert {r.day: r.shown_day for r in got} == {"": None, "2026-02-31": "2026-03-02", "2026-03-02": "2026-03-02"}
    say = spark.range(1).select(*(listing.empty_state(F.lit(n), F.lit(d), "2026-10-08").alias(str(k)) for k, (n, d) in enumerate([(1, "x"), (0, "2026-10-08"), (0, "2026-10-09"), (0, "2026-10-07")]))).first()
    assert tuple(say) == (None, "today", "future", "past")
    strip = listing.date_strip(rows.withColumn("day", F.lit("2026-10-10")), "2026-10-08").collect()
    assert [(r.offset, r.n) for r in strip] == [*((i, 0) for i in range(-6, 2)), (2, 5)]


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"yazilar": {"a": "x", "b": 3}, "bayraklar": {"ilce_sayfasinda_il_geneli": False}, "ilce_sayfasinda_il_geneli": True, "bugun_bossa_dunu_goster": True, "acil_gizle": {"il": ["Van"]}, "sayilar": "odd"}))
    r = feeds.read_settings(spark, f"file://{tmp_path}/s.json").first()
    assert r.yazilar["a"] == "x" and r.bayraklar == {"ilce_sayfasinda_il_geneli": False, "bugun_bossa_dunu_goster": True} and r.sayilar == {} and tuple(r.acil_gizle) == (["Van"], [], [])


def test_scan_states(spark):
    cases = [(200, False, True, "ok"), (200, True, False, "unverified"), (404, True, True, "cached"), (404, False, True, "no_source"), (500, True, True, "cached"), (500, False, True, "failed"), (None, True, True, "cached"), (None, False, True, "offline")]
    rows = spark.createDataFrame(cases, "code int, cached boolean, verified boolean, want string")
    assert all(r.got == r.want for r in rows.select("want", feeds.scan_status(F.col("code"), F.col("cached"), F.col("verified")).alias("got")).collect())
    fresh = spark.createDataFrame([("2026-10-08T10:00:00Z", 0), ("x", 1000), (None, 1000)], "u string, ms long").select(feeds.freshness(F.col("u"), F.col("ms")).alias("t")).collect()
    assert [r.t.year for r in fresh] == [2026, 1970, 1970]


def test_forms(spark):
    rows = spark.createDataFrame([("1", "Ali Veli", "e", 70, "2026-10-06", None, "2026-10-08", None, "Köy", None, "İKİNDİ - TEPE CAMİİ", "Tepe Camii"), ("2", "Can Tez", None, None, None, None, "öğleden sonra", None, None, None, None, "Ulu Cami")],
                                 "id string, ad_soyad string, cinsiyet string, yas int, vefat_tarihi string, namaz_tarihi string, defin_zamani string, liste_tarihi string, mahalle string, defin_yeri string, namaz_yeri_vakti string, gorev_yeri string")
    a, b = panel.correction_form(rows).orderBy("duzeltme_id").collect()
    assert (a.namaz_tarihi, a.namaz_vakti, a.namaz_cami, a.orijinal_cami, a.orijinal_mahalle) == ("2026-10-08", "İkindi", "Tepe Camii", "Tepe Camii", "Köy") and b.namaz_tarihi is None and b.namaz_cami == ""
    a, b = panel.edit_form(rows).orderBy("id").collect()
    assert (a.namaz_vakti, a.namaz_cami, a.cami_diger, a.yas_yok) == ("İKİNDİ", "TEPE CAMİİ", True, False) and (b.namaz_vakti, b.namaz_cami, b.cami_diger, b.yas_yok) == (None, None, False, True)
    sent = panel.patch(rows, ["cinsiyet"], ["yas", "mahalle"], F.col("id") == "2").orderBy("id").collect()
    assert sent[0].sent == {"cinsiyet": "e", "yas": "70", "mahalle": "Köy"} and sent[1].sent == {"yas": None, "mahalle": None}


def test_saved_rows(spark):
    stored, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, t int"), spark.createDataFrame([("b", 9), ("c", 3)], "k string, t int")
    assert [tuple(r) for r in state.upserted(stored, new, "k").orderBy(*state.newest_first("t", "k")).collect()] == [("b", 9), ("c", 3), ("a", 1)]
    notes = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"]), (3, None)], "n int, tags array<string>")
    assert [r.n for r in people.tagged(notes, "tags", "y").collect()] == [1, 2]
    labels = spark.createDataFrame([("y", "Ömür"), ("z", "Af")], "tag string, label string")
    assert [(r.tag, r.n, r.rank) for r in people.top_tags(notes, F.col("tags"), labels).collect()] == [("y", 2, 1)]
    assert [r.n for r in listing.page(notes.select("n"), [F.col("n").desc()], size=2).collect()] == [3, 2]
