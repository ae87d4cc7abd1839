"""Merges, place matches and lockouts whose rows heap up under one key, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import places
from tidemark.operators import conflicts, lockout, merge, panel, people
from tidemark.plans.cases import QUERIES
from test_operators import SCHEMA, plain_merge

NAMES = "Ulu Camii Yeni Mahallesi Fatih Merkez Çarşı Köyü Kale Hz Ali Mah Orta".split()


def merged(spark, base, feed, rounds=conflicts.ROUNDS):
    """Kept rows of several scopes, and those that the plain fold keeps."""
    want = set()
    for scope in {r[2] for r in base}:
        mine, sent = [r for r in base if r[2] == scope], [r for r in feed if r[2] == scope]
        told = plain_merge([(r[0], r[3], r[4], r[5]) for r in mine], [(r[0], r[3], r[4], r[5], r[6]) for r in sent])
        want |= {(scope, kind, (mine if kind == "base" else sent)[n][1]) for kind, n in told}
    seen = []
    settle, conflicts.Merge.settle = conflicts.Merge.settle, lambda self: (settle(self, rounds), seen.append(self))[0]
    try:
        rows = merge.greedy_merge(spark.createDataFrame(base, SCHEMA), spark.createDataFrame(feed, SCHEMA + ", corrects string")).collect()
    finally:
        conflicts.Merge.settle = settle
    return {(r.scope, "feed" if r.feed else "base", r.place) for r in rows}, want, seen[0]


@pytest.mark.parametrize("rounds", [conflicts.ROUNDS, 1, 0])
def test_random_merges(spark, rounds):
    """Whether rounds settle all, some or none of the rows, the fold's rows stay."""
    rnd = random.Random(rounds)
    base, feed = [], []
    for scope in "abc":
        row = lambda n: (f"i{rnd.randrange(20)}", n, scope, f"k{rnd.randrange(3)}", rnd.choice([None, 5, 6, 7, 30]), [rnd.randrange(20) for _ in range(rnd.randrange(3))])  # noqa: E731, B023
        base += [row(n) for n in range(8)]
        feed += [(*row(n), rnd.choice([None, None, None, f"i{rnd.randrange(20)}"])) for n in range(50)]
    got, want, _ = merged(spark, base, feed, rounds)
    assert got == want


def test_ten_years_of_one_name(spark):
    """A row every third day in one scope: neighbours' bands touch, but none waits for another, so one round over all tasks settles them."""
    feed = [(f"f{n}", n, "s", "same", 40, [3 * n], None) for n in range(1200)]
    got, want, done = merged(spark, [("b", 0, "s", "other", None, [])], feed)
    assert got == want and len(got) == 1201 and len(done.kept) == 1


def test_a_true_chain_and_a_hot_day(spark):
    """Every second day each row hangs on the one before; and a thousand rows of one person and day meet as one cell."""
    chain = [(f"f{n}", n, "s", "same", 40, [2 * n], None) for n in range(120)]
    hot = [(f"h{n}", 1000 + n, "s", "hot", 40 + n % 3, [5], None) for n in range(1000)]
    got, want, done = merged(spark, [("b", 0, "s", "other", None, [])], chain + hot)
    assert got == want and done.waiting.isEmpty()


def test_corrections_in_turn(spark):
    """A correction frees its target's id and person for later rows, also those that came before it in the table's order; itself it needs a free id."""
    base = [("a", 0, "s", "ali", 60, [10]), ("a", 1, "s", "can", 60, [10])]
    feed = [("x", 0, "s", "ali", 61, [11], None), ("c", 1, "s", "veli", 1, [10], "a"), ("y", 2, "s", "ali", 61, [11], None), ("a", 3, "s", "can", 60, [40], None), ("c", 4, "s", "z", 1, [1], "y"), ("d", 5, "s", "q", None, [], "d"), ("e", 6, "s", "q", 1, [1], "y"), ("y", 7, "s", "ali", 61, [11], None), (None, 8, "s", None, None, [11], None), (None, 9, "s", None, None, [11], None)]
    got, want, _ = merged(spark, base, feed)
    assert {r[2] for r in got if r[1] == "feed"} == {1, 3, 5, 6, 7, 8, 9}
    assert got - {("s", "feed", 9)} == want - {("s", "feed", 9)}  # the plain fold takes two null ids for one


def test_place_tokens_say_what_places_match_says(spark):
    rnd = random.Random(3)
    name = lambda: rnd.choice([None, "", " ".join(rnd.choice(NAMES) for _ in range(rnd.randrange(1, 4)))])
    rows = spark.createDataFrame([tuple(name() for _ in "abcd") for _ in range(2000)], "a string, b string, c string, d string")
    c = F.col
    both = rows.select(F.coalesce(places.places_match(c("a"), c("b"), c("c"), c("d")), F.lit(False)).alias("m"), F.arrays_overlap(places.duty_tokens(c("a"), c("d")), places.place_tokens(c("b"), c("c"))).alias("t"))
    found = {(r.m, r.t) for r in both.collect()}
    assert found == {(True, True), (False, False)}


def test_officers_meet_notices_by_tokens_only(spark):
    rows = spark.createDataFrame([(1, "Ordu", "Fatsa", "Öğle-ULU CAMİİ", "Kale Mah"), (2, "Ordu", "Ünye", "İkindi-Kale Camii", None), (3, "Ordu", None, None, "Fatih"), (4, "Van", "Fatsa", "Öğle-ULU CAMİİ", None)], "n int, province string, district string, namaz_yeri_vakti string, mahalle string")
    rows = rows.selectExpr("*", "0 AS section", "false AS gorevli", "false AS sehit", "'x' AS il")
    officers = spark.createDataFrame([("a", "Ordu", "FATSA", "Ulu Camii Kale"), ("b", "Ordu", "", "Kale"), ("c", "Ordu", None, "Hz Fatih Camii"), ("d", None, None, "Kale"), ("e", "Ordu", None, "")], "officer string, il string, ilce string, gorev_yeri string")
    met = panel.of_place(rows, officers)
    assert sorted((r.officer, r.n) for r in met.collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 3)] and met.columns == ["officer", *rows.columns]
    assert "_token" in met._jdf.queryExecution().toString().split("Join Inner")[1].split("\n")[0]


def told(attempts, most, lock_s):
    states, out = {}, {}
    for key, at, tie, ok in sorted(attempts, key=lambda a: (str(a[0]), a[1], a[2])):
        states[key], out[tie] = lockout.step(states.get(key, (0, None)), at, bool(ok), most, lock_s)
    return out


@pytest.mark.parametrize("block, most, lock_s", [(7, 5, 60.0), (1, 3, 5.0), (50, 1, 20.0), (3, 5, 0.0)])
def test_one_hot_key_over_many_blocks(spark, block, most, lock_s):
    """A key with most rows, equal times, nulls: whatever the blocks, each attempt is told as by a loop."""
    rng = np.random.default_rng(block)
    rows = [("hot" if rng.random() < 0.7 else None if rng.random() < 0.3 else f"k{rng.integers(3)}", float(rng.integers(0, 400)), i, [True, False, False, False, None][rng.integers(5)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "key string, at double, n long, ok boolean").repartition(5)
    got = {r.tie: r.result for r in lockout.lockout(frame, "key", "at", "n", "ok", most, lock_s, block).collect()}
    assert got == told(rows, most, lock_s) and "locked" in got.values()
    assert lockout.lockout(frame.limit(0), "key", "at", "n", "ok").count() == 0


def test_block_maps_are_short():
    """Neighbouring entries that lead to one exit are one."""
    at = np.arange(20_000.0)
    fresh, froms, exits = lockout.block_map(at, np.zeros(20_000, bool), 5, 60.0)
    assert len(froms) == len(exits) < 400 and len(fresh) == 5


def _plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_cards_work_out_each_value_once(spark, small):
    """What the blurb uses several times is no copy for each use; a plan of copies takes minutes for any table."""
    assert _plan_size(QUERIES["people_cards"](spark, small)) < 50_000
    rows = spark.createDataFrame([("1", "A", "sanatcilar", "1939-01-01", 60, False, 1, None, ["Yazar", " yazar", "Şair", "Oyuncu", "x"], "12 dilde; Türk şair; Zqxw kurucusu", None, None, None)],
                                 "wikidata_id string, ad string, file string, vefat_tarihi string, vefat_yasi int, vefat_yasi_yaklasik boolean, sitelink int, turk boolean, meslek array<string>, neden_onemli string, aciklama string, aciklama_kaynak string, sira string")
    assert people.card(rows).first().blurb == "Yazar, şair, oyuncu"


def test_notices_of_a_json_text_parse_it_once(spark, small):
    plan = QUERIES["notice_whitelist"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_notices_of_one_place_meet_officers_in_blocks(spark, monkeypatch):
    """Places are folded before their tokens meet, and a place with many notices is several blocks; repeated ids and officers stay."""
    monkeypatch.setattr(panel, "BLOCK", 3)
    notices = [(i % 17, "P", ("D", "Q", None)[i % 3], 0, False, False, "Öğle-Ulu Kale Camii" if i % 2 else None, "Çarşı Mah.", i) for i in range(40)]
    officers = [(k % 5, "P", ("d", None, "D")[k % 3], ("Kale Camii", "çarşı", "Başka Yer")[k % 3 if k < 6 else 0]) for k in range(12)]
    rows = spark.createDataFrame(notices, "id long, province string, district string, section int, gorevli boolean, sehit boolean, namaz_yeri_vakti string, mahalle string, at long")
    told = spark.createDataFrame(officers, "officer long, il string, ilce string, gorev_yeri string")
    from tidemark.functions.dates import period_and_mosque
    pairs = rows.crossJoin(told).where("il = province AND (ilce IS NULL OR lower(ilce) = lower(district))")
    want = pairs.where(places.places_match(F.col("gorev_yeri"), period_and_mosque(F.col("namaz_yeri_vakti"))["mosque"], F.col("mahalle"), F.col("ilce"))).select("officer", "at")
    got = panel.of_place(rows, told)
    assert got.columns == ["officer", *rows.columns]
    assert sorted(map(tuple, got.select("officer", "at").collect())) == sorted(map(tuple, want.collect())) != []


def test_round_trip_parses_each_text_once(spark, small):
    plan = QUERIES["round_trip"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 6
