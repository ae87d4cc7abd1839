"""More queries: operators whose inputs are built from the driver's tables so that each of their cases shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.operators import alerts, cards, gender, listing, merge, panel, people, state, suppress
from tidemark.plans.queries import DAY, QUERIES, SQL, _events, _key, _low, _spread, _table, _up, query
from tidemark.sources import feeds, scan
from tidemark.streaming import answers

__all__ = ["QUERIES", "SQL"]


@query("""
    WITH c AS (SELECT c_custkey, r_name AS province, r_name || '/' || n_name AS pair, n_name || '-' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      b AS (SELECT *, province = 'ASIA' OR pair = 'EUROPE/NATION_3' OR c_custkey % 10 = 0 AS was, pair = 'EUROPE/NATION_3' OR pair = 'AFRICA/NATION_5' OR c_custkey % 15 = 0 AS now FROM c)
    SELECT c_custkey, CASE WHEN now THEN 'withdrawn' ELSE 'returned' END AS change FROM b WHERE was <> now""")
def late_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notices already shown: what newer lists withdraw and bring back; ids hidden by table, as many as customers."""
    places = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _table(spark, sf_dir, "customer")
    rows = c.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("province"), F.col("n_name").alias("district"), F.concat_ws("-", "n_name", F.col("c_custkey").cast("string")).alias("id"))
    ids = lambda k: c.where(F.col("c_custkey") % k == 0).select(F.lit("id").alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    before = suppress.hides(spark, ["asia"], ["Europe/nation 3"], []).unionByName(ids(10))
    after = suppress.hides(spark, [], ["Europe/nation 3", "AFRICA/Nation-5"], []).unionByName(ids(15))
    return suppress.late_changes(rows, before, after).select("c_custkey", "change")


ANSWERS = """
    a AS (SELECT DISTINCT user_id, user_id % 5 AS kind FROM events),
    fresh AS (SELECT 'p' || user_id AS province, event_id, 'ok' AS status FROM events WHERE event_type = 'purchase' AND user_id % 5 = 0),
    s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 <> 0)"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users as provinces: by five, a good answer of their purchases, none, 404, 500 and a broken body; sign-ups of two in three as last good copies."""
    e = _events(spark, sf_dir).withColumn("province", F.concat(F.lit("p"), F.col("user_id").cast("string")))
    notice = F.struct(F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("ad_soyad"))
    own = e.groupBy("province", "user_id").agg(F.collect_list(F.when(F.col("event_type") == "purchase", notice)).alias("notices"))
    good = F.to_json(F.struct(F.col("province").alias("il"), F.lit("2026-10-08T10:00:00Z").alias("guncelleme"), F.create_map(F.lit("Merkez"), F.col("notices")).alias("ilceler")))
    kind = F.col("user_id") % 5
    code = F.when(kind.isin(0, 4), 200).when(kind == 2, 404).when(kind == 3, 500)
    told = own.select("province", code.alias("code"), F.when(kind == 0, good).when(kind == 4, F.substr(good, F.lit(1), F.length(good) - 1)).alias("body"), F.lit(2_000_000).cast("long").alias("fetched_ms"))
    copies = e.where("event_type = 'signup' AND user_id % 3 <> 0").select("province", F.lit(None).cast("string").alias("guncelleme"), F.lit(1).alias("section"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("int").alias("district_no"), F.col("event_id").cast("int").alias("ordinal"),
                      feeds.notice(F.from_json(F.to_json(notice), feeds.NOTICE_IN)).alias("n"), F.lit(1_000_000).cast("long").alias("saved_ms"))
    copies = copies.select("province", "guncelleme", "section", "district", "district_no", "ordinal", "n.*", "saved_ms")
    states = copies.select("province", F.lit("2026-10-07T10:00:00Z").alias("updated"), "saved_ms").distinct()
    return told, copies, states


@query(f"""
    WITH {ANSWERS} SELECT province, 'n' || event_id AS id, status FROM fresh UNION ALL
    SELECT 'p' || e.user_id, 'n' || event_id, 'cached' FROM events e JOIN s USING (user_id) WHERE event_type = 'signup' AND user_id % 5 <> 0""")
def last_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of good answers, and the last good copies' of all others."""
    return scan.with_last_good(*_answers(spark, sf_dir)).select("province", "id", "status")


@query(f"""
    WITH {ANSWERS}, o AS (SELECT a.user_id, kind, s.user_id IS NOT NULL AS has FROM a LEFT JOIN s USING (user_id)),
      t AS (SELECT user_id, CASE WHEN kind = 0 THEN 'ok' WHEN has THEN 'cached' WHEN kind = 1 THEN 'offline' WHEN kind = 2 THEN 'no_source' ELSE 'failed' END AS status FROM o)
    SELECT 'p' || user_id AS province, status, CASE WHEN status IN ('ok', 'cached') THEN true WHEN status = 'no_source' THEN false END AS sourced,
      CASE status WHEN 'ok' THEN '2026-10-08T10:00:00Z' WHEN 'cached' THEN '2026-10-07T10:00:00Z' END AS updated,
      CASE status WHEN 'ok' THEN '2026-10-08 10:00:00' WHEN 'cached' THEN '2026-10-07 10:00:00' END AS as_of FROM t""")
def province_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, _, states = _answers(spark, sf_dir)
    return scan.outcomes(told, states).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"))


@query("""
    WITH e AS (SELECT event_id, user_id, ts, event_type = 'view' AS asks, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 6 HOUR PRECEDING) AS said,
        max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM events)
    SELECT event_id FROM e WHERE NOT asks AND said = latest""")
def late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as requests; all else answers what was asked for six hours before, so a newer request makes it stale."""
    e = _events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    asked = F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -6 * 3_600_000_000))
    asks = F.col("event_type") == "view"
    rows = e.select("event_id", F.col("user_id").cast("string").alias("client"), F.when(asks, F.col("event_id")).otherwise(asked).alias("number"), (~asks).alias("answered"), "at")
    return answers.in_force(rows).select("event_id")


@query(f"""
    WITH n AS (SELECT event_id, user_id % 10 AS p, CASE WHEN user_id % 4 > 0 THEN event_type END AS district, CASE WHEN user_id % 4 = 0 THEN CASE WHEN user_id % 8 = 0 THEN 0 ELSE 1 END END AS general, {DAY} AS day, value FROM events),
      d AS (SELECT DISTINCT p, district FROM n WHERE district IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY district) - 1 AS district_no FROM d)
    SELECT 'P' || n.p AS province, CASE WHEN n.district IS NULL THEN 1 ELSE 0 END AS section, n.district, k.district_no::INTEGER AS district_no,
      (row_number() OVER (PARTITION BY n.p, n.district ORDER BY general, event_id) - 1)::INTEGER AS ordinal, 'n' || event_id AS id, day AS vefat_tarihi, floor(value)::BIGINT::INTEGER AS yas, event_id % 2 = 0 AS sehit,
      CASE WHEN event_id % 3 = 0 THEN 'Van' END AS defin_il, CASE WHEN event_id % 6 = 0 THEN 'Edremit' END AS defin_ilce FROM n LEFT JOIN k USING (p, district)""")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as province files (districts, no district, elsewhere), flattened, told as JSON and read through the whitelist again."""
    e, k = _events(spark, sf_dir), F.col("event_id")
    away = F.when(k % 3 == 0, F.struct(F.lit("Van").alias("il"), F.when(k % 6 == 0, "Edremit").alias("ilce")))
    notice = F.struct(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.lit("Ad").alias("ad_soyad"), F.col("day").alias("vefat_tarihi"), F.floor("value").alias("yas"), (k % 2 == 0).alias("sehit"), away.alias("il_disi_defin"), F.lit("5").alias("telefon"))
    user = F.col("user_id")
    part = F.when(user % 4 > 0, F.col("event_type")).when(user % 8 == 0, "ilce_belirsiz").otherwise("il_disi")
    lists = e.groupBy((user % 10).alias("p"), (user % 4 > 0).alias("in_district"), part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), notice.alias("n")))).alias("_l")).withColumn("l", F.col("_l.n"))
    entry = F.struct(F.col("part").alias("key"), F.col("l").alias("value"))
    files = lists.groupBy("p").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("in_district"), entry)))).alias("ilceler"), F.first(F.when(F.col("part") == "ilce_belirsiz", F.col("l")), True).alias("ilce_belirsiz"), F.first(F.when(F.col("part") == "il_disi", F.col("l")), True).alias("il_disi"))
    body = F.to_json(F.struct(F.concat(F.lit("P"), F.col("p").cast("string")).alias("il"), "ilceler", "ilce_belirsiz", "il_disi"))
    rows = feeds.flat(files.select(F.from_json(body, feeds.PROVINCE_IN).alias("f")).select("f.*"))
    told = feeds.as_json(rows, "province", "section", "district", "district_no", "ordinal")
    back = feeds.notices_of(_spread(told), F.col("json"), "province", "section", "district", "district_no", "ordinal")
    return back.select("province", "section", "district", "district_no", "ordinal", *(f"n.{c}" for c in ("id", "vefat_tarihi", "yas", "sehit", "defin_il", "defin_ilce")))


@query("""
    WITH t AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day FROM events)
    SELECT DISTINCT user_id, day AS id FROM t WHERE day = '2024-01-15' AND user_id % 3 > 0 UNION SELECT user_id, 'e' || event_id FROM t WHERE day = '2024-01-15' AND user_id % 3 > 0""")
def todays_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's ids of every user, each twice told and once kept; every third user has no source."""
    e = _events(spark, sf_dir)
    told = e.select("user_id", "day", F.explode(F.array(F.concat(F.lit("e"), F.col("event_id").cast("string")), F.col("day"), F.col("day"))).alias("id"))
    return alerts.todays_ids(told, "user_id", "2024-01-15", sources=e.select("user_id", (F.col("user_id") % 3 > 0).alias("sourced")).distinct())


@query("""
    WITH f AS (SELECT event_id, event_id % 7 AS k, strftime(ts, '%Y-%m-%d') AS d FROM events)
    SELECT 'gorevli-' || substr('f' || event_id || CASE WHEN k = 5 THEN repeat('x', 40) ELSE '' END, 1, 32) AS id, d || CASE WHEN k = 3 THEN 'T12:00' ELSE '' END AS namaz_tarihi
    FROM f WHERE k NOT IN (1, 2) AND d || CASE WHEN k = 3 THEN 'T12:00' ELSE '' END BETWEEN '2024-01-08' AND '2024-01-17'""")
def feed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an official feed on 2024-01-15: without an id, with a death day that is none, with a time behind the day (past the last bound), with a long id."""
    k = F.col("event_id") % 7
    row = F.struct(
        F.when(k == 1, "").when(k == 5, F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit("x" * 40))).otherwise(F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("id"), F.lit("Ad").alias("ad_soyad"),
        F.when(k == 3, F.concat("day", F.lit("T12:00"))).otherwise(F.col("day")).alias("namaz_tarihi"), F.when(k == 2, "dün").otherwise(F.col("day")).alias("vefat_tarihi"))
    raw = _events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("il")).agg(F.collect_list(row).alias("kayitlar"))
    raw = raw.select(F.from_json(F.to_json(F.struct("il", "kayitlar")), feeds.FEED_IN).alias("r")).select("r.*")
    return feeds.feed_rows(raw, "2024-01-15").select("id", "namaz_tarihi")


PEOPLE = """
    p AS (SELECT p_partkey, p_size, string_split(p_type, ' ') AS t, p_name, p_brand FROM part)"""


@query(f"""
    WITH {PEOPLE}, w AS (SELECT p_partkey, p_size, p_name, lower(t[1]) AS work, p_size % 5 AS k FROM p),
      u AS (SELECT *, {_up("substr(translate(work, 'i', 'ı'), 1, 1)")} || substr(translate(work, 'i', 'ı'), 2) AS title FROM w)
    SELECT p_partkey, CASE WHEN k = 4 THEN '–' ELSE '1939' END AS year, CASE k WHEN 0 THEN '~' || p_size WHEN 1 THEN '–' ELSE p_size::VARCHAR END AS age,
      CASE WHEN k = 2 THEN p_size || '. Cumhurbaşkanı' WHEN k = 3 THEN (p_size + 1) || '. Başbakan' END AS office,
      title || CASE WHEN k IN (0, 3) THEN '' WHEN k = 1 THEN ' · Zqxw yapıtı' WHEN k = 2 THEN ' · Vqzw kurucusu' ELSE ' · Wxqz notu' END AS blurb FROM u""")
def people_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as people of five kinds: a clause that says the profession again; one that tells; an office by number beside a telling clause; an office said in a note, and repeated; a trusted note."""
    k, s = F.col("p_size") % 5, F.col("p_size").cast("string")
    work = F.get(F.split("p_type", " "), F.lit(0))
    why = F.when(k == 0, F.concat(F.lit("12 dilde; "), work)).when(k == 1, F.lit("Vikipedi maddesi; (x) Görev: zqxw yapıtı; sonra")).when(k == 2, "Vqzw kurucusu; 2. Türkiye Cumhurbaşkanı").when(k == 3, F.concat((F.col("p_size") + 1).cast("string"), F.lit(". Başbakan")))
    rows = _spread(_table(spark, sf_dir, "part")).select(
        "p_partkey", F.col("p_partkey").cast("string").alias("wikidata_id"), F.col("p_name").alias("ad"), F.when(k == 2, "cumhurbaskanlari").when(k == 3, "basbakanlar").otherwise("12-03").alias("file"),
        F.when(k == 4, "39").otherwise("1939-12-05").alias("vefat_tarihi"), F.when(k != 1, F.col("p_size")).alias("vefat_yasi"), (k == 0).alias("vefat_yasi_yaklasik"), F.lit(1).alias("sitelink"), F.lit(None).cast("boolean").alias("turk"),
        F.array(work, F.lit(" "), F.concat(F.lit(" "), work)).alias("meslek"), why.alias("neden_onemli"), F.when(k == 4, "wxqz notu (y)").alias("aciklama"), F.when(k == 4, "wikidata_tr").alias("aciklama_kaynak"), F.when(k == 2, F.concat(s, F.lit("."))).alias("sira"))
    return people.card(rows).select(F.col("wikidata_id").cast("long").alias("p_partkey"), "year", "age", F.regexp_replace("office", "^$", "").alias("office"), "blurb")


@query("""
    WITH f AS (SELECT event_id, event_id % 4 AS k, strftime(ts, '%Y-%m-%d') AS d FROM events)
    SELECT 'n' || event_id AS duzeltme_id, CASE k WHEN 1 THEN '' ELSE 'Ulu Camii' END AS orijinal_cami, CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d END AS namaz_tarihi, CASE k WHEN 0 THEN 'Öğle' WHEN 1 THEN 'Yatsı' ELSE '' END AS namaz_vakti,
      CASE k WHEN 1 THEN '' ELSE 'Ulu Camii' END AS namaz_cami, CASE k WHEN 0 THEN 'ÖĞLE' WHEN 1 THEN 'yatsı' END AS edit_vakti, CASE k WHEN 0 THEN 'ULU CAMİİ' WHEN 1 THEN NULL ELSE 'Ulu Camii' END AS edit_cami,
      k = 0 AS cami_diger, k = 3 AS yas_yok FROM f""")
def notice_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notices with a prayer day and text; a listed day with a time and no mosque; a burial day and no period; and no day."""
    k = F.col("event_id") % 4
    stored = F.when(k == 0, " ÖĞLE  - ULU  CAMİİ ").when(k == 1, "yatsı").otherwise("-Ulu Camii")
    c = lambda v, name: v.cast("string").alias(name)
    none = F.lit(None)
    rows = _events(spark, sf_dir).select(
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("id"), F.lit("Ad").alias("ad_soyad"), c(none, "cinsiyet"), F.when(k != 3, 60).alias("yas"), c(none, "vefat_tarihi"), c(none, "mahalle"), c(none, "defin_yeri"),
        F.when(k == 0, F.col("day")).alias("namaz_tarihi"), F.when(k == 2, F.col("day")).when(k == 1, "öğleden sonra").alias("defin_zamani"), F.when(k == 1, F.concat("day", F.lit(" 10:00"))).alias("liste_tarihi"), F.regexp_replace(stored, " {2,}", " ").alias("namaz_yeri_vakti"), F.lit("Ulu Camii").alias("gorev_yeri"))
    edits = panel.edit_form(rows).select(F.col("id").alias("duzeltme_id"), F.col("namaz_vakti").alias("edit_vakti"), F.col("namaz_cami").alias("edit_cami"), "cami_diger", "yas_yok")
    return panel.correction_form(rows).select("duzeltme_id", "orijinal_cami", "namaz_tarihi", "namaz_vakti", "namaz_cami").join(edits, "duzeltme_id")


@query(f"""
    WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS section, user_id % 10 = 0 AS martyr, CASE WHEN user_id % 5 > 0 THEN event_type END AS district, {DAY} AS day FROM events),
      n AS (SELECT count(*) AS n FROM e WHERE day = '2024-01-15' AND (district = 'click' OR section = 1))
    SELECT 'scope' AS part, event_id FROM e WHERE district = 'click' OR (section = 1 AND martyr) UNION ALL SELECT 'all', event_id FROM e UNION ALL SELECT 'general', event_id FROM e WHERE district = 'click' OR section = 1
    UNION ALL SELECT 'filled', (n > 0)::BIGINT FROM n UNION ALL SELECT 'filled', 0 UNION ALL SELECT 'found', arg_min(event_id, (section, district, event_id)) FROM e WHERE event_type = 'purchase' AND day = '2024-01-15'""")
def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one district, of all, and of one with the general section; whether the scope's day has rows (the general section's count); the first row with an id."""
    user = F.col("user_id")
    e = _events(spark, sf_dir).select("event_id", "day", F.concat_ws("/", "event_type", "day").alias("id"), F.when(user % 5 == 0, 1).otherwise(0).alias("section"), (user % 10 == 0).alias("martyr"), F.when(user % 5 > 0, F.col("event_type")).alias("district"), F.lit(0).alias("district_no"), F.col("event_id").alias("ordinal"))
    told = lambda part, rows, value="event_id": rows.select(F.lit(part).alias("part"), F.col(value).cast("long").alias("event_id"))
    out = told("scope", listing.in_scope(e, "click")).unionByName(told("all", listing.in_scope(e, None))).unionByName(told("general", listing.in_scope(e, "click", general=True)))
    for day in ("2024-01-15", "2031-01-01"):
        out = out.unionByName(told("filled", listing.day_filled(e, "click", day), "filled"))
    return out.unionByName(told("found", listing.found(e, "id", "purchase/2024-01-15")))


@query(f"""
    WITH n AS (SELECT user_id, {DAY} AS day, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT user_id FROM events), a AS (SELECT user_id, day FROM d, (VALUES ('2024-01-14'), ('2024-01-15'), ('2024-01-16')) v(day))
    SELECT a.user_id, a.day, CASE WHEN n.n > 0 THEN NULL WHEN a.day = '2024-01-15' THEN 'today' WHEN a.day > '2024-01-15' THEN 'future' ELSE 'past' END AS state FROM a LEFT JOIN n USING (user_id, day)""")
def empty_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a user's day before, on or after 2024-01-15 shows nothing."""
    e = _events(spark, sf_dir)
    asked = e.select("user_id").distinct().withColumn("day", F.explode(F.array(*map(F.lit, ("2024-01-14", "2024-01-15", "2024-01-16")))))
    counts = listing.day_counts(e, by=("user_id",))
    return asked.join(counts, ["user_id", "day"], "left").select("user_id", "day", listing.empty_state(F.coalesce("n", F.lit(0)), F.col("day"), "2024-01-15").alias("state"))


@query(f"""
    WITH p AS (SELECT p_partkey, p_size, p_partkey % 3 = 0 AS own, CASE WHEN p_partkey % 4 > 0 THEN '19' || p_size END AS died FROM part),
      r AS (SELECT 'death' AS kind, p_partkey, row_number() OVER (ORDER BY coalesce(died, '') DESC, p_partkey)::BIGINT AS rank FROM p UNION ALL SELECT 'own', p_partkey, row_number() OVER (ORDER BY own DESC, p_size DESC, p_partkey)::BIGINT FROM p
        UNION ALL SELECT 'saved', p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey)::BIGINT FROM p UNION ALL SELECT 'first', p_partkey, row_number() OVER (ORDER BY p_partkey)::BIGINT FROM p)
    SELECT * FROM r WHERE rank <= CASE kind WHEN 'first' THEN 3 ELSE 60 END""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages of people by death (missing last) and own first, of saved rows by age, and the panel's first three."""
    k = F.col("p_partkey")
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_size", (k % 3 == 0).alias("own"), F.when(k % 4 > 0, F.concat(F.lit("19"), F.col("p_size").cast("string"))).alias("died"))
    told = lambda kind, order, size=60: listing.page(p, order, size).select(F.lit(kind).alias("kind"), "p_partkey", "rank")
    pages = told("death", people.by_death("died", "p_partkey")).unionByName(told("own", people.own_first("own", "p_size", "p_partkey")))
    return pages.unionByName(told("saved", state.newest_first("p_size", "p_partkey"))).unionByName(told("first", [k], 3))


@query(f"""
    WITH t AS (SELECT p_partkey, p_size, p_name AS n, string_split(p_name, ' ') AS w, p_brand AS b FROM part)
    SELECT p_partkey, list_distinct([substr({_low('x')}, 1, 5) FOR x IN list_filter(w, lambda y: length(y) >= 4)]).list_sort().array_to_string(' ') AS stems, translate(p_size::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits,
      'https://www.google.com/maps/search/?api=1&query=' || replace(n, ' ', '%20') || CASE WHEN p_size % 2 = 0 THEN '%2C%20' || replace(b, '#', '%23') ELSE '' END AS address,
      n || ' (' || p_size || ') ' || n AS told, sha256(b || '|' || n) AS pin, CASE p_size % 4 WHEN 0 THEN 'Öğle' WHEN 1 THEN 'İkindi' ELSE '' END AS period,
      CASE p_size % 2 WHEN 0 THEN {_up("substr(w[1], 1, 1)")} || substr(w[1], 2) || ' ' || w[2] ELSE 'Turk ' || w[1] END AS plain FROM t""")
def text_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems, digits, map addresses, templates, digests, prayers before a dash, and texts without the adjective of nationality."""
    c, k = F.col, F.col("p_size")
    told = F.when(k % 2 == 0, F.concat(F.lit("Türk "), c("p_name"))).otherwise(F.concat(F.lit("Turk "), F.get(F.split("p_name", " "), F.lit(0))))
    prayer = F.when(k % 4 == 0, "ÖĞLE namazı - Sabah Camii").when(k % 4 == 1, "bugün ikindi").when(k % 4 == 2, "Ulu - yatsı")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.sort_array(X.stems(c("p_name"))), " ").alias("stems"), X.arabic_digits(k.cast("string")).alias("digits"), X.map_address(c("p_name"), F.when(k % 2 == 0, c("p_brand")).otherwise(" ")).alias("address"),
        X.filled(F.lit("{0} ({1}) {0}"), c("p_name"), k).alias("told"), X.pin_hash(c("p_brand"), c("p_name")).alias("pin"), D.period_of(prayer).alias("period"), people._without_nationality(told).alias("plain"))


@query(f"""
    WITH e AS (SELECT event_id, user_id, ts, {DAY} AS day, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS next, user_id % 4 AS k FROM events)
    SELECT event_id, strftime(CASE WHEN hour(ts) < 9 THEN date_trunc('day', ts) + INTERVAL 9 HOUR ELSE date_trunc('day', ts) + INTERVAL 33 HOUR END, '%Y-%m-%d %H:%M:%S') AS slot,
      k <> 0 AND NOT (hour(ts) >= 21 OR hour(ts) < 7) AND CASE WHEN event_id % 2 = 0 THEN k <> 1 ELSE k = 1 END AS worth,
      k > 0 AND (k = 1 OR '2024-01-15' >= strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d')) AS ask,
      CASE WHEN k < 2 AND day < '2024-01-11' THEN day ELSE '2024-01-11' END AS first_day, CASE WHEN k < 2 AND day > '2024-01-16' THEN day ELSE '2024-01-16' END AS last_day, CASE WHEN k = 0 THEN '2024-01-15' ELSE CASE WHEN k = 1 THEN next ELSE 'soon' END END AS selected FROM e""")
def date_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 09:00; whether it is worth looking (allowed, awake, not done); whether to ask again; the days that may be picked; the day selected after midnight."""
    c, k, s = F.col, F.col("user_id") % 4, F.lit
    role = F.when(c("event_id") % 2 == 0, "morning").otherwise("noon")
    bounds = D.day_bounds(F.when(k < 2, c("day")).otherwise("soon"), "2024-01-15", 4, 1)
    selected = D.rolled_over(F.when(k == 0, "2024-01-14").when(k == 1, F.date_format(F.date_add("ts", 1), "yyyy-MM-dd")).otherwise("soon"), F.when(k == 1, "x").otherwise("2024-01-14"), s("2024-01-15"))
    return _events(spark, sf_dir).select(
        "event_id", F.date_format(D.next_slot(c("ts"), 9), "yyyy-MM-dd HH:mm:ss").alias("slot"), alerts.worth_looking(role, c("ts"), c("day"), k != 0, F.when(k == 1, c("day")).otherwise(s(None)), s(None).cast("string")).alias("worth"),
        D.ask_again(F.when(k == 0, True), F.when(k > 1, c("day")), "2024-01-15").alias("ask"), bounds["first"].alias("first_day"), bounds["last"].alias("last_day"), selected.alias("selected"))


@query(f"""
    WITH p AS (SELECT p_partkey, p_size, p_name AS n, p_size % 3 AS k FROM part)
    SELECT p_partkey, CASE WHEN k = 0 THEN 'Cenaze töreni · 8 Ekim · Öğle' WHEN k = 1 THEN 'Cenaze · 8 Ekim' ELSE 'Cenaze' END AS label,
      CASE k WHEN 0 THEN 'İzmir Merkez’de' WHEN 1 THEN 'Fatsa’da' ELSE 'Muş’ta' END || ' bugünkü cenaze ilanlarını göster' AS alert, CASE k WHEN 0 THEN 'Şehidimize ' WHEN 1 THEN 'Merhuma ' ELSE '' END || n AS counter,
      CASE k WHEN 0 THEN '2026-10-08 10:00:00' ELSE '1970-01-01 00:00:01' END AS fresh, CASE k WHEN 0 THEN 'Şehidimiz ' || n WHEN 1 THEN n ELSE n END AS title, CASE k WHEN 0 THEN 'Gizlendi · Düzeltildi' WHEN 1 THEN 'Kontrolde' ELSE '' END AS status,
      n || CASE k WHEN 0 THEN ' Vaizi' WHEN 1 THEN ' · Hoca' ELSE '' END AS official, CASE k WHEN 0 THEN 'user' || p_partkey ELSE NULL END AS account, CASE WHEN k = 0 THEN true WHEN k = 1 THEN false END AS approved, CASE WHEN p_partkey % 2 = 0 THEN 'e' END AS chosen FROM p""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a notice, an alert, a counter, the panel and an account say, by three kinds of part; and the user's choice."""
    c, k, s, key = F.col, F.col("p_size") % 3, F.lit, F.col("p_partkey")
    part = _table(spark, sf_dir, "part")
    pick = lambda a, b, d: F.when(k == 0, a).when(k == 1, b).otherwise(d)
    name = F.concat(s(" USER"), key.cast("string"))
    said = pick(F.concat(name, s("@diyanet.gov.tr ")), F.concat(name, s("@example.org")), s("ab"))
    body = pick(s('{"durum": "onayli"}'), s('{"durum": "kuyruk", "il": 1}'), s('{"il": "x"}'))
    rows = gender.with_choice(part, part.where(key % 2 == 0).select("p_partkey", F.lit("e").alias("choice")), "p_partkey")
    return rows.select(
        "p_partkey", listing.label(k == 0, pick(s("2026-10-08"), s("2026-10-08"), s("")), pick(s("ÖĞLE-X"), s("Ulu-öğle"), s(None))).alias("label"), alerts.alert_text(pick(s("İzmir"), s("Ordu"), s("Muş")), pick(s("Merkez"), s("Fatsa"), s(""))).alias("alert"),
        gender.counter_label(pick(s("s"), s("e"), s(None)), c("p_name")).alias("counter"), F.date_format(feeds.freshness(pick(s("2026-10-08T10:00:00Z"), s("x"), s(None)), s(1000)), "yyyy-MM-dd HH:mm:ss").alias("fresh"),
        cards.panel_title(c("p_name"), k == 0, s("")).alias("title"), cards.panel_status(pick(s("gizli"), s("bekliyor"), s("?")), pick(s("x"), s(""), s(None))).alias("status"), cards.official_title(c("p_name"), pick(s("Vaiz"), s("Hoca"), s(None))).alias("official"),
        cards.account_name(said).alias("account"), cards.account(body)["approved"].alias("approved"), "chosen")


@query(f"""
    WITH t AS (SELECT event_type AS tag, 1 AS n FROM events UNION ALL SELECT 'band-' || floor(value / 50)::INTEGER, 1 FROM events), l AS (SELECT DISTINCT event_type AS tag, upper(event_type) AS label FROM events WHERE event_type <> 'click')
    SELECT tag, count(*) AS n, label, row_number() OVER (ORDER BY count(*) DESC, {_key('label')}, tag)::BIGINT AS rank FROM t JOIN l USING (tag) GROUP BY tag, label QUALIFY rank <= 4""")
def labelled_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest tags that have a label."""
    e = _table(spark, sf_dir, "events")
    known = e.where("event_type <> 'click'").select(F.col("event_type").alias("tag"), F.upper("event_type").alias("label")).distinct()
    return people.top_tags(e, F.array("event_type", F.concat(F.lit("band-"), F.floor(F.col("value") / 50).cast("string"))), known).select("tag", "n", "label", "rank")


@query(f"""
    SELECT 'u' || user_id AS province, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS section, CASE WHEN event_id % 9 > 0 THEN event_type END AS district, string_agg(event_id::VARCHAR || ':' || {DAY}, ',' ORDER BY event_id) AS notices FROM events GROUP BY 1, 2, 3""")
def district_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each province's rows as its districts and its general section hold them, in order."""
    e = _events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("province"), F.when(F.col("event_id") % 9 == 0, 1).otherwise(0).alias("section"), F.when(F.col("event_id") % 9 > 0, F.col("event_type")).alias("district"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("id"), "day")
    lists = merge.by_district(e, "id", "day")
    return lists.withColumn("notices", F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["id"].cast("string"), n["day"])), ","))
