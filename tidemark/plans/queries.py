"""The library's operators over the driver's tables, one query each, and DuckDB SQL for what it can express.

The tables hold no notices, so each query is an analog: the same operator, fed with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import places as P
from tidemark.functions import text as X
from tidemark.operators import alerts, gender, listing, lockout, merge, panel, people, state, suppress
from tidemark.sources import feeds

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _low(x: str) -> str:
    return f"replace(lower(translate({x}, 'Iİ', 'ıi')), 'i\u0307', 'i')"


def _up(x: str) -> str:
    return f"upper(translate({x}, 'iı', 'İI'))"


def _fold(x: str) -> str:
    return f"translate({_low(x)}, '{X.MARKED}', '{X.PLAIN}')"


def _key(x: str) -> str:
    return f"list_transform(string_split({_low(x)}, ''), lambda c: CASE WHEN strpos('{X.ORDER}', c) > 0 THEN strpos('{X.ORDER}', c) - 1 ELSE 1000 + unicode(c) END)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """rows over all cores: a small file is one task or two, however much is done with each of its rows."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("day", D.day_text(F.col("ts")))


DAY = "strftime(ts, '%Y-%m-%d')"


PLACES = ["Ünye", "Çamaş", "Fatsa", "Iğdır", "İkizce"]


@query(f"""
    WITH r AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS section_rank, event_type = 'error' OR (event_type = 'purchase' AND user_id % 7 = 0) AS general,
      coalesce(CASE WHEN user_id % 3 = 0 THEN {DAY} END, CASE WHEN user_id % 5 = 0 THEN strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') END,
               CASE WHEN event_type = 'click' THEN strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') END, strftime(ts - INTERVAL 2 DAY, '%Y-%m-%d')) AS day FROM events),
      e AS (SELECT *, CASE WHEN NOT general THEN {PLACES!r}[user_id % 5 + 1] END AS district FROM r)
    SELECT event_id, day, section_rank::BIGINT AS section_rank,
      row_number() OVER (PARTITION BY day ORDER BY section_rank, general, {_key('district')}, event_id)::BIGINT AS place FROM e""")
def day_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's listing in order: funeral day; martyrs, districts, general; within these districts in order, general last; input order."""
    e, user, kind = _events(spark, sf_dir), F.col("user_id"), F.col("event_type")
    burial = F.when(user % 5 == 0, D.add_days(F.col("day"), 1)).otherwise("after noon")
    day = listing.funeral_day(F.when(user % 3 == 0, F.col("day")), burial, F.when(kind == "click", D.add_days(F.col("day"), -1)), D.add_days(F.col("day"), -2))
    general = (kind == "error") | ((kind == "purchase") & (user % 7 == 0))
    district = F.when(~general, F.get(F.array(*map(F.lit, PLACES)), (user % 5).cast("int")))
    rows = e.select("event_id", day.alias("day"), (kind == "purchase").alias("martyr"), F.when(general, 1).otherwise(0).alias("section"), district.alias("district"))
    return listing.ranked(rows, ["day"], ordinal="event_id").select("event_id", "day", F.col("section_rank").cast("long"), "place")


@query(f"""
    WITH d AS (SELECT o AS "offset", strftime(DATE '2024-01-29' + o::INTEGER, '%Y-%m-%d') AS day FROM range(-6, 3) t(o)),
         n AS (SELECT {DAY} AS day, count(*) AS n FROM events GROUP BY 1)
    SELECT "offset", d.day, coalesce(n.n, 0)::BIGINT AS n FROM d LEFT JOIN n USING (day) WHERE "offset" <= 1 OR n.n > 0""")
def date_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.date_strip(_events(spark, sf_dir), "2024-01-29")


@query("""
    WITH s AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)
    SELECT event_id, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS n FROM s""")
def clamped_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _events(spark, sf_dir).withColumn("step", F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1))
    return state.clamped_counter(steps, ["user_id"], ["ts", "event_id"], "step", F.col("day")).select("event_id", "n")


@query(f"""
    SELECT p_partkey, rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, {_key('p_name')}, p_partkey)::BIGINT AS rank FROM part) WHERE rank <= 120""")
def ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of the most prominent."""
    return listing.page(_table(spark, sf_dir, "part"), people.by_prominence("p_size", "p_name", "p_partkey"), pages=2).select("p_partkey", "rank")


@query(f"""
    WITH t AS (SELECT event_type AS tag FROM events UNION ALL SELECT 'band-' || floor(value / 50)::INTEGER FROM events), n AS (SELECT tag, count(*) AS n FROM t GROUP BY 1)
    SELECT tag, n, rank FROM (SELECT tag, n, row_number() OVER (ORDER BY n DESC, {_key('tag')}, tag)::BIGINT AS rank FROM n) WHERE rank <= 4""")
def tag_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.top_tags(_table(spark, sf_dir, "events"), F.array("event_type", F.concat(F.lit("band-"), F.floor(F.col("value") / 50).cast("string"))))


@query(f"SELECT p_partkey, p_name FROM part WHERE contains({_fold('p_name')}, 'ring')")
def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.search(_table(spark, sf_dir, "part"), "p_name", "RİNG").select("p_partkey", "p_name")


@query(f"SELECT n_name, row_number() OVER (ORDER BY {_key('n_name')}, n_nationkey)::BIGINT AS rank FROM nation")
def turkish_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.ranked_by_name(_table(spark, sf_dir, "nation"), "n_name", "n_nationkey").select("n_name", "rank")


@query("""
    WITH e AS (SELECT event_id, event_type, user_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 11 = 0 THEN NULL ELSE floor(value / 10)::INTEGER END AS v FROM events)
    SELECT a.event_id AS id, count(*)::BIGINT AS matches, min(b.event_id) AS first_match FROM e a JOIN e b ON a.user_id = b.user_id AND abs(date_diff('day', b.d, a.d)) <= 2
      AND (a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) <= 1) WHERE a.event_type = 'purchase' AND b.event_type = 'signup' GROUP BY 1""")
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with their likely sign-ups: same user, days and values near."""
    e = _events(spark, sf_dir).select("event_id", "event_type", "user_id", F.to_date("ts").alias("d"), F.when(F.col("event_id") % 11 != 0, F.floor(F.col("value") / 10).cast("int")).alias("v"))
    return merge.band_matches(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "user_id", "d", "v", "event_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.quality = 0 OR l.toxic = 1))")
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.excluded(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1"), "doc_id")


@query("""
    SELECT event_id FROM events e WHERE hour(ts) >= 12 AND NOT EXISTS
      (SELECT 1 FROM events m WHERE hour(m.ts) < 12 AND m.user_id = e.user_id AND m.event_type = e.event_type AND CAST(m.ts AS DATE) = CAST(e.ts AS DATE))""")
def new_since_morning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return alerts.unseen(e.where(F.hour("ts") >= 12), e.where(F.hour("ts") < 12), ["user_id", "event_type", "day"]).select("event_id")


@query("""
    SELECT c_custkey, (r_name = 'ASIA' OR (r_name = 'EUROPE' AND n_name = 'NATION_3') OR n_name || '-' || c_custkey = 'NATION_4-55' OR n_name || '-' || c_custkey LIKE '%-2') AS hidden
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def emergency_hide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row is of the general section and names its district itself."""
    places = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.col("r_name").alias("province"), F.when(F.col("c_custkey") % 3 > 0, F.col("n_name")).alias("district"), F.col("n_name").alias("ilce"), F.concat_ws("-", "n_name", F.col("c_custkey").cast("string")).alias("id"))
    return suppress.hidden_flags(rows, ["Asia"], ["europe/Nation 3", "no place"], ["2", "NATION_4-55"]).select("c_custkey", "hidden")


@query("""
    WITH c AS (SELECT o_orderkey + 100000000 AS k, o_totalprice AS p, CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey ELSE -o_orderkey END AS target FROM orders WHERE o_orderkey % 10 = 0)
    SELECT o_orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.target = o.o_orderkey) UNION ALL SELECT k, p FROM c""")
def correction_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth order is corrected; half of the corrections name no order."""
    base = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    target = F.when(F.col("o_orderkey") % 20 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    fixes = base.where(F.col("o_orderkey") % 10 == 0).select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), "o_totalprice", target.alias("target"))
    return merge.replaced(base, fixes, "o_orderkey", "target")


@query(f"""
    WITH f AS (SELECT p_partkey, p_size, {_up("substr(string_split(p_name, ' ')[1], 1, 1)")} || {_low("substr(string_split(p_name, ' ')[1], 2)")} AS f FROM part)
    SELECT p_partkey, CASE WHEN p_size = 1 THEN 's' WHEN p_size = 2 THEN 'b' WHEN p_size % 7 = 0 THEN 'k' WHEN length(f) < 4 THEN 'e' WHEN length(f) > 4 THEN 'k' WHEN p_size % 2 = 0 THEN 'e' END AS code FROM f""")
def gender_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder with both name lists; a name in both decides nothing."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    names = rows.select(gender.first_name(F.col("p_name")).alias("name")).distinct()
    rows = gender.listed_gender(rows, "p_name", names.where(F.length("name") <= 4), names.where(F.length("name") >= 4))
    size = F.col("p_size")
    return rows.select("p_partkey", gender.resolved(size == 1, size == 2, F.when(size % 7 == 0, "k"), F.col("listed"), F.when(size % 2 == 0, "e")).alias("code"))


@query(f"""
    WITH a AS (SELECT DISTINCT user_id AS key, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d') AS before FROM events WHERE event_type = 'signup'
               UNION ALL SELECT user_id, x.day, x.before FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('soon', 'soon'), ('2024-01-32', '2024-01-31'), ('', '')) x(day, before)),
         p AS (SELECT user_id AS key, {DAY} AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
         j AS (SELECT a.key, a.day, a.before, coalesce(o.n, 0)::BIGINT AS n_own, coalesce(b.n, 0)::BIGINT AS n_before FROM a
               LEFT JOIN p o ON o.key = a.key AND o.day = a.day LEFT JOIN p b ON b.key = a.key AND b.day = a.before)
    SELECT key, day, n_own, n_before, CASE WHEN n_own > 0 THEN day WHEN n_before > 0 THEN before END AS shown_day FROM j""")
def yesterday_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days after sign-ups, a day that rolls over and texts that are no day: the day's purchases, or else the day before's."""
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "key")
    asked = e.where("event_type = 'signup'").select("key", D.add_days(F.col("day"), 1).alias("day")).distinct()
    odd = e.select("key").distinct().select("key", F.explode(F.array(F.lit("soon"), F.lit("2024-01-32"), F.lit(""))).alias("day"))
    return listing.with_yesterday(e.where("event_type = 'purchase'"), asked.unionByName(odd))


@query(r"""
    WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)
    SELECT doc_id, n::BIGINT AS n_words, n BETWEEN 2 AND 5 AS name_like FROM w""")
def word_count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return _table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words"), n.between(2, 5).alias("name_like"))


@query("""
    WITH RECURSIVE e AS (SELECT 'e' || event_id % 4000 AS id, event_id AS place, user_id AS scope, event_type IN ('purchase', 'signup') AS is_base, floor(value / 5)::BIGINT::VARCHAR AS key,
        CASE WHEN event_id % 13 <> 0 THEN (event_id % 60)::INTEGER END AS age, CAST(ts AS DATE) AS day, CASE WHEN event_id % 17 = 0 THEN 'e' || (event_id + 4) % 4000 END AS corrects FROM events),
      f AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY place) AS n FROM e WHERE NOT is_base),
      s AS (SELECT scope, 0::BIGINT AS n, list({'feed': false, 'place': place, 'id': id, 'key': key, 'age': age, 'day': day}) AS kept FROM e WHERE is_base GROUP BY scope
        UNION ALL
        SELECT s.scope, f.n, CASE
            WHEN len(list_filter(kept, lambda x: x.id = f.id)) > 0 THEN kept
            WHEN f.corrects IS NOT NULL THEN list_append(list_filter(kept, lambda x: x.id <> f.corrects), {'feed': true, 'place': f.place, 'id': f.id, 'key': f.key, 'age': f.age, 'day': f.day})
            WHEN len(list_filter(kept, lambda x: x.key = f.key AND abs(x.day - f.day) <= 2 AND (x.age IS NULL OR f.age IS NULL OR abs(x.age - f.age) <= 1))) > 0 THEN kept
            ELSE list_append(kept, {'feed': true, 'place': f.place, 'id': f.id, 'key': f.key, 'age': f.age, 'day': f.day}) END
        FROM s JOIN f ON f.scope = s.scope AND f.n = s.n + 1),
      u AS (SELECT scope, unnest(kept) AS x FROM (SELECT scope, arg_max(kept, n) AS kept FROM s GROUP BY scope))
    SELECT scope, x.id AS id, x.place AS place, x.feed AS feed FROM u""")
def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and sign-ups as a table, the other events as a feed to it; users are scopes."""
    e = _events(spark, sf_dir).select(
        F.concat(F.lit("e"), (F.col("event_id") % 4000).cast("string")).alias("id"), F.col("event_id").alias("place"), F.col("user_id").alias("scope"), F.col("event_type").isin("purchase", "signup").alias("is_base"),
        F.floor(F.col("value") / 5).cast("string").alias("key"), F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 60).cast("int")).alias("age"), F.array(F.unix_date(F.to_date("ts"))).alias("days"),
        F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("e"), ((F.col("event_id") + 4) % 4000).cast("string"))).alias("corrects"))
    return merge.greedy_merge(e.where("is_base"), e.where("not is_base"))


@query("""
    WITH RECURSIVE a AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) / 1e6 AS at, event_id AS tie, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      s AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS tie, 0 AS failures, -1e18::DOUBLE AS until, '' AS result FROM a WHERE n = 1
        UNION ALL
        SELECT a.key, a.n, a.tie, CASE WHEN a.at < s.until THEN failures WHEN ok OR failures + 1 >= 5 THEN 0 ELSE failures + 1 END, CASE WHEN a.at < s.until THEN s.until WHEN NOT ok AND failures + 1 >= 5 THEN a.at + 21600 ELSE -1e18 END,
          CASE WHEN a.at < s.until THEN 'ignored' WHEN ok THEN 'success' WHEN failures + 1 >= 5 THEN 'locked' ELSE 'failed' END
        FROM s JOIN a ON a.key = s.key AND a.n = s.n + 1)
    SELECT key, tie, result FROM s WHERE n > 0""")
def attempt_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but purchases as failed attempts of a user, 6 hours' lock."""
    e = _events(spark, sf_dir).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return lockout.lockout(e, "user_id", "at", "event_id", "ok", lock_s=21_600.0)


CASED = "p_name || ' IİI.x i\u0307s ' || p_type || ' mez.'"


@query(f"""
    WITH t AS (SELECT p_partkey, {CASED} AS s FROM part), l AS (SELECT *, {_low('s')} AS lower, regexp_extract({_low('s')}, '([{X.VOWELS}])[^{X.VOWELS}]*$', 1) AS v FROM t)
    SELECT p_partkey, lower, {_up('s')} AS upper, {_fold('s')} AS folded, regexp_replace({_fold('s')}, '[^a-z0-9]', '', 'g') AS slug, {_up('substr(lower, 1, 1)')} || substr(lower, 2) AS sentence,
      regexp_replace(array_to_string(list_transform(string_split({_low("regexp_replace(s, '[.]([^[:space:]0-9])', '. \\1', 'g')")}, ' '), lambda w: {_up('substr(w, 1, 1)')} || substr(w, 2)), ' '), '(^| )Mez[.]( |$)', '\\1Mezarlığı\\2', 'g') AS title,
      s || '’' || CASE WHEN regexp_matches(right(lower, 1), '[{X.VOICELESS}]') THEN 't' ELSE 'd' END || CASE WHEN regexp_matches(v, '[{X.FRONT}]') THEN 'e' ELSE 'a' END AS placed FROM l""")
def text_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat("p_name", F.lit(" IİI.x i\u0307s "), "p_type", F.lit(" mez."))
    return _table(spark, sf_dir, "part").select("p_partkey", X.tr_lower(s).alias("lower"), X.tr_upper(s).alias("upper"), X.fold(s).alias("folded"), X.slug(s).alias("slug"), X.sentence_case(s).alias("sentence"), X.title_case(s).alias("title"), X.locative(s).alias("placed"))


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"""
    SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS local_day, strftime(ts + INTERVAL 3 HOUR, '%H:%M') AS local_time, dayofweek(ts)::BIGINT AS weekday,
      day(ts) || ' ' || {_list(D.MONTHS)}[month(ts)] || ' ' || year(ts) AS words, day(ts) || ' ' || {_list(D.MONTHS)}[month(ts)] || ' ' || {_list(D.DAYS)}[dayofweek(ts) + 1] AS label,
      strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d') AS later, hour(ts) >= 21 OR hour(ts) < 7 AS is_quiet FROM events""")
def date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, at = F.col("day"), F.col("ts").cast("timestamp")
    return _events(spark, sf_dir).select("event_id", D.turkey_day(at).alias("local_day"), D.turkey_hour(at).alias("local_time"), D.weekday(day).cast("long").alias("weekday"), D.long_date(day).alias("words"), D.day_label(day).alias("label"), D.add_days(day, 2).alias("later"), D.quiet(F.col("ts")).alias("is_quiet"))


@query("""
    WITH t AS (SELECT p_partkey, p_size, string_split(lower(p_name), ' ') AS g, lower(p_type) AS kind FROM part),
         u AS (SELECT p_partkey, g, [kind, g[2]] AS a, CASE WHEN p_size % 2 = 0 THEN [g[1]] ELSE [] END AS b, CASE WHEN p_size % 3 = 0 THEN [g[2]] ELSE [] END AS x FROM t),
         v AS (SELECT *, list_filter(g, lambda w: length(w) >= 4 AND NOT list_contains(x, w)) AS telling FROM u)
    SELECT p_partkey, a = g OR list_has_any(telling, a) OR (len(b) > 0 AND (b = g[len(g):] OR list_has_any(telling, b))) AS matches FROM v""")
def place_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, words, even = _table(spark, sf_dir, "part"), F.split("p_name", " "), F.col("p_size")
    mosque = F.concat_ws(" ", "p_type", words[1], F.lit("Mescidi"))
    found = P.places_match(F.concat("p_name", F.lit(" CAMİİ")), mosque, F.when(even % 2 == 0, F.concat(words[0], F.lit(" Mahallesi"))), F.when(even % 3 == 0, words[1]))
    return part.select("p_partkey", found.alias("matches"))


@query("""
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' UNION ALL
    SELECT o_orderkey, 0.0 FROM orders n WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderstatus = 'O' AND s.o_orderkey = n.o_orderkey)""")
def saved_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return state.insert_absent(orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), "o_orderkey")


@query("""
    WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT 'orders' AS name, count(*)::BIGINT AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone) UNION ALL
    SELECT 'lineitem', count(*)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    left = state.deleted({"orders": orders, "lineitem": _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))}, orders.where("o_orderstatus = 'P'"), "o_orderkey")
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT c_custkey, coalesce(sum(o_orderkey % 7), 0)::BIGINT AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 7).alias("n"))
    return state.totals(_table(spark, sf_dir, "customer"), counters, "c_custkey")


@query("""
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)
      AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def less_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    partial = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("key"))
    keyed = c.select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    return people.less(keyed, [partial, c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("key"))], "key").select("c_custkey")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'remote' ELSE o_orderstatus END AS a, o_orderpriority AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'new' END AS c FROM orders""")
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.col("o_orderpriority"))
    merged = feeds.overlaid(defaults, F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("a"), F.lit("remote"), F.lit("c"), F.lit("new"))))
    return _table(spark, sf_dir, "orders").select("o_orderkey", *(F.try_element_at(merged, F.lit(k)).alias(k) for k in "abc"))


@query("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id ELSE event_type || '_' || strftime(ts, '%Y-%m-%d') END AS id, CASE WHEN event_id % 5 < 3 THEN (props->>'$.k')::BIGINT END AS yas, event_type = 'error' AS aile FROM events""")
def notice_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON notices, read back through the whitelist: default id, ages as numbers (cut to whole ones) and as texts (whole ones only), strict flags."""
    odd, k = F.col("event_id") % 2 == 1, F.get_json_object("props", "$.k")
    told = F.to_json(F.struct(F.when(~odd, F.concat(F.lit(" n"), F.col("event_id").cast("string"))).alias("id"), F.concat(F.lit(" "), "event_type").alias("ad_soyad"), F.col("day").alias("vefat_tarihi"), F.when(F.col("event_type") == "error", "aile").alias("kaynak_turu"), F.lit("secret").alias("telefon")))
    age = F.get(F.array(k, F.concat(k, F.lit(".9")), F.concat(F.lit('" '), k, F.lit('"')), F.concat(F.lit('"'), k, F.lit('.5"')), F.lit("true")), (F.col("event_id") % 5).cast("int"))
    raw = F.concat(F.lit('{"yas": '), age, F.lit(", "), F.substr(told, F.lit(2)))
    rows = feeds.notices_of(_spread(_events(spark, sf_dir)), raw, "event_id")
    return rows.select("event_id", "n.id", F.col("n.yas").cast("long").alias("yas"), "n.aile")


@query(f"""
    WITH i AS (SELECT user_id, {DAY} AS day, event_type, max(CASE WHEN hour(ts) < 12 THEN 1 ELSE 0 END) AS m FROM events GROUP BY 1, 2, 3)
    SELECT user_id, day, sum(m)::BIGINT AS n_morning, sum(1 - m)::BIGINT AS n_new, sum(m) > 0 AS morning, sum(m) > 0 AND sum(1 - m) > 0 AS noon FROM i GROUP BY 1, 2""")
def alert_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.decisions(_events(spark, sf_dir), "user_id", "day", "event_type", F.hour("ts") < 12)


@query("""
    SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 10 = 0 THEN 'unverified' ELSE 'ok' END WHEN value > 50 THEN 'cached'
      WHEN event_type = 'error' THEN 'offline' WHEN event_type = 'click' THEN 'no_source' ELSE 'failed' END AS status FROM events""")
def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 404).when(F.col("event_type") != "error", 500)
    return _table(spark, sf_dir, "events").select("event_id", feeds.scan_status(code, F.col("value") > 50, F.col("event_id") % 10 != 0).alias("status"))


@query("""
    WITH c AS (SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 5 <> 0),
         o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS n, r_name, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][s_suppkey % 5 + 1] AS g
               FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey AS officer, c_custkey FROM c JOIN o ON c.r_name = o.r_name AND (o.n IS NULL OR o.n = c.n_name) AND c.c_mktsegment = o.g""")
def officer_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notices and suppliers as officers: who is shown which notices by their place."""
    at = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c, s = _table(spark, sf_dir, "customer").join(at, F.col("c_nationkey") == F.col("n_nationkey")), _table(spark, sf_dir, "supplier").join(at, F.col("s_nationkey") == F.col("n_nationkey"))
    prayer = F.concat(F.lit("Öğle-"), "c_mktsegment", F.lit(" CAMİİ"))
    rows = c.select("c_custkey", F.col("r_name").alias("province"), F.col("n_name").alias("district"), F.lit(0).alias("section"), (F.col("c_custkey") % 5 == 0).alias("gorevli"), F.lit(False).alias("sehit"), prayer.alias("namaz_yeri_vakti"), F.lit(None).cast("string").alias("mahalle"))
    place = F.concat(F.get(F.array(*map(F.lit, ("Automobile", "Building", "Furniture", "Household", "Machinery"))), (F.col("s_suppkey") % 5).cast("int")), F.lit(" Camii"))
    officers = s.select(F.col("s_suppkey").alias("officer"), F.col("r_name").alias("il"), F.when(F.col("s_suppkey") % 2 == 0, X.tr_lower(F.col("n_name"))).alias("ilce"), place.alias("gorev_yeri"))
    return panel.of_place(rows, officers).select("officer", "c_custkey")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'set' WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def form_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order is patched: a field that is absent stays, one that is emptied in an edit goes."""
    orders, k = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderkey")
    forms = orders.where(k % 3 == 0).select("o_orderkey", F.when(k % 2 == 0, "new").alias("o_orderstatus"), F.when(k % 4 == 0, "set").alias("o_orderpriority"))
    return panel.patched(orders, panel.patch(forms, ["o_orderstatus"], ["o_orderpriority"], k % 5 == 0), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(r"""
    SELECT p_partkey, length(p_name) - length(replace(p_name, ' ', '')) + 2 BETWEEN 2 AND 5 AS name_like, length(p_size || '' || p_partkey) = 4 AS code_like, p_name AS reported,
      p_brand AS il, p_name AS ilce, CASE WHEN p_size % 2 = 0 THEN p_type || '|x' ELSE '' END AS place, p_size % 3 = 0 AS holds, p_size > 0 AND p_size < 20 AS outdated, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' Kıssadan hisse: ' || p_type END AS told FROM part""")
def panel_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, codes, ids, place records, consents, versions and morals as a panel checks them."""
    c, even = F.col, F.col("p_size") % 2 == 0
    at = panel.place_record(F.when(even, F.concat_ws("|", "p_brand", "p_name", "p_type", F.lit("x"))).otherwise(F.concat_ws("|", "p_brand", "p_name")))
    said = F.concat(c("p_name"), F.lit(" Kıssadan hisse: "), c("p_type"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", panel.name_fits(F.concat(F.lit(" "), c("p_name"), F.lit("  soyad "))).alias("name_like"), panel.code_fits(F.concat(c("p_size").cast("string"), c("p_partkey").cast("string"))).alias("code_like"),
        panel.report_id(F.concat(F.when(even, "aile-").otherwise("gorevli-"), c("p_name"))).alias("reported"), at["il"].alias("il"), at["ilce"].alias("ilce"), at["gorev_yeri"].alias("place"),
        panel.consent_holds(F.concat(c("p_brand"), F.when(c("p_size") % 3 == 0, "|").otherwise(":"), F.lit("2026-10-08")), c("p_brand")).alias("holds"), panel.must_update(c("p_size"), F.lit(20)).alias("outdated"),
        panel.without_moral(said, F.when(even, c("p_type"))).alias("told"))
