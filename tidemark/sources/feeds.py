"""Notices, people and settings from nested JSON, through a whitelist of fields; snapshots in Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tidemark.functions.text import bare, trimmed

#: The text fields and the flags of a notice that are read, in the source's order.
TEXT = "id ad_soyad il ilce mahalle vefat_tarihi defin_yeri defin_zamani namaz_tarihi namaz_yeri_vakti liste_tarihi cinsiyet rutbe toren gorev_yeri duzeltme_id kaynak_turu".split()
FLAGS = "sehit bebek aile gorevli".split()
NOTICE_IN = T.StructType(
    [T.StructField(n, T.StringType()) for n in TEXT] + [T.StructField("yas", T.VariantType())] + [T.StructField(n, T.BooleanType()) for n in FLAGS]
    + [T.StructField("il_disi_defin", T.StructType([T.StructField("il", T.StringType()), T.StructField("ilce", T.StringType())]))]
)
PROVINCE_IN = T.StructType([
    T.StructField("il", T.StringType()), T.StructField("guncelleme", T.StringType()), T.StructField("ilceler", T.MapType(T.StringType(), T.VariantType())),
    T.StructField("ilce_belirsiz", T.VariantType()), T.StructField("il_disi", T.VariantType()),
])
FEED_IN = T.StructType([T.StructField("il", T.StringType()), T.StructField("kayitlar", T.VariantType())])
PERSON_IN = "ad string, vefat_tarihi string, dogum_tarihi string, vefat_yasi variant, vefat_yasi_yaklasik boolean, wikidata_id string, sitelink variant, sitelink_sayisi variant, turk boolean, meslek variant, neden_onemli string, aciklama string, aciklama_kaynak string, sira string"
#: Spellings of gender that are accepted.
GENDERS = {"Erkek": "e", "erkek": "e", "e": "e", "Kadın": "k", "kadın": "k", "k": "k"}


def whole(v: Column) -> Column:
    """An integer from a JSON value: a number is cut to one, text must be one; anything else is null."""
    kind = F.schema_of_variant(v)
    text = bare(F.try_variant_get(v, "$", "string"))
    spelled = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")).when(text.rlike("^0[xX][0-9a-fA-F]{1,7}$"), F.conv(F.substr(text, F.lit(3)), 16, 10).try_cast("int"))
    number = F.try_variant_get(v, "$", "double").try_cast("int")
    return F.when(kind == "STRING", spelled).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), number)


def professions(v: Column) -> Column:
    """A list of texts from a JSON list, or from text with commas; else none."""
    text, many = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "array<string>")
    return F.when(F.schema_of_variant(v) == "STRING", F.split(text, ",")).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def notice(n: Column) -> Column:
    """A raw notice by the whitelist: trimmed text, strict flags, a default id. Names may be null: filter those."""
    t = {f: trimmed(n[f]) for f in TEXT}
    gender = F.lit(None).cast("string")
    for said, code in GENDERS.items():
        gender = F.when(t["cinsiyet"] == said, code).otherwise(gender)
    flags = {f: F.coalesce(n[f], F.lit(False)) for f in FLAGS}
    flags["aile"] |= t["kaynak_turu"].eqNullSafe("aile")
    key = F.coalesce(t["id"], F.concat(t["ad_soyad"], F.lit("_"), F.coalesce(t["vefat_tarihi"], F.lit(""))))
    texts = [t[f].alias(f) for f in TEXT if f not in ("id", "cinsiyet", "kaynak_turu")]
    away = [trimmed(n["il_disi_defin"][f]).alias(f"defin_{f}") for f in ("il", "ilce")]
    return F.struct(key.alias("id"), *texts, gender.alias("cinsiyet"), whole(n["yas"]).alias("yas"), *(c.alias(f) for f, c in flags.items()), *away)


def notices_of(rows: DataFrame, json: Column, *keys: str) -> DataFrame:
    """keys, and n: the notice that a JSON text tells, by the whitelist. The text is parsed once for a row, in a step of its own, not once for each use of a field."""
    return rows.select(*keys, F.from_json(json, NOTICE_IN).alias("n")).select(*keys, notice(F.col("n")).alias("n"))


def raw_notices(v: Column) -> Column:
    """The objects of a JSON list, by the fields that are read; what is no list is an empty one, what is no object is left out."""
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.from_json(F.lit("[]"), "array<variant>"))
    objects = F.filter(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    return F.transform(objects, lambda x: F.from_json(F.to_json(x), NOTICE_IN))


def flat(provinces: DataFrame) -> DataFrame:
    """A row per notice: province, section (0 districts, 1 general), district and its number, ordinal, and the notice's fields."""
    general = F.concat(raw_notices(F.col("ilce_belirsiz")), raw_notices(F.col("il_disi")))
    sections = [
        provinces.select("il", "guncelleme", F.posexplode("ilceler").alias("district_no", "district", "list")).select("il", "guncelleme", F.lit(0).alias("section"), "district", "district_no", F.posexplode(raw_notices(F.col("list"))).alias("ordinal", "n")),
        provinces.select("il", "guncelleme", F.lit(1).alias("section"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("int").alias("district_no"), F.posexplode(general).alias("ordinal", "n")),
    ]
    rows = sections[0].unionByName(sections[1]).where("n is not null").withColumn("n", notice(F.col("n")))
    return rows.where("n.ad_soyad is not null").select(F.col("il").alias("province"), "guncelleme", "section", "district", "district_no", "ordinal", "n.*")


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_provinces(spark: SparkSession, path: str) -> DataFrame:
    """Province files, a JSON object each, as rows of notices."""
    return flat(_json(spark, path, PROVINCE_IN))


def read_feed(spark: SparkSession, path: str, today: str) -> DataFrame:
    """The officers' feed within its window; a missing feed is an empty one."""
    try:
        raw = _json(spark, path, FEED_IN)
    except AnalysisException:
        raw = spark.createDataFrame([], FEED_IN)
    return feed_rows(raw, today)


def feed_rows(raw: DataFrame, today: str) -> DataFrame:
    """Rows with an id and both days, whose prayer day is from today less 7 to today plus 2; ids are marked."""
    rows = raw.select(F.col("il").alias("province"), F.posexplode(raw_notices(F.col("kayitlar"))).alias("ordinal", "raw")).where("raw is not null")
    iso = r"^\d{4}-\d{2}-\d{2}"
    low, high = (F.date_format(F.date_add(F.to_date(F.lit(today)), d), "yyyy-MM-dd") for d in (-7, 2))
    rows = rows.where(F.col("raw.namaz_tarihi").rlike(iso) & F.col("raw.vefat_tarihi").rlike(iso) & F.col("raw.namaz_tarihi").between(low, high) & (F.col("raw.id") != ""))
    rows = rows.withColumn("raw", F.col("raw").withField("id", F.concat(F.lit("gorevli-"), F.substring("raw.id", 1, 32))).withField("gorevli", F.lit(True)).dropFields("kaynak_turu", "aile"))
    rows = rows.withColumn("raw", F.col("raw").withField("kaynak_turu", F.lit(None).cast("string")).withField("aile", F.lit(False)))
    return rows.withColumn("n", notice(F.col("raw"))).where("n.ad_soyad is not null").select("province", "ordinal", "n.*")


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """People with the name of their file (a category, or MM-DD), which rules over the day in the record."""
    rows = spark.read.schema(PERSON_IN).option("multiLine", True).json(path)
    links = F.coalesce(F.when(~F.is_variant_null("sitelink"), F.col("sitelink")), F.col("sitelink_sayisi"))
    read = {"file": F.regexp_extract("_metadata.file_name", r"([^/]+)\.json$", 1), "vefat_yasi": whole(F.col("vefat_yasi")), "sitelink": F.coalesce(whole(links), F.lit(0)), "meslek": professions(F.col("meslek"))}
    return rows.withColumns(read).drop("sitelink_sayisi")


def write_people(people: DataFrame, path: str) -> None:
    """Rows of read_people in a folder for each file, so that a day's or a category's rows are read by its name."""
    people.repartition("file").write.mode("overwrite").partitionBy("file").parquet(path)


def people_of(spark: SparkSession, path: str, *files: str) -> DataFrame:
    """The rows of some files (MM-DD, or categories) of write_people; only their folders are read."""
    return spark.read.parquet(path).where(F.col("file").isin(*files))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name, list (e or k) of the two lists of first names."""
    raw = _json(spark, path, "e array<string>, k array<string>")
    return raw.select(F.explode(F.map_from_arrays(F.array(F.lit("e"), F.lit("k")), F.array("e", "k"))).alias("list", "names")).select(F.explode("names").alias("name"), "list").where("name IS NOT NULL")


def read_excluded(spark: SparkSession, path: str) -> DataFrame:
    """wikidata_id of the entities that are left out: a JSON list of ids."""
    body = spark.read.option("wholetext", True).text(path)
    return body.select(F.explode(F.from_json("value", "array<string>")).alias("wikidata_id")).where("wikidata_id IS NOT NULL").distinct()


def excluded_ids(candidates: DataFrame, always: list[str]) -> DataFrame:
    """wikidata_id of rows that are no mere candidates (aday), and of those always left out, each once."""
    own = candidates.where(~F.coalesce(F.col("aday"), F.lit(False))).select("wikidata_id")
    more = candidates.sparkSession.createDataFrame([(i,) for i in always], "wikidata_id string")
    return own.unionByName(more).where("wikidata_id IS NOT NULL").distinct()


def read_prayers(spark: SparkSession, path: str, fields: tuple[str, ...] = ("b", "ar", "ok", "an", "k", "kadin", "not")) -> tuple[DataFrame, DataFrame]:
    """Prayers by section (section, ordinal, the fields that are shown, tags), and the labels of tags."""
    item = ", ".join(f"`{f}`: string" for f in fields) + ", e: array<string>"
    raw = _json(spark, path, f"etiketler map<string,string>, bolumler array<struct<k: string, ad: string, liste: array<struct<{item}>>>>")
    rows = raw.select(F.explode("bolumler").alias("s")).select(F.col("s.k").alias("section"), F.posexplode("s.liste").alias("ordinal", "p"))
    shown = rows.select("section", "ordinal", *(F.nullif(F.col("p")[f], F.lit("")).alias(f) for f in fields), F.coalesce("p.e", F.array().cast("array<string>")).alias("tags"))
    return shown, raw.select(F.explode("etiketler").alias("tag", "label"))


def read_prayer_times(spark: SparkSession, path: str) -> DataFrame:
    """district, day, slot (from 0), time."""
    raw = _json(spark, path, "ilceler map<string, map<string, string>>")
    days = raw.select(F.explode("ilceler").alias("district", "days")).select("district", F.explode("days").alias("day", "times"))
    return days.select("district", "day", F.posexplode(F.split(F.trim("times"), r"[\s,]+")).alias("slot", "time"))


def write_snapshot(rows: DataFrame, path: str) -> None:
    """The last good snapshot, a folder for each province; only provinces in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("province").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and a notice as one JSON text of the whitelist's fields, the burial elsewhere as an object (null if it names no province)."""
    away = F.when(F.col("defin_il").isNotNull(), F.struct(F.col("defin_il").alias("il"), F.col("defin_ilce").alias("ilce")))
    fields = [c for c in rows.columns if c in {*TEXT, *FLAGS, "yas"}]
    return rows.select(*keys, F.to_json(F.struct(*fields, away.alias("il_disi_defin"))).alias("json"))


SETTINGS_IN = "yazilar map<string,string>, kaliplar map<string,string>, listeler map<string,array<string>>, haritalar map<string,map<string,string>>, bayraklar map<string,boolean>, sayilar map<string,double>, acil_gizle struct<il: array<string>, ilce: array<string>, id: array<string>>"
#: Flags that may also stand beside the sections.
LOOSE_FLAGS = ("ilce_sayfasinda_il_geneli", "bugun_bossa_dunu_goster")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row of settings by section; what a section doesn't have is an empty map or list, and loose flags join theirs unless named there."""
    loose = ", ".join(f"{name} boolean" for name in LOOSE_FLAGS)
    raw = _json(spark, path, f"{SETTINGS_IN}, {loose}")
    sections = T.StructType.fromDDL(SETTINGS_IN)
    out = {f.name: F.coalesce(f.name, F.from_json(F.lit("{}"), f.dataType)) for f in sections if f.name != "acil_gizle"}
    flags = out["bayraklar"]
    for name in LOOSE_FLAGS:
        flags = F.when(F.col(name).isNotNull() & ~F.map_contains_key(out["bayraklar"], name), F.map_concat(flags, F.create_map(F.lit(name), F.col(name)))).otherwise(flags)
    hide = F.struct(*(F.coalesce(F.col(f"acil_gizle.{k}"), F.array().cast("array<string>")).alias(k) for k in ("il", "ilce", "id")))
    return raw.select(*((flags if k == "bayraklar" else c).alias(k) for k, c in out.items()), hide.alias("acil_gizle"))


def overlaid(defaults: Column, remote: Column) -> Column:
    """A settings map with the remote's entries over the defaults'."""
    keys = F.map_keys(F.coalesce(remote, defaults))
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.array_contains(keys, k) | remote.isNull()), F.coalesce(remote, F.map_filter(defaults, lambda k, _: F.lit(False))))


def scan_status(code: Column, cached: Column, verified: Column | None = None) -> Column:
    """How a scan went: ok, unverified, cached, no_source, offline or failed.

    An answer of 200 is ok, or unverified if it doesn't hold; after any other (null: no answer) an earlier copy is shown
    if there is one, else 404 says that the province has no source, no answer that there's no connection.
    """
    good = F.lit(True) if verified is None else verified
    return F.when(code == 200, F.when(good, "ok").otherwise("unverified")).when(cached, "cached").when(code.isNull(), "offline").when(code == 404, "no_source").otherwise("failed")


def current_only(rows: DataFrame, scope: str, wanted: str) -> DataFrame:
    """Answers for the scope that is wanted now; one that was asked for before is stale."""
    return rows.where(F.col(scope) == wanted)


def freshness(updated: Column, cached_ms: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(updated), F.timestamp_millis(cached_ms))
