"""Text, language, metadata and set operators on ``documents``, ``pages``, ``events`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, timebase
from ..operators import metadata
from .base import query, table


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE lang END AS tag, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS name FROM documents")
def prj07_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.normalised_language(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", "tag", "name")


@query(r"SELECT page_id, sha256(trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(13) || chr(10))) AS plain FROM pages")
def txt01_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_markup("html"), 256).alias("plain"))


@query("SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10))) AS escaped FROM documents")
def txt02_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.escape_cue("text"), 256).alias("escaped"))


@query("SELECT doc_id, lpad(CAST(n_chars * 997 // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n_chars * 997 // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n_chars * 997 // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(n_chars * 997 % 1000 AS VARCHAR), 3, '0') AS stamp FROM documents")
def txt03_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", timebase.clock_text(F.col("n_chars") * 997).alias("stamp"))


@query("SELECT page_id, CASE WHEN regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') = '' THEN 'untitled' ELSE regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g') END AS stem FROM pages")
def txt15_file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.file_stem("url").alias("stem"))


@query("SELECT p_partkey, lpad(lower(to_hex(p_partkey * 7919)), 16, '0') AS digits, p_partkey * 7919 AS value FROM part")
def txt14_hash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = text.hash_hex(F.col("p_partkey") * 7919)
    return table(spark, sf_dir, "part").select("p_partkey", digits.alias("digits"), text.hex_hash(digits).alias("value"))


@query("SELECT p_partkey, p_size * 40 AS width, p_size * 30 AS height, p_partkey * 1000 AS bitrate FROM part")
def txt13_rung_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("%dx%d@%dk:pad,top", F.col("p_size") * 40, F.col("p_size") * 30, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", text.rung_text(line).alias("r")).select("p_partkey", "r.width", "r.height", "r.bitrate")


@query("SELECT o_orderkey, o_orderkey % 5 * 3600.0 + o_custkey % 60 * 60 + o_orderkey % 60 AS seconds, CAST(o_custkey AS BIGINT) * 1000 AS bits FROM orders")
def mth15_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.format_string("%dh%dm%ds", F.col("o_orderkey") % 5, F.col("o_custkey") % 60, F.col("o_orderkey") % 60)
    return table(spark, sf_dir, "orders").select("o_orderkey", timebase.duration_seconds(t).alias("seconds"), timebase.bits_per_second(F.concat(F.col("o_custkey").cast("string"), F.lit("k"))).alias("bits"))


@query("SELECT event_id, round(user_id % 180 - 90 + floor(value) / 128.0, 2) AS latitude, round(user_id % 360 - 180 + floor(value) / 128.0, 2) AS longitude FROM events")
def met01_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("user_id") % 180 - 90 + F.floor("value") / 128.0, F.col("user_id") % 360 - 180 + F.floor("value") / 128.0
    kept = metadata.kept_location(lat, lon, F.lit(3.0), F.lit("place"), "approximate")
    return table(spark, sf_dir, "events").select("event_id", kept.alias("k")).select("event_id", "k.latitude", "k.longitude")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def met02_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", metadata.kept_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "date").alias("day"))


@query("SELECT event_id, event_type AS model FROM events")
def met03_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = F.create_map(F.lit("model"), F.col("event_type"), F.lit("serial"), F.col("user_id").cast("string"), F.lit("owner"), F.lit("x"))
    kept = metadata.kept_device(device, "keep")
    return table(spark, sf_dir, "events").select("event_id", kept.alias("k")).where("size(k) = 1").select("event_id", F.col("k")["model"].alias("model"))


@query("SELECT user_id, array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda x: x NOT IN ('view', 'click'))), ',') AS beyond FROM events GROUP BY 1")
def met05_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = metadata.category_sets(table(spark, sf_dir, "events"), "user_id", "event_type")
    return sets.select("user_id", F.array_join(metadata.violations(F.col("categories"), F.array(F.lit("view"), F.lit("click"))), ",").alias("beyond"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS categories FROM events GROUP BY 1")
def agg13_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.category_sets(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.array_join("categories", ",").alias("categories"))


@query("""WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' || event_id END AS value, CASE event_type WHEN 'view' THEN 'display_name' WHEN 'click' THEN 'performer' WHEN 'signup' THEN 'capture_time' WHEN 'purchase' THEN 'make' ELSE 'unclassified' END AS field FROM events)
SELECT user_id, field, arg_min(value, event_id) AS value FROM t WHERE value <> '' GROUP BY 1, 2""")
def met06_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("event_type") == "view", "Display Name").when(F.col("event_type") == "click", "Performer").when(F.col("event_type") == "signup", "creation-time").when(F.col("event_type") == "purchase", "Manufacturer").otherwise("error")
    value = F.when(F.col("event_id") % 3 == 0, " \0").otherwise(F.concat(F.lit(" v"), F.col("event_id").cast("string"), F.lit("\0")))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", tag.alias("tag"), value.alias("value"))
    return metadata.first_values(e, "user_id", "tag", "value", "event_id").select("user_id", "field", "value")


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['a', 'b'] ELSE ['c', 'a'] END AS a, CASE p_size % 3 WHEN 0 THEN ['b'] WHEN 1 THEN ['c', 'a'] ELSE ['d'] END AS b FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS united, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS common, list_has_all(a, b) AS holds FROM s""")
def set05_stage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda *names: F.array(*map(F.lit, names))
    a = F.when(F.col("p_size") % 2 == 0, of("a", "b")).otherwise(of("c", "a"))
    b = F.when(F.col("p_size") % 3 == 0, of("b")).when(F.col("p_size") % 3 == 1, of("c", "a")).otherwise(of("d"))
    s = table(spark, sf_dir, "part").select("p_partkey", metadata.stage_sets(a, b).alias("s"))
    return s.select("p_partkey", F.array_join("s.united", ",").alias("united"), F.array_join("s.common", ",").alias("common"), "s.holds")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written FROM events")
def txt05_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("t")).select("event_id", text.normalised_date("t").alias("written"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events")
def txt06_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    classic = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) + 2_082_844_800
    return table(spark, sf_dir, "events").select("event_id", text.quicktime_seconds(classic).cast("long").alias("seconds"))


@query("SELECT user_id, user_id % 90 + 0.5 AS latitude, -(user_id % 180) - 0.25 AS longitude FROM events GROUP BY user_id")
def txt07_iso6709(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    place = text.parse_iso6709(text.iso6709(F.col("user_id") % 90 + F.lit(0.5), -(F.col("user_id") % 180) - F.lit(0.25)))
    return users.select("user_id", place.alias("p")).select("user_id", "p.latitude", "p.longitude")


@query("SELECT p_partkey, p_size AS crf, CASE WHEN p_size % 2 = 0 THEN 'speed' ELSE '' END AS unknown FROM part")
def txt12_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("crf="), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " speed=3").otherwise(" preset=fast"))
    return table(spark, sf_dir, "part").select("p_partkey", text.key_values(line, ["crf", "preset"]).alias("k")).select("p_partkey", F.col("k.pairs")["crf"].cast("int").alias("crf"), F.array_join("k.unknown", ",").alias("unknown"))
