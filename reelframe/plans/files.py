"""File layouts, playlists, colour and aspect on ``lineitem``, ``part`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, picture
from ..operators import layout
from .base import query, table
from .timelines import packets

_P = "p AS (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS arrival, CAST(l_quantity AS BIGINT) AS duration FROM lineitem)"


@query(f"WITH {_P}, t AS (SELECT *, duration % 10 AS time FROM p) SELECT s, arrival, row_number() OVER w - 1 AS place, CAST(coalesce(sum(duration) OVER (PARTITION BY s ORDER BY time, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 48 AS BIGINT) AS at FROM t WINDOW w AS (PARTITION BY s ORDER BY time, arrival)")
def snk02_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = packets(spark, sf_dir).withColumn("time", F.col("duration") % 10)
    return layout.interleaved(chunks, "s", "time", "arrival", "duration", 48).select("s", "arrival", F.col("place").cast("long").alias("place"), F.col("offset").alias("at"))


@query(f"WITH {_P}, c AS (SELECT s, (arrival - 1) // 2 AS chunk, count(*) AS samples FROM p GROUP BY 1, 2), n AS (SELECT s, samples, row_number() OVER w AS first_chunk, lag(samples) OVER w AS was FROM c WINDOW w AS (PARTITION BY s ORDER BY chunk)) SELECT s, CAST(first_chunk AS INTEGER) AS first_chunk, samples FROM n WHERE was IS NULL OR was <> samples")
def snk03_samples_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("chunk", F.floor((F.col("arrival") - 1) / 2))
    return layout.samples_per_chunk(p, "s", "chunk")


@query(f"WITH {_P}, v AS (SELECT s, arrival, duration % 2 AS v FROM p), n AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY s ORDER BY arrival) THEN 0 ELSE 1 END AS new FROM v), r AS (SELECT *, sum(new) OVER (PARTITION BY s ORDER BY arrival) - 1 AS run FROM n) SELECT s, CAST(run AS BIGINT) AS run, count(*) AS count, first(v) AS v FROM r GROUP BY 1, 2")
def snk04_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.run_lengths(packets(spark, sf_dir).withColumn("v", F.col("duration") % 2), "s", "arrival", "v")


@query("""SELECT p_partkey // 8 AS package, sha256('#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || string_agg('#EXT-X-STREAM-INF:BANDWIDTH=' || p_partkey * 100 || ',AVERAGE-BANDWIDTH=' || p_partkey * 80 || ',RESOLUTION=' || p_size * 40 || 'x' || p_size * 30 || chr(10) || 'r' || p_partkey || '.m3u8' || chr(10), '' ORDER BY p_partkey DESC)) AS playlist FROM part GROUP BY 1""")
def snk09_master_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.floor(F.col("p_partkey") / 8).alias("package"), F.concat(F.lit("r"), F.col("p_partkey").cast("string"), F.lit(".m3u8")).alias("uri"), (F.col("p_partkey") * 100).alias("peak"), (F.col("p_partkey") * 80).alias("average"), (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 30).alias("height"))
    return layout.master_playlist(rows, "package").select("package", F.sha2("playlist", 256).alias("playlist"))


@query("SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE length(html) > 4000)")
def snk17_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return layout.overwritten(p.select("page_id", "url"), p.where(F.length("html") > 4000), "url").select("page_id", "url")


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT a.user_id, a.event_id, round(sum(b.value * CASE WHEN b.n = 1 THEN pow(CAST(1 AS DOUBLE) / 3, a.n - b.n) ELSE (1 - CAST(1 AS DOUBLE) / 3) * pow(CAST(1 AS DOUBLE) / 3, a.n - b.n) END), 6) AS smooth FROM r a JOIN r b ON a.user_id = b.user_id AND b.n <= a.n GROUP BY 1, 2""")
def win13_carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return layout.carried_state(e, "user_id", "event_id", "value", 1 / 3).select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


_K = "CASE WHEN i >= 2048 THEN 0 ELSE 6 / CAST(10 AS DOUBLE) * exp(-((i + 0.5) / 8 / 9) * ((i + 0.5) / 8 / 9)) END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, CAST(value AS DOUBLE) AS a, value * 2.0 AS b FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, x + ka * (a - x), y + kb * (b - y) FROM (SELECT *, (SELECT {_K} FROM (SELECT floor(abs(a - x) * 8) AS i)) AS ka, (SELECT {_K} FROM (SELECT floor(abs(b - y) * 8) AS i)) AS kb
FROM (SELECT e.user_id, e.event_id, e.n, CAST(e.value AS DOUBLE) AS x, e.value * 2.0 AS y, r.a, r.b FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT user_id, event_id, round(a, 6) AS a, round(b, 6) AS b FROM r""")
def win13_temporal_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two samples."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.array(F.col("value").cast("double"), F.col("value") * 2.0).alias("y"))
    out = layout.denoised(e, "user_id", "event_id", "y", 6.0)
    return out.select("user_id", "event_id", F.round(F.col("smooth")[0], 6).alias("a"), F.round(F.col("smooth")[1], 6).alias("b"))


@query("""SELECT p_partkey, CASE p_size % 20 WHEN 1 THEN 'bt709' WHEN 4 THEN 'bt470bg' WHEN 6 THEN 'bt709' WHEN 8 THEN 'linear' WHEN 14 THEN 'bt709' WHEN 15 THEN 'bt709' WHEN 16 THEN 'pq' WHEN 18 THEN 'hlg' ELSE 'unspecified' END AS transfer,
CASE WHEN p_size % 3 = 0 THEN 'container' WHEN p_size % 3 = 1 THEN 'bitstream' WHEN p_size * 30 < 720 THEN 'bt601' ELSE 'bt709' END AS space FROM part""")
def clr09_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("p_size") % 3
    space = colour.resolved(F.when(third == 0, "container"), F.when(third == 1, "bitstream"), F.col("p_size") * 30)
    return table(spark, sf_dir, "part").select("p_partkey", colour.transfer(F.col("p_size") % 20).alias("transfer"), space.alias("space"))


@query("WITH a AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_partkey > 0 THEN p_partkey ELSE 1 END AS n, CASE WHEN p_size % 2 = 0 THEN 60 WHEN p_partkey > 0 THEN 48 ELSE 1 END AS d FROM part) SELECT p_partkey, n // gcd(n, d) AS num, CAST(d // gcd(n, d) AS BIGINT) AS den FROM a")
def src36_sample_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0)
    a = table(spark, sf_dir, "part").select("p_partkey", colour.sample_aspect(own, F.lit(60), "p_partkey", F.lit(48)).alias("a"))
    return a.select("p_partkey", "a.num", "a.den")


@query("WITH d AS (SELECT p_partkey, p_size * 3 + 1 AS w, p_size * 2 + 1 AS h FROM part) SELECT p_partkey, CAST(w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2) AS BIGINT) AS yuv420p, CAST((w * h + 2 * ((w + 1) // 2) * h) * 2 AS BIGINT) AS yuv422p10, CAST(w * h * 3 AS BIGINT) AS rgb24 FROM d")
def fmt01_frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 3 + 1, F.col("p_size") * 2 + 1
    return table(spark, sf_dir, "part").select("p_partkey", *(colour.frame_bytes(F.lit(f), w, h).alias(f) for f in ("yuv420p", "yuv422p10", "rgb24")))


@query("SELECT l_orderkey, l_linenumber, round((l_partkey - 16) / 1.5, 9) AS x, round((l_suppkey - 9) / 1.5, 9) AS y FROM lineitem")
def arr02_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = colour.to_source("l_partkey", "l_suppkey", F.lit(1.5), F.lit(16), F.lit(9))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query("SELECT doc_id, sha256(text) AS same FROM documents")
def txt08_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("b")).select("doc_id", F.sha2(colour.decoded_text("b"), 256).alias("same"))


@query("""SELECT doc_id, '{"hook":"' || source || '","verdict":"' || CASE WHEN toxic = 1 THEN 'reject' ELSE 'accept' END || '","quality":' || quality || '}' AS view FROM documents JOIN labels USING (doc_id)""")
def txt17_json_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    view = F.to_json(F.struct(F.col("source").alias("hook"), F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("verdict"), "quality"))
    return d.select("doc_id", view.alias("view"))


@query("SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 25 WHEN 1 THEN 30000 WHEN 2 THEN 24000 ELSE 12500 END AS BIGINT) AS num, CAST(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1001 WHEN 2 THEN 1001 ELSE 1000 END AS BIGINT) AS den FROM part")
def mth18_rational_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = F.when(F.col("p_size") % 4 == 0, 25.0).when(F.col("p_size") % 4 == 1, 29.97).when(F.col("p_size") % 4 == 2, 23.976).otherwise(12.5)
    return table(spark, sf_dir, "part").select("p_partkey", picture.rational_rate(fps).alias("r")).select("p_partkey", "r.num", "r.den")


@query("SELECT o_orderkey, CASE WHEN length(o_orderpriority) * 2 < 12 THEN 'unrecognised' WHEN o_orderpriority NOT LIKE '1%' THEN 'unknown' END AS reason FROM orders")
def flt02_container_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("DKIF"), F.repeat(F.col("o_orderpriority"), 2))).otherwise(F.repeat(F.col("o_orderpriority"), 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", picture.container_gate(head.cast("binary"), ["ivf"]).alias("reason"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_acctbal <= n_nationkey * 400")
def flt11_capable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import joins

    devices = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("device"), "c_custkey", "c_acctbal")
    table_of = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("device"), F.col("n_regionkey").cast("string").alias("codec"), (F.col("n_nationkey") * 400).alias("most"))
    return joins.capable(devices, table_of, "1", F.col("c_acctbal")).select("c_custkey")


@query("""WITH c AS (SELECT conv_id, turn, turn * 30 AS s, turn * 30 + 10 + length(text) % 60 AS e FROM conversations), l AS (SELECT conv_id, conv_id % 7 AS late FROM c GROUP BY 1)
SELECT conv_id, turn, CAST(s - late AS BIGINT) AS start, CAST(e - late AS BIGINT) AS until FROM c JOIN l USING (conv_id)""")
def jon11_shifted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import joins

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 30).alias("start"), (F.col("turn") * 30 + 10 + F.length("text") % 60).alias("end"))
    video = c.select("conv_id", (F.col("conv_id") % 7).alias("start")).distinct()
    return joins.shifted_windows(video, c, "conv_id").select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("until"))


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || '-' || n END AS label FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_partkey // 32, p_type ORDER BY p_partkey) AS n FROM part)")
def win11_unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.floor(F.col("p_partkey") / 32), "p_type").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(n == 1, F.col("p_type")).otherwise(F.concat(F.col("p_type"), F.lit("-"), n.cast("string"))).alias("label"))


@query("SELECT c_mktsegment, c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT n_name, n_nationkey FROM nation")
def set01_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_mktsegment", "c_custkey")
    return a.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("c_mktsegment"), F.col("n_nationkey").cast("long").alias("c_custkey")))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') AND o_custkey % 8 + 1 <= 6 THEN 'pass' ELSE 'transcode' END AS decision FROM orders")
def aud07_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.audio import decision

    return table(spark, sf_dir, "orders").select("o_orderkey", decision("o_orderstatus", ["F", "P"], F.col("o_custkey") % 8 + 1, 6, "keep").alias("decision"))


@query("SELECT vec_id, [CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE), 0.0][1] AS lft, CAST(embedding[1] AS DOUBLE) AS rgt, embedding[5:8] = [embedding[5], embedding[6], embedding[7], embedding[8]] AS fits FROM embeddings")
def arr01_channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.audio import channel_map, window

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", channel_map("embedding", ("FL", "FR"), [("FR", "FL"), ("FL", "FR")], ("FL", "FR")).alias("m"), window("embedding", 2, F.lit(2), F.lit(4)).alias("w"))
    return e.select("vec_id", F.col("m")[0].alias("lft"), F.col("m")[1].alias("rgt"), (F.col("w") == F.slice("embedding", 5, 4)).alias("fits"))


