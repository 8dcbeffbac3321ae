"""Sweeps, selection, fingerprints, reports and ladder arithmetic on ``lineitem``, ``part``, ``embeddings`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import picture
from ..operators import joins, quality, selection
from .base import query, table
from .frames import planes

_SWEEP = "w AS (SELECT l_orderkey AS title, l_linenumber - 1 AS delta, min(CAST(l_extendedprice AS BIGINT)) AS bytes, min(0.9 + l_discount) AS ssim FROM lineitem GROUP BY 1, 2)"


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each line of an order: delta from the line number, bytes from the price, ssim from the discount."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("title"), (F.col("l_linenumber") - 1).alias("delta"))
    return rows.agg(F.min(F.bround("l_extendedprice").cast("long")).alias("bytes"), F.min(F.lit(0.9) + F.col("l_discount")).alias("ssim"))


_DB = "least(60.0, -10 * log10(greatest(1 - ssim, 1e-6)))"


@query(f"WITH {_SWEEP} SELECT title, delta, bytes FROM w WHERE ssim >= 0.95 QUALIFY row_number() OVER (PARTITION BY title ORDER BY bytes, delta) = 1")
def top01_smallest_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.smallest_above(sweep(spark, sf_dir), "title", 0.95).select("title", "delta", "bytes")


@query(f"WITH {_SWEEP} SELECT title, bytes FROM w WHERE delta = 0")
def top02_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.base_rows(sweep(spark, sf_dir)).select("title", "bytes")


@query(f"WITH {_SWEEP}, d AS (SELECT *, {_DB} AS db FROM w), b AS (SELECT title, db AS base FROM d WHERE delta = 0) SELECT title, delta, bytes FROM d JOIN b USING (title) WHERE db >= base - 0.7 QUALIFY row_number() OVER (PARTITION BY title ORDER BY bytes, delta) = 1")
def top03_within_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.within_drop(sweep(spark, sf_dir), "title", 0.7).select("title", "delta", "bytes")


@query(f"WITH {_SWEEP} SELECT title, max(delta) AS delta FROM w WHERE ssim >= 0.93 GROUP BY 1")
def top04_cheapest_reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.cheapest_reaching(sweep(spark, sf_dir), "title", 0.93).select("title", "delta")


@query(f"WITH {_SWEEP} SELECT title, delta, round((1 - ssim) + 2.5 * bytes / 1000000.0, 9) AS cost FROM w QUALIFY row_number() OVER (PARTITION BY title ORDER BY (1 - ssim) + 2.5 * bytes / 1000000.0, delta) = 1")
def top05_rate_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rate_distortion(sweep(spark, sf_dir), "title", 2.5, F.lit(1_000_000.0)).select("title", "delta", F.round("cost", 9).alias("cost"))


@query(f"WITH {_SWEEP}, p AS (SELECT *, bytes / (ssim - (min(ssim) OVER (PARTITION BY title) - 0.01)) AS price, count(*) OVER (PARTITION BY title) AS n FROM w), g AS (SELECT title, delta, lag(price) OVER (PARTITION BY title ORDER BY delta) - price AS gain FROM p WHERE n >= 3) SELECT title, delta, round(gain, 3) AS gain FROM g WHERE gain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY gain DESC, delta DESC) = 1")
def top06_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.knee(sweep(spark, sf_dir), "title").select("title", "delta", F.round("gain", 3).alias("gain"))


@query(f"WITH {_SWEEP} SELECT title, delta, round({_DB}, 6) AS db FROM w")
def top07_ssim_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, sf_dir).select("title", "delta", F.round(picture.ssim_db("ssim"), 6).alias("db"))


@query(f"WITH {_SWEEP}, m AS (SELECT title, max(delta) AS last, count(*) AS n FROM w GROUP BY 1), r AS (SELECT title, max(delta) AS delta FROM w WHERE ssim >= 0.93 GROUP BY 1) SELECT title, delta, delta = last AND n > 1 AS capped FROM r JOIN m USING (title)")
def top08_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.cheapest_reaching(sweep(spark, sf_dir), "title", 0.93).select("title", "delta", "capped")


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def top09_fastest_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.fastest(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10")
def top12_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_of_each(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id")


@query("""WITH RECURSIVE b AS (SELECT l_orderkey AS frame, l_returnflag AS label, l_extendedprice AS score, CAST(l_partkey % 100 AS DOUBLE) AS x0, CAST(l_suppkey % 100 AS DOUBLE) AS y0, CAST(l_quantity AS DOUBLE) AS w FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, x0, y0, x0 + w, y0 + w, label) AS n FROM b),
r AS (SELECT frame, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(n BIGINT, label VARCHAR, x0 DOUBLE, y0 DOUBLE, w DOUBLE)[]) AS kept FROM o WHERE n = 1
UNION ALL SELECT o.frame, o.n, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: k.label = o.label AND
greatest(0.0, least(k.x0 + k.w, o.x0 + o.w) - greatest(k.x0, o.x0)) * greatest(0.0, least(k.y0 + k.w, o.y0 + o.w) - greatest(k.y0, o.y0)) /
greatest(k.w * k.w + o.w * o.w - greatest(0.0, least(k.x0 + k.w, o.x0 + o.w) - greatest(k.x0, o.x0)) * greatest(0.0, least(k.y0 + k.w, o.y0 + o.w) - greatest(k.y0, o.y0)), 1e-12) > 0.1)) = 0
THEN list_append(kept, {'n': o.n, 'label': o.label, 'x0': o.x0, 'y0': o.y0, 'w': o.w}) ELSE kept END FROM r JOIN o ON o.frame = r.frame AND o.n = r.n + 1),
l AS (SELECT frame, arg_max(kept, n) AS kept FROM r GROUP BY 1), k AS (SELECT frame, unnest(kept).n AS n FROM l)
SELECT o.frame, label, score, x0, y0, x0 + w AS x1, y0 + w AS y1 FROM k JOIN o USING (frame, n)""")
def top13_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the lines of an order."""
    return selection.suppressed(boxes(spark, sf_dir), "frame", "label", "score", 0.1, 3)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("score"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + F.col("l_quantity")).alias("y1"))


@query("SELECT l_returnflag AS rung, l_linenumber AS delta, round(sum(l_extendedprice), 2) AS bytes, round(avg(40 + l_tax * 100), 6) AS psnr, round(avg(0.9 + l_discount), 9) AS ssim, count(*) AS packets, max(l_extendedprice) AS largest, round((sum(l_extendedprice) - max(l_extendedprice)) / (count(*) - 1), 4) AS mean_other FROM lineitem GROUP BY 1, 2")
def agg07_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rung"), F.col("l_linenumber").alias("delta"), "l_extendedprice", (F.lit(0.9) + F.col("l_discount")).alias("ssim"), (40 + F.col("l_tax") * 100).alias("psnr"))
    out = selection.sweep_rows(rows, ["rung", "delta"], "l_extendedprice", "ssim", "psnr")
    return out.select("rung", "delta", F.round("bytes", 2).alias("bytes"), F.round("psnr", 6).alias("psnr"), F.round("ssim", 9).alias("ssim"), "packets", "largest", F.round("mean_other", 4).alias("mean_other"))


@query("SELECT DISTINCT l_linenumber - 1 AS delta FROM lineitem ORDER BY 1")
def set04_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("delta")).distinct().orderBy("delta")


_PAIR = """p AS (SELECT vec_id, list_transform(embedding, lambda x: least(255.0, greatest(0.0, 128 + 255 * CAST(x AS DOUBLE)))) AS y FROM embeddings),
q AS (SELECT a.vec_id, unnest(a.y) AS x, unnest(b.y) AS y FROM p a JOIN p b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, avg((x - y) * (x - y)) AS mse, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM q GROUP BY 1)"""


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planes(spark, sf_dir).select("vec_id", "y")
    return joins.pairwise_error(p, p.select((F.col("vec_id") - 1).alias("vec_id"), "y"), ["vec_id"], "y")


@query(f"WITH {_PAIR} SELECT vec_id, round(mse, 6) AS mse, round(10 * log10(65025.0 / mse), 6) AS psnr FROM s")
def agg05_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_scores(spark, sf_dir).select("vec_id", F.round("mse", 6).alias("mse"), F.round("psnr", 6).alias("psnr"))


@query(f"WITH {_PAIR} SELECT vec_id, round(((2 * mx * my + 6.5025) * (2 * c + 58.5225)) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)), 6) AS ssim FROM s")
def agg06_ssim_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_scores(spark, sf_dir).select("vec_id", F.round("ssim", 6).alias("ssim"))


#: Sixteen vectors one below the other as a plane of 64 columns (what is left over is in the last one), and the same in steps of 16.
_PLANES = """u AS (SELECT vec_id, least(vec_id // 16, (SELECT count(*) // 16 - 1 FROM embeddings)) AS plane, embedding FROM embeddings WHERE len(embedding) = 64),
v AS (SELECT plane, row_number() OVER (PARTITION BY plane ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda x: floor(least(255.0, greatest(0.0, 128 + 255 * CAST(x AS DOUBLE))))) AS y FROM u),
px AS (SELECT plane, r, unnest(range(0, 64)) AS c, unnest(y) AS x, 16 * floor(unnest(y) / 16) AS y FROM v)"""


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planes(spark, sf_dir).where("size(y) = 64").select("vec_id", F.transform("y", lambda v: F.floor(v).cast("double")).alias("y"))
    last = table(spark, sf_dir, "embeddings").count() // 16 - 1
    rows = p.groupBy(F.least(F.floor(F.col("vec_id") / 16), F.lit(last)).alias("plane")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "y"))).alias("rows"))
    return rows.select("plane", F.flatten("rows.y").alias("x"), F.size("rows").alias("h"), F.lit(64).alias("w")).withColumn("y", F.transform("x", lambda v: 16.0 * F.floor(v / 16)))


@query(f"""WITH {_PLANES}, g AS (SELECT i, exp(-(i - 5) * (i - 5) / CAST(4.5 AS DOUBLE)) / (SELECT sum(exp(-(j - 5) * (j - 5) / CAST(4.5 AS DOUBLE))) FROM range(0, 11) t(j)) AS w FROM range(0, 11) s(i)),
n AS (SELECT plane, max(r) + 1 AS h FROM px GROUP BY 1),
m AS (SELECT plane, r - a.i AS r, c - b.i AS c, sum(a.w * b.w * x) AS mx, sum(a.w * b.w * y) AS my, sum(a.w * b.w * x * x) AS xx, sum(a.w * b.w * y * y) AS yy, sum(a.w * b.w * x * y) AS xy
 FROM px JOIN n USING (plane), g a, g b WHERE h >= 11 AND r >= a.i AND r - a.i <= h - 11 AND c >= b.i AND c - b.i <= 53 GROUP BY 1, 2, 3
 UNION ALL SELECT plane, 0, 0, avg(x), avg(y), avg(x * x), avg(y * y), avg(x * y) FROM px JOIN n USING (plane) WHERE h < 11 GROUP BY 1)
SELECT plane, round(avg(((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225)) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225))), 6) AS ssim FROM m GROUP BY 1""")
def agg06_ssim_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.windowed_ssim(stacked(spark, sf_dir), ["plane"], "x", "y", "w", "h", tile=16).withColumn("ssim", F.round("ssim", 6))


@query(f"""WITH {_PLANES}, n AS (SELECT plane, max(r) + 1 AS h FROM px GROUP BY 1),
o AS (SELECT plane, i // 32 AS d, i % 32 AS a, h / CAST(32 AS DOUBLE) AS fy FROM n, range(0, 1024) t(i)),
s AS (SELECT o.plane, d, a, CAST(sum(x * (least((d + 1) * fy, r + 1) - greatest(d * fy, r))) / (2 * fy) AS FLOAT) AS v FROM o JOIN px ON px.plane = o.plane AND px.c // 2 = a AND px.r < (d + 1) * fy AND px.r + 1 > d * fy GROUP BY o.plane, d, a, fy),
b AS (SELECT k, j, cos(pi() * (2 * j + 1) * k / 64) AS b FROM range(0, 8) p(k), range(0, 32) q(j)),
l AS (SELECT plane, y.k AS ky, x.k AS kx, sum(CAST(v AS DOUBLE) * y.b * x.b) AS f FROM s JOIN b y ON y.j = d JOIN b x ON x.j = a GROUP BY 1, 2, 3),
z AS (SELECT plane, list_sort(list(f)) AS f FROM l GROUP BY 1)
SELECT plane, string_agg(CASE WHEN l.f > (z.f[32] + z.f[33]) / 2 THEN '1' ELSE '0' END, '' ORDER BY ky, kx) AS bits FROM l JOIN z USING (plane) GROUP BY 1""")
def udf06_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, sf_dir).select("plane", F.lpad(F.bin("hash"), 64, "0").alias("bits"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(spark, sf_dir).select("plane", picture.fingerprint("x", "w", "h").alias("hash"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-01/02/05: average and difference hashes of the planes, in whole steps of luma."""
    p = planes(spark, sf_dir).select("vec_id", F.transform("y", lambda v: F.floor(v)).alias("y"), F.expr("if(size(y) % 8 = 0, size(y) div 8, size(y))").alias("w"), F.expr("if(size(y) % 8 = 0, 8, 1)").alias("h"))
    return p.select("vec_id", picture.average_hash("y", "w", "h").alias("ahash"), picture.difference_hash("y", "w", "h").alias("dhash"))


_HASH = """p AS (SELECT vec_id, list_transform(embedding, lambda x: floor(least(255.0, greatest(0.0, 128 + 255 * CAST(x AS DOUBLE))))) AS y FROM embeddings),
m AS (SELECT vec_id, y, list_sum(y) / 64 AS mean, list_transform(range(0, 72), lambda i: CAST(list_sum(list_transform(range(0, 8), lambda x: y[CAST(i // 9 * 8 + x + 1 AS INTEGER)] * greatest(0.0, least((i % 9 + 1) * 8 / CAST(9 AS DOUBLE), x + 1) - greatest(i % 9 * 8 / CAST(9 AS DOUBLE), x)))) / (8 / CAST(9 AS DOUBLE)) AS FLOAT)) AS c FROM p),
h AS (SELECT vec_id, array_to_string(list_transform(y, lambda v: CASE WHEN v > mean THEN '1' ELSE '0' END), '') AS bits, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN c[CAST(i // 8 * 9 + i % 8 + 2 AS INTEGER)] > c[CAST(i // 8 * 9 + i % 8 + 1 AS INTEGER)] THEN '1' ELSE '0' END), '') AS steps FROM m)"""


@query(f"WITH {_HASH} SELECT vec_id, bits FROM h")
def hsh01_ahash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir).select("vec_id", F.lpad(F.bin("ahash"), 64, "0").alias("bits"))


@query(f"WITH {_HASH} SELECT vec_id, steps AS bits FROM h")
def hsh02_dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir).select("vec_id", F.lpad(F.bin("dhash"), 64, "0").alias("bits"))


#: Bits in which hashes may differ to be a pair, and parts they are filed by.
NEAR, PARTS = 14, 5


@query(f"WITH {_HASH}, r AS (SELECT steps, min(vec_id) AS k FROM h GROUP BY 1) SELECT a.k AS a, b.k AS b, CAST(hamming(a.steps, b.steps) AS INTEGER) AS distance FROM r a JOIN r b ON a.k < b.k AND hamming(a.steps, b.steps) <= {NEAR}")
def jon09_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.hamming_pairs(hashes(spark, sf_dir), "vec_id", "dhash", NEAR, PARTS)


@query(f"""WITH {_HASH}, r AS (SELECT steps, min(vec_id) AS k, count(*) AS n FROM h GROUP BY 1), l AS (SELECT a.k AS k, sum(b.n) AS near FROM r a JOIN r b ON a.k <> b.k AND hamming(a.steps, b.steps) <= {NEAR} GROUP BY 1)
SELECT vec_id, k AS class_id, CAST(n - 1 + coalesce(near, 0) AS BIGINT) AS links FROM h JOIN r USING (steps) LEFT JOIN l USING (k)""")
def jon09_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashes(spark, sf_dir)
    return joins.hamming_members(h, "vec_id", "dhash", joins.hamming_pairs(h, "vec_id", "dhash", NEAR, PARTS))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def agg18_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import digests

    return table(spark, sf_dir, "documents").select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * CASE WHEN back = n - 1 THEN pow(0.6, back) ELSE 0.4 * pow(0.6, back) END), 6) AS smoothed FROM r GROUP BY 1""")
def agg16_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return selection.smoothed(e, "user_id", "at", "value", 0.4).select("user_id", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH d AS (SELECT c_custkey, c_nationkey, 1 + c_custkey % 4 AS w, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS m FROM customer)
SELECT c_custkey, round(coalesce(m, w * coalesce(avg(m / w) OVER (PARTITION BY c_nationkey), 1)), 6) AS rate FROM d""")
def agg17_scaled_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (1 + F.col("c_custkey") % 4).alias("w"), F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("m"))
    return selection.scaled_weights(d, "c_nationkey", "w", "m").select("c_custkey", F.round("rate", 6).alias("rate"))


@query("SELECT o_custkey, count_if(o_orderstatus = 'F') AS fine, count_if(o_orderstatus <> 'F') AS failed, bool_and(o_orderstatus = 'F') AS all_ok FROM orders GROUP BY 1")
def agg10_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderstatus") == "F")
    out = selection.batch_report(o, "o_custkey", "ok")
    return out.select("o_custkey", "fine", "failed", "all_ok")


_HOOK = "r AS (SELECT source, lang, doc_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS verdict, CASE WHEN quality = 0 THEN 'low quality' END AS error FROM documents JOIN labels USING (doc_id))"


def hook_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("source", "lang", "doc_id", F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("verdict"), F.when(F.col("quality") == 0, "low quality").alias("error"))


@query(f"WITH {_HOOK} SELECT source, lang, count(*) AS records, count_if(verdict = 'reject') AS rejected, count(error) AS errors FROM r GROUP BY 1, 2")
def agg15_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.hook_report(hook_records(spark, sf_dir), "source", "lang", "verdict", "error")


@query(f"WITH {_HOOK} SELECT source, CASE WHEN count_if(verdict = 'reject') > 0 THEN 'reject' ELSE 'accept' END AS verdict, CAST(min(doc_id) FILTER (verdict = 'reject') AS VARCHAR) AS reason FROM r GROUP BY 1")
def udf03_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hook_records(spark, sf_dir).withColumn("reason", F.col("doc_id").cast("string"))
    return selection.decided(r, "source", "verdict", "reason", "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipmode FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS l_shipmode, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS f FROM lineitem) WHERE l_shipmode <> f")
def cod07_one_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return selection.one_config(p, "l_orderkey", "at", "l_returnflag").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("l_shipmode"))


@query("""WITH s AS (SELECT p_partkey, p_size * 40 AS w, p_size * 30 AS h FROM part), t AS (SELECT *, w * 1.0 / h AS a, CASE WHEN h > 1080 THEN 1080 ELSE h - h % 2 END AS top FROM s),
c AS (SELECT *, CASE WHEN h > 1080 THEN CAST(round(1080 * a) AS BIGINT) // 2 * 2 ELSE w - w % 2 END AS topw, (SELECT max(x) FROM (VALUES (1080), (720), (480), (360), (240)) v(x) WHERE x < top) AS near FROM t),
r AS (SELECT p_partkey, topw AS width, top AS height FROM c UNION SELECT p_partkey, CAST(round(x * a) AS BIGINT) // 2 * 2, x FROM c, (VALUES (2160), (1440), (1080), (720), (480), (360), (240)) v(x) WHERE x < top AND x <= 1080 AND NOT (x = near AND top <= near * 1.15) AND CAST(round(x * a) AS BIGINT) // 2 * 2 >= 200)
SELECT p_partkey, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM r""")
def mth01_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = picture.ladder(F.col("p_size") * 40, F.col("p_size") * 30)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(rungs).alias("r")).select("p_partkey", "r.*")


@query("""WITH s AS (SELECT p_partkey, p_size * 40.0 AS w, p_size * 30.0 + p_partkey % 7 AS h FROM part), k AS (SELECT *, least(1280 / w, 720 / h) AS s, 1280 >= w AND 720 >= h AND 1280 - w < 2 AND 720 - h < 2 AS slack FROM s), z AS (SELECT *, least(s, 1.0) AS z FROM k)
SELECT p_partkey, CAST(least(least(greatest(round(w * z / 2) * 2, 2), 1280), greatest(floor((w + 1e-6) / 2) * 2, 2)) AS BIGINT) AS width, CAST(least(least(greatest(round(h * z / 2) * 2, 2), 720), greatest(floor((h + 1e-6) / 2) * 2, 2)) AS BIGINT) AS height FROM z""")
def mth02_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = picture.fit(F.col("p_size") * 40, F.col("p_size") * 30 + F.col("p_partkey") % 7, F.lit(1280), F.lit(720))
    return table(spark, sf_dir, "part").select("p_partkey", placed.alias("p")).select("p_partkey", "p.width", "p.height")


@query("SELECT p_partkey, CAST(greatest(round(p_retailprice / 16) * 16, 16) AS BIGINT) AS rounded, CAST(greatest(floor((p_retailprice + 1e-6) / 16) * 16, 16) AS BIGINT) AS floored FROM part")
def mth03_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", picture.aligned_round("p_retailprice", 16).alias("rounded"), picture.aligned_floor("p_retailprice", 16).alias("floored"))


@query("SELECT p_partkey, CAST(greatest(round(p_size / 10.0 * 29.97), 1) AS BIGINT) AS frames, CAST(greatest(greatest(round(p_size / 10.0 * 29.97), 1) * 10, 1) AS BIGINT) AS chunk FROM part")
def mth05_keyframe_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.timebase import chunk_frames, keyframe_interval

    k = keyframe_interval(F.col("p_size") / 10.0, 29.97)
    return table(spark, sf_dir, "part").select("p_partkey", k.alias("frames"), chunk_frames(k).alias("chunk"))


_ANCHOR = "a(i, s, r) AS (VALUES (1, 144, 200000.0), (2, 240, 400000.0), (3, 360, 800000.0), (4, 480, 1200000.0), (5, 720, 3000000.0), (6, 1080, 5000000.0), (7, 1440, 9000000.0), (8, 2160, 16000000.0))"


@query(f"""WITH {_ANCHOR}, p AS (SELECT p_partkey, p_size * 50 AS side, 24 + p_size AS fps FROM part),
b AS (SELECT p_partkey, fps, CASE WHEN side <= 144 THEN 200000.0 WHEN side >= 2160 THEN 16000000.0 * (side / 2160.0) * (side / 2160.0) ELSE (SELECT x.r + (y.r - x.r) * (side - x.s) / (y.s - x.s) FROM a x JOIN a y ON y.i = x.i + 1 WHERE side > x.s AND side <= y.s) END AS base FROM p)
SELECT p_partkey, CAST(round(base * (1 + 0.5 * (CASE WHEN fps > 30 THEN least(fps, 120) ELSE 30 END / 30.0 - 1)) * 0.5 / 1000) * 1000 AS BIGINT) AS bitrate FROM b""")
def mth07_cbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", picture.default_bitrate(F.lit("av1"), F.col("p_size") * 50, 24 + F.col("p_size")).alias("bitrate"))


@query("""WITH a(h, qh, l, ql) AS (VALUES (100, 10, 98, 20), (98, 20, 95, 27), (95, 27, 90, 32), (90, 32, 85, 38), (85, 38, 70, 55)), p AS (SELECT o_orderkey, CAST(55 + o_orderkey % 50 AS INTEGER) AS v FROM orders)
SELECT o_orderkey, CASE WHEN v >= 100 THEN 10 WHEN v <= 70 THEN 55 ELSE (SELECT min(qh + (ql - qh) * (h - v) // (h - l)) FROM a WHERE v <= h AND v >= l) END AS quantiser FROM p""")
def mth08_vmaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", picture.vmaf_quantiser(55 + F.col("o_orderkey") % 50).alias("quantiser"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 27 WHEN 'O' THEN 32 END AS quantiser FROM orders")
def mth09_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "standard")
    return table(spark, sf_dir, "orders").select("o_orderkey", picture.target_quantiser(name).alias("quantiser"))


@query("""WITH r(x) AS (VALUES (32), (40), (48), (56), (64), (80), (96), (112), (128), (160), (192), (224), (256), (320)), p AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders)
SELECT o_orderkey, arg_min(x * 1000, abs(x * 1000 - b) * 1000000 + x) AS rate FROM p, r GROUP BY 1""")
def mth11_mp3_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", picture.nearest_mp3_rate(F.floor("o_totalprice")).alias("rate"))


@query("SELECT p_partkey, round(sqrt(least(greatest(CASE WHEN p_size % 5 = 0 THEN 2.0 ELSE p_size * 512 / 1024.0 END / 8, 0.25), 4.0)) * CASE WHEN p_size % 16 < 4 THEN 0.5 WHEN p_size % 16 < 8 THEN 0.75 ELSE 1.0 END, 9) AS weight FROM part")
def mth12_device_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    vram = F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size") * 512)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(picture.device_weight(vram, F.col("p_size") % 16), 9).alias("weight"))


@query("""WITH a(q0, v0, q1, v1) AS (VALUES (1, 255, 20, 205), (20, 205, 40, 162), (40, 162, 60, 120), (60, 120, 80, 72), (80, 72, 90, 44), (90, 44, 100, 1)), p AS (SELECT p_partkey, least(greatest(p_size * 2, 1), 100) AS q FROM part)
SELECT p_partkey, (SELECT CAST(round(v0 + (q - q0) * ((v1 - v0) / (q1 - q0))) AS INTEGER) FROM a WHERE (q > q0 OR q0 = 1) AND q <= q1) AS quantiser FROM p""")
def mth16_still_quantiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", picture.still_quantiser(F.col("p_size") * 2).alias("quantiser"))


@query("SELECT p_partkey, CAST(least(greatest(p_partkey * p_size, -32768), 32767) AS INTEGER) AS step FROM part")
def mth17_quality_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", picture.quality_step("p_partkey", "p_size").alias("step"))


@query("SELECT o_orderkey, CASE WHEN ceil(o_totalprice / 300) * 4 < 2 * (o_custkey % 200) OR o_orderstatus = 'F' THEN 'serial' ELSE 'spread' END AS mode FROM orders")
def mth20_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", picture.spread("o_totalprice", F.lit(300), F.lit(4), F.col("o_custkey") % 200, F.col("o_orderstatus") == "F").alias("mode"))


@query("""WITH l(i, v, s, r) AS (VALUES (1, 10, 36864, 829440), (2, 11, 73728, 2764800), (3, 20, 122880, 4608000), (4, 21, 245760, 9216000), (5, 30, 552960, 20736000), (6, 31, 983040, 36864000), (7, 40, 2228224, 83558400), (8, 41, 2228224, 160432128), (9, 50, 8912896, 311951360), (10, 51, 8912896, 588251136), (11, 52, 8912896, 1176502272), (12, 60, 35651584, 1176502272), (13, 61, 35651584, 2353004544), (14, 62, 35651584, 4706009088))
SELECT p_partkey, coalesce((SELECT arg_min(v, i) FROM l WHERE p_size * 40 * p_size * 30 <= s AND ceil(p_size * 40 * p_size * 30 * 29.97) <= r), 62) AS level FROM part""")
def prj06_vp9_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", picture.vp9_level(F.col("p_size") * 40, F.col("p_size") * 30, 29.97).alias("level"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 * 90 IN (90, 270) THEN p_size * 30 ELSE p_size * 40 END AS width, CASE WHEN p_size % 4 * 90 IN (90, 270) THEN p_size * 40 ELSE p_size * 30 END AS height FROM part")
def prj01_upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", picture.upright(F.col("p_size") * 40, F.col("p_size") * 30, F.col("p_size") % 4 * 90).alias("u")).select("p_partkey", "u.*")


@query("SELECT p_partkey, round(CASE WHEN p_size / 25.0 >= 1 THEN 720 * (p_size / 25.0) ELSE 720 END, 6) AS width, round(CASE WHEN p_size / 25.0 < 1 THEN 576 / (p_size / 25.0) ELSE 576 END, 6) AS height FROM part")
def prj02_display_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", picture.display_size(F.lit(720), F.lit(576), "p_size", F.lit(25)).alias("d"))
    return d.select("p_partkey", F.round("d.width", 6).alias("width"), F.round("d.height", 6).alias("height"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor((CAST(l_partkey AS DOUBLE) * 90000 * 2 + 1001) / 2002) AS BIGINT) AS ticks, l_partkey / 90000.0 AS seconds FROM lineitem")
def prj04_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.timebase import rescale, seconds

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rescale("l_partkey", F.lit(90_000).cast("long"), F.lit(1001).cast("long")).alias("ticks"), seconds("l_partkey", F.lit(90_000)).alias("seconds"))


@query("SELECT p_partkey, 'avc1.' || lpad(lower(to_hex(p_size)), 2, '0') || lpad(lower(to_hex(p_partkey % 256)), 2, '0') || lpad(lower(to_hex(31)), 2, '0') AS avc, 'av01.0.' || lpad(CAST(p_size % 24 AS VARCHAR), 2, '0') || CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'H' END || '.08' AS av1 FROM part")
def prj05_codec_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", picture.avc_codec("p_size", F.col("p_partkey") % 256, F.lit(31)).alias("avc"), picture.av1_codec(F.lit(0), F.col("p_size") % 24, F.col("p_size") % 2, F.lit(8)).alias("av1"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_partkey * 3003 / CAST((p_size % 7) * 1000 AS DOUBLE) END AS seconds, CAST(greatest(round(coalesce(CASE WHEN p_size % 3 > 0 THEN (p_size % 3) * 1.5::DOUBLE END, 2) * CAST(23.976 AS DOUBLE)), 1) AS BIGINT) AS gop FROM part")
def prj03_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of clocks, one of 0 Hz among them, as seconds; the frames of a GOP of so many seconds, or of none given."""
    from ..functions.timebase import keyframe_interval, seconds

    length = F.when(F.col("p_size") % 3 > 0, (F.col("p_size") % 3) * 1.5)
    return table(spark, sf_dir, "part").select("p_partkey", seconds(F.col("p_partkey") * 3003, F.col("p_size") % 7 * 1000).alias("seconds"), keyframe_interval(length, 23.976).alias("gop"))
