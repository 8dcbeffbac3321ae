"""Frame operators on ``events`` (frames of a user's stream, in order of time) and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import picture, timebase
from ..operators import frames
from .base import query, table

RATIO = 0.4
#: Frame numbers of each user's events.
_K = "k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@query("SELECT p_partkey, CASE WHEN p_size * 2 > 0 AND 30 < p_size * 2 * (1 - 1e-6) THEN 30.0 / (p_size * 2) END AS ratio FROM part")
def smp01_decimation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", timebase.decimation_ratio(F.col("p_size") * 2, 30).alias("ratio"))


@query(f"WITH {_K} SELECT user_id, event_id, k, CAST(ceil(k * 0.4 - 1e-9) AS BIGINT) AS slot FROM k WHERE ceil((k + 1) * 0.4 - 1e-9) > ceil(k * 0.4 - 1e-9)")
def smp02_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.decimated(numbered(spark, sf_dir), RATIO).select("user_id", "event_id", "k", "slot")


@query("SELECT user_id, CAST(ceil(count(*) * 0.4 - 1e-9) AS BIGINT) AS frames FROM events GROUP BY user_id")
def smp03_output_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(timebase.frames_out(F.count("*"), RATIO).alias("frames"))


_L = "l AS (SELECT l_orderkey, l_linenumber, greatest(l_linenumber, 1) AS r, sum(greatest(l_linenumber, 1)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS upto FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()


@query(f"WITH {_L} SELECT l_orderkey, l_linenumber, CAST(unnest(range(CAST(upto - r AS BIGINT), CAST(upto AS BIGINT))) AS BIGINT) AS slot FROM l")
def smp04_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.repeated(lines(spark, sf_dir), "l_orderkey", "l_linenumber", "l_linenumber").select("l_orderkey", "l_linenumber", "slot")


@query(f"WITH {_L}, s AS (SELECT l_orderkey, l_linenumber, unnest(range(CAST(ceil((upto - r) * 0.4 - 1e-9) AS BIGINT), CAST(ceil(upto * 0.4 - 1e-9) AS BIGINT))) AS slot FROM l) SELECT *, CAST(ceil(slot / 0.4 - 1e-9) AS BIGINT) AS period FROM s")
def smp05_capped_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.repeated_under_cap(lines(spark, sf_dir), "l_orderkey", "l_linenumber", "l_linenumber", RATIO).select("l_orderkey", "l_linenumber", "slot", "period")


@query("""WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS pts FROM events),
s AS (SELECT user_id, event_type, min(pts) AS low, max(pts + 1) AS high FROM e GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(high - low) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s)
SELECT e.user_id, e.event_id, CAST(pts - low + base AS BIGINT) AS joined FROM e JOIN b USING (user_id, event_type)""")
def smp06_joined_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pts"))
    return frames.joined_clips(clips, "user_id", "event_type", "pts").select("user_id", "event_id", F.col("joined").cast("long").alias("joined"))


@query(f"""WITH {_K}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT user_id, 'poster' AS pick, least(CAST(floor(n * 0.10) AS BIGINT), n - 1) AS k FROM n UNION ALL SELECT user_id, 'still_' || i, least(CAST(floor(n * (i + 0.5) / 3) AS BIGINT), n - 1) FROM n, range(0, 3) t(i))
SELECT w.user_id, pick, event_id FROM w JOIN k ON k.user_id = w.user_id AND k.k = w.k""")
def smp07_stills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.stills(numbered(spark, sf_dir), "user_id").select("user_id", "pick", "event_id")


@query("""WITH t AS (SELECT p_partkey, p_size * 60 AS total FROM part),
r AS (SELECT p_partkey, greatest(least(total, 1080), 60) AS reach FROM t)
SELECT DISTINCT p_partkey, CAST((reach - 60) * (i + 1) // 4 AS BIGINT) AS start, CAST(60 AS BIGINT) AS length FROM r, range(0, 3) x(i)""")
def smp08_sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60).alias("total"))
    return frames.sample_windows(titles, "total", windows=3).select("p_partkey", "start", "length")


@query("""WITH f AS (SELECT user_id, k // 20 AS win, event_type = 'view' AS blank FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)),
b AS (SELECT user_id, win, avg(CASE WHEN blank THEN 1.0 ELSE 0.0 END) AS share FROM f GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share, win) AS r FROM b)
SELECT user_id, CAST(win AS BIGINT) AS win, round(share, 9) AS blank_fraction FROM r WHERE share <= 0.5 OR r = 1""")
def smp09_busy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.chunked(numbered(spark, sf_dir), "user_id", "k", 20).withColumn("blank", F.col("event_type") == "view")
    return frames.busy_windows(f, "user_id", "chunk", "blank").select("user_id", F.col("chunk").alias("win"), F.round("blank_fraction", 9).alias("blank_fraction"))


@query("""WITH d AS (SELECT event_type, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000) AS d FROM events),
p AS (SELECT event_type, d, row_number() OVER (PARTITION BY event_type ORDER BY d) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM d WHERE d > 0)
SELECT event_type, CASE WHEN 90000.0 / d BETWEEN 1 AND 240 THEN round(90000.0 / d, 6) END AS fps FROM p WHERE r = n // 2 + 1""")
def smp10_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("pts"))
    return frames.estimated_fps(samples, "event_type", "pts", width=3600).select("event_type", F.round("fps", 6).alias("fps"))


@query(f"WITH {_K}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS shown FROM k WHERE event_type <> 'error') SELECT user_id, event_id, shown FROM v WHERE shown < 40")
def flt03_presentation_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = numbered(spark, sf_dir)
    return frames.presented(every, every.where("event_type = 'error'"), "user_id", limit=40).select("user_id", "event_id", "shown")


@query(f"WITH {_K} SELECT user_id, event_id, k FROM k WHERE k >= ceil(0.5 * 24) AND k < ceil(1.3 * 24)")
def flt04_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.trimmed(numbered(spark, sf_dir), 24, 0.5, 1.3, "k").select("user_id", "event_id", "k")


_PLANE = "p AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255.0, greatest(0.0, 128 + 255 * CAST(x AS DOUBLE)))) AS y FROM embeddings)"


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 plane of luma for each embedding: 0 to 255 around 128."""
    y = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 255 * x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", y.alias("y"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes(spark, sf_dir).select("vec_id", "label", F.explode("y").alias("v")).groupBy("vec_id", "label").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))


@query(f"WITH {_PLANE}, a AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT vec_id, unnest(y) AS v FROM p) GROUP BY 1) SELECT vec_id, s < 3 OR (m <= 22 AND s < 6) AS blank FROM a")
def flt05_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).select("vec_id", picture.is_blank("mean", "deviation").alias("blank"))


@query(f"WITH {_PLANE} SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM (SELECT vec_id, unnest(y) AS v FROM p) GROUP BY 1")
def agg02_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).select("vec_id", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"WITH {_PLANE}, a AS (SELECT vec_id, label, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT vec_id, label, unnest(y) AS v FROM p) GROUP BY 1, 2) SELECT label, round(avg(m), 6) AS mean, round(avg(s), 6) AS deviation FROM a GROUP BY 1")
def agg03_window_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).groupBy("label").agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("deviation"), 6).alias("deviation"))


@query(f"WITH {_PLANE}, a AS (SELECT vec_id, label, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT vec_id, label, unnest(y) AS v FROM p) GROUP BY 1, 2) SELECT label, round(avg(CASE WHEN s < 30 THEN 1.0 ELSE 0.0 END), 9) AS fraction FROM a GROUP BY 1")
def agg04_blank_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).groupBy("label").agg(F.round(F.avg((F.col("deviation") < 30).cast("double")), 9).alias("fraction"))


@query("SELECT p_partkey, CASE WHEN p_size * 40 < 360 OR p_size * 30 < 360 THEN 'too_small' WHEN p_size < 15 THEN 'too_slow' WHEN p_retailprice > 900 THEN 'too_long' WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23') THEN 'unlisted' END AS reason FROM part")
def flt01_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23"]
    return table(spark, sf_dir, "part").select("p_partkey", picture.gate(F.col("p_size") * 40, F.col("p_size") * 30, "p_size", "p_retailprice", "p_brand", listed).alias("reason"))


@query(f"WITH {_K}, f AS (SELECT *, k = 0 OR floor(k / 24.0 / 0.5 + 1e-9) <> floor((k - 1) / 24.0 / 0.5 + 1e-9) AS first FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS n FROM f WHERE first) SELECT user_id, event_id, k FROM r WHERE n <= 3")
def flt10_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.hook_frames(numbered(spark, sf_dir), "user_id", seconds=0.5, fps=24.0, most=3).select("user_id", "event_id", "k")


@query(f"WITH {_K} SELECT user_id, event_id, k // 16 AS chunk, k // 16 = max(k // 16) OVER (PARTITION BY user_id) AS final FROM k")
def win12_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.chunked(numbered(spark, sf_dir), "user_id", "k", 16).select("user_id", "event_id", "chunk", "final")


_LIVE = "e AS (SELECT user_id, event_id, CAST(epoch_us(ts) * 10 AS BIGINT) AS t FROM events), s AS (SELECT *, t - min(t) OVER (PARTITION BY user_id) AS d FROM e)"


@query(f"WITH {_LIVE} SELECT user_id, event_id, CAST((2 * CAST(d AS HUGEINT) + 36000000000) // 72000000000 AS BIGINT) AS slot FROM s")
def mth13_live_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 10).alias("t"))
    start = F.min("t").over(Window.partitionBy("user_id"))
    return e.withColumn("t0", start).select("user_id", "event_id", timebase.live_slot("t", "t0", 1, 3600).alias("slot"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_partkey % 50 - l_suppkey % 10) > 40 THEN 'reanchor' WHEN l_partkey % 50 - l_suppkey % 10 < 0 THEN 'drop' ELSE 'write' END AS action, CAST(CASE WHEN abs(l_partkey % 50 - l_suppkey % 10) > 40 OR l_partkey % 50 - l_suppkey % 10 < 0 THEN 0 ELSE l_partkey % 50 - l_suppkey % 10 END AS BIGINT) AS repeats FROM lineitem")
def mth14_live_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", timebase.live_place(F.col("l_partkey") % 50, F.col("l_suppkey") % 10, 40).alias("p")).select("l_orderkey", "l_linenumber", "p.action", "p.repeats")
