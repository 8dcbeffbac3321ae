"""Segments, packets, cues and joins on ``lineitem``, ``orders``, ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, segments
from .base import query, table


@query("""WITH s AS (SELECT l_returnflag AS rendition, sum(l_extendedprice) AS b, sum(l_quantity) AS s, max(CASE WHEN l_quantity > 0 THEN floor(l_extendedprice * 8 / l_quantity) END) AS p FROM lineitem GROUP BY 1)
SELECT rendition, CAST(floor(b * 8 / s) AS BIGINT) AS average, CAST(greatest(p, floor(b * 8 / s)) AS BIGINT) AS peak FROM s""")
def agg01_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.bandwidth(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "rendition"), "rendition", "l_extendedprice", "l_quantity")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS bytes, sum(l_quantity) AS seconds, count(*) AS segments FROM lineitem GROUP BY 1, 2")
def agg08_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("r", F.struct("l_returnflag", "l_linestatus"))
    return segments.totals(rows, "r", "l_extendedprice", "l_quantity").select("r.*", F.round("bytes", 2).alias("bytes"), "seconds", "segments")


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN CAST(ceil(floor(p_retailprice) / p_size) AS BIGINT) ELSE 0 END AS segments FROM part")
def agg09_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.timebase import segments as count

    return table(spark, sf_dir, "part").select("p_partkey", count(F.floor("p_retailprice"), "p_size").alias("segments"))


@query("""SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) <> count(DISTINCT l_linenumber) THEN 'duplicate' WHEN max(l_linenumber) - min(l_linenumber) + 1 <> count(DISTINCT l_linenumber) THEN 'gap' WHEN count(DISTINCT l_linestatus) > 1 THEN 'disagrees on l_linestatus' END AS problem FROM lineitem GROUP BY 1""")
def agg12_merge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.merge_check(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_linestatus"])


_PACKETS = """p AS (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS arrival, epoch_us(l_shipdate) // 1000000 * 1000 + l_linenumber AS pts, CAST(l_quantity AS BIGINT) AS duration FROM lineitem)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by ``s``, so what goes by it needs no shuffle: the window is over the column's new name, as Spark takes the old one for another."""
    from pyspark.sql import Window

    w = Window.partitionBy("s").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    pts = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1_000_000) * 1000 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "s")
    return rows.select("s", F.row_number().over(w).alias("arrival"), pts.cast("long").alias("pts"), F.col("l_quantity").cast("long").alias("duration"))


_CTTS = f"""WITH {_PACKETS}, d AS (SELECT DISTINCT s FROM (SELECT s, pts FROM p GROUP BY 1, 2 HAVING count(*) > 1)),
q AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pts) AS r, coalesce(sum(duration) OVER (PARTITION BY s ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dt FROM p WHERE s NOT IN (SELECT s FROM d)),
o AS (SELECT a.s, a.arrival, CAST(b.dt - a.dt AS BIGINT) AS offs FROM q a JOIN q b ON a.s = b.s AND b.arrival = a.r)"""


@query(_CTTS + ' SELECT s, arrival, offs AS "offset" FROM o')
def win01_composition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.composition_offsets(packets(spark, sf_dir), "s", "arrival", "pts", "duration").select("s", "arrival", F.col("offset").cast("long").alias("offset"))


@query(_CTTS + " SELECT s, bool_or(offs <> 0) AS reordered FROM o GROUP BY 1")
def win02_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.is_reordered(segments.composition_offsets(packets(spark, sf_dir), "s", "arrival", "pts", "duration"), "s")


_WRAP = """e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events), w AS (SELECT *, t % 4294967296 AS m FROM e),
d AS (SELECT *, row_number() OVER o AS n, m - lag(m) OVER o AS step FROM w WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)),
u AS (SELECT *, m + 4294967296 * sum(CASE WHEN step < -2147483648 THEN 1 WHEN step > 2147483648 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS v FROM d)"""


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("t"))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id"))).withColumn("m", F.col("t") % (1 << 32))


@query(f"WITH {_WRAP} SELECT user_id, event_id, CAST(v AS BIGINT) AS unwrapped FROM u")
def win03_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.unwrapped(wrapped(spark, sf_dir), "user_id", "n", "m", bits=32).select("user_id", "event_id", "unwrapped")


@query("""WITH w AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n, (epoch_us(ts) // 1000) % 4294967296 AS m FROM events),
l AS (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY n) AS p FROM w),
b AS (SELECT *, p IS NOT NULL AND (event_type = 'error' OR ((m - p + 6442450944) % 4294967296) - 2147483648 NOT BETWEEN 0 AND 86400000) AS broken FROM l)
SELECT user_id, event_id, broken, CAST(count_if(broken) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS segment FROM b""")
def win04_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("flag"))
    w = wrapped(spark, sf_dir).join(e, "event_id")
    return segments.time_base_breaks(w, "user_id", "n", "m", 86_400_000, flag="flag", bits=32).select("user_id", "event_id", "broken", "segment")


_CUES = "c AS (SELECT conv_id, turn, CAST(turn * 30 AS BIGINT) AS start, CAST(10 + length(text) % 60 AS BIGINT) AS duration, text FROM conversations)"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue for each turn, in tenths of a second: one begins each three seconds, and lasts by its length."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 30).cast("long").alias("start"), (10 + F.length("text") % 60).cast("long").alias("duration"), "text")


@query(f"""WITH {_CUES}, z AS (SELECT conv_id, turn, start, CASE WHEN turn % 4 = 2 THEN 0 ELSE duration END AS d FROM c), n AS (SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY start, turn) AS nx FROM z),
o AS (SELECT conv_id, turn, start, CASE WHEN start + d > nx THEN greatest(nx - start, 1) ELSE d END AS duration FROM n) SELECT * FROM o WHERE duration > 0""")
def win05_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).withColumn("duration", F.when(F.col("turn") % 4 == 2, 0).otherwise(F.col("duration")).cast("long"))
    return segments.without_overlap(c, "conv_id", "start", "duration", "turn").select("conv_id", "turn", "start", "duration")


_SEGMENTS = "g AS (SELECT conv_id, unnest(range(0, max(start + duration) // 40 + 1)) AS n FROM c GROUP BY 1)"


def cue_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).withColumn("end", F.col("start") + F.col("duration"))
    g = c.groupBy("conv_id").agg(F.floor(F.max("end") / 40).alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("segment"))
    g = g.withColumn("first", F.col("segment") * 40).withColumn("until", F.col("first") + 40)
    return joins.overlapping(c, g, "conv_id", ("start", "end"), ("first", "until"))


@query(f"WITH {_CUES}, {_SEGMENTS} SELECT c.conv_id, turn, CAST(n AS BIGINT) AS segment FROM c JOIN g ON c.conv_id = g.conv_id AND c.start < n * 40 + 40 AND c.start + c.duration > n * 40")
def jon01_cue_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_segments(spark, sf_dir).select("conv_id", "turn", "segment")


@query(f"""WITH {_CUES}, {_SEGMENTS}, e AS (SELECT c.conv_id, n, start, turn, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS t FROM c JOIN g ON c.conv_id = g.conv_id AND c.start < n * 40 + 40 AND c.start + c.duration > n * 40)
SELECT conv_id, CAST(n AS BIGINT) AS segment, sha256('WEBVTT' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY start, turn)) AS document FROM e WHERE t <> '' GROUP BY 1, 2""")
def txt04_segment_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import escape_cue

    e = cue_segments(spark, sf_dir).withColumn("t", escape_cue("text")).where("t <> ''")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "turn", "t"))), lambda x: x["t"]), "\n\n")
    return e.groupBy("conv_id", "segment").agg(F.sha2(F.concat(F.lit("WEBVTT\n\n"), lines), 256).alias("document"))


@query(f"WITH {_CUES} SELECT conv_id, turn, greatest(start, 45) - 45 AS start, least(start + duration, 200) - greatest(start, 45) AS duration FROM c WHERE start < 200 AND start + duration > 45")
def win15_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.rebased(cues(spark, sf_dir), "start", "duration", 45, 200).select("conv_id", "turn", "start", "duration")


#: A picture each 7 ticks, but for a hole in the video from 95 to 150.
_PICTURES = "p AS (SELECT conv_id, pts, row_number() OVER (PARTITION BY conv_id ORDER BY pts) - 1 AS frame FROM (SELECT conv_id, unnest(range(0, max(start + duration), 7)) AS pts FROM a GROUP BY 1) WHERE pts < 95 OR pts >= 150)"


@query(f"""WITH RECURSIVE {_CUES}, a AS (SELECT conv_id, turn, start + CASE WHEN turn % 3 = 2 THEN -14 ELSE turn % 4 * 9 END AS start, 14 + duration % 20 AS duration, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c), {_PICTURES},
t AS (SELECT conv_id, turn, start AS t FROM a UNION ALL SELECT conv_id, turn, start + duration FROM a),
s AS (SELECT t.conv_id, t.t, arg_min(frame * 7 + t.t - pts, abs(t.t - pts) * 100000 + pts) AS shown FROM t JOIN p ON t.conv_id = p.conv_id GROUP BY 1, 2),
b AS (SELECT a.*, x.shown AS since, y.shown AS upto FROM a JOIN s x ON x.conv_id = a.conv_id AND x.t = a.start JOIN s y ON y.conv_id = a.conv_id AND y.t = a.start + a.duration),
r AS (SELECT conv_id, turn, n, start AS expect, since AS shown, CAST(0 AS BIGINT) AS hole, false AS dropped, false AS kept, duration FROM b WHERE n = 1 AND false UNION ALL SELECT conv_id, turn, n, start + duration, upto, CAST(0 AS BIGINT), false, true, duration FROM b WHERE n = 1
UNION ALL SELECT conv_id, turn, n, CASE WHEN late THEN expect ELSE start + duration END, CASE WHEN late THEN shown ELSE upto END, CASE WHEN NOT late AND off > duration // 2 THEN off ELSE 0 END, late, true, duration
FROM (SELECT *, own < -(duration // 2) OR off < -(duration // 2) AS late FROM (SELECT b.*, r.expect, r.shown, b.start - r.expect AS own, CASE WHEN b.start - r.expect > b.duration // 2 THEN b.since - r.shown ELSE 0 END AS off FROM r JOIN b ON b.conv_id = r.conv_id AND b.n = r.n + 1)))
SELECT conv_id, turn, hole, dropped, CASE WHEN dropped THEN 0 ELSE duration + coalesce((SELECT q.hole FROM r q WHERE q.conv_id = r.conv_id AND q.n > r.n AND NOT q.dropped ORDER BY q.n LIMIT 1), 0) END AS lasts FROM r""")
def win06_audio_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("start") + F.when(F.col("turn") % 3 == 2, -14).otherwise(F.col("turn") % 4 * 9)
    a = cues(spark, sf_dir).select("conv_id", "turn", start.cast("long").alias("start"), (14 + F.col("duration") % 20).alias("duration"))
    last = a.groupBy("conv_id").agg(F.max(F.col("start") + F.col("duration")).alias("end"))
    p = last.select("conv_id", F.explode(F.expr("sequence(0, end - 1, 7)")).alias("pts")).where("pts < 95 or pts >= 150")
    # The pictures from 150 on come after the 14 before 95.
    p = p.withColumn("frame", F.when(F.col("pts") < 95, F.floor(F.col("pts") / 7)).otherwise(F.floor((F.col("pts") - 154) / 7) + 14))
    return segments.placed_audio(a, "conv_id", "turn", "start", "duration", p, 7).select("conv_id", "turn", "hole", "dropped", "lasts")


_CUT = """WITH RECURSIVE p AS (SELECT s, arrival, duration, arrival % 2 = 1 AS key, coalesce(sum(duration) OVER (PARTITION BY s ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS arrival, CAST(l_quantity AS BIGINT) AS duration FROM lineitem)),
r AS (SELECT s, arrival, t, CAST(0 AS BIGINT) AS segment, CAST(0 AS HUGEINT) AS since FROM p WHERE arrival = 1
UNION ALL SELECT p.s, p.arrival, p.t, CASE WHEN {key} AND p.t - r.since >= 60 THEN r.segment + 1 ELSE r.segment END, CASE WHEN {key} AND p.t - r.since >= 60 THEN p.t ELSE r.since END FROM r JOIN p ON p.s = r.s AND p.arrival = r.arrival + 1)
SELECT s, arrival, segment FROM r"""


@query(_CUT.format(key="p.key"))
def win07_keyframe_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("key", F.col("arrival") % 2 == 1)
    return segments.cut_on_keyframes(p, "s", "arrival", "duration", "key", 60).select("s", "arrival", F.col("segment").cast("long").alias("segment"))


@query(_CUT.format(key="true"))
def win08_length_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.cut_by_length(packets(spark, sf_dir), "s", "arrival", "duration", 60).select("s", "arrival", F.col("segment").cast("long").alias("segment"))


@query("""WITH s AS (SELECT l_returnflag AS r, least(l_orderkey % 70 + 1, CASE WHEN l_returnflag = 'R' THEN 69 ELSE 70 END) AS n, floor(avg(l_quantity)) AS q FROM lineitem GROUP BY 1, 2),
e AS (SELECT r, sum(q) OVER (PARTITION BY r ORDER BY n) AS e, row_number() OVER (PARTITION BY r ORDER BY n) AS boundary FROM s), c AS (SELECT r, count(*) AS n FROM e GROUP BY 1)
SELECT boundary, max(abs(e - own)) AS drift, count(*) AS renditions, (SELECT min(n) = max(n) FROM c) AND count(*) = (SELECT count(*) FROM c) AND coalesce(max(abs(e - own)) <= 3, false) AS aligned FROM (SELECT e.*, (SELECT x.e FROM e x WHERE x.boundary = e.boundary AND x.r = (SELECT min(r) FROM c)) AS own FROM e) GROUP BY 1""")
def win09_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renditions of which one has its last two segments as one: no boundary is aligned, however small the drift."""
    return segments.alignment(rendition_seconds(spark, sf_dir, F.when(F.col("l_returnflag") == "R", 69).otherwise(70)), "r", "sequence", "q", 3.0)


def rendition_seconds(spark: SparkSession, sf_dir: str, last: Column) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("r"), F.least(F.col("l_orderkey") % 70 + 1, last).alias("sequence")).agg(F.floor(F.avg("l_quantity")).cast("double").alias("q"))


@query("""WITH s AS (SELECT l_returnflag AS r, l_orderkey % 70 AS n, floor(avg(l_quantity)) AS q FROM lineitem GROUP BY 1, 2), e AS (SELECT r, sum(q) OVER (PARTITION BY r ORDER BY n) AS e, row_number() OVER (PARTITION BY r ORDER BY n) AS boundary FROM s)
SELECT e.boundary, max(abs(e.e - x.e)) AS drift, count(*) AS renditions, max(abs(e.e - x.e)) <= 3 AS aligned FROM e JOIN e x ON x.boundary = e.boundary AND x.r = 'N' GROUP BY 1""")
def jon10_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renditions of as many segments each, against a named base."""
    return segments.alignment(rendition_seconds(spark, sf_dir, F.lit(70)), "r", "sequence", "q", 3.0, base="N")


@query("SELECT o_orderkey, CASE WHEN abs(o_totalprice / 1000 - o_custkey / 10.0) > 120 THEN 'fail' WHEN abs(o_totalprice / 1000 - o_custkey / 10.0) > 40 THEN 'warn' ELSE 'ok' END AS verdict FROM orders")
def win10_duration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("v"), (F.col("o_custkey") / 10.0).alias("a"))
    return segments.duration_check(o, "v", "a", 40.0).select("o_orderkey", "verdict")


_KEYS = "k AS (SELECT DISTINCT o_custkey AS s, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS p FROM orders), t AS (SELECT DISTINCT s, (p // 365) * 365 AS g FROM k)"


def keyframes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("s"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("p")).distinct()
    return k, k.select("s", (F.floor(F.col("p") / 365) * 365).alias("g")).distinct()


@query(f"WITH {_KEYS} SELECT t.s, t.g AS target, arg_min(p, abs(p - g) * 1000000 + p) AS nearest FROM t JOIN k USING (s) GROUP BY 1, 2")
def jon04_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = keyframes(spark, sf_dir)
    return joins.nearest(k, t, "s", "p", "g").select("s", F.col("g").alias("target"), "nearest")


@query(f"WITH {_KEYS} SELECT t.s, t.g AS target, max(CASE WHEN p + 30 <= g THEN p END) AS keyframe FROM t JOIN k USING (s) GROUP BY 1, 2")
def jon05_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = keyframes(spark, sf_dir)
    return joins.as_of(k, t, "s", "p", "g", 30).select("s", F.col("g").alias("target"), F.col("p").alias("keyframe"))


@query("""WITH p AS (SELECT s, arrival, coalesce(sum(duration) OVER (PARTITION BY s ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(duration) OVER (PARTITION BY s ORDER BY arrival) AS e FROM (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS arrival, CAST(l_quantity AS BIGINT) AS duration FROM lineitem)),
f AS (SELECT s, min(arrival) AS n FROM p WHERE a < 90 AND e > 60 GROUP BY 1)
SELECT p.s, p.arrival, NOT (a < 90 AND e > 60) AS preroll FROM p LEFT JOIN f USING (s) WHERE (a < 90 AND e > 60) OR (arrival < n AND (arrival >= n - 1 OR e > 60 - 40))""")
def jon03_preroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = packets(spark, sf_dir)
    end = F.sum("duration").over(Window.partitionBy("s").orderBy("arrival"))
    p = p.withColumn("end", end).withColumn("start", F.col("end") - F.col("duration"))
    return joins.prerolled(p, "s", "arrival", "start", "end", (60, 90), 1, 40).select("s", "arrival", "preroll")


@query("""WITH r AS (SELECT p_partkey, copy, p_size, row_number() OVER (PARTITION BY p_partkey // 8, copy ORDER BY p_size DESC, p_partkey) - 1 AS pos FROM part, range(0, 2) x(copy)),
u(ord, sel, v, qd, codec, crf) AS (VALUES (1, 'any', 0, 0, 'h264', 30), (2, 'top', 0, -3, 'av1', NULL), (3, 'below_top', 0, 2, NULL, 34), (4, 'step', 2, 1, 'h265', NULL), (5, 'short_le', 10, 4, NULL, 40), (6, 'short_ge', 45, -1, 'vp9', NULL)),
j AS (SELECT * FROM r JOIN u ON sel = 'any' OR (sel = 'top' AND pos = 0) OR (sel = 'below_top' AND pos > 0) OR (sel = 'step' AND pos = v) OR (sel = 'short_le' AND p_size <= v) OR (sel = 'short_ge' AND p_size >= v))
SELECT p_partkey, CAST(sum(qd) AS INTEGER) AS quality_delta, max_by(codec, ord) FILTER (codec IS NOT NULL) AS codec, max_by(crf, ord) FILTER (crf IS NOT NULL) AS crf FROM j GROUP BY p_partkey, copy""")
def jon06_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.floor(F.col("p_partkey") / 8)).orderBy(F.desc("p_size"), "p_partkey")) - 1
    rungs = table(spark, sf_dir, "part").select("p_partkey", place.alias("position"), F.col("p_size").alias("short_side"))
    rungs = rungs.union(rungs)  # equal rungs stay rows of their own
    rules = spark.createDataFrame([(1, "any", 0, 0, "h264", 30), (2, "top", 0, -3, "av1", None), (3, "below_top", 0, 2, None, 34), (4, "step", 2, 1, "h265", None), (5, "short_le", 10, 4, None, 40), (6, "short_ge", 45, -1, "vp9", None)], "ord int, selector string, value int, quality_delta int, codec string, crf int")
    return joins.with_rules(rungs, rules, ["codec", "crf"]).select("p_partkey", "quality_delta", "codec", "crf")


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name) AS preset FROM customer JOIN nation ON c_nationkey = n_nationkey")
def jon07_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("place"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("preset"))
    defaults = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("preset"))
    return joins.with_defaults(jobs, defaults, ["preset"], ["place"]).select("c_custkey", "preset")


@query("""WITH r AS (SELECT p_partkey, p_partkey // 8 AS ladder, p_size // 15 AS w, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1 AS pos FROM part), f AS (SELECT *, min(pos) OVER (PARTITION BY ladder, w) AS m FROM r)
SELECT p_partkey, CASE WHEN pos <> m THEN m END AS same_as FROM f""")
def jon08_same_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.distinct_placements(placed_rungs(spark, sf_dir), "ladder", "pos", ["w"]).select("p_partkey", "same_as")


def placed_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders of eight rungs."""
    from pyspark.sql import Window

    rungs = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 8).alias("ladder"), F.floor(F.col("p_size") / 15).alias("w"))
    return rungs.withColumn("pos", (F.row_number().over(Window.partitionBy("ladder").orderBy("p_partkey")) - 1).cast("long"))


@query("""WITH r AS (SELECT p_partkey, p_partkey // 8 AS ladder, p_size // 15 AS w, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) AS pos FROM part) SELECT p_partkey FROM r QUALIFY row_number() OVER (PARTITION BY ladder, w ORDER BY pos) = 1""")
def set03_distinct_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.distinct_placements(placed_rungs(spark, sf_dir), "ladder", "pos", ["w"]).where("same_as is null").select("p_partkey")


@query("""WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents WHERE source < 'src15'), b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents WHERE source >= 'src15')
SELECT coalesce(a.lang, b.lang) AS lang, CAST(coalesce(a.place, b.place) AS INTEGER) AS place, a.doc_id AS track, b.doc_id AS clip_track FROM a FULL JOIN b ON a.lang = b.lang AND a.place = b.place""")
def jon13_continued_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "source")
    return joins.continued_tracks(d.where("source < 'src15'"), d.where("source >= 'src15'"), "lang", "doc_id")


@query("SELECT l.doc_id FROM documents l WHERE l.source NOT IN (SELECT source FROM documents WHERE n_chars < 9)")
def flt07_deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return joins.without(d, d.where("n_chars < 9"), ["source"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
def flt06_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.only_languages(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "fr"]).select("doc_id")


@query("""WITH v AS (SELECT l_returnflag AS rendition, max(CAST(floor(l_extendedprice) AS BIGINT)) AS peak, min(CAST(floor(l_extendedprice) AS BIGINT)) AS average FROM lineitem GROUP BY 1)
SELECT rendition, average + (SELECT max(p_size) FROM part) + (SELECT max(s_nationkey) FROM supplier) AS average, peak + (SELECT max(p_size * 2) FROM part) + (SELECT max(s_nationkey * 2) FROM supplier) AS peak FROM v""")
def agg14_variant_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("l_extendedprice").cast("long")
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("rendition")).agg(F.max(price).alias("peak"), F.min(price).alias("average"))
    two = lambda df, c: df.select(F.col(c).cast("long").alias("average"), (F.col(c) * 2).cast("long").alias("peak"))
    return segments.variant_rates(v, two(table(spark, sf_dir, "part"), "p_size"), two(table(spark, sf_dir, "supplier"), "s_nationkey"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, '#EXTINF:' || format('{:.6f}', l_quantity) || ',' || chr(10) || 'seg' || l_linenumber || '.m4s' || chr(10) AS line FROM lineitem),
p AS (SELECT l_orderkey, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST(CAST(ceil(max(l_quantity)) AS BIGINT) AS VARCHAR) || chr(10) || '#EXT-X-PLAYLIST-TYPE:' AS head, chr(10) || '#EXT-X-MAP:URI="init.mp4"' || chr(10) || string_agg(line, '' ORDER BY l_linenumber, line) AS body FROM l GROUP BY 1)
SELECT l_orderkey, sha256(head || 'VOD' || body || '#EXT-X-ENDLIST' || chr(10)) AS playlist, sha256(head || 'EVENT' || body) AS growing FROM p""")
def txt18_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.concat(F.lit("seg"), F.col("l_linenumber").cast("string"), F.lit(".m4s")).alias("uri"))
    done, live = (segments.media_playlist(rows, "l_orderkey", "l_linenumber", "l_quantity", "uri", live=x) for x in (False, True))
    return done.join(live.withColumnRenamed("playlist", "growing"), "l_orderkey").select("l_orderkey", F.sha2("playlist", 256).alias("playlist"), F.sha2("growing", 256).alias("growing"))


@query(f"""WITH {_CUES}, {_SEGMENTS} SELECT conv_id, sha256('#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:4' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || string_agg('#EXTINF:4.000000,' || chr(10) || 'seg-' || n || '.vtt' || chr(10), '' ORDER BY n) || '#EXT-X-ENDLIST' || chr(10)) AS playlist FROM g GROUP BY 1""")
def snk11_subtitle_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The playlist of the documents of ``txt04_segment_document``, on the grid of the video's segments: empty ones too."""
    c = cues(spark, sf_dir)
    g = c.groupBy("conv_id").agg(F.floor(F.max(F.col("start") + F.col("duration")) / 40).alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("n"))
    g = g.withColumn("seconds", F.lit(4.0)).withColumn("uri", F.concat(F.lit("seg-"), F.col("n").cast("string"), F.lit(".vtt")))
    return segments.media_playlist(g, "conv_id", "n", "seconds", "uri", target=4, init=None).select("conv_id", F.sha2("playlist", 256).alias("playlist"))
