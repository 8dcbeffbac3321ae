"""The live timeline and the kernels on ``events`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio
from ..kernels import pixels
from ..sources import pcm
from ..streaming import live, sessions
from .base import query, table
from .frames import planes

_LIVE = """e AS (SELECT user_id, event_id, event_type, CAST(epoch_us(ts) * 10 AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, event_type, n, t AS t0, CAST(1 AS BIGINT) AS written, CAST(0 AS BIGINT) AS slot, 'write' AS status, CAST(0 AS BIGINT) AS repeats FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, event_type, n, CASE WHEN jump THEN t - written * 36000000000 ELSE t0 END, CASE WHEN jump THEN written + 1 WHEN k < written THEN written ELSE k + 1 END, CASE WHEN jump THEN written ELSE k END,
CASE WHEN jump THEN 'reanchor' WHEN k < written THEN 'drop' ELSE 'write' END, CASE WHEN jump OR k < written THEN 0 ELSE k - written END
FROM (SELECT *, abs(k - written) > 24 AS jump FROM (SELECT e.*, r.t0, r.written, CASE WHEN e.t < r.t0 THEN -1 ELSE 1 END * ((2 * abs(e.t - r.t0) + 36000000000) // 72000000000) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) * 10).alias("t"))
    return live.timeline(e, "user_id", "event_id", "t", 1, 3600, 24)


@query(f"WITH RECURSIVE {_LIVE} SELECT user_id, event_id, slot, status, repeats FROM r")
def str01_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).select("user_id", "event_id", "slot", "status", "repeats")


@query(f"WITH RECURSIVE {_LIVE} SELECT user_id, CAST(count_if(status <> 'drop') + sum(repeats) AS BIGINT) AS frames, CAST(sum(repeats) AS BIGINT) AS repeated, count_if(status = 'drop') AS dropped_early, CAST(0 AS BIGINT) AS dropped_behind, count_if(status = 'reanchor') AS reanchored FROM r GROUP BY 1")
def agg11_live_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_stats(timeline(spark, sf_dir), "user_id")


@query(f"""WITH RECURSIVE {_LIVE}, w AS (SELECT *, CASE WHEN event_id % 6 = 5 THEN 1280 ELSE 640 END AS width FROM r WHERE status <> 'drop')
SELECT user_id, event_id, first_value(width) OVER o AS out_width, width <> first_value(width) OVER o AS rescaled, coalesce(event_type <> lag(event_type) OVER o, false) AS renewed FROM w WINDOW o AS (PARTITION BY user_id ORDER BY event_id)""")
def str06_shape_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir).where("status <> 'drop'").withColumn("width", F.when(F.col("event_id") % 6 == 5, 1280).otherwise(640)).withColumn("height", F.lit(360))
    return live.shape_changes(e, "user_id", "event_id", "width", "height", "event_type").select("user_id", "event_id", "out_width", "rescaled", "renewed")


#: Hours as seconds, every third event sound at 100 samples a second; first all pictures, then all sound by the anchor that held when it came.
@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, event_id % 3 = 1 AS sound, CAST(epoch_us(ts) * 10 // 3600 AS BIGINT) AS t, CASE WHEN event_id % 6 = 5 THEN 1280 ELSE 640 END AS width, 50 + event_id % 400 AS n, CASE WHEN event_id % 17 = 10 THEN 50 ELSE 100 END AS rate, row_number() OVER (PARTITION BY user_id, event_id % 3 = 1 ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, event_type, width, i, t AS t0, CAST(1 AS BIGINT) AS written, CAST(0 AS BIGINT) AS slot, 'write' AS status, CAST(0 AS BIGINT) AS repeats FROM e WHERE i = 1 AND NOT sound
UNION ALL SELECT user_id, event_id, event_type, width, i, CASE WHEN jump THEN t - written * 10000000 ELSE t0 END, CASE WHEN jump THEN written + 1 WHEN k < written THEN written ELSE k + 1 END, CASE WHEN jump THEN written ELSE k END,
CASE WHEN jump THEN 'reanchor' WHEN k < written THEN 'drop' ELSE 'write' END, CASE WHEN jump OR k < written THEN 0 ELSE k - written END
FROM (SELECT *, abs(k - written) > 24 AS jump FROM (SELECT e.*, r.t0, r.written, CASE WHEN e.t < r.t0 THEN -1 ELSE 1 END * ((2 * abs(e.t - r.t0) + 10000000) // 20000000) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1 AND NOT e.sound))),
w AS (SELECT user_id, event_id, first_value(width) OVER o AS out_width, width <> first_value(width) OVER o AS rescaled, coalesce(event_type <> lag(event_type) OVER o, false) AS renewed FROM r WHERE status <> 'drop' WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT user_id, event_id, t0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM r),
s AS (SELECT e.user_id, e.event_id, e.n, e.rate, e.i, coalesce(b.t0, f.t0) AS t0, e.t FROM e JOIN a f ON f.user_id = e.user_id AND f.nth = 1 ASOF LEFT JOIN a b ON b.user_id = e.user_id AND b.event_id <= e.event_id WHERE e.sound),
b AS (SELECT *, first_value(rate) OVER (PARTITION BY user_id ORDER BY event_id) AS base FROM s),
c AS (SELECT user_id, event_id, n, base, rate <> base AS other, CASE WHEN t < t0 THEN -1 ELSE 1 END * ((2 * abs(t - t0) * base + 10000000) // 20000000) AS pos, i FROM b),
q AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS heard, CAST(0 AS BIGINT) AS pos, false AS other, CAST(0 AS BIGINT) AS silence, CAST(0 AS BIGINT) AS trim, CAST(0 AS BIGINT) AS kept FROM c WHERE i = 1
UNION ALL SELECT user_id, event_id, i, CASE WHEN other THEN heard ELSE heard + silence + n - trim END, pos, other, silence, trim, n - trim FROM (
SELECT *, CASE WHEN d > CASE WHEN heard = 0 THEN 0 ELSE base // 25 END AND d <= 10 * base THEN d ELSE 0 END AS silence, CASE WHEN d < CASE WHEN heard = 0 THEN 0 ELSE -(base // 25) END THEN least(-d, n) ELSE 0 END AS trim FROM (SELECT c.*, q.heard, c.pos - q.heard AS d FROM q JOIN c ON c.user_id = q.user_id AND c.i = q.i + 1)))
SELECT user_id, event_id, status, slot, repeats, out_width, rescaled, renewed, NULL AS "at", NULL AS silence, NULL AS trim, NULL AS kept FROM r LEFT JOIN w USING (user_id, event_id)
UNION ALL SELECT user_id, event_id, CASE WHEN other THEN 'reshaped' ELSE 'placed' END, NULL, NULL, NULL, NULL, NULL, CASE WHEN NOT other THEN pos END, CASE WHEN NOT other THEN silence END, CASE WHEN NOT other THEN trim END, CASE WHEN NOT other THEN kept END FROM q WHERE i > 0""")
def str03_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures and sound of each user's events on one timeline."""
    sound = F.col("event_id") % 3 == 1
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("arrival"), F.when(sound, "sound").otherwise("picture").alias("kind"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) * 10 / 3600).alias("time"), F.col("event_type").alias("shape"),
        F.when(F.col("event_id") % 6 == 5, 1280).otherwise(640).alias("width"), F.lit(360).alias("height"), F.when(F.col("event_id") % 17 == 10, 50).otherwise(100).alias("rate"), F.lit(2).alias("channels"), (50 + F.col("event_id") % 400).alias("samples"),
    )
    out = sessions.placed(e, sessions.Rules(1, 1, 24)).where("kind <> 'end'")
    return out.select(F.col("source").cast("long").alias("user_id"), F.col("arrival").alias("event_id"), "status", "slot", "repeats", "out_width", "rescaled", "renewed", "at", "silence", "trim", "kept")


@query("SELECT event_id, round, epoch_us(ts) // 1000000 + round * 86400 AS t FROM events, range(0, 3) x(round)")
def src30_repeated_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    return live.repeated_source(e, "t", 86_400, 3).select("event_id", F.col("round").cast("long").alias("round"), "t")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, turn * 30 + (conv_id * 7 + turn * 13) % 25 AS at, 10 + length(text) % 60 AS n, CASE WHEN turn % 5 = 3 THEN 'b' ELSE 'a' END AS shape, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, shape AS first FROM c WHERE i = 1),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS written, CAST(0 AS BIGINT) AS silence, CAST(0 AS BIGINT) AS trim, CAST(0 AS BIGINT) AS kept FROM f
UNION ALL SELECT conv_id, turn, i, written + silence + kept, silence, trim, kept FROM (
SELECT *, CASE WHEN other THEN 0 ELSE least(n - trim, greatest(200 - written - silence, 0)) END AS kept FROM (
SELECT *, CASE WHEN NOT other AND d < 0 AND (written = 0 OR d < -4) THEN least(-d, n) ELSE 0 END AS trim, CASE WHEN NOT other AND ((written = 0 AND d > 0 AND d <= 40) OR (d > 4 AND d <= 40)) THEN least(d, greatest(200 - written, 0)) ELSE 0 END AS silence FROM (
SELECT c.conv_id, c.turn, c.i, c.n, c.shape <> f.first AS other, r.written, c.at - r.written AS d FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1 JOIN f ON f.conv_id = c.conv_id))))
SELECT conv_id, turn, silence, trim, kept FROM r WHERE i > 0""")
def str03_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("turn") * 30 + (F.col("conv_id") * 7 + F.col("turn") * 13) % 25).cast("long")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", at.alias("at"), (10 + F.length("text") % 60).cast("long").alias("n"), F.when(F.col("turn") % 5 == 3, "b").otherwise("a").alias("shape"))
    return live.audio_timeline(c, "conv_id", "turn", "at", "n", 4, 40, cap=200, shape="shape").select("conv_id", F.col("turn").cast("long").alias("turn"), "silence", "trim", "kept")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '6 hours', ts)) // 1000000 AS start, count(*) AS frames, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str04_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.timed_segments(e, "event_type", "ts", "6 hours", value="value")
    return out.select("event_type", F.unix_seconds("start").alias("start"), "frames", F.round("total", 4).alias("total"))


_LAYOUTS = [*audio.LAYOUTS]
_LAYOUT_ROWS = ", ".join(f"('{n}', {list(x)})" for n, x in audio.LAYOUTS.items())


@query(f"""WITH l(name, sp) AS (VALUES {_LAYOUT_ROWS}),
s AS (SELECT name AS source, unnest(sp) AS x, generate_subscripts(sp, 1) AS i FROM l),
pairs AS (SELECT a.name AS source, b.name AS target, a.sp AS src, CASE WHEN b.name = 'mono' AND a.name <> 'mono' THEN ['FL', 'FR'] ELSE b.sp END AS dst FROM l a, l b),
c AS (SELECT source, target, src, dst, x, i, list_contains(dst, 'FL') AND list_contains(dst, 'FR') AS fronts, list_contains(dst, 'BL') AS backs, list_contains(dst, 'SL') AS sides, list_contains(src, 'BL') AND list_contains(src, 'SL') AS four FROM pairs JOIN s USING (source)),
g AS (SELECT source, target, src, dst, i, CASE
 WHEN list_contains(dst, x) THEN [(x, 1.0::DOUBLE)]
 WHEN x = 'FC' AND fronts THEN [('FL', sqrt(0.5)), ('FR', sqrt(0.5))]
 WHEN x IN ('FL', 'FR') AND list_contains(dst, 'FC') THEN [('FC', sqrt(0.5))]
 WHEN x IN ('BL', 'BR') AND sides THEN [('S' || x[2], CASE WHEN four THEN sqrt(0.5) ELSE 1 END)]
 WHEN x IN ('SL', 'SR') AND backs THEN [('B' || x[2], CASE WHEN four THEN sqrt(0.5) ELSE 1 END)]
 WHEN x IN ('BL', 'BR', 'SL', 'SR') AND list_contains(dst, 'BC') THEN [('BC', sqrt(0.5))]
 WHEN x IN ('BL', 'BR', 'SL', 'SR') AND list_contains(dst, 'F' || x[2]) THEN [('F' || x[2], sqrt(0.5))]
 WHEN x = 'BC' AND (backs OR sides) THEN [(CASE WHEN backs THEN 'BL' ELSE 'SL' END, sqrt(0.5)), (CASE WHEN backs THEN 'BR' ELSE 'SR' END, sqrt(0.5))]
 WHEN x = 'BC' AND fronts THEN [('FL', 0.5), ('FR', 0.5)] ELSE [] END AS goes FROM c),
u AS (SELECT source, target, dst, i, unnest(goes) AS w FROM g),
m AS (SELECT source, target, CASE WHEN target = 'mono' AND source <> 'mono' THEN 1 ELSE list_position(dst, w[1]) END AS o, i, sum(w[2] * CASE WHEN target = 'mono' AND source <> 'mono' THEN sqrt(0.5) ELSE 1 END) AS gain FROM u GROUP BY ALL),
n AS (SELECT source, target, greatest(max(total), 1) AS widest FROM (SELECT source, target, o, sum(gain) AS total FROM m GROUP BY ALL) GROUP BY ALL),
p AS (SELECT vec_id, embedding AS e, {_LAYOUTS}[CAST(vec_id % {len(_LAYOUTS)} + 1 AS INTEGER)] AS source, {_LAYOUTS}[CAST(vec_id // {len(_LAYOUTS)} % {len(_LAYOUTS)} + 1 AS INTEGER)] AS target FROM embeddings),
k AS (SELECT p.*, unnest(range(1, len(l.sp) + 1)) AS o FROM p JOIN l ON l.name = p.target)
SELECT k.vec_id, k.source, k.target, CAST(k.o AS INTEGER) AS speaker, round(coalesce(sum(m.gain / n.widest * CAST(k.e[CAST(m.i AS INTEGER)] AS DOUBLE)), 0), 6) AS sample FROM k LEFT JOIN m ON m.source = k.source AND m.target = k.target AND m.o = k.o LEFT JOIN n ON n.source = k.source AND n.target = k.target GROUP BY 1, 2, 3, 4""")
def aud01_remix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame from each vector, from and to each of the layouts in turn."""
    pick = lambda n: F.element_at(F.array(*map(F.lit, _LAYOUTS)), (n % len(_LAYOUTS) + 1).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", pick(F.col("vec_id")).alias("source"), pick(F.floor(F.col("vec_id") / len(_LAYOUTS))).alias("target"))
    e = e.join(F.broadcast(audio.remixes(spark)), ["source", "target"]).withColumn("frame", F.slice(F.transform("embedding", lambda x: x.cast("double")), F.lit(1), F.size(F.col("gains")[0])))
    out = e.select("vec_id", "source", "target", F.posexplode(audio.remixed_by("frame", "gains")).alias("o", "v"))
    return out.select("vec_id", "source", "target", (F.col("o") + 1).alias("speaker"), F.round("v", 6).alias("sample"))


@query("""WITH b AS (SELECT vec_id // 50 AS track, vec_id % 50 AS block, embedding AS e FROM embeddings), c AS (SELECT p_partkey, p_partkey % 10 AS track, p_partkey * 13 % 1700 - 20 AS low, p_partkey * 13 % 1700 - 20 + 3 * p_size - 20 AS high FROM part),
s AS (SELECT track, block * 32 + (i - 1) // 2 AS frame, i % 2 AS side, CAST(e[CAST(i AS INTEGER)] AS DOUBLE) AS v FROM b, range(1, 65) t(i) WHERE i <= len(e))
SELECT p_partkey, count(*) AS samples, CAST(min(frame) AS BIGINT) AS first, round(sum(v), 5) AS total, round(arg_min(v, frame * 2 - side), 6) AS head, round(arg_max(v, frame * 2 - side), 6) AS tail FROM c JOIN s ON s.track = c.track AND frame >= low AND frame < high GROUP BY 1""")
def aud08_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors are a track of two channels, a block each; each part cuts a window out of one."""
    e = table(spark, sf_dir, "embeddings")
    blocks = e.select(F.floor(F.col("vec_id") / 50).cast("string").alias("path"), F.lit(2).alias("channels"), (F.col("vec_id") % 50).alias("block"), F.transform("embedding", lambda v: v.cast("float")).alias("samples"))
    start = F.col("p_partkey") * 13 % 1700 - 20
    cuts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10).cast("string").alias("path"), start.alias("start"), (start + 3 * F.col("p_size") - 20).alias("end"))
    whole = pcm.joined(pcm.windows(blocks, cuts, block=32), ["p_partkey", "start"])
    total = F.reduce("samples", F.lit(0.0), lambda a, v: a + v)
    return whole.select("p_partkey", F.size("samples").cast("long").alias("samples"), F.greatest("start", F.lit(0)).cast("long").alias("first"), F.round(total, 5).alias("total"), F.round(F.get("samples", F.lit(0)).cast("double"), 6).alias("head"), F.round(F.element_at("samples", -1).cast("double"), 6).alias("tail"))


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 frame for each embedding."""
    digits = F.array_join(F.transform("y", lambda v: F.lpad(F.hex(F.floor(v)), 2, "0")), "")
    return planes(spark, sf_dir).select("vec_id", F.expr("if(size(y) % 8 = 0, size(y) div 8, size(y))").cast("int").alias("width"), F.expr("if(size(y) % 8 = 0, 8, 1)").alias("height"), F.unhex(digits).alias("pixels"))


@query(r"WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(least(255.0, greatest(0.0, 128 + 255 * CAST(x AS DOUBLE)))) AS INTEGER)) AS y FROM embeddings) SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: lpad(upper(to_hex(255 - y[i // 8 * 8 + 8 - i % 8])), 2, '0')), '') AS pixels FROM p")
def pix03_flip_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.filtered(frame_table(spark, sf_dir), [pixels.hflip, pixels.invert]).select("vec_id", F.hex("pixels").alias("pixels"))


@query()
def pix13_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [pixels.blend(pixels.bilateral, 0.8), pixels.gaussian, pixels.median, pixels.bilinear(16, 12)]
    return pixels.filtered(frame_table(spark, sf_dir), chain).select("vec_id", "width", "height", F.sha2("pixels", 256).alias("sha256"))
