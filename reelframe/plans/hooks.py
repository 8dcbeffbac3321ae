"""Hooks, sweeps and detectors on ``documents``, ``lineitem`` and ``embeddings``; audio layouts, joins and back-end quantisers."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, picture, text
from ..operators import hooks, segments
from .base import query, table
from .frames import planes
from .timelines import packets


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each source; its documents are what it reaches, at a stage by their id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    stage = F.element_at(F.array(*map(F.lit, ("probe", "decoded-frame", "artifact", "completed"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(F.col("source").alias("job"), stage.alias("stage"), F.col("doc_id").alias("item"), "n_chars", "quality", "toxic")


def judged_toxic(event: dict[str, Any]) -> tuple[str | None, dict[str, str]]:
    if event["n_chars"] % 3 == 0:
        raise ValueError("cannot tell")
    return ("toxic" if event["toxic"] else None), {"chars": str(event["n_chars"])}


def hook_set() -> hooks.Hooks:
    long = hooks.Hook("length", ["probe", "decoded-frame"], hooks.answer(F.when(F.col("n_chars") > 12_000, "too long"), {"chars": F.col("n_chars")}))
    poor = hooks.Hook("quality", ["decoded-frame", "artifact"], hooks.answer(F.when((F.col("quality") == 0) & (F.col("item") % 5 == 0), "poor")), background=True)
    return hooks.Hooks().with_hook(long).with_hook(poor).with_hook(hooks.Hook("toxic", ["artifact", "completed"], judged_toxic, fail_closed=True))


@query("""WITH e AS (SELECT source AS job, doc_id % 4 AS s, ['probe', 'decoded-frame', 'artifact', 'completed'][CAST(doc_id % 4 + 1 AS INTEGER)] AS stage, doc_id AS item, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)),
x AS (SELECT job, stage, s, item, 0 AS n, 'length' AS hook, CASE WHEN n_chars > 12000 THEN 'too long' END AS reason, CAST(NULL AS VARCHAR) AS error FROM e WHERE s IN (0, 1)
UNION ALL SELECT job, stage, s, item, 1, 'quality', CASE WHEN quality = 0 AND item % 5 = 0 THEN 'poor' END, NULL FROM e WHERE s IN (1, 2)
UNION ALL SELECT job, stage, s, item, 2, 'toxic', CASE WHEN n_chars % 3 = 0 THEN 'toxic failed: ValueError: cannot tell' WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars % 3 = 0 THEN 'ValueError: cannot tell' END FROM e WHERE s IN (2, 3)),
o AS (SELECT *, (s * 1000000000 + item) * 10 + n AS place FROM x), f AS (SELECT job, min(place) AS stop FROM o WHERE reason IS NOT NULL AND n <> 1 GROUP BY 1),
b AS (SELECT o.job, min(s) AS last FROM o LEFT JOIN f USING (job) WHERE reason IS NOT NULL AND n = 1 AND (stop IS NULL OR place <= stop) GROUP BY 1)
SELECT job, stage, item, hook, CASE WHEN reason IS NULL THEN 'continue' ELSE 'reject' END AS verdict, reason, error FROM o LEFT JOIN f USING (job) LEFT JOIN b USING (job) WHERE (stop IS NULL OR place <= stop) AND (last IS NULL OR s <= last)""")
def udf01_hook_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.records(events(spark, sf_dir), hook_set()).select("job", "stage", "item", "hook", "verdict", "reason", "error")


def later_set() -> hooks.Hooks:
    """Hooks of a second configuration: one of a name that ``hook_set`` has too, and an optional one of its own."""
    short = hooks.Hook("length", ["decoded-frame", "artifact"], hooks.answer(F.when(F.col("n_chars") < 600, "too short")))
    return hooks.Hooks().with_hook(hooks.Hook("late", ["completed"], hooks.answer(None, {"chars": F.col("n_chars")}))).with_hook(short)


@query("""WITH e AS (SELECT source AS job, doc_id % 4 AS s, ['probe', 'decoded-frame', 'artifact', 'completed'][CAST(doc_id % 4 + 1 AS INTEGER)] AS stage, doc_id AS item, n_chars, quality FROM documents JOIN labels USING (doc_id)),
x AS (SELECT job, stage, s, item, 0 AS n, 'quality' AS hook, CASE WHEN quality = 0 AND item % 5 = 0 THEN 'poor' END AS reason FROM e WHERE s IN (1, 2)
UNION ALL SELECT job, stage, s, item, 1, 'late', NULL FROM e WHERE s = 3
UNION ALL SELECT job, stage, s, item, 2, 'length', CASE WHEN n_chars < 600 THEN 'too short' END FROM e WHERE s IN (1, 2)),
o AS (SELECT *, (s * 1000000000 + item) * 10 + n AS place FROM x), f AS (SELECT job, min(place) AS stop FROM o WHERE reason IS NOT NULL AND n <> 0 GROUP BY 1),
b AS (SELECT o.job, min(s) AS last FROM o LEFT JOIN f USING (job) WHERE reason IS NOT NULL AND n = 0 AND (stop IS NULL OR place <= stop) GROUP BY 1)
SELECT job, stage, item, hook, CASE WHEN hook = 'quality' THEN 'background' ELSE 'blocking' END AS mode, CASE WHEN reason IS NULL THEN 'continue' ELSE 'reject' END AS verdict, reason FROM o LEFT JOIN f USING (job) LEFT JOIN b USING (job) WHERE (stop IS NULL OR place <= stop) AND (last IS NULL OR s <= last)""")
def set07_cascaded_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set over another: a hook of both is the later one's, and runs last; without the optional one that was not asked for."""
    first = hooks.Hooks(tuple(replace(h, required=False) for h in hook_set().hooks))
    cascade = first.merged(later_set()).select(["length", "quality", "late"])
    return hooks.records(events(spark, sf_dir), cascade).select("job", "stage", "item", "hook", "mode", "verdict", "reason")


def _floor_sum(state: tuple[int, float], rows: pa.RecordBatch, delta: int) -> tuple[int, float]:
    prices = rows.column(1).to_numpy()
    return state[0] + len(prices), state[1] + float((prices // 2**delta).sum())


def _finished(state: tuple[int, float], delta: int) -> dict[str, float]:
    if delta == 3 and state[0] % 2:
        raise ValueError("no such setting")
    return {"bytes": state[1], "ssim": 1 - delta / 100}


MEASURED = hooks.Measure(lambda: (0, 0.0), _floor_sum, lambda a, b: (a[0] + b[0], a[1] + b[1]), _finished)


@query("""WITH t AS (SELECT l_suppkey AS title, delta, count(*) AS n, sum(floor(l_extendedprice / pow(2, delta))) AS bytes FROM lineitem, range(0, 4) x(delta) GROUP BY 1, 2)
SELECT title, CAST(delta AS INTEGER) AS delta, CAST(bytes AS DOUBLE) AS bytes, 1 - delta / CAST(100 AS DOUBLE) AS ssim FROM t WHERE NOT (delta = 3 AND n % 2 = 1)""")
def udf07_per_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("title"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    return hooks.per_title(rows, "title", [0, 1, 2, 3], MEASURED, "bytes double, ssim double")


def bright_quarters(y: list[float]) -> list[tuple[str, float, float, float, float, float]]:
    """A box for each quarter of an 8x8 plane that is brighter than 140 on average."""
    out = []
    for top in (0, 4):
        for left in (0, 4):
            mean = sum(y[8 * (top + r) + left + c] for r in range(4) for c in range(4)) / 16
            if mean > 140:
                out.append(("bright", mean, float(left), float(top), left + 4.0, top + 4.0))
    return out


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: least(255.0, greatest(0.0, 128 + 255 * CAST(x AS DOUBLE)))) AS y FROM embeddings),
q AS (SELECT vec_id, t, l, list_avg(list_transform(range(0, 16), lambda i: y[CAST(8 * (t + i // 4) + l + i % 4 + 1 AS INTEGER)])) AS mean FROM p, (VALUES (0), (4)) a(t), (VALUES (0), (4)) b(l))
SELECT vec_id, 'bright' AS label, round(mean, 6) AS score, CAST(l AS DOUBLE) AS x0, CAST(t AS DOUBLE) AS y0, l + CAST(4 AS DOUBLE) AS x1, t + CAST(4 AS DOUBLE) AS y1 FROM q WHERE mean > 140""")
def udf08_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hooks.detected(planes(spark, sf_dir), ["vec_id"], ["y"], bright_quarters)
    return found.withColumn("score", F.round("score", 6))


_NAMES = [*audio.LAYOUTS]
_CODECS = [*audio.CARRIED, "mp3", "he_aac_v2"]


@query(f"""WITH l(i, name, sp) AS (VALUES {', '.join(f"({i}, '{n}', {list(audio.LAYOUTS[n])})" for i, n in enumerate(_NAMES))}),
c(codec, ord, name) AS (VALUES {', '.join(f"('{c}', {i}, '{n}')" for c, names in audio.CARRIED.items() for i, n in enumerate(names))}),
t(a, b) AS (VALUES ('BL', 'SL'), ('BR', 'SR'), ('SL', 'BL'), ('SR', 'BR')),
u AS (SELECT s.name AS source, c.codec, c.ord, c.name AS target, d.sp AS td, s.sp AS ts, unnest(s.sp) AS x FROM l s, c JOIN l d ON d.name = c.name WHERE len(d.sp) >= len(s.sp)),
f AS (SELECT source, codec, ord, target, bool_and(list_contains(td, x) OR coalesce((SELECT list_contains(td, b) AND NOT list_contains(ts, b) FROM t WHERE a = x), false) OR (x = 'BC' AND (list_has_all(td, ['BL', 'BR']) OR list_has_all(td, ['SL', 'SR'])))) AS ok FROM u GROUP BY 1, 2, 3, 4),
m AS (SELECT source, codec, arg_min(target, ord) AS layout FROM f WHERE ok GROUP BY 1, 2),
p AS (SELECT p_partkey, {_CODECS}[CAST(p_partkey % {len(_CODECS)} + 1 AS INTEGER)] AS codec, {_NAMES}[CAST(p_size % {len(_NAMES)} + 1 AS INTEGER)] AS source FROM part)
SELECT p_partkey, CASE WHEN codec = 'mp3' THEN CASE WHEN source = 'mono' THEN 'mono' ELSE 'stereo' END WHEN codec = 'he_aac_v2' THEN 'stereo' WHEN codec IN ('ac3', 'eac3', 'dts') THEN coalesce(layout, '5.1(side)') ELSE layout END AS layout FROM p LEFT JOIN m USING (codec, source)""")
def aud02_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", audio.carried(pick(_CODECS, F.col("p_partkey")), pick(_NAMES, F.col("p_size"))).alias("layout"))


_P = "p AS (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS arrival, CAST(l_quantity AS BIGINT) AS duration FROM lineitem), e AS (SELECT *, CAST(sum(duration) OVER (PARTITION BY s ORDER BY arrival) AS BIGINT) AS upto FROM p)"


@query(f"WITH {_P}, k AS (SELECT *, upto - duration AS a FROM e WHERE upto - duration >= 40 AND upto - duration < 120) SELECT s, arrival, a - min(a) OVER (PARTITION BY s) AS at FROM k")
def aud09_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.trimmed_audio(packets(spark, sf_dir), "s", "arrival", "duration", 40, 120).select("s", "arrival", "at")


@query(f"""WITH {_P}, w AS (SELECT s, arrival AS n, upto AS t FROM e UNION ALL SELECT DISTINCT s, 0, 0 FROM e), one AS (SELECT s, arg_min(n, abs(t - 100) * 1000 + n) AS n, arg_min(t, abs(t - 100) * 1000 + n) AS t FROM w GROUP BY 1),
two AS (SELECT w.s, arg_min(w.n, abs(w.t - greatest(30 + one.t - 100, 0)) * 1000 + w.n) AS n FROM w JOIN one USING (s) GROUP BY 1)
SELECT e.s, arrival, 0 AS piece FROM e JOIN one USING (s) WHERE arrival <= n UNION ALL SELECT e.s, arrival, 1 FROM e JOIN two USING (s) WHERE arrival > n""")
def aud09_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("s", "arrival", "duration")
    return segments.joined_audio(p.withColumn("end", F.lit(100)), p.withColumn("skip", F.lit(30)), "s", "arrival", "duration", "end", "skip").select("s", "arrival", "piece")


_TARGETS = ("visually_lossless", "high", "standard", "low")


@query(f"""WITH a(b, h, qh, l, ql) AS (VALUES {', '.join(f"('{b}', {x[0]}, {x[1]}, {y[0]}, {y[1]})" for b, anchors in picture.BACKEND_ANCHORS.items() for x, y in zip(anchors[:-1], anchors[1:], strict=True))}),
n(b, name, q) AS (VALUES {', '.join(f"('{b}', '{k}', {v})" for b, names in picture.BACKEND_TARGETS.items() for k, v in names.items())}),
p AS (SELECT p_partkey, {list(_TARGETS)}[CAST(p_partkey % 4 + 1 AS INTEGER)] AS name, CASE WHEN p_partkey % 3 = 0 THEN 52 + p_size END AS v FROM part),
s AS (SELECT p_partkey, a.b, min(qh + CAST(trunc(CAST((ql - qh) * (h - v) AS DOUBLE) / (h - l)) AS INTEGER)) AS q FROM p JOIN a ON v <= h AND v >= l GROUP BY 1, 2),
low AS (SELECT b, ql FROM a WHERE l = 70), high AS (SELECT b, qh FROM a WHERE h = 100),
q AS (SELECT p.p_partkey, n.b, CASE WHEN v IS NULL THEN n.q WHEN v >= 100 THEN qh WHEN v <= 70 THEN ql ELSE s.q END AS q FROM p JOIN n USING (name) JOIN low USING (b) JOIN high USING (b) LEFT JOIN s ON s.p_partkey = p.p_partkey AND s.b = n.b),
h AS (SELECT p_partkey, least(greatest(q + p_partkey % 9 - 4, 0), 51) AS qp FROM q WHERE b = 'h26x')
SELECT p_partkey, max(q) FILTER (b = 'libaom') AS libaom, max(q) FILTER (b = 'nvenc') AS nvenc, max(q) FILTER (b = 'amf') AS amf, max(q) FILTER (b = 'amf_quality') AS amf_quality, max(q) FILTER (b = 'qsv') AS qsv, max(q) FILTER (b = 'h26x') AS h26x,
CAST(max(least(qp * 2, 127)) AS INTEGER) AS vp8, CAST(max(least(greatest(round(qp * CAST(3.8 AS DOUBLE)), 1), 255)) AS INTEGER) AS vp9, CAST(max(least(greatest(round(0.625 * pow(2, qp / CAST(6 AS DOUBLE)) / 2.6), 1), 31)) AS INTEGER) AS mpeg2 FROM q JOIN h USING (p_partkey) GROUP BY 1""")
def mth10_backend_quantisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _TARGETS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    score = F.when(F.col("p_partkey") % 3 == 0, 52 + F.col("p_size"))
    software = [picture.software_quantiser(F.lit(c), name, score, F.col("p_partkey") % 9 - 4).alias(c) for c in ("vp8", "vp9", "mpeg2")]
    return table(spark, sf_dir, "part").select("p_partkey", *(picture.backend_quantiser(b, name, score).alias(b) for b in picture.BACKEND_TARGETS), *software)


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(chr(255) || 'Lavc' || doc_id || '.2.' || lang || 'LAME3.100UUU' || CASE WHEN doc_id % 2 = 0 THEN 'LAME LAME iTunes' ELSE 'Lavf12345678901234567890' END, '(Lavc|Lavf|LAME|iTunes)[0-9.]{0,16}'))), ',') AS idents FROM documents")
def txt16_encoder_idents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 2 == 0, "LAME LAME iTunes").otherwise("Lavf12345678901234567890")
    content = F.concat(F.unhex(F.lit("FF")), F.encode(F.concat(F.lit("Lavc"), F.col("doc_id").cast("string"), F.lit(".2."), F.col("lang"), F.lit("LAME3.100UUU"), tail), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.encoder_idents(content)), ",").alias("idents"))
