"""Scans that split a key, and overlaps by nested bins, against plain loops and the unsplit form."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelframe.operators import frames, joins, layout, passes, segments


def one_stream(spark, n=3000, seed=1):
    """A hot stream with most rows, some small ones, a null stream; times with jumps, wraps and nulls."""
    rng, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += rng.choice([1, 2, 3, 40, -5, 200])
        out.append((rng.choice(["hot"] * 20 + ["a", "b", None]), i, t % 256 if rng.random() < 0.95 else None, t, rng.randint(1, 9), rng.random() < 0.02, rng.choice("xxxy")))
    return spark.createDataFrame(out, "s string, n long, m long, t long, d long, flag boolean, v string")


@pytest.mark.parametrize("rows_each", [100, 10**9])
def test_scans_equal_plain_sums_and_values(spark, rows_each):
    df = one_stream(spark)
    made = sorted(df.collect(), key=lambda r: r["n"])
    scan = passes.Scan(df.repartition(7), "s", ["n"], rows=rows_each)
    assert scan.split == (rows_each == 100) and (not scan.split or scan.df.select("_part").distinct().count() > 20)
    got = {r["n"]: r for r in scan.take(total=("sum", F.col("d")), was=("last", F.col("m")), following=("next", F.col("m"))).done().collect()}
    assert len(got) == len(made)
    for s in {r["s"] for r in made}:
        mine = [r for r in made if r["s"] == s]
        total, was = 0, None
        for i, r in enumerate(mine):
            following = next((x["m"] for x in mine[i + 1 :] if x["m"] is not None), None)
            assert (got[r["n"]]["total"], got[r["n"]]["was"], got[r["n"]]["following"]) == (total, was, following)
            total, was = total + r["d"], was if r["m"] is None else r["m"]


def test_operators_are_the_same_however_streams_are_split(spark, monkeypatch):
    df = one_stream(spark, 1500, 2)
    times = df.where("m is not null").dropDuplicates(["s", "t"])
    points, targets = times.where("n % 7 = 0").select("s", F.col("t").alias("p")), times.where("n % 5 = 0").select("s", F.col("t").alias("q"))
    calls = {
        "win01": lambda: segments.composition_offsets(times, "s", "n", "t", "d"),
        "win03": lambda: segments.unwrapped(times, "s", "n", "m", bits=8),
        "win04": lambda: segments.time_base_breaks(df, "s", "n", "m", 50, flag="flag", bits=8),
        "win05": lambda: segments.without_overlap(times, "s", "t", "d", "n"),
        "aud09": lambda: segments.trimmed_audio(df, "s", "n", "d", 500, 3000),
        "boundary": lambda: segments.nearest_boundary(df.where("s is not null").withColumn("w", F.lit(1234)), "s", "n", "d", "w"),
        "smp04": lambda: frames.repeated(df, "s", "n", "d"),
        "smp05": lambda: frames.repeated_under_cap(df, "s", "n", "d", 0.3),
        "numbered": lambda: frames.numbered(df, "s", ["n"]),
        "jon03": lambda: joins.prerolled(df.withColumn("e", F.col("n") + F.col("d")), "s", "n", "n", "e", (700, 800), 3, 20),
        "jon04": lambda: joins.nearest(points, targets, "s", "p", "q"),
        "jon05": lambda: joins.as_of(points, targets, "s", "p", "q", 3),
        "snk02": lambda: layout.interleaved(times, "s", "t", "n", "d", 32),
        "snk04": lambda: layout.run_lengths(df, "s", "n", "v"),
    }
    whole = {name: rows(call()) for name, call in calls.items()}
    monkeypatch.setattr(passes, "ROWS", 100)
    for name, call in calls.items():
        assert rows(call()) == whole[name] and whole[name], name


def test_one_stream_runs_in_many_tasks(spark):
    df = spark.range(40_000).select(F.lit("s").alias("s"), "id").repartition(4)
    out = passes.Scan(df, "s", ["id"], rows=5000).take(n=("sum", F.lit(1))).done()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 40_000 and out.where("n <> id").isEmpty()


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(3)

    def made(n, most):
        out = []
        for i in range(n):
            start = rng.randint(-most // 2, most)
            out.append((rng.choice("ab"), i, start, start + rng.choice([0, -3, 1, 2, 40, 1000, 10**6, 10**9])))
        return out

    cues, parts = made(250, 10**9), made(250, 10**9)
    cues += [("a", 900, -(1 << 60), 1 << 60), ("a", 901, -1, 1), ("a", 902, 0, 1), ("b", 903, 1 << 60, (1 << 60) + 1)]
    parts += [("a", 900, -1, 1), ("a", 901, -5, 0), ("b", 902, (1 << 60) - 1, (1 << 60) + 1), ("a", 903, 7, 7)]
    parts += [("a", 1000 + i, x, x + 1) for i, x in enumerate([0, 1, -1, 5, 10**9])]
    left, right = spark.createDataFrame(cues, "s string, c long, x long, y long"), spark.createDataFrame(parts, "s string, p long, f long, t long")
    got = rows(joins.overlapping(left, right, "s", ("x", "y"), ("f", "t")), "c", "p")
    want = sorted(((c, p) for s, c, x, y in cues for r, p, f, t in parts if s == r and x < y and f < t and x < t and f < y), key=repr)
    assert got == want and len(want) > 500
    assert rows(joins.overlapping(left.limit(0), right, "s", ("x", "y"), ("f", "t"))) == []


def test_a_long_cue_is_one_row_in_its_bin(spark):
    long = spark.createDataFrame([("a", 1, 0, 10**12)], "s string, c long, x long, y long")
    short = spark.range(1000).select(F.lit("a").alias("s"), (F.col("id") * 10**6).alias("f"), (F.col("id") * 10**6 + 5).alias("t"))
    out = joins.overlapping(long, short, "s", ("x", "y"), ("f", "t"))
    assert out.count() == 1000
    assert "sequence" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_dealt_by_key_are_not_dealt_again(spark):
    """Runs of one table of packets: one shuffle for places, values before, sums and groups, where no stream is split."""
    from reelframe.queries import QUERIES

    plan = QUERIES["snk04_run_lengths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
