"""Suppression on a grid against the fold, and measures in parts against whole ones."""

import random

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelframe.operators import hooks, selection


def random_boxes(seed, frames=4, n=120):
    rng, out = random.Random(seed), []
    for f in range(frames):
        for _ in range(n):
            size = rng.choice([1, 3, 10, 40])
            x, y = rng.choice([rng.uniform(-60, 60), rng.randint(-3, 3) * 10.0]), rng.uniform(-60, 60)
            out.append((f if f else None, rng.choice(["cat", "dog", None]), rng.choice([0.5, 0.9, rng.random()]), x, y, x + size * rng.uniform(0.7, 1.3), y + size))
    out += [(1, "cat", 0.9, 0.0, 0.0, 10.0, 10.0)] * 3 + [(1, "cat", 0.8, 0.0, 0.0, 10.0, 10.0), (1, "cat", 0.7, 5.0, 5.0, 5.0, 9.0), (2, "dog", 0.2, 3.0, 3.0, 2.0, 9.0)]
    return out


@pytest.mark.parametrize(("overlap", "most"), [(0.3, None), (0.05, 20), (0.0, None), (0.7, 5)])
def test_suppression_on_a_grid_is_the_fold(spark, overlap, most):
    df = spark.createDataFrame(random_boxes(int(overlap * 100)), "f int, l string, s double, x0 double, y0 double, x1 double, y1 double")
    fold = rows(selection.suppressed(df, "f", "l", "s", overlap, most, folded=10**9))
    assert rows(selection.suppressed(df, "f", "l", "s", overlap, most, folded=0)) == fold
    assert rows(selection.suppressed(df, "f", "l", "s", overlap, most, folded=121)) == fold  # some frames each way
    assert rows(selection.suppressed(df.limit(0), "f", "l", "s", overlap, most)) == []


def test_a_frame_of_very_many_boxes(spark):
    """200,000 boxes of one frame, in clusters: each cluster keeps its best."""
    made = spark.range(200_000).select(
        F.lit(1).alias("f"), F.lit("a").alias("l"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("s"), ((F.col("id") % 40_000) * 20.0).alias("x0"), F.lit(0.0).alias("y0"),
    ).withColumn("x1", F.col("x0") + 10 + F.col("s")).withColumn("y1", F.lit(10.0))
    out = selection.suppressed(made, "f", "l", "s", 0.5)
    assert out.count() == 40_000
    best = made.groupBy("x0").agg(F.max("s").alias("s"))
    assert out.join(best, ["x0", "s"], "left_anti").isEmpty()


def test_measures_in_parts_are_whole_ones(spark):
    def total(state, batch, delta):
        values = batch.column(1).to_pylist()
        if delta == 9:
            raise ValueError("no such setting")
        return state[0] + len(values), state[1] + sum(v // 2**delta for v in values)

    def finished(state, delta):
        if delta == 2 and state[0] % 2:
            raise ValueError("odd")
        return {"bytes": state[1], "n": state[0]}

    rng = random.Random(5)
    made = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.randint(0, 999), rng.random()) for _ in range(5000)]
    df = spark.createDataFrame(made, "t string, v long, extra double")
    measure = hooks.Measure(lambda: (0, 0), total, lambda a, b: (a[0] + b[0], a[1] + b[1]), finished)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = rows(hooks.per_title(df.repartition(7), "t", [0, 2, 9], measure, "bytes double, n double"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for t in {x[0] for x in made}:
        values = [v for x, v, _ in made if x == t]
        want += [(t, d, float(sum(v // 2**d for v in values)), float(len(values))) for d in (0, 2) if d == 0 or len(values) % 2 == 0]
    assert got == sorted(want, key=repr)
    assert hooks.per_title(df.limit(0), "t", [0], measure, "bytes double, n double").collect() == []


def test_a_merge_that_fails_costs_its_candidate_alone(spark):
    def merge(a, b):
        raise RuntimeError("cannot merge")

    measure = hooks.Measure(lambda: 0, lambda s, b, d: s + b.num_rows, merge, lambda s, d: {"n": s})
    one = spark.createDataFrame(pa.table({"t": ["a"], "v": [1]}).to_pandas()).union(spark.createDataFrame(pa.table({"t": ["b"] * 4, "v": [1] * 4}).to_pandas()).repartition(4))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert rows(hooks.per_title(one, "t", [1], measure, "n double")) == [("a", 1, 1.0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")



def counted_parts():
    """A measure that counts its rows, and the states they were in."""

    def update(state, batch, delta):
        if delta == 2 and batch.column(0)[0].as_py() == 3.0:
            raise ValueError("no such setting")
        return state[0], state[1] + batch.num_rows

    return hooks.Measure(lambda: (1, 0), update, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s, _: {"parts": s[0], "n": s[1]})


def test_titles_that_lie_apart_are_few_states(spark):
    """A title's rows come together before they are measured, however they lie in the table: not a state for each title in each batch."""
    title = F.when(F.col("id") % 7 == 5, F.lit("NaN").cast("double")).when(F.col("id") % 7 != 6, (F.col("id") % 7).cast("double"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = hooks.per_title(spark.range(0, 70_000, 1, 3).select(title.alias("t"), "id"), "t", [0, 2], counted_parts(), "parts double, n double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r.t), r.delta, r.n) for r in got) == sorted((t, d, 10_000.0) for t in ("0.0", "1.0", "2.0", "3.0", "4.0", "nan", "None") for d in (0, 2) if (t, d) != ("3.0", 2))
    assert max(r.parts for r in got) <= 12  # 70 batches have rows of each title as they lie


def test_a_long_title_is_several_tasks(spark):
    """A title with most of the rows is split, and its parts are merged."""

    def update(state, batch, delta):
        from pyspark import TaskContext

        return state[0] | {TaskContext.get().partitionId()}, state[1] + batch.num_rows

    measure = hooks.Measure(lambda: (frozenset(), 0), update, lambda a, b: (a[0] | b[0], a[1] + b[1]), lambda s, _: {"tasks": len(s[0]), "n": s[1]})
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        made = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 50 == 0, F.col("id") / 50.0).otherwise(-1.0).alias("t"), F.rand(1).alias("x"))
        got = {r.t: r for r in hooks.per_title(made, "t", [0], measure, "tasks double, n double").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(got) == 4001 and got[7.0].n == 1
    assert got[-1.0].n == 196_000 and got[-1.0].tasks > 1
