"""Operators against plain loops, on hot keys and on the cases that the rules are about."""

import collections
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelframe.functions import picture, timebase
from reelframe.kernels import pixels
from reelframe.operators import frames, hooks, joins, passes, segments, selection


def test_cuts_of_a_long_stream(spark):
    """One stream of 200,000 packets beside short ones, against the greedy walk."""
    rng = np.random.default_rng(1)
    n = 200_000
    lasts, keys = rng.integers(0, 9, n), rng.random(n) < 0.1
    keys[0] = True
    df = spark.range(n).select(F.lit("hot").alias("s"), F.col("id").alias("k"))
    made = spark.createDataFrame([("hot", i, int(d), bool(x)) for i, (d, x) in enumerate(zip(lasts, keys, strict=True))] + [("none", 0, 5, False), ("none", 1, 50, True), ("none", 2, 50, None)], "s string, k long, d long, key boolean")
    want, since, at, number = [], 0, 0, 0
    for d, x in zip(lasts.tolist(), keys.tolist(), strict=True):
        if x and at - since >= 100:
            since, number = at, number + 1
        want.append(number)
        at += d
    got = segments.cut_on_keyframes(made, "s", "k", "d", "key", 100).where("s = 'hot'").orderBy("k").select("segment").toPandas()["segment"].tolist()
    assert got == want and df.count() == n
    assert {r.segment for r in segments.cut_on_keyframes(made, "s", "k", "d", "key", 100).where("s = 'none'").collect()} == {0}  # begins without a keyframe
    assert segments.cut_by_length(made.where("s = 'none'"), "s", "k", "d", 50).orderBy("k").select("segment").collect() == [(0,), (0,), (1,)]
    with pytest.raises(ValueError):
        segments.cut_by_length(made, "s", "k", "d", 0)


def test_rates_and_ranks_of_one_hot_key(spark):
    made = spark.range(60_000).select(F.lit("hot").alias("s"), (F.col("id") * 3003 + F.when(F.col("id") % 7 == 0, 5).otherwise(0)).alias("pts"))
    made = made.union(made.limit(100)).union(spark.createDataFrame([("one", 5), ("x", None)], "s string, pts long"))
    pts = np.unique([r.pts for r in made.where("s = 'hot'").collect()])
    d = np.sort(np.diff(pts))
    for width in (None, 10_000):
        assert rows(frames.estimated_fps(made, "s", "pts", width=width)) == [("hot", 90_000 / d[len(d) // 2])]
    ranked = passes.ranked(spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 1000).alias("at")), "k", "at", "place", 64).collect()
    for k in (0, 1):
        own = sorted((r["at"], r.place) for r in ranked if r.k == k)
        assert [p for _, p in own] == list(range(1, 501))


def test_hamming_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = [int(v) for v in base]
    for v in base.tolist():  # near ones, at all distances around the bound
        for n in (1, 4, 9, 10, 11, 12):
            values.append(v ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)))
    values += values[:5]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)] + [(999, None), (None, 5)], "k long, h long")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = sorted((min(i, j), max(i, j), (v ^ w).bit_count()) for v, i in first.items() for w, j in first.items() if i < j and (v ^ w).bit_count() <= 11)
    for parts, block in ((4, 2048), (5, 3), (8, 16)):
        joins.BLOCK, kept = block, joins.BLOCK
        try:
            pairs = joins.hamming_pairs(df, "k", "h", 11, parts)
            assert rows(pairs, "a", "b", "distance") == sorted(want, key=repr)
        finally:
            joins.BLOCK = kept
    links = collections.Counter()
    for i, v in enumerate(values):
        links[i] = sum((v ^ w).bit_count() <= 11 for j, w in enumerate(values) if j != i)
    got = {r.k: (r.class_id, r.links) for r in joins.hamming_members(df, "k", "h", joins.hamming_pairs(df, "k", "h", 11)).collect()}
    assert all(got[i] == (first[v], links[i]) for i, v in enumerate(values)) and got[999] == (None, 0)


def test_preroll_counts_from_the_edit(spark):
    made = spark.createDataFrame([("t", i, 40 * i, 40 * i + 40) for i in range(8)], "t string, n int, a int, e int")
    keep = lambda edit, packets, ticks: [r.n for r in joins.prerolled(made, "t", "n", "a", "e", edit, packets, ticks).orderBy("n").collect()]
    assert keep((150, 200), 0, 30) == [3, 4]  # the packet of the edit begins 30 ticks before it
    assert keep((150, 200), 0, 31) == [2, 3, 4] and keep((150, 200), 1, 0) == [2, 3, 4] and keep((160, 200), 0, 1) == [3, 4] and keep((9, 9), 3, 99) == []


def test_alignment_with_the_base(spark):
    made = [("a", n, 4.0) for n in range(3)] + [("b", n, 4.0 + 0.0004 * (n == 1)) for n in range(3)] + [("c", n, 4.0 + 0.01 * (n == 2)) for n in range(3)]
    df = spark.createDataFrame(made, "r string, n int, q double")
    got = segments.alignment(df, "r", "n", "q").orderBy("boundary").collect()
    assert [r.aligned for r in got] == [True, True, False]
    fewer = segments.alignment(df.where("not (r = 'b' and n = 2)"), "r", "n", "q").collect()
    assert not any(r.aligned for r in fewer)


def test_boxes_of_a_frame_are_capped_over_all_labels(spark):
    made = [(1, "x", 0.9 - i / 10, 20.0 * i, 0.0, 20.0 * i + 10, 10.0) for i in range(3)] + [(1, "y", 0.85 - i / 10, 20.0 * i, 0.0, 20.0 * i + 10, 10.0) for i in range(3)] + [(1, "x", 0.5, 1.0, 0.0, 11.0, 10.0)]
    df = spark.createDataFrame(made, "f int, label string, score double, x0 double, y0 double, x1 double, y1 double")
    assert [round(r.score, 2) for r in selection.suppressed(df, "f", "label", "score", 0.4, 3).orderBy(F.desc("score")).collect()] == [0.9, 0.85, 0.8]
    assert selection.suppressed(df, "f", "label", "score", 0.4, 99).count() == 6  # the last one overlaps the first of its label


def test_rules_keep_equal_rungs_and_hold_the_sum(spark):
    rungs = spark.createDataFrame([(0, 720), (0, 720), (1, 480), (2, None)], "position int, short_side int")
    rules = spark.createDataFrame([(1, "any", 0, 30_000, "a"), (2, "any", 0, 30_000, None), (3, "top", 0, -10, "b"), (4, "short_le", 500, 1, "c"), (5, "odd", 0, 5, "d")], "ord int, selector string, value int, quality_delta int, codec string")
    got = rows(joins.with_rules(rungs, rules, ["codec"]), "position", "quality_delta", "codec")
    assert got == [(0, 32757, "b"), (0, 32757, "b"), (1, 32767, "c"), (2, 32767, "a")]


def test_a_policy_of_many_lines_folds_in_order(spark):
    import random

    rng = random.Random(6)
    lines = [(i, rng.choice(["any", "top", "below_top", "step", "short_le", "short_ge", "odd"]), rng.randint(0, 40), rng.choice([0, 900, -700, 30_000, -30_000]), rng.choice([None, "a", "b", "c"])) for i in range(700)]
    made = [(p, s) for p in (0, 1, 7) for s in (5, 20, 39, None)]
    want = []
    for place, side in made:
        total, codec = 0, None
        for _, selector, value, delta, name in lines:
            on = {"any": True, "top": place == 0, "below_top": place > 0, "step": place == value, "short_le": side is not None and side <= value, "short_ge": side is not None and side >= value}
            if on.get(selector):
                total, codec = max(-32768, min(32767, total + delta)), name or codec
        want.append((place, side, total, codec))
    rules = spark.createDataFrame(lines, "ord int, selector string, value int, quality_delta int, codec string").repartition(3)
    got = rows(joins.with_rules(spark.createDataFrame(made, "position int, short_side int"), rules, ["codec"]))
    assert got == sorted(want, key=repr)


def test_time_base_breaks(spark):
    full = 1 << 33
    clock = [full - 10, 5, 20, None, 30, 10, None, 12, 13]
    flags = [True, None, False, None, True, False, True, True, False]
    df = spark.createDataFrame([("s", i, t, f) for i, (t, f) in enumerate(zip(clock, flags, strict=True))], "s string, n int, t long, f boolean")
    got = segments.time_base_breaks(df, "s", "n", "t", 100, flag="f").orderBy("n").collect()
    # Wrapping is no break, nor is the first flag; row 4 is flagged, 5 runs back, 6 is flagged and leaves no value, so 7 breaks nothing.
    assert [r.broken for r in got] == [False, False, False, False, True, True, True, False, False]
    assert [r.segment for r in got] == [0, 0, 0, 0, 1, 2, 3, 3, 3]


def test_audio_after_a_break_goes_where_its_video_is_shown(spark):
    packets = spark.createDataFrame([("t", 0, 0, 0, 10), ("t", 1, 0, 10, 10), ("t", 2, 0, 40, 10), ("t", 3, 0, 44, 10), ("t", 4, 1, 1000, 10), ("t", 5, 1, 1010, 10)], "t string, n int, b int, s long, d long")
    pictures = spark.createDataFrame([("t", 0, 10 * i, i) for i in range(6)] + [("t", 1, 1000 + 10 * i, 8 + i) for i in range(3)], "t string, b int, pts long, frame long")
    got = segments.placed_audio(packets, "t", "n", "s", "d", pictures, 10, "b").orderBy("n").collect()
    # A hole of 20 before packet 2; packet 3 overlaps by more than half; after the break the video is shown at 80, and 50 are due.
    assert [(r.hole, r.dropped, r.lasts) for r in got] == [(0, False, 10), (0, False, 30), (20, False, 40), (0, True, 0), (30, False, 10), (0, False, 10)]
    plain = segments.placed_audio(packets.where("b = 0"), "t", "n", "s", "d").orderBy("n").collect()
    assert [(r.hole, r.dropped) for r in plain] == [(0, False), (0, False), (20, False), (0, True)]


def test_hook_sets():
    hook = lambda name, **more: hooks.Hook(name, ["probe"], a_judge(), **more)
    base = hooks.Hooks().with_hook(hook("a")).with_hook(hook("b", required=False)).with_hook(hook("c", background=True))
    assert [h.name for h in base.with_hook(hook("a", fail_closed=True)).hooks] == ["b", "c", "a"]
    both = base.merged(hooks.Hooks().with_hook(hook("b", background=True)).with_hook(hook("d", required=False)))
    assert [(h.name, h.background) for h in both.hooks] == [("a", False), ("c", True), ("b", True), ("d", False)]
    assert [h.name for h in base.select([]).hooks] == ["a", "c"] and [h.name for h in base.select(["b"]).hooks] == ["a", "b", "c"]
    assert [d["mode"] for d in base.described()] == ["blocking", "blocking", "background"]
    with pytest.raises(ValueError, match="cannot select .'zz'"):
        base.select(["zz"])
    with pytest.raises(ValueError, match="no such stages"):
        hooks.Hook("x", ["nowhere"], a_judge())


def a_judge():
    def judge(event):
        if event["item"] == 5:
            raise KeyError("five")
        return ("seven" if event["item"] == 7 else None), {"item": str(event["item"])}

    return judge


def test_records_end_where_a_job_ends(spark):
    df = spark.createDataFrame([("j", s, i) for s, i in (("probe", 0), ("decoded-frame", 5), ("decoded-frame", 7), ("decoded-frame", 8), ("completed", None), ("failed", None))] + [("k", "probe", 1), ("k", "completed", 0), ("k", "failed", 0)], "job string, stage string, item long")
    watch = hooks.Hook("watch", list(hooks.STAGES), hooks.answer(annotations={"stage": F.col("stage")}))
    told = lambda **more: {(r.job, r.stage, r["item"], r.hook) for r in hooks.records(df, hooks.Hooks().with_hook(hooks.Hook("py", ["decoded-frame"], a_judge(), **more)).with_hook(watch)).collect()}
    blocking = told()
    assert ("j", "decoded-frame", 7, "py") in blocking and ("j", "decoded-frame", 7, "watch") not in blocking and ("j", "completed", 0, "watch") not in blocking
    assert ("j", "failed", 0, "watch") in blocking and ("k", "failed", 0, "watch") not in blocking and ("k", "completed", 0, "watch") in blocking
    later = told(background=True)
    assert ("j", "decoded-frame", 8, "watch") in later and ("j", "completed", 0, "watch") not in later
    closed = hooks.records(df, hooks.Hooks().with_hook(hooks.Hook("py", ["decoded-frame"], a_judge(), fail_closed=True)).with_hook(watch))
    r = hooks.rejections(closed).first()
    assert (r.job, r["item"], r.reason) == ("j", 5, "py failed: KeyError: 'five'") and hooks.rejections(closed).count() == 1


def test_frames_built_before_either_runs(spark):
    """No batch size of the session is touched, so frames can be built and run in any order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    try:
        planes = spark.range(200).select("id", F.lit(2).alias("width"), F.lit(1).alias("height"), F.unhex(F.lit("0A14")).alias("pixels"))
        one, two = pixels.filtered(planes, [pixels.invert]), segments.cut_by_length(spark.range(50).select(F.lit(1).alias("s"), "id", F.lit(1).alias("d")), "s", "id", "d", 10)
        assert two.count() == 50 and {bytes(r.pixels) for r in one.collect()} == {b"\xf5\xeb"}
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_kernels_by_plain_numpy():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 256, (6, 9), dtype=np.uint8)
    assert np.array_equal(pixels.vflip(p), p[::-1]) and np.array_equal(pixels.hflip(p), p[:, ::-1])
    assert np.array_equal(pixels.invert(p), 255 - p)


def test_area_hashes_of_any_size(spark):
    rng = random.Random(3)
    made = []
    for i, (w, h) in enumerate([(8, 8), (9, 8), (17, 5), (3, 3), (64, 48)]):
        made.append((i, w, h, [rng.randrange(256) for _ in range(w * h)]))

    def shrunk(y, w, h, across, down):
        out = []
        for r in range(down):
            for c in range(across):
                total = area = 0.0
                for j in range(h):
                    for i in range(w):
                        share = max(0.0, min((c + 1) * w / across, i + 1) - max(c * w / across, i)) * max(0.0, min((r + 1) * h / down, j + 1) - max(r * h / down, j))
                        total, area = total + y[j * w + i] * share, area + share
                out.append(np.float32(total / area))
        return out

    got = {r.i: r for r in spark.createDataFrame(made, "i int, w int, h int, y array<int>").select("i", picture.average_hash("y", "w", "h").alias("a"), picture.difference_hash("y", "w", "h").alias("d"), picture.area_shrink("y", "w", "h", 9, 8).alias("c")).collect()}
    for i, w, h, y in made:
        cells, nine = shrunk(y, w, h, 8, 8), shrunk(y, w, h, 9, 8)
        assert np.allclose(got[i].c, nine, rtol=1e-5)
        mean = np.float32(sum(map(float, cells)) / 64)
        assert format(got[i].a % 2**64, "064b") == "".join("1" if c > mean else "0" for c in cells)
        assert format(got[i].d % 2**64, "064b") == "".join("1" if nine[r * 9 + c + 1] > nine[r * 9 + c] else "0" for r in range(8) for c in range(8))


def test_seconds_and_default_interval(spark):
    r = spark.range(1).select(timebase.seconds(F.lit(180_000), F.lit(90_000)).alias("a"), timebase.seconds(F.lit(5), F.lit(0)).alias("b"), timebase.keyframe_interval(F.lit(None).cast("double"), 25.0).alias("c"), timebase.keyframe_interval(F.lit(0.001), 25.0).alias("d")).first()
    assert tuple(r) == (2.0, None, 50, 1)
