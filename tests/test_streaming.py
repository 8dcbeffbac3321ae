"""The stream forms on files that arrive, against plain loops and the batch forms."""

import collections
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelframe.operators import segments
from reelframe.sources import live as source
from reelframe.sources import storage
from reelframe.streaming import live, playlists, sessions
from reelframe.streaming.rungs import Rungs


def run(writer):
    """All that is there now."""
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def placed(times, rate, gap, limit=None):
    """(slot, status, repeats) by the rules, one picture after the other."""
    start, written, out = times[0], 0, []
    for t in times:
        if limit is not None and written >= limit:
            out.append((written, "over", 0))
            continue
        units = (t - start) * rate / live.CLOCK
        slot = int(abs(units) + 0.5) * (1 if units >= 0 else -1)
        if abs(slot - written) > gap:
            start = t - written * live.CLOCK // rate
            out.append((written, "reanchor", 0))
            written += 1
        elif slot < written:
            out.append((slot, "drop", 0))
        elif limit is not None and slot >= limit:
            out.append((slot, "over", limit - written))
            written = limit
        else:
            out.append((slot, "write", slot - written))
            written = slot + 1
    return out


SECONDS = [0, 1, 2, 1000, 1001, 1002, 5, 6, 7, 7, 6, 9, 9.4, 9.6]


def arrivals(seconds):
    return [(i, int(t * live.CLOCK)) for i, t in enumerate(seconds)]


def test_timeline_moves_its_anchor(spark):
    df = spark.createDataFrame([("a", *x) for x in arrivals(SECONDS)] + [("b", 0, 5)], "source string, n long, t long")
    got = {}
    for r in live.timeline(df, "source", "n", "t", 1, 1, 10).orderBy("source", "n").collect():
        got.setdefault(r.source, []).append((r.slot, r.status, r.repeats))
    assert got["a"] == placed([t for _, t in arrivals(SECONDS)], 1, 10) and got["b"] == [(0, "write", 0)]
    assert [x[:2] for x in got["a"][3:9]] == [(3, "reanchor"), (4, "write"), (5, "write"), (6, "reanchor"), (7, "write"), (8, "write")]
    assert live.timeline(df.limit(0), "source", "n", "t", 1, 1, 10).count() == 0
    short = live.timeline(df, "source", "n", "t", 1, 1, 10, limit=5).where("source = 'a'").orderBy("n").collect()
    assert [(r.slot, r.status, r.repeats) for r in short] == placed([t for _, t in arrivals(SECONDS)], 1, 10, 5)


def test_sound_is_placed(spark):
    rng = random.Random(5)
    made = [("a", i, 100 * i + rng.choice([0, 0, 3, -3, 30, -30, 700]), rng.choice([90, 100, 110]), rng.choice(["s", "s", "s", "t"]) if i else "s") for i in range(300)]
    written, want = 0, []
    for _, _, at, n, shape in made:
        drift, silence, trim = at - written, 0, 0
        if shape == "t":
            want.append((0, 0, 0))
            continue
        if (not written and 0 < drift <= 200) or 4 < drift <= 200:
            silence = min(drift, 20_000 - written)
        elif drift < 0 and (not written or drift < -4):
            trim = min(-drift, n)
        kept = max(0, min(n - trim, 20_000 - written - silence))
        written += silence + kept
        want.append((silence, trim, kept))
    df = spark.createDataFrame(made, "source string, n long, at long, length long, shape string")
    got = live.audio_timeline(df.repartition(5), "source", "n", "at", "length", 4, 200, cap=20_000, shape="shape").orderBy("n").collect()
    assert [(r.silence, r.trim, r.kept) for r in got] == want and any(w[1] for w in want) and want[-1] == (0, 0, 0)


def test_sound_follows_the_pictures_anchor(spark):
    pictures = live.timeline(spark.createDataFrame([("a", 2 * i + 1, int(t * live.CLOCK)) for i, t in enumerate([5, 6, 500, 501])], "source string, n long, t long"), "source", "n", "t", 1, 1, 10)
    packets = spark.createDataFrame([("a", 0, 5 * live.CLOCK), ("a", 2, 5 * live.CLOCK + live.CLOCK // 2), ("a", 6, 501 * live.CLOCK)], "source string, n long, t long")
    got = live.sound_positions(packets, pictures, "source", "n", "t", 1000).orderBy("n").collect()
    assert [r["at"] for r in got] == [0, 500, 3000]


def test_shapes_and_repeats(spark):
    df = spark.createDataFrame([("a", 0, 64, 32, "x"), ("a", 1, 64, 32, "y"), ("a", 2, 32, 32, "y")], "source string, n long, w int, h int, kind string")
    got = live.shape_changes(df, "source", "n", "w", "h", "kind").orderBy("n").collect()
    assert [(r.out_width, r.rescaled, r.renewed) for r in got] == [(64, False, False), (64, False, True), (64, True, False)]
    again = live.repeated_source(df, "n", 10, 2)
    assert sorted(r.n for r in again.collect()) == [0, 1, 2, 10, 11, 12]


def test_windows_agree_with_batch(spark, tmp_path):
    made = spark.range(200).select((F.col("id") % 3).cast("string").alias("source"), F.timestamp_seconds(F.col("id") * 7).alias("at"))
    made.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.read_arriving(spark, str(tmp_path / "in"), "source string, at timestamp", files=1)
    q = live.timed_segments(stream, "source", "at", "60 seconds", late="1 day").writeStream.format("memory").queryName("windows").outputMode("complete")
    run(q)
    assert rows(spark.table("windows")) == rows(live.timed_segments(made, "source", "at", "60 seconds"))


def test_publish_is_repeatable(spark, tmp_path):
    spark.range(10).select((F.col("id") % 2).alias("rung"), "id").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = live.read_arriving(spark, str(tmp_path / "in"), "rung long, id long")
        live.publish(stream, str(tmp_path / "out"), str(tmp_path / "check"), "rung").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


# Sessions


def random_events(seed, n=250):
    """Events of three sources; some have sound before the first picture, odd sizes, other sample rates, dropped pictures."""
    rng, out = random.Random(seed), []
    for name in "abc":
        t, early = 0, rng.randint(0, 6)
        for i in range(n):
            t += rng.choice([1, 1, 1, 1, 0, -1, 3, 50, -60]) * live.CLOCK // 25
            kind = "sound" if i < early or rng.random() < 0.5 else "picture"
            out.append((name, i, kind, t, rng.choice("xxxy"), rng.choice([64, 64, 32]), 32, 48_000 if rng.random() < 0.97 else 44_100, 2 if rng.random() < 0.98 else 0, rng.choice([1920, 500, 4000]), rng.random() < 0.03))
        if name != "c":
            out.append((name, n, "lost" if name == "a" else "end", None, None, None, None, None, None, None, None))
            out.append((name, n + 1, "picture", t, "x", 64, 32, 0, 0, 0, False))
    return out


EVENTS = "source string, arrival long, kind string, time long, shape string, width int, height int, rate int, channels int, samples long, behind boolean"


def plain_session(events, rate, gap, limit=None):
    """(arrival, status, numbers...) of one source, written out rule by rule."""
    start, written, heard, base, size, shape, early, out = None, 0, 0, None, None, None, [], []

    def sound(e):
        nonlocal heard, base
        _, i, _, t, *_, hz, channels, n, _ = e
        if not hz or not channels:
            out.append((i, "empty"))
            return
        base = base or (hz, channels)
        if base != (hz, channels):
            out.append((i, "reshaped"))
            return
        drift = int(abs(t - start) * hz / live.CLOCK + 0.5) * (1 if t >= start else -1) - heard
        silence = drift if (drift > 0 and not heard or drift > hz // 25) and drift <= 10 * hz else 0
        trim = min(-drift, n) if drift < 0 and (not heard or drift < -(hz // 25)) else 0
        room = n if limit is None else max(limit * hz // rate - heard, 0)
        silence = silence if limit is None else min(silence, room)
        kept = n - trim if limit is None else max(0, min(n - trim, room - silence))
        heard += silence + kept
        out.append((i, "placed", silence, trim, kept))

    for e in events:
        _, i, kind, t, look, w, h, *_, behind = e
        if kind in ("end", "lost"):
            out.append((i, "no picture" if start is None else {"end": "ended", "lost": "lost"}[kind]))
            return out
        if kind == "sound":
            sound(e) if start is not None else early.append(e)
            continue
        if behind:
            out.append((i, "behind"))
            continue
        fresh = start is None
        start = t if fresh else start
        slot = int(abs(t - start) * rate / live.CLOCK + 0.5) * (1 if t >= start else -1)
        if abs(slot - written) > gap:
            start = t - written * live.CLOCK // rate
            slot, status, repeats = written, "reanchor", 0
        else:
            status, repeats = ("drop", 0) if slot < written else ("write", slot - written)
        if status == "write" and limit is not None and slot >= limit:
            out.append((i, "over", limit - written))
            written = limit
        elif status == "drop":
            out.append((i, "drop"))
        else:
            size = size or (w, h)
            out.append((i, status, slot, repeats, size != (w, h), shape is not None and look != shape))
            shape, written = look, slot + 1
        if fresh:
            for x in early:
                sound(x)
        if limit is not None and written >= limit:
            out.append((i, "length"))
            return out
    return out


def told(row):
    """A row of ``placed`` as the plain session has it."""
    if row["kind"] == "sound":
        return (row["arrival"], row["status"], row["silence"], row["trim"], row["kept"]) if row["status"] == "placed" else (row["arrival"], row["status"])
    if row["status"] in ("write", "reanchor"):
        return row["arrival"], row["status"], row["slot"], row["repeats"], row["rescaled"], row["renewed"]
    return (row["arrival"], row["status"], row["repeats"]) if row["status"] == "over" else (row["arrival"], row["status"])


@pytest.mark.parametrize("limit", [None, 60])
def test_sessions_follow_the_rules(spark, limit):
    made = random_events(7)
    got = {}
    for r in sessions.placed(spark.createDataFrame(made, EVENTS).repartition(5), sessions.Rules(25, 1, 40, limit)).collect():
        got.setdefault(r["source"], []).append(r)
    for name, found in got.items():
        assert [told(r) for r in found] == plain_session([e for e in made if e[0] == name], 25, 40, limit)
        if found[-1]["kind"] == "end":
            tally = collections.Counter(r["status"] for r in found)
            assert found[-1]["tally"] == tally
    assert set(got) == set("abc")


def test_any_micro_batches_give_the_rows_of_the_table(spark, tmp_path):
    sessions.use_rocksdb(spark)
    df = spark.createDataFrame(random_events(8), EVENTS)
    for n, (cuts, limit) in enumerate((([0, 2, 3, 9, 120, 400], None), ([0, 70, 80, 400], 45))):
        for a, b in zip(cuts, cuts[1:], strict=False):
            df.where((F.col("arrival") >= a) & (F.col("arrival") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
            time.sleep(0.05)
        rules = sessions.Rules(25, 1, 40, limit)
        stream = live.read_arriving(spark, str(tmp_path / f"in{n}"), EVENTS, files=1)
        run(sessions.placed_stream(stream, rules).writeStream.format("memory").queryName(f"placed{n}").option("checkpointLocation", str(tmp_path / f"c{n}")))
        assert rows(spark.table(f"placed{n}")) == rows(sessions.placed(df, rules))


def test_a_silent_source_ends(spark, tmp_path):
    """By what is received later, as in the table; and by the timer, when nothing more comes."""
    sessions.use_rocksdb(spark)
    second = live.CLOCK
    made = [("a", i, "picture", i * second, "x", 8, 8, i * 1000) for i in range(3)] + [("a", 3, "picture", 9 * second, "x", 8, 8, 9000)]
    df = spark.createDataFrame(made, "source string, arrival long, kind string, time long, shape string, width int, height int, received long")
    rules = sessions.Rules(1, 1, 100, idle_ms=3000)
    assert [(r["arrival"], r["status"]) for r in sessions.placed(df, rules).collect()] == [(0, "write"), (1, "write"), (2, "write"), (2, "idle")]
    df.where("arrival < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.read_arriving(spark, str(tmp_path / "in"), "source string, arrival long, kind string, time long, shape string, width int, height int, received long")
    q = sessions.placed_stream(stream, rules).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(150):
            if spark.table("silent").where("status = 'idle'").count():
                break
            time.sleep(0.2)
        assert [(r["arrival"], r["status"], r["slot"]) for r in spark.table("silent").orderBy("arrival", "kind").collect()][-2:] == [(2, "idle", 3), (2, "write", 2)]
    finally:
        q.stop()


# The live source


def pictures_and_sound(rng, n):
    return [{"kind": "picture" if rng.random() < 0.6 else "sound", "time": i * 400_000, "shape": "x", "width": 64, "height": 32, "rate": 48_000, "channels": 2, "samples": 1920} for i in range(n)]


def until(done, seconds=60):
    end = time.monotonic() + seconds
    while not done():
        assert time.monotonic() < end, "too late"
        time.sleep(0.1)


@pytest.mark.parametrize("realtime", [False, True])
def test_a_source_is_read_once_across_restarts(spark, tmp_path, realtime):
    rng, sent = random.Random(1), {"a": [], "b": []}
    place, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")

    def send(number, n):
        for name, log in sent.items():
            events = pictures_and_sound(rng, n)
            source.deliver(place, name, number, events)
            log += events

    def read(broken=False):
        def each(batch, number):
            if broken and number == 2:
                raise ValueError("card lost")  # between the offsets of a batch and its commit
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

        return source.live_events(spark, place, realtime, 20).writeStream.foreachBatch(each).option("checkpointLocation", check).trigger(processingTime="50 milliseconds").start()

    def have():
        whole = [str(x.parent) for x in tmp_path.glob("out/n=*/_SUCCESS")]
        return spark.read.parquet(*whole).count() if whole else 0

    send(0, 90)
    q = read()
    until(have)
    q.stop()  # wherever it is
    send(1, 90)
    with pytest.raises(Exception, match="card lost"):
        q = read(broken=True)
        if realtime:
            until(lambda: not q.isActive or have() == 360)
            send(2, 30)
        q.awaitTermination(60)
    send(3, 40)
    q = read()
    until(lambda: have() == sum(map(len, sent.values())))
    q.stop()
    got = spark.read.parquet(out)
    for name, log in sent.items():
        found = got.where(F.col("source") == name).orderBy("arrival").collect()
        assert [(r["arrival"], r["kind"], r["time"]) for r in found] == [(i, e["kind"], e["time"]) for i, e in enumerate(log)]
        by_batch = {}
        for r in found:
            by_batch.setdefault(r["batch"], []).append(r)
        for batch in by_batch.values():  # a queue with room for 20 pictures, empty at the begin of each batch
            shown = [r["behind"] for r in batch if r["kind"] == "picture"]
            assert shown == [realtime and i >= 20 for i in range(len(shown))] and (realtime or len(shown) <= 20)
        assert not any(r["behind"] for r in found if r["kind"] == "sound")
    assert got.where("behind").count() > 0 if realtime else got.select("batch").distinct().count() > 5


# Playlists and rungs


SEGMENTS = "rendition string, n long, seconds double, uri string"


def test_playlists_grow_by_their_tail_and_end(spark, tmp_path):
    made = [(r, k, 4.0 - k / 8, f"{r}{k}.m4s") for k in range(12) for r in ("v/1", "w 2")]
    df = spark.createDataFrame(made, SEGMENTS)
    out, check = str(tmp_path / "hls"), str(tmp_path / "c")
    for k in range(3):
        df.where(f"n div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
        stream = live.read_arriving(spark, str(tmp_path / "in/*"), SEGMENTS, files=1)
        playlists.publish_hls(stream, out, check, "rendition", "n", "seconds", "uri").awaitTermination(120)
        growing = {r["rendition"]: r["playlist"] for r in playlists.playlists(spark, out, 4).collect()}
        assert set(growing) == {"v/1", "w 2"} and all(p.count("#EXTINF") == 4 * k + 4 and "EVENT" in p and "ENDLIST" not in p for p in growing.values())
    sizes = [len(storage.get(f"{out}/log/{x}")) for x in storage.names(f"{out}/log")]
    assert len(sizes) >= 3 and max(sizes) < 300  # what a batch writes does not grow
    playlists.finish_hls(out)
    want = segments.media_playlist(df, "rendition", "n", "seconds", "uri", target=4)
    assert rows(playlists.playlists(spark, out, 4)) == rows(want)
    assert storage.names(f"{out}/_staged") == []


def test_an_aborted_batch_leaves_nothing_and_a_repeated_one_adds_nothing(spark, tmp_path):
    out = str(tmp_path / "hls")
    writer = playlists.TailWriter(out)
    rows_of = lambda *ns: iter([{"rendition": "v", "sequence": n, "seconds": 4.0, "uri": f"s{n}"} for n in ns])
    first, second = writer.write(rows_of(2, 1)), writer.write(rows_of(3))
    writer.commit([first, None, second], 0)
    lost = writer.write(rows_of(4))
    writer.abort([lost, None], 1)
    again = writer.write(rows_of(1, 2, 3))
    writer.commit([again], 0)
    text = playlists.playlists(spark, out, 4).first()["playlist"]
    assert [x for x in text.splitlines() if x.startswith("s")] == ["s1", "s2", "s3"]
    assert storage.names(f"{out}/_staged") == []
    left = writer.write(rows_of(5))
    storage.move(left.tails[0][2], f"{out}/tails/000000000001-000000")  # killed before the log
    assert playlists.playlists(spark, out, 4).first()["playlist"] == text
    writer.commit([writer.write(rows_of(4))], 1)
    assert "s4" in playlists.playlists(spark, out, 4).first()["playlist"] and "s5" not in playlists.playlists(spark, out, 4).first()["playlist"]


def test_dead_rungs_stay_dead(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    stream = lambda: live.read_arriving(spark, str(tmp_path / "in/*"), "id long", files=1)

    def broken(batch, number):
        if number:
            raise ValueError("card lost")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"broken/n={number}"))

    def fine(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"fine/n={number}"))

    def mended(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"broken/n={number}"))

    def made(second):
        return Rungs(spark, str(tmp_path / "rungs"), {"fine": lambda: stream().writeStream.foreachBatch(fine), "broken": lambda: stream().writeStream.foreachBatch(second)})

    rungs = made(broken).start()
    rungs.wait(120)
    assert set(rungs.failed) == {"broken"} and "card lost" in rungs.failed["broken"]
    assert spark.read.parquet(str(tmp_path / "fine")).count() == 30 and spark.read.parquet(str(tmp_path / "broken")).count() == 10
    spark.range(100, 110).coalesce(1).write.parquet(str(tmp_path / "in/k=9"))
    rungs = made(mended).start()  # as after a restart: the dead rung is remembered
    rungs.wait(120)
    assert spark.read.parquet(str(tmp_path / "fine")).count() == 40 and spark.read.parquet(str(tmp_path / "broken")).count() == 10
    rungs.forgive("broken")
    rungs = made(mended).start()
    rungs.wait(120)
    assert rungs.failed == {} and spark.read.parquet(str(tmp_path / "broken")).count() == 40  # from its checkpoint, without a hole

    def dead(batch, number):
        raise ValueError("no card")

    with pytest.raises(RuntimeError, match="every rung failed"):
        Rungs(spark, str(tmp_path / "all"), {x: lambda: stream().writeStream.foreachBatch(dead) for x in "ab"}).start().wait(120)


def test_the_listener_writes_down_what_ended_a_rung(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))

    def dead(batch, number):
        raise ValueError("no card")

    rungs = Rungs(spark, str(tmp_path / "rungs"), {"a": lambda: live.read_arriving(spark, str(tmp_path / "in"), "id long").writeStream.foreachBatch(dead)}).start()
    until(lambda: "no card" in rungs.failed.get("a", ""))
    with pytest.raises(RuntimeError, match="every rung failed"):
        rungs.stop()
