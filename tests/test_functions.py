"""Closed forms of column functions, and properties of operators without SQL."""

import collections
import struct

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from reelframe.functions import audio, picture, text, timebase
from reelframe.kernels import pixels
from reelframe.operators import frames, joins, metadata, segments, selection


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ladder_of_known_sources(spark):
    got = one(spark, picture.ladder(F.lit(1920), F.lit(1080)))
    assert [(r.width, r.height) for r in got] == [(1920, 1080), (1280, 720), (852, 480), (640, 360), (426, 240)]
    assert one(spark, picture.ladder(F.lit(3840), F.lit(2160)))[0] == (1920, 1080)
    assert len(one(spark, picture.ladder(F.lit(3840), F.lit(2160), F.lit(2160)))) == 7
    assert one(spark, picture.ladder(F.lit(0), F.lit(10))) == []


def test_bitrates_of_known_heights(spark):
    want = {2160: 16_000_000, 1440: 9_000_000, 1080: 5_000_000, 720: 3_000_000, 540: 1_650_000, 480: 1_200_000, 360: 800_000, 240: 400_000, 144: 200_000, 100: 200_000, 4320: 64_000_000}
    df = spark.createDataFrame([(k,) for k in want], "side int").select("side", picture.default_bitrate(F.lit("h264"), "side", F.lit(30.0)).alias("b"))
    assert {r.side: r.b for r in df.collect()} == want


def test_fit_modes(spark):
    contain = one(spark, picture.fit(F.lit(640), F.lit(480), F.lit(1280), F.lit(720), upscale=True))
    assert (contain.width, contain.height) == (960, 720)
    pad = one(spark, picture.fit(F.lit(640), F.lit(480), F.lit(1280), F.lit(720), "pad", upscale=True))
    assert (pad.x, pad.y, pad.canvas_width, pad.canvas_height) == (160, 0, 1280, 720)
    turned = one(spark, picture.fit(F.lit(720), F.lit(1280), F.lit(640), F.lit(360)))
    assert (turned.width, turned.height) == (360, 640)
    cover = one(spark, picture.fit(F.lit(4000), F.lit(3000), F.lit(1280), F.lit(720), "cover"))
    assert (cover.canvas_width, cover.canvas_height) == (1280, 720)


def test_text_forms(spark):
    assert one(spark, timebase.clock_text(F.lit(3_723_004))) == "01:02:03.004"
    assert one(spark, timebase.duration_seconds(F.lit("1h2m3s"))) == 3723.0
    assert one(spark, timebase.duration_seconds(F.lit("250ms"))) == 0.25
    assert one(spark, timebase.duration_seconds(F.lit("x1"))) is None
    assert one(spark, timebase.bits_per_second(F.lit("2.5M"))) == 2_500_000
    assert one(spark, text.escape_cue(F.lit("a & <b>  \n\n c"))) == "a &amp; &lt;b&gt;\n c"
    assert one(spark, text.strip_markup(F.lit(r"0,0,Default,,0,0,0,,{\i1}Hi\Nthere"), "ass")) == "Hi\nthere"
    assert one(spark, text.strip_markup(F.lit("<v Bob>1 &lt; 2</v>"), "webvtt")) == "1 < 2"
    assert one(spark, text.hex_hash(F.lit("0xffffffffffffffff"))) == -1
    assert one(spark, text.hash_hex(F.lit(-1))) == "f" * 16
    codes = [("eng", "en"), ("ger", "de"), ("deu", "de"), ("fre", "fr"), ("Qaa", "qaa"), ("", "und"), (None, "und")]
    df = spark.createDataFrame([(c,) for c, _ in codes], "code string")
    assert rows(text.normalised_language(df, "code"), "tag") == sorted((t,) for _, t in codes)


def test_containers_by_first_bytes(spark):
    kinds = {b"\0\0\0\x18ftypisom....": "mp4", b"\x1a\x45\xdf\xa3" + b"0" * 12: "matroska", b"RIFF0000WAVE0000": "wav", b"DKIF" + b"0" * 12: "ivf", b"G" + b"\0" * 187 + b"G": "mpeg_ts", b"none of these ...": "unknown"}
    df = spark.createDataFrame([(bytearray(k), v) for k, v in kinds.items()], "head binary, want string")
    assert df.where(picture.container_kind(F.col("head")) != F.col("want")).count() == 0


def test_composition_offsets(spark):
    pts = [0, 3, 1, 2, 6, 4, 5]
    df = spark.createDataFrame([("s", i, p, 10) for i, p in enumerate(pts)], "s string, arrival int, pts int, duration int")
    got = segments.composition_offsets(df, "s", "arrival", "pts", "duration")
    assert [o // 10 for _, o in rows(got, "arrival", "offset")] == [0, 2, -1, -1, 2, -1, -1]
    twice = df.union(spark.createDataFrame([("s", 9, 0, 10)], df.schema))
    assert segments.composition_offsets(twice, "s", "arrival", "pts", "duration").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "s string, k long, r int")
    assert frames.repeated(none, "s", "k", "r").count() == 0
    assert frames.stills(none, "s").count() == 0
    assert segments.bandwidth(spark.createDataFrame([], "r string, b double, s double"), "r", "b", "s").count() == 0


def test_metadata(spark):
    assert one(spark, metadata.field_of(F.lit("Creation-Time"))) == "capture_time"
    assert one(spark, metadata.violations(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("b")))) == ["a"]


def test_suppression_against_a_loop(spark):
    rng = np.random.default_rng(1)
    made = [("f", "l", float(s), float(x), float(y), float(x + 20), float(y + 20)) for s, x, y in zip(rng.permutation(40), rng.integers(0, 60, 40), rng.integers(0, 60, 40), strict=True)]
    df = spark.createDataFrame(made, "frame string, label string, score double, x0 double, y0 double, x1 double, y1 double")

    def iou(a, b):
        w, h = max(0, min(a[5], b[5]) - max(a[3], b[3])), max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h / (800 - w * h)

    kept = []
    for b in sorted(made, key=lambda b: -b[2]):
        if len(kept) < 6 and all(iou(k, b) <= 0.3 for k in kept):
            kept.append(b)
    assert rows(selection.suppressed(df, "frame", "label", "score", 0.3, 6)) == sorted(kept, key=repr)


def test_audio(spark):
    stereo = one(spark, audio.remixed(F.array(*map(F.lit, [0.5, 0.25, 1.0, 0.0])), ("FL", "FR"), ("FC",)))
    assert np.allclose(stereo, [0.375, 0.5])
    assert one(spark, audio.channel_map(F.array(F.lit(1.0), F.lit(2.0)), ("FL", "FR"), [("FR", "FL")], ("FL", "FR"))) == [2.0, 0.0]


def test_kernels():
    p = np.arange(64, dtype=np.uint8).reshape(8, 8) * 3
    flat = np.full((16, 16), 90, np.uint8)
    for k in (pixels.bilateral, pixels.gaussian, pixels.median, pixels.bilinear(16, 16)):
        assert np.array_equal(k(flat), flat)
    assert np.array_equal(pixels.hflip(pixels.hflip(p)), p) and np.array_equal(pixels.vflip(pixels.vflip(p)), p) and np.array_equal(pixels.invert(pixels.invert(p)), p)
    noisy = np.clip(100 + np.random.default_rng(0).normal(0, 8, (40, 40)), 0, 255).astype(np.uint8)
    for k in (pixels.bilateral, pixels.gaussian, pixels.blend(pixels.gaussian, 0.5)):
        assert k(noisy).std() < noisy.std()


def test_cues_playlists_and_manifests(spark, tmp_path):
    from reelframe.sources import media

    (tmp_path / "a.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVEfmt ")
    assert rows(media.assets(spark, str(tmp_path), "*.wav"), "container") == [("wav",)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.vtt").write_text("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\n<b>Hi</b> &amp; bye\n\n00:03.000 --> 00:04.000\ntwo\n")
    assert rows(media.cues(spark, str(tmp_path / "c")), "start", "duration", "text") == [(1000, 1500, "Hi & bye"), (3000, 1000, "two")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/m.m3u8").write_text("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:4.000,\na.m4s\n#EXTINF:3.5,\nb.m4s\n#EXT-X-ENDLIST\n")
    assert rows(media.playlist(spark, str(tmp_path / "p")), "sequence", "seconds", "uri") == [(7, 4.0, "a.m4s"), (8, 3.5, "b.m4s")]
    (tmp_path / "jobs.json").write_text('{"defaults": {"codec": "av1", "crf": 30}, "jobs": [{"input": "a", "crf": 20}, {"input": "b"}]}')
    assert rows(media.manifest(spark, str(tmp_path / "jobs.json"), ["input", "codec", "crf"])) == [(0, "a", "av1", 20), (1, "b", "av1", 30)]


def test_hamming_pairs_and_members_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 7)  # several blocks in most files
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 2**56, 12)]
    values = [b ^ sum(1 << int(i) for i in rng.choice(56, rng.integers(0, 12), replace=False)) for b in base for _ in range(8)] + [base[0]] * 40 + [None]
    df = spark.createDataFrame(list(enumerate(values)) + [(None, base[0])], "id long, h long")
    first, size = {}, collections.Counter(values)
    for i, h in enumerate(values):
        first.setdefault(h, i)
    far = lambda x, y: (x ^ y).bit_count()
    near = [(first[x], first[y], far(x, y)) for x in first for y in first if x is not None and y is not None and first[x] < first[y] and far(x, y) <= 15]
    pairs = joins.hamming_pairs(df, "id", "h", 15, parts=4, bits=56)
    assert rows(pairs) == sorted(near, key=repr)
    links = lambda x: sum(n for y, n in size.items() if y is not None and far(x, y) <= 15) - 1
    want = [(i, first[h], links(h)) if h is not None else (i, None, 0) for i, h in enumerate(values)] + [(None, None, 0)]
    assert rows(joins.hamming_members(df, "id", "h", pairs)) == sorted(want, key=repr)
