"""Blocks of uncompressed sound, windows across them, and downmixes of all layouts."""

import struct

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelframe.functions import audio
from reelframe.sources import pcm


def wav(raw, code, channels, rate, bits, before=(), size=None, long=False, pad=b""):
    """A WAV file: other chunks ``before`` the samples, a plain or a long format chunk, and what follows."""
    form = struct.pack("<HHIIHH", 0xFFFE if long else code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if long:
        form += struct.pack("<HHIH", 22, bits, 0, code) + b"\x00" * 14
    body = b"".join(n + struct.pack("<I", len(b)) + b + b"\x00" * (len(b) % 2) for n, b in [*before, (b"fmt ", form)])
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + body + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw + pad


def encoded(values, code, bits):
    if code == 3:
        return values.astype(f"<f{bits // 8}").tobytes()
    if bits == 8:
        return np.round(values * 127 + 128).astype(np.uint8).tobytes()
    whole = np.round(values * (2 ** (bits - 1) - 1)).astype("<i8")
    return whole.view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()


@pytest.mark.parametrize(("code", "bits"), [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_samples_of_all_widths(spark, tmp_path, code, bits):
    values = np.sin(np.arange(1003 * 2) / 9) * 0.9
    raw = encoded(values, code, bits)
    (tmp_path / "a.wav").write_bytes(wav(raw, code, 2, 8000, bits, [(b"LIST", b"abc"), (b"fact", b"\x00" * 4)], long=bits == 24, pad=b"LIST\x02\x00\x00\x00hi"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.WAV").write_bytes(wav(raw + b"\x01", code, 2, 8000, bits, size=0xFFFFFFFF))  # a stream: no size, and a part of a frame
    (tmp_path / "c.wav").write_bytes(b"RIFFxxxxWAVE")
    (tmp_path / "d.wav").write_bytes(wav(raw, 85, 2, 8000, 16))  # another codec
    (tmp_path / "e.wav").write_bytes(b"")
    got = pcm.pcm_blocks(spark, str(tmp_path), block=100, blocks=3)
    assert got.rdd.getNumPartitions() == 8  # eleven blocks in threes, twice
    for name in ("a.wav", "sub/b.WAV"):
        mine = got.where(F.col("path").endswith(name)).orderBy("block").collect()
        assert [(r["block"], r["first"], r["channels"], r["rate"]) for r in mine] == [(i, 100 * i, 2, 8000) for i in range(11)]
        assert np.allclose(np.concatenate([r["samples"] for r in mine]), values, atol={8: 0.02, 16: 1e-4}.get(bits, 1e-6))
    assert {r["path"][-5:] for r in got.select("path").distinct().collect()} == {"a.wav", "b.WAV"}


def test_a_folder_without_sound_has_no_rows(spark, tmp_path):
    assert pcm.pcm_blocks(spark, str(tmp_path)).collect() == []


def test_windows_across_blocks_are_slices(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = {c: (rng.integers(-30_000, 30_000, 1717 * c) / 32_768).astype(np.float32) for c in (1, 2, 6)}
    for c, v in values.items():
        (tmp_path / f"{c}.wav").write_bytes(wav((v * 32_768).astype("<i2").tobytes(), 1, c, 8000, 16))
    made, want = [], {}
    for i in range(120):
        c = (1, 2, 6)[i % 3]
        start, end = int(rng.integers(-50, 1800)), int(rng.integers(0, 1800))
        made.append((f"{tmp_path}/{c}.wav", i, start, end))
        cut = values[c].reshape(-1, c)[max(start, 0) : max(end, 0)].reshape(-1).tolist()
        if cut:
            want[i] = cut
    cuts = spark.createDataFrame([*made, (None, 500, 0, 9), ("none", 501, 0, 9)], "path string, id int, start long, end long")
    parts = pcm.windows(pcm.pcm_blocks(spark, str(tmp_path), block=64, blocks=5), cuts, block=64)
    assert parts.columns == ["path", "id", "start", "end", "block", "samples"]
    assert {r["id"]: r["samples"] for r in pcm.joined(parts, ["id"]).collect()} == want


def test_a_large_file_is_read_by_ranges(spark, tmp_path):
    """64 MB of silence, no row of more than a block, in as many tasks as there are ranges."""
    n = 16 << 20
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(wav(b"", 1, 2, 48_000, 16, size=4 * n))
        f.truncate(f.tell() + 4 * n)
    got = pcm.pcm_blocks(spark, str(tmp_path / "long.wav"))
    assert got.rdd.getNumPartitions() == 4
    assert rows(got.agg(F.count("*"), F.max(F.size("samples")), F.sum(F.size("samples")))) == [(1024, 2 * pcm.BLOCK, 2 * n)]


def plain_gains(source, target):
    """Gains by (input, output) speaker, rule by rule."""
    half, out = 0.5**0.5, {}
    if target == ("FC",) and source != ("FC",):
        for (name, _), g in plain_gains_unscaled(source, ("FL", "FR")).items():
            out[name, "FC"] = out.get((name, "FC"), 0) + half * g
    else:
        out = plain_gains_unscaled(source, target)
    widest = max([1, *(sum(g for (_, o), g in out.items() if o == t) for t in target)])
    return {k: g / widest for k, g in out.items()}


def plain_gains_unscaled(source, target):
    half, out = 0.5**0.5, {}
    for s in source:
        if s in target:
            out[s, s] = 1.0
        elif s == "FC" and "FL" in target:
            out[s, "FL"] = out[s, "FR"] = half
        elif s in ("FL", "FR") and "FC" in target:
            out[s, "FC"] = half
        elif s == "BC":
            for pair, gain in ((("BL", "BR"), half), (("SL", "SR"), half), (("FL", "FR"), 0.5)):
                if pair[0] in target:
                    out[s, pair[0]] = out[s, pair[1]] = gain
                    break
        elif s[0] in "BS":
            twin = ("S" if s[0] == "B" else "B") + s[1]
            if twin in target:
                out[s, twin] = half if twin in source else 1.0
            elif "BC" in target:
                out[s, "BC"] = half
            elif "F" + s[1] in target:
                out[s, "F" + s[1]] = half
    return out


def test_downmixes_of_all_pairs():
    for source in audio.LAYOUTS.values():
        for target in audio.LAYOUTS.values():
            want = plain_gains(source, target)
            matrix = audio.remix_matrix(source, target)
            assert np.allclose(matrix, [[want.get((s, t), 0) for s in source] for t in target])
            assert max(sum(r) for r in matrix) < 1 + 1e-9
    same = audio.remix_matrix(audio.LAYOUTS["5.1"], audio.LAYOUTS["5.1(side)"])
    assert np.allclose(same, np.eye(6))  # the same surrounds by another name
    assert np.allclose(audio.remix_matrix(audio.LAYOUTS["4.0"], audio.LAYOUTS["stereo"])[0], np.array([1, 0, 0.5**0.5, 0.5]) / (1.5 + 0.5**0.5))


def test_layouts_that_codecs_carry():
    assert [audio.carried_layout("opus", x) for x in ("5.1(side)", "7.1", "mono", "quad(side)")] == ["5.1", "7.1", "mono", "quad"]
    for codec, names in audio.CARRIED.items():
        for name in names:
            assert audio.carried_layout(codec, name) is not None
    assert audio.carried_layout("ac3", "7.1") == "5.1(side)" and audio.carried_layout("mp3", "5.1") == "stereo" and audio.carried_layout("he_aac_v2", "mono") == "stereo"
