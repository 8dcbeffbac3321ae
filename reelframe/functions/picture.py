"""Column functions on picture sizes, rates, quality and codec names."""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timebase import _c

# Fixed values: (short side, bits per second) of H.264 at 30 frames per second, and each codec's factor.
CBR_ANCHORS = ((144, 200_000), (240, 400_000), (360, 800_000), (480, 1_200_000), (720, 3_000_000), (1080, 5_000_000), (1440, 9_000_000), (2160, 16_000_000))
CODEC_FACTOR = {"h264": 1.0, "h265": 0.65, "av1": 0.5, "vp9": 0.65, "vp8": 1.0, "mpeg4": 1.5, "mpeg2": 2.0, "prores": 1.0}
# Fixed values: (score, quantiser) anchors; (quality, quantiser) of stills; the quantiser of each named target.
VMAF_ANCHORS = ((100, 10), (98, 20), (95, 27), (90, 32), (85, 38), (70, 55))
STILL_ANCHORS = ((1, 255), (20, 205), (40, 162), (60, 120), (80, 72), (90, 44), (100, 1))
TARGETS = {"visually_lossless": 20, "high": 27, "standard": 32, "low": 38}
# Each back end's quantiser of a named target, and its (score, quantiser) anchors.
BACKEND_TARGETS = {
    "libaom": {"visually_lossless": 20, "high": 27, "standard": 32, "low": 38},
    "nvenc": {"visually_lossless": 19, "high": 25, "standard": 30, "low": 36},
    "amf": {"visually_lossless": 72, "high": 100, "standard": 120, "low": 144},
    "amf_quality": {"visually_lossless": 95, "high": 85, "standard": 70, "low": 55},
    "qsv": {"visually_lossless": 16, "high": 22, "standard": 26, "low": 31},
    "h26x": {"visually_lossless": 18, "high": 22, "standard": 26, "low": 32},
}
BACKEND_ANCHORS = {
    "libaom": ((100, 10), (98, 20), (95, 27), (90, 32), (85, 38), (70, 55)),
    "nvenc": ((100, 10), (98, 19), (95, 25), (90, 30), (85, 36), (70, 52)),
    "amf": ((100, 50), (98, 72), (95, 100), (90, 120), (85, 144), (70, 200)),
    "amf_quality": ((100, 100), (98, 95), (95, 85), (90, 70), (85, 55), (70, 35)),
    "qsv": ((100, 8), (98, 18), (95, 24), (90, 30), (85, 36), (70, 48)),
    "h26x": ((100, 8), (98, 18), (95, 24), (90, 30), (85, 36), (70, 48)),
}
# Fixed values: (level, largest picture, largest samples per second).
VP9_LEVELS = (
    (10, 36_864, 829_440), (11, 73_728, 2_764_800), (20, 122_880, 4_608_000), (21, 245_760, 9_216_000), (30, 552_960, 20_736_000),
    (31, 983_040, 36_864_000), (40, 2_228_224, 83_558_400), (41, 2_228_224, 160_432_128), (50, 8_912_896, 311_951_360), (51, 8_912_896, 588_251_136),
    (52, 8_912_896, 1_176_502_272), (60, 35_651_584, 1_176_502_272), (61, 35_651_584, 2_353_004_544), (62, 35_651_584, 4_706_009_088),
)
# kbit/s of the audio ladder.
MP3_RATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
# The short sides of a ladder, its default cap, the least dimension, and how near the top absorbs a rung.
SHORT_SIDES, DEFAULT_CAP, LEAST_SIDE, ABSORB = (2160, 1440, 1080, 720, 480, 360, 240), 1080, 200, 0.15


def _even(x: Column) -> Column:
    return (x - x % 2).cast("long")


def upright(width, height, rotation) -> Column:
    """PRJ-01: struct(width, height) of a picture as shown: quarter turns swap the sides."""
    turned = F.pmod(_c(rotation), F.lit(180)) == 90
    return F.struct(F.when(turned, _c(height)).otherwise(_c(width)).alias("width"), F.when(turned, _c(width)).otherwise(_c(height)).alias("height"))


def display_size(width, height, sar_num, sar_den) -> Column:
    """PRJ-02: struct(width, height) as shown: wide samples widen, tall ones heighten."""
    ratio = _c(sar_num) / F.nullif(_c(sar_den), F.lit(0))
    ratio = F.when(ratio > 0, ratio).otherwise(1.0)
    return F.struct(F.when(ratio >= 1, _c(width) * ratio).otherwise(_c(width).cast("double")).alias("width"), F.when(ratio < 1, _c(height) / ratio).otherwise(_c(height).cast("double")).alias("height"))


def vp9_level(width, height, fps) -> Column:
    """PRJ-06: the least level that holds the picture and its sample rate; the highest if none does."""
    size = _c(width).cast("long") * _c(height)
    rate = F.ceil(size * F.greatest(_c(fps), F.lit(0.0)))
    out = None
    for level, picture, samples in VP9_LEVELS:
        fits = (size <= picture) & (rate <= samples)
        out = F.when(fits, level) if out is None else out.when(fits, level)
    return out.otherwise(VP9_LEVELS[-1][0])


def default_bitrate(codec, short_side, fps) -> Column:
    """MTH-07: between anchors by the short side in a line, above the last by area; more for fast pictures; by the codec; whole kbit."""
    side = F.greatest(_c(short_side), F.lit(1)).cast("double")
    base = F.when(side <= CBR_ANCHORS[0][0], float(CBR_ANCHORS[0][1]))
    for (s0, r0), (s1, r1) in pairwise(CBR_ANCHORS):
        base = base.when(side <= s1, r0 + (side - s0) * (r1 - r0) / (s1 - s0))
    last_side, last_rate = CBR_ANCHORS[-1]
    base = base.otherwise(last_rate * (side / last_side) * (side / last_side))
    fast = F.when(_c(fps) > 30, F.least(_c(fps), F.lit(120.0))).otherwise(30.0)
    factor = F.lit(1.0)
    for name, value in CODEC_FACTOR.items():
        factor = F.when(_c(codec) == name, value).otherwise(factor)
    return F.greatest(F.round(base * (1 + 0.5 * (fast / 30 - 1)) * factor / 1000) * 1000, F.lit(1000.0)).cast("long")


def vmaf_quantiser(score) -> Column:
    """MTH-08: anchors joined by lines, truncated to whole numbers, flat beyond both ends."""
    s = _c(score).cast("int")
    out = F.when(s >= VMAF_ANCHORS[0][0], VMAF_ANCHORS[0][1])
    for (high, q_high), (low, q_low) in pairwise(VMAF_ANCHORS):
        out = out.when(s >= low, q_high + F.floor((high - s) * (q_low - q_high) / (high - low)))
    return out.otherwise(VMAF_ANCHORS[-1][1]).cast("int")


def still_quantiser(quality) -> Column:
    """MTH-16: anchors joined by lines, rounded."""
    q = F.least(F.greatest(_c(quality).cast("int"), F.lit(1)), F.lit(100))
    out = None
    for (q0, v0), (q1, v1) in pairwise(STILL_ANCHORS):
        here = F.round(v0 + (q - q0) * ((v1 - v0) / (q1 - q0)))
        out = F.when(q <= q1, here) if out is None else out.when(q <= q1, here)
    return out.cast("int")


def target_quantiser(target) -> Column:
    """MTH-09: of a named target; null for an unknown name."""
    out = F.lit(None).cast("int")
    for name, q in TARGETS.items():
        out = F.when(_c(target) == name, q).otherwise(out)
    return out


def backend_quantiser(backend: str, target=None, score=None) -> Column:
    """MTH-10: what a back end takes for a named ``target``, or for a ``score`` (0 to 100) where that is not null: anchors joined by
    lines, cut to whole numbers towards the better end, flat beyond both ends. Null for an unknown name."""
    named = F.lit(None).cast("int")
    for name, q in BACKEND_TARGETS[backend].items():
        named = F.when(_c(target) == name, q).otherwise(named) if target is not None else named
    if score is None:
        return named
    s, anchors = _c(score).cast("int"), BACKEND_ANCHORS[backend]
    out = F.when(s.isNull(), named).when(s >= anchors[0][0], anchors[0][1])
    for (high, q_high), (low, q_low) in pairwise(anchors):
        step = (high - s) * abs(q_low - q_high) / (high - low)
        out = out.when(s >= low, q_high + F.floor(step) * (1 if q_low > q_high else -1))
    return out.otherwise(anchors[-1][1]).cast("int")


def software_quantiser(codec, target=None, score=None, delta=0) -> Column:
    """MTH-10: the quantiser of the software encoders: that of H.264 moved by ``delta`` within 0 to 51, on the codec's own scale by its step."""
    qp = F.least(F.greatest(backend_quantiser("h26x", target, score) + _c(delta), F.lit(0)), F.lit(51))
    scale = F.round(0.625 * F.pow(F.lit(2.0), qp / 6.0) / 2.6)
    return (
        F.when(_c(codec) == "vp8", F.least(qp * 2, F.lit(127)))
        .when(_c(codec) == "vp9", F.least(F.greatest(F.round(qp * 3.8), F.lit(1)), F.lit(255)))
        .when(_c(codec).isin("mpeg2", "mpeg4"), F.least(F.greatest(scale, F.lit(1.0)), F.lit(31.0)))
        .otherwise(qp)
        .cast("int")
    )


def coded_sample_rate(rate) -> Column:
    """MTH-11: the rate that MP3, AC-3 and DTS code a source at."""
    r = _c(rate)
    return F.when(r.isin(32_000, 44_100, 48_000), r).when(r % 11_025 == 0, 44_100).otherwise(48_000)


def nearest_mp3_rate(bits) -> Column:
    """MTH-11: the rate of the audio ladder nearest to ``bits`` per second, the lower one on ties."""
    rates = F.array(*(F.lit(r * 1000) for r in MP3_RATES))
    return F.array_min(F.transform(rates, lambda r: F.struct(F.abs(r - _c(bits)).alias("far"), r.alias("rate"))))["rate"]


def device_weight(vram_mib, link_gbytes) -> Column:
    """MTH-12: the root of the memory against 8 GiB within bounds, less for a slow link; none of its own counts as 2 GiB."""
    gib = F.when(_c(vram_mib) == 0, 2.0).otherwise(_c(vram_mib) / 1024)
    slow = F.when(_c(link_gbytes) < 4, 0.5).when(_c(link_gbytes) < 8, 0.75).otherwise(1.0)
    return F.sqrt(F.least(F.greatest(gib / 8, F.lit(0.25)), F.lit(4.0))) * slow


def quality_step(step, position) -> Column:
    """MTH-17: a step for each rung below the top, within 16 bits."""
    return F.least(F.greatest(_c(step) * _c(position), F.lit(-32768)), F.lit(32767)).cast("int")


def rational_rate(fps) -> Column:
    """MTH-18: struct(num, den): NTSC rates over 1001, whole rates over 1, others over 1000."""
    f = _c(fps)
    whole, ntsc = F.round(f), F.round(f * 1001 / 1000)
    num = F.when(F.abs(f - whole) < 1e-3, whole).when(F.abs(f - ntsc * 1000 / 1001) < 5e-3, ntsc * 1000).otherwise(F.round(f * 1000))
    den = F.when(F.abs(f - whole) < 1e-3, 1).when(F.abs(f - ntsc * 1000 / 1001) < 5e-3, 1001).otherwise(1000)
    return F.struct(num.cast("long").alias("num"), den.cast("long").alias("den"))


def spread(frames, chunk, rungs, cards, trimmed) -> Column:
    """MTH-20: ``serial`` where too few chunks would keep the cards busy, where trimmed, and where the count is unknown."""
    few = F.ceil(_c(frames) / _c(chunk)) * _c(rungs) < 2 * _c(cards)
    return F.when(few | _c(trimmed) | (_c(frames) <= 0), "serial").otherwise("spread")


def aligned_round(value, align) -> Column:
    """MTH-03: the nearest multiple, at least one."""
    return F.greatest(F.round(_c(value) / _c(align)) * _c(align), _c(align)).cast("long")


def aligned_floor(value, align) -> Column:
    """MTH-03: the multiple below, with room for rounding."""
    return F.greatest(F.floor((_c(value) + 1e-6) / _c(align)) * _c(align), _c(align)).cast("long")


def ladder(width, height, cap=DEFAULT_CAP) -> Column:
    """MTH-01: array of struct(width, height), the top first: the source within the cap, then the standard short sides below it.

    The standard side just under the top is absorbed where the top is at most 15 % above it.
    """
    w, h, limit = _c(width).cast("long"), _c(height).cast("long"), _c(cap)
    short, long_side = F.least(w, h), F.greatest(w, h)
    aspect = long_side / short
    wide = w >= h
    over = short > limit
    top = F.when(over, limit - limit % 2).otherwise(_even(short)).cast("long")
    top_long = F.when(over, _even(F.round(limit * aspect).cast("long"))).otherwise(_even(long_side))
    sides = F.array(*(F.lit(x).cast("long") for x in SHORT_SIDES))
    below = F.filter(sides, lambda s: (s < top) & (s <= limit))
    near = F.array_max(below)
    absorbed = F.when(top <= near * (1 + ABSORB), near)
    lower = F.filter(F.transform(F.filter(below, lambda s: absorbed.isNull() | (s != absorbed)), lambda s: F.struct(_even(F.round(s * aspect).cast("long")).alias("l"), _even(s).alias("s"))), lambda x: (x["s"] >= LEAST_SIDE) & (x["l"] >= LEAST_SIDE))
    rungs = F.concat(F.array(F.struct(top_long.alias("l"), top.alias("s"))), lower)
    shaped = F.transform(rungs, lambda x: F.struct(F.when(wide, x["l"]).otherwise(x["s"]).alias("width"), F.when(wide, x["s"]).otherwise(x["l"]).alias("height")))
    return F.when((w > 0) & (h > 0), F.array_distinct(shaped)).otherwise(F.array().cast("array<struct<width:bigint,height:bigint>>"))


def fit(width, height, box_width, box_height, mode: str = "contain", upscale: bool = False, align: int = 2) -> Column:
    """MTH-02: struct(width, height, x, y, canvas_width, canvas_height) of a square-sample picture in a box.

    The box turns with the picture. ``contain``: the canvas is the picture; ``pad``: the canvas is the
    box; ``cover``: the canvas is the box or the largest of its shape that the picture fills;
    ``stretch``: the box as it is. Pictures are enlarged only with ``upscale``.
    """
    w, h = _c(width).cast("double"), _c(height).cast("double")
    b0, b1 = _c(box_width).cast("double"), _c(box_height).cast("double")
    turn = (b0 != b1) & (w != h) & ((w > h) != (b0 > b1)) if mode != "stretch" else F.lit(False)
    bw, bh = F.when(turn, b1).otherwise(b0), F.when(turn, b0).otherwise(b1)
    up, down = lambda v: aligned_round(v, align).cast("double"), lambda v: aligned_floor(v, align).cast("double")
    x = y = F.lit(0.0)
    if mode == "stretch":
        cw, ch = iw, ih = bw, bh
    elif mode == "cover":
        k = F.lit(1.0) if upscale else F.least(w / bw, h / bh, F.lit(1.0))
        cw = iw = F.when(k < 1, F.least(up(bw * k), down(w), bw)).otherwise(bw)
        ch = ih = F.when(k < 1, F.least(up(bh * k), down(h), bh)).otherwise(bh)
    else:
        s = F.least(bw / w, bh / h)
        slack = (bw >= w) & (bh >= h) & (bw - w < 2) & (bh - h < 2)
        held = slack | F.lit(not upscale)
        s = F.when(held, F.least(s, F.lit(1.0))).otherwise(s)
        iw, ih = F.least(up(w * s), bw), F.least(up(h * s), bh)
        iw, ih = F.when(held, F.least(iw, down(w))).otherwise(iw), F.when(held, F.least(ih, down(h))).otherwise(ih)
        cw, ch = (iw, ih) if mode == "contain" else (bw, bh)
        if mode == "pad":
            half = lambda room: F.floor(F.floor(room / 2) / align) * align
            x, y = half(bw - iw), half(bh - ih)
    return F.struct(*(v.cast("long").alias(n) for v, n in ((iw, "width"), (ih, "height"), (x, "x"), (y, "y"), (cw, "canvas_width"), (ch, "canvas_height"))))


def is_blank(mean, deviation) -> Column:
    """FLT-05: flat, or dark and nearly flat."""
    return (_c(deviation) < 3) | ((_c(mean) <= 22) & (_c(deviation) < 6))


def ssim_db(ssim) -> Column:
    """TOP-07: similarity on a decibel scale, 60 at most."""
    return F.least(F.lit(60.0), -10 * F.log10(F.greatest(1 - _c(ssim), F.lit(1e-6))))


def psnr(mse) -> Column:
    """AGG-05: infinite for equal pictures."""
    return F.when(_c(mse) == 0, F.lit(float("inf"))).otherwise(10 * F.log10(255.0 * 255.0 / _c(mse)))


def avc_codec(profile, constraints, level) -> Column:
    """PRJ-05: ``avc1.`` and three bytes in hex."""
    byte = lambda x: F.lpad(F.lower(F.hex(_c(x).cast("long"))), 2, "0")
    return F.concat(F.lit("avc1."), byte(profile), byte(constraints), byte(level))


def av1_codec(profile, level, tier, depth) -> Column:
    """PRJ-05: ``av01.P.LLT.DD``."""
    return F.concat(F.lit("av01."), _c(profile).cast("string"), F.lit("."), F.lpad(_c(level).cast("string"), 2, "0"), F.when(_c(tier) == 0, "M").otherwise("H"), F.lit("."), F.lpad(_c(depth).cast("string"), 2, "0"))


def gate(width, height, fps, duration, container, listed) -> Column:
    """FLT-01: why a stream is refused; the first failing rule tells; null if accepted."""
    return F.when((_c(width) < 360) | (_c(height) < 360), "too_small").when(_c(fps) < 15, "too_slow").when(_c(duration) > 900, "too_long").when(~_c(container).isin(*listed), "unlisted")


def container_gate(head, accepted) -> Column:
    """FLT-02: bytes too few to tell are ``unrecognised``; else the kind where it is not accepted; null if it is."""
    kind = container_kind(head)
    return F.when(F.octet_length(_c(head)) < 12, "unrecognised").when(~kind.isin(*accepted), kind)


def container_kind(head) -> Column:
    """SRC-01: what the first bytes say, from magic numbers and, for transport streams, sync bytes 188 apart."""
    b = _c(head).cast("binary")
    text = F.hex(F.substring(b, 1, 16))
    at = lambda first, hexed: F.substring(text, 2 * first + 1, len(hexed)) == hexed
    hexed = lambda s: s.encode().hex().upper()
    sync = F.hex(F.substring(b, 1, 1)) == "47"
    return (
        F.when(at(4, hexed("ftyp")) | at(4, hexed("moov")) | at(4, hexed("mdat")), "mp4")
        .when(at(0, "1A45DFA3"), "matroska")
        .when(at(0, hexed("RIFF")) & at(8, hexed("AVI ")), "avi")
        .when(at(0, hexed("RIFF")) & at(8, hexed("WAVE")), "wav")
        .when(at(0, hexed("RIFF")) & at(8, hexed("WEBP")), "webp")
        .when(at(0, hexed("DKIF")), "ivf")
        .when(at(0, hexed("fLaC")), "flac")
        .when(at(0, hexed("OggS")), "ogg")
        .when(at(0, hexed("ID3")), "mp3")
        .when(at(0, "000001BA"), "mpeg_ps")
        .when(at(0, "89504E47"), "png")
        .when(at(0, "FFD8FF"), "jpeg")
        .when(sync & ((F.octet_length(b) < 189) | (F.hex(F.substring(b, 189, 1)) == "47")), "mpeg_ts")
        .otherwise("unknown")
    )


def _cells(luma: str, width: str, height: str, across: int, down: int) -> str:
    """``area_shrink`` as SQL."""
    share = lambda at, step, i: f"(least(({at} + 1) * {step}, {i} + 1D) - greatest({at} * {step}, {i} + 0D))"
    reach = lambda at, step, end: f"sequence(cast(floor({at} * {step}) as int), cast(least(ceil(({at} + 1) * {step}), {end}) as int) - 1)"
    fx, fy = f"(p.w / {across}D)", f"(p.h / {down}D)"
    rows = f"transform(sequence(0, p.h - 1), r -> transform(sequence(0, {across - 1}), c -> aggregate({reach('c', fx, 'p.w')}, 0D, (a, x) -> a + p.y[r * p.w + x] * {share('c', fx, 'x')})))"
    cells = f"transform(sequence(0, {down - 1}), d -> transform(sequence(0, {across - 1}), c -> aggregate({reach('d', fy, 'p.h')}, 0D, (a, r) -> a + s[r][c] * {share('d', fy, 'r')}) / ({fx} * {fy})))"
    # The plane is bound once: an expression that makes it would else run again for each pixel.
    bound = f"array(struct({luma} as y, cast({width} as int) as w, cast({height} as int) as h))"
    return f"transform({bound}, p -> transform(array({rows}), s -> cast(flatten({cells}) as array<float>))[0])[0]"


def area_shrink(luma: str, width: str, height: str, across: int, down: int) -> Column:
    """HSH-04: the plane ``luma`` (numbers, row by row) as ``across`` x ``down`` cells, each the mean of what it covers, parts of a pixel by their share."""
    return F.expr(_cells(luma, width, height, across, down))


def _packed(flags: Column) -> Column:
    """HSH-05: flags as the bits of a long, the first one most significant."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def average_hash(luma: str, width: str, height: str) -> Column:
    """HSH-01: 64 bits: which of 8 x 8 cells are brighter than their mean, in single precision."""
    cells = area_shrink(luma, width, height, 8, 8)
    return F.transform(F.array(cells), lambda c: _packed(F.transform(c, lambda v: v > (F.aggregate(c, F.lit(0.0).cast("float"), lambda a, x: a + x) / 64).cast("float"))))[0]


def difference_hash(luma: str, width: str, height: str) -> Column:
    """HSH-02: 64 bits: which of the first 8 of 9 x 8 cells are darker than the one to their right."""
    cells = area_shrink(luma, width, height, 9, 8)
    right = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.floor(i / 8) * 9 + i % 8)
    return F.transform(F.array(cells), lambda c: _packed(F.transform(right, lambda i: F.get(c, (i + 1).cast("int")) > F.get(c, i.cast("int")))))[0]


def fingerprint(luma: str, width: str, height: str) -> Column:
    """UDF-06: 64 bits of a perceptual hash: which of the 8 x 8 lowest frequencies of 32 x 32 cells are above their median.

    The cosine transform is two products with a constant table: rows, then columns, each sum from the left.
    """
    table = ", ".join(f"array({', '.join(f'{math.cos(math.pi * (2 * n + 1) * k / 64)!r}D' for n in range(32))})" for k in range(8))
    product = lambda value: f"aggregate(sequence(0, 31), 0D, (a, n) -> a + {value})"
    rows = f"transform(sequence(0, 31), y -> transform(sequence(0, 7), k -> {product('cast(p.c[y * 32 + n] as double) * p.b[k][n]')}))"
    low = f"flatten(transform(sequence(0, 7), k -> transform(sequence(0, 7), x -> {product('r[n][x] * p.b[k][n]')})))"
    bits = "aggregate(f, 0L, (a, v) -> shiftleft(a, 1) | if(v > (o[31] + o[32]) / 2D, 1L, 0L))"
    # Each step is bound once, by a transform of an array of one.
    bound = f"transform(array(struct({_cells(luma, width, height, 32, 32)} as c, array({table}) as b)), p -> transform(array({rows}), r -> transform(array({low}), f -> transform(array(array_sort(f)), o -> {bits})[0])[0])[0])[0]"
    return F.expr(bound)
