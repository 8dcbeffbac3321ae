"""Column functions on ticks, frame numbers and rates. Integer in, integer out; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def rescale(value, to, source) -> Column:
    """PRJ-04: ticks of a clock of ``source`` Hz in one of ``to`` Hz, to the nearest, ties up; 0 for a clock of 0 Hz.

    Exact for products beyond 64 bits: the arithmetic is decimal.
    """
    wide = lambda x: _c(x).cast("decimal(19,0)")
    twice = wide(source) * F.lit(2).cast("decimal(2,0)")
    exact = F.floor((wide(value) * wide(to)).cast("decimal(38,0)") / twice.cast("decimal(20,0)") * 2 + 0.5)
    small = F.floor((_c(value) * _c(to) * 2 + _c(source)) / (_c(source) * 2))
    return F.when(_c(source) == 0, 0).when(F.abs(_c(value).cast("double") * _c(to)) < 2**50, small).otherwise(exact).cast("long")


def seconds(ticks, timescale) -> Column:
    """PRJ-03: ticks as seconds; null for a clock of 0 Hz."""
    return _c(ticks) / F.nullif(_c(timescale), F.lit(0))


def decimation_ratio(source_fps, cap_fps) -> Column:
    """SMP-01: cap / source where the cap is positive and truly below the source's rate, else null."""
    s, c = _c(source_fps), _c(cap_fps)
    return F.when((s > 0) & (c > 0) & (c < s * (1 - 1e-6)), c / s)


def frames_out(frame, ratio) -> Column:
    """SMP-02/03: how many frames are out before frame number ``frame`` at a decimation ``ratio``."""
    return F.ceil(_c(frame) * _c(ratio) - 1e-9).cast("long")


def source_of(slot, ratio) -> Column:
    """SMP-05: the source period that output slot ``slot`` shows."""
    return F.ceil(_c(slot) / _c(ratio) - 1e-9).cast("long")


def is_kept(frame, ratio) -> Column:
    """SMP-02: whether a frame is the one that fills a new output slot."""
    return frames_out(_c(frame) + 1, ratio) > frames_out(frame, ratio)


def live_slot(time_100ns, start_100ns, rate_num, rate_den) -> Column:
    """MTH-13: the frame slot nearest to a timestamp, ties away from zero."""
    ticks = (_c(time_100ns) - _c(start_100ns)).cast("long") * _c(rate_num)
    per = _c(rate_den).cast("long") * 10_000_000
    return (F.signum(ticks) * F.floor((F.abs(ticks) * 2 + per) / (per * 2))).cast("long")


def live_place(slot, written, max_gap) -> Column:
    """MTH-14: struct(action, repeats) for a frame of ``slot`` once ``written`` frames are out."""
    ahead = _c(slot) - _c(written)
    action = F.when(F.abs(ahead) > _c(max_gap), "reanchor").when(ahead < 0, "drop").otherwise("write")
    return F.struct(action.alias("action"), F.when(action == "write", ahead).otherwise(0).cast("long").alias("repeats"))


def keyframe_interval(gop_seconds, fps) -> Column:
    """MTH-05/06: frames from one keyframe to the next; two seconds where no length is given."""
    return F.greatest(F.round(F.coalesce(_c(gop_seconds), F.lit(2.0)) * _c(fps)), F.lit(1)).cast("long")


def chunk_frames(interval) -> Column:
    """MTH-19: frames of one chunk of a single file: ten keyframe intervals."""
    return F.greatest(_c(interval) * 10, F.lit(1)).cast("long")


def segments(frames, interval) -> Column:
    """AGG-09: segments of ``interval`` frames that hold ``frames``; 0 without an interval."""
    return F.when(_c(interval) > 0, F.ceil(_c(frames) / _c(interval))).otherwise(0).cast("long")


def new_bucket(index, fps, interval_seconds) -> Column:
    """FLT-10: whether a frame is the first of its ``interval_seconds``; unknown rates count as 30."""
    rate = F.when(_c(fps) > 0, _c(fps)).otherwise(30.0)
    at = lambda i: F.floor(i / rate / _c(interval_seconds) + 1e-9)
    return (_c(index) == 0) | (at(_c(index)) != at(_c(index) - 1))


def clock_text(milliseconds) -> Column:
    """TXT-03: HH:MM:SS.mmm."""
    ms = _c(milliseconds).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000)
    shown = F.when(hours < 100, pad(hours, 2)).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit("."), pad(ms % 1000, 3))


def duration_seconds(text) -> Column:
    """MTH-15: ``90``, ``1.5``, ``250ms`` or a run of h, m and s numbers such as ``1h2m3s``; null for anything else."""
    t = F.lower(F.trim(_c(text)))
    number = r"[0-9]+(?:\.[0-9]+)?"
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(t, rf"({number}){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    run = F.length(t) > 0
    return (
        F.when(t.rlike(rf"^{number}$"), t.try_cast("double"))
        .when(t.rlike(rf"^{number}ms$"), F.regexp_extract(t, rf"^({number})ms$", 1).try_cast("double") / 1000)
        .when(run & t.rlike(rf"^(?:{number}h)?(?:{number}m)?(?:{number}s)?$"), part("h") * 3600 + part("m") * 60 + part("s"))
    )


def bits_per_second(text) -> Column:
    """MTH-15: ``800``, ``800k`` or ``2.5M``; null for anything else."""
    t = F.trim(_c(text))
    value = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)[kKmM]?$", 1)
    unit = F.when(t.rlike("[kK]$"), 1e3).when(t.rlike("[mM]$"), 1e6).otherwise(1.0)
    return F.when(value != "", F.floor(value.try_cast("double") * unit)).cast("long")
