"""Operators on frame tables: edits, trims, decimation, repeats, sampling. Frames are rows in an order within a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timebase as T
from .passes import Scan, steps


def numbered(df: DataFrame, stream: str, order: list[str], into: str = "k") -> DataFrame:
    """A frame number from 0 in each stream."""
    return Scan(df, stream, order).take(**{into: ("sum", F.lit(1).cast("long"))}).done()


def decimated(frames: DataFrame, ratio: Column | float, k: str = "k") -> DataFrame:
    """SMP-02: the frames that fill a new output slot, with the slot's number in ``slot``."""
    return frames.where(T.is_kept(k, ratio)).withColumn("slot", T.frames_out(k, ratio))


def repeated(frames: DataFrame, stream: str, k: str, repeats: str) -> DataFrame:
    """SMP-04: a row for each slot; frame i fills as many slots as it repeats, at least one."""
    times = F.greatest(F.coalesce(F.col(repeats), F.lit(1)), F.lit(1)).cast("long")
    return Scan(frames, stream, [k]).take(first_slot=("sum", times)).done().withColumn("slot", F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + times - 1)))


def repeated_under_cap(frames: DataFrame, stream: str, k: str, repeats: str, ratio: float) -> DataFrame:
    """SMP-05: the output slots of each frame under a frame-rate cap, and the source period that each shows."""
    times = F.greatest(F.coalesce(F.col(repeats), F.lit(1)), F.lit(1)).cast("long")
    out = Scan(frames, stream, [k]).take(_before=("sum", times)).done()
    out = out.withColumn("_a", T.frames_out(F.col("_before"), ratio)).withColumn("_b", T.frames_out(F.col("_before") + times, ratio)).where("_b > _a").drop("_before")
    return out.withColumn("slot", F.explode(F.expr("sequence(_a, _b - 1)"))).withColumn("period", T.source_of("slot", ratio)).drop("_a", "_b")


def presented(frames: DataFrame, hidden: DataFrame, stream: str, k: str = "k", limit: int | None = None) -> DataFrame:
    """FLT-03, JON-02: frames that are not in ``hidden`` (stream, k), with their place among the shown ones; those past ``limit`` are cut.

    The hidden list is joined by key, so a long one is shuffled rather than held.
    """
    shown = numbered(frames.join(hidden.select(stream, k), [stream, k], "left_anti"), stream, [k], "shown")
    return shown if limit is None else shown.where(F.col("shown") < limit)


def trimmed(frames: DataFrame, fps: float, start: float, end: float | None, place: str = "shown") -> DataFrame:
    """FLT-04: the frames from the first at or after ``start`` seconds to the last before ``end``; negative times count as 0."""
    first = F.greatest(F.ceil(F.lit(start * fps)), F.lit(0))
    out = frames.where(F.col(place) >= first)
    return out if end is None else out.where(F.col(place) < F.greatest(F.ceil(F.lit(end * fps)), F.lit(0)))


def joined_clips(frames: DataFrame, stream: str, clip: str, pts: str, duration: str | None = None) -> DataFrame:
    """SMP-06, SET-01: ``frames`` with ``joined``: each clip's timestamps start where the clip before ended."""
    last = F.max(F.col(pts) + (F.col(duration) if duration else F.lit(1)))
    spans = frames.groupBy(stream, clip).agg(F.min(pts).alias("_low"), last.alias("_high"))
    before = Window.partitionBy(stream).orderBy(clip).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_base", F.coalesce(F.sum(F.col("_high") - F.col("_low")).over(before), F.lit(0)))
    return frames.join(spans, [stream, clip]).withColumn("joined", F.col(pts) - F.col("_low") + F.col("_base")).drop("_low", "_high", "_base")


def stills(frames: DataFrame, stream: str, k: str = "k", count: int = 3) -> DataFrame:
    """SMP-07: of each stream, the poster (a tenth in) and ``count`` evenly spread frames; ``pick`` names each."""
    totals = frames.groupBy(stream).agg((F.max(k) + 1).alias("total"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(F.concat(F.lit("still_"), i.cast("string")).alias("pick"), F.least(F.floor(F.col("total") * (i + 0.5) / count), F.col("total") - 1).alias("at")))
    poster = F.array(F.struct(F.lit("poster").alias("pick"), F.least(F.floor(F.col("total") * 0.10), F.col("total") - 1).alias("at")))
    wanted = totals.select(stream, F.explode(F.concat(poster, spread)).alias("x")).select(stream, "x.pick", F.col("x.at").alias(k))
    return frames.join(wanted, [stream, k])


def sample_windows(titles: DataFrame, total: str, frames: int = 180, windows: int = 1, skip: int = 900) -> DataFrame:
    """SMP-08: struct rows (window, start, length) of the sample windows of each title, spread over what the sample may reach."""
    each = -(-max(frames, 1) // max(windows, 1))
    reach = F.greatest(F.least(F.col(total), F.lit(skip + frames)), F.lit(each))
    starts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.floor((reach - each) * (i + 1) / (windows + 1)).cast("long"))
    return titles.withColumn("start", F.explode(F.array_distinct(starts))).withColumn("length", F.lit(each).cast("long"))


def busy_windows(frames: DataFrame, title: str, window: str, blank: str, most: float = 0.5) -> DataFrame:
    """SMP-09, AGG-04: (title, window, blank_fraction) of windows that are not mostly blank; of a title with none, the least blank."""
    share = frames.groupBy(title, window).agg(F.avg(F.col(blank).cast("double")).alias("blank_fraction"))
    first = F.row_number().over(Window.partitionBy(title).orderBy("blank_fraction", window))
    return share.withColumn("_rank", first).where((F.col("blank_fraction") <= most) | (F.col("_rank") == 1)).drop("_rank")


def estimated_fps(samples: DataFrame, stream: str, pts: str, clock: int = 90_000, width: int | None = None) -> DataFrame:
    """SMP-10: clock / median of the positive differences of sorted timestamps, the upper middle for an even number; null outside 1 to 240.

    Differences are taken in buckets of ``width`` ticks (64 seconds by default) and counted by their value, so that no
    stream is one task: only its buckets' bounds and its distinct differences are sorted as a whole.
    """
    counted = steps(samples, stream, pts, width or 64 * clock).groupBy(stream, "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy(stream)
    ranked = counted.withColumn("upto", F.sum("n").over(w.orderBy("step"))).withColumn("all", F.sum("n").over(w))
    middle = ranked.where(F.expr("all div 2 + 1 <= upto and all div 2 + 1 > upto - n"))
    fps = F.lit(float(clock)) / F.col("step")
    return middle.select(stream, F.when(fps.between(1, 240), fps).alias("fps"))


def hook_frames(frames: DataFrame, stream: str, k: str = "k", every: int | None = None, seconds: float | None = None, fps: float = 30.0, most: int | None = None) -> DataFrame:
    """FLT-10: the first frame, or each ``every``-th, or the first of each ``seconds``; ``most`` of a stream at most."""
    test = F.col(k) % every == 0 if every else T.new_bucket(k, F.lit(fps), seconds) if seconds else F.col(k) == 0
    out = frames.where(test)
    if most is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(stream).orderBy(k))).where(F.col("_n") <= most).drop("_n")


def chunked(frames: DataFrame, stream: str, k: str, size: int) -> DataFrame:
    """WIN-12: ``frames`` with ``chunk`` and whether it is the stream's last."""
    chunk = F.floor(F.col(k) / size).cast("long")
    return frames.withColumn("chunk", chunk).withColumn("final", F.col("chunk") == F.max("chunk").over(Window.partitionBy(stream)))
