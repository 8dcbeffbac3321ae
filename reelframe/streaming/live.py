"""The live timeline: pictures and sound placed by their timestamps.

Where a picture goes depends on all that was written before it, so a source is a walk over its rows in order of arrival
with a few numbers of state: ``Clock`` and ``Sound`` are the steps, ``sessions`` takes them on streams too. Segments by time are windowed
aggregates behind a watermark.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.passes import walked

#: Ticks of a second on the live clock.
CLOCK = 10_000_000


def nearest(ticks: int, num: int, den: int) -> int:
    """ticks of the live clock as units of den / num seconds, to the nearest, halves away from zero."""
    per = den * CLOCK
    return (abs(ticks) * num * 2 + per) // (per * 2) * (1 if ticks >= 0 else -1)


@dataclass(frozen=True)
class Clock:
    """Frames of ``rate_num / rate_den`` a second; a jump of more than ``max_gap`` frames anchors anew; ``limit``: frames of the output, at most."""

    rate_num: int
    rate_den: int
    max_gap: int
    limit: int | None = None

    def place(self, start: int | None, written: int, t: int) -> tuple[int, int, int, str, int]:
        """(start, written, slot, status, repeats) after a picture of time t: write, drop, reanchor, or over past the limit.

        A gap repeats the picture before; a picture whose frame is written already is dropped; one too far off either
        way moves the start so that it is the next frame.
        """
        if self.limit is not None and written >= self.limit:
            return t if start is None else start, written, written, "over", 0
        start = t if start is None else start
        slot = nearest(t - start, self.rate_num, self.rate_den)
        ahead = slot - written
        if abs(ahead) > self.max_gap:
            back = written * CLOCK * self.rate_den // self.rate_num
            return t - back, written + 1, written, "reanchor", 0
        if ahead < 0:
            return start, written, slot, "drop", 0
        room = ahead + 1 if self.limit is None else self.limit - written
        if ahead >= room:
            return start, written + room, slot, "over", room
        return start, slot + 1, slot, "write", ahead


def timeline(frames: DataFrame, source: str, order: str, time: str, rate_num: int, rate_den: int, max_gap: int, limit: int | None = None) -> DataFrame:
    """STR-01, AGG-11 on a table: ``slot``, ``status``, ``repeats`` and ``start`` (the anchor in use) of each frame, in order of arrival.

    Times are not null. A source is one walk, in bounded memory, as each place depends on the last.
    """
    clock = Clock(rate_num, rate_den, max_gap, limit)

    def walk(state: tuple[int, int] | None, times: np.ndarray) -> tuple:
        start, written = state or (None, 0)
        slots, statuses, repeats, starts = [], [], [], []
        for t in times.tolist():
            start, written, slot, status, again = clock.place(start, written, t)
            slots.append(slot)
            statuses.append(status)
            repeats.append(again)
            starts.append(start)
        return (start, written), slots, statuses, repeats, starts

    return walked(frames, source, [order], [time], walk, "slot long, status string, repeats long, start long")


@dataclass(frozen=True)
class Sound:
    """Samples of ``rate`` a second; drifts up to ``tolerance`` samples stay, beyond ``most`` they are ignored; ``cap``: samples, at most."""

    rate: int
    tolerance: int
    most: int
    cap: int | None = None

    def place(self, written: int, at: int, length: int) -> tuple[int, int, int, int]:
        """(written, silence before, trim at the head, kept) after ``length`` samples that belong at sample ``at``.

        The packet is moved to where the track ends, unless it is early by more than it may be (not at all for the
        first one), or late by more than that and no more than ``most``. What it then covers beyond the track and below the cap is kept.
        """
        slack = self.tolerance if written else 0
        moved = -slack <= at - written <= slack or at - written > self.most
        begin = written if moved else at
        end = written + length if moved else max(at + length, written)
        top = max(end, begin, written) if self.cap is None else max(self.cap, written)
        heard, over = min(max(begin, written), top), min(end, top)
        trim = min(max(written - begin, 0), length)
        return max(heard, over), heard - written, trim, max(over - heard, 0)


def audio_timeline(packets: DataFrame, source: str, order: str, at: str, length: str, tolerance: int, most: int, cap: int | None = None, shape: str | None = None) -> DataFrame:
    """STR-03: ``silence`` before, ``trim`` at the head and ``kept`` samples of each packet, in order of arrival.

    ``at``: the sample where the packet belongs. A gap beyond ``tolerance`` (any, before the first sample) is
    silence; an overlap beyond it (any, before the first sample) is trimmed; a gap of more than ``most`` is ignored, its
    samples are not. A packet of another ``shape`` than the first one's is left out: nothing of it is kept.
    """
    sound = Sound(0, tolerance, most, cap)
    rows = packets.withColumn("_shape", F.coalesce(F.col(shape).cast("string"), F.lit("")) if shape else F.lit(""))

    def walk(state: tuple[int, str | None] | None, ats: np.ndarray, lengths: np.ndarray, shapes: np.ndarray) -> tuple:
        written, first = state or (0, None)
        out: tuple[list, list, list] = ([], [], [])
        for a, n, s in zip(ats.tolist(), lengths.tolist(), shapes.tolist(), strict=True):
            first = s if first is None else first
            found = (written, 0, 0, 0) if s != first else sound.place(written, a, n)
            written = found[0]
            for o, v in zip(out, found[1:], strict=True):
                o.append(v)
        return (written, first), *out

    return walked(rows, source, [order], [at, length, "_shape"], walk, "silence long, trim long, kept long").drop("_shape")


def sound_positions(packets: DataFrame, pictures: DataFrame, source: str, order: str, time: str, rate: int) -> DataFrame:
    """``packets`` with ``at``: the sample where each belongs, from the anchor (``start`` of ``timeline``) in use when it arrived.

    Packets that arrive before the first picture wait for it. One sort of both; no pair of rows is made.
    """
    both = packets.withColumn("_start", F.lit(None).cast("long")).unionByName(pictures.select(source, order, F.col("start").alias("_start")), allowMissingColumns=True)
    w = Window.partitionBy(source).orderBy(order)
    last = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.first("_start", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ticks = (F.col(time) - F.coalesce("_last", "_next")) * rate
    at = F.signum(ticks) * F.floor((F.abs(ticks) * 2 + CLOCK) / (2 * CLOCK))
    return both.withColumn("_last", last).withColumn("_next", following).where("_start is null").withColumn("at", at.cast("long")).drop("_start", "_last", "_next")


def shape_changes(frames: DataFrame, source: str, order: str, width: str, height: str, kind: str) -> DataFrame:
    """STR-06: of written frames: ``out_width`` and ``out_height`` (of the source's first one), ``rescaled`` to these, and ``renewed`` where ``kind`` (format and colour) is not that of the frame before."""
    w = Window.partitionBy(source).orderBy(order)
    first = {c: F.first(c).over(w) for c in (width, height)}
    out = frames.withColumn("out_width", first[width]).withColumn("out_height", first[height])
    renewed = F.when(F.row_number().over(w) > 1, ~F.col(kind).eqNullSafe(F.lag(kind).over(w))).otherwise(F.lit(False))
    return out.withColumn("rescaled", (F.col(width) != F.col("out_width")) | (F.col(height) != F.col("out_height"))).withColumn("renewed", renewed)


def timed_segments(frames: DataFrame, source: str, time: str, length: str, late: str = "30 seconds", value: str | None = None) -> DataFrame:
    """STR-04: frames of each source in windows of ``length``, on a table or a stream; later rows than ``late`` are left out of a stream."""
    rows = frames.withWatermark(time, late) if frames.isStreaming else frames
    more = [F.sum(value).alias("total")] if value else []
    out = rows.groupBy(F.window(time, length), source).agg(F.count("*").alias("frames"), *more)
    return out.select(source, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "frames", *(["total"] if value else []))


def live_stats(placed: DataFrame, source: str) -> DataFrame:
    """AGG-11: of each source, the frames of the output, those repeated, and pictures dropped early or behind."""
    written = F.col("status").isin("write", "reanchor")
    return placed.groupBy(source).agg(
        (F.count_if(written) + F.sum("repeats")).alias("frames"), F.sum("repeats").alias("repeated"), F.count_if(F.col("status") == "drop").alias("dropped_early"), F.count_if(F.col("status") == "behind").alias("dropped_behind"), F.count_if(F.col("status") == "reanchor").alias("reanchored")
    )


def read_arriving(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """SRC-30: Parquet files as they arrive, so many in a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def repeated_source(frames: DataFrame, time: str, length: int, times: int) -> DataFrame:
    """SRC-30: a file played ``times`` times: copies of its rows, each ``length`` ticks later than the one before, with ``round``."""
    rounds = F.sequence(F.lit(0), F.lit(times - 1))
    return frames.withColumn("round", F.explode(rounds)).withColumn(time, F.col(time) + F.col("round") * F.lit(length))


def publish(stream: DataFrame, path: str, checkpoint: str, by: str) -> Any:
    """SNK-21: append what is new below ``path`` for each value of ``by``; the batch number makes a repeated batch overwrite itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
