"""Operators on segments, packets and timelines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .passes import Scan, walked


def bandwidth(segments: DataFrame, rendition: str, size: str, seconds: str) -> DataFrame:
    """AGG-01: average and peak bits per second of each rendition; segments without length do not count for the peak, which is never below the average."""
    bits = segments.groupBy(rendition).agg(F.sum(size).alias("_b"), F.sum(seconds).alias("_s"), F.max(F.when(F.col(seconds) > 0, F.floor(F.col(size) * 8 / F.col(seconds)))).alias("_peak"))
    average = F.coalesce(F.when(F.col("_s") > 0, F.floor(F.col("_b") * 8 / F.col("_s"))), F.lit(0))
    return bits.select(rendition, average.cast("long").alias("average"), F.greatest(F.coalesce("_peak", F.lit(0)), average).cast("long").alias("peak"))


def totals(segments: DataFrame, rendition: str, size: str, seconds: str) -> DataFrame:
    """AGG-08: bytes, seconds and number of segments of each rendition."""
    return segments.groupBy(rendition).agg(F.sum(size).alias("bytes"), F.sum(seconds).alias("seconds"), F.count("*").alias("segments"))


def merge_check(parts: DataFrame, rendition: str, sequence: str, agree: list[str]) -> DataFrame:
    """AGG-12, SET-02: what is wrong with the united contributions to each rendition: duplicates, gaps, or fields that disagree."""
    one = [(F.min(c) != F.max(c)).alias(f"_{c}") for c in agree]
    out = parts.groupBy(rendition).agg(F.count("*").alias("n"), F.count_distinct(sequence).alias("_d"), (F.max(sequence) - F.min(sequence) + 1).alias("_span"), *one)
    wrong = F.when(F.col("n") != F.col("_d"), "duplicate").when(F.col("_span") != F.col("_d"), "gap")
    for c in agree:
        wrong = wrong.when(F.col(f"_{c}"), f"disagrees on {c}")
    return out.select(rendition, "n", wrong.alias("problem"))


def composition_offsets(packets: DataFrame, stream: str, arrival: str, pts: str, duration: str) -> DataFrame:
    """WIN-01: offset of each packet: the decode time at its rank by pts, less the decode time at its arrival; streams that repeat a pts give no rows."""
    decoded = Scan(packets, stream, [arrival]).take(_place=("sum", F.lit(1)), _dt=("sum", F.col(duration))).done()
    shown = Scan(decoded, stream, [pts]).take(_rank=("sum", F.lit(1)), _was=("last", F.col(pts))).done()
    twice = shown.where(F.col("_was") == F.col(pts)).select(stream).distinct()
    base = shown.drop("_was").join(twice, stream, "left_anti")
    at = decoded.select(stream, F.col("_place").alias("_rank"), F.col("_dt").alias("_at"))
    return base.join(at, [stream, "_rank"]).withColumn("offset", F.col("_at") - F.col("_dt")).drop("_place", "_rank", "_dt", "_at")


def is_reordered(offsets: DataFrame, stream: str) -> DataFrame:
    """WIN-02: whether any offset of a stream is not 0."""
    return offsets.groupBy(stream).agg(F.bool_or(F.col("offset") != 0).alias("reordered"))


def unwrapped(samples: DataFrame, stream: str, order: str, pts: str, bits: int = 33) -> DataFrame:
    """WIN-03: timestamps that wrap at 2^bits as a continuous count: each step is taken the short way round."""
    full, half = 1 << bits, 1 << (bits - 1)
    step = F.col(pts) - F.col("_was.t")
    turn = F.when(step < -half, 1).when(step > half, -1).otherwise(0)
    scan = Scan(samples, stream, [order]).take(_was=("last", F.struct(F.col(pts).alias("t")))).also(_turn=turn).take(_turns=("sum", F.col("_turn")))
    return scan.also(unwrapped=F.col(pts) + (F.col("_turns") + F.col("_turn")) * F.lit(full)).done("_was", "_turn", "_turns")


def time_base_breaks(samples: DataFrame, stream: str, order: str, time: str, most: int, back: int = 0, flag: str | None = None, bits: int = 33) -> DataFrame:
    """WIN-04: ``segment`` counts up at each ``broken`` row: one whose clock runs back by more than ``back`` or on by more than
    ``most`` from the value before, taken the short way round 2^bits, or that is flagged.

    A null time has no value. A flag breaks only a time base that some value has set; a flagged row without a value
    leaves none behind.
    """
    flagged = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    says = F.when(F.col(time).isNotNull() | flagged, F.struct(F.col(time).alias("t")))  # a value, or that there is none any more
    half, full = F.lit(1 << (bits - 1)), F.lit(1 << bits)
    step = F.pmod(F.col(time) - F.col("_last.t") + half, full) - half
    broken = F.col("_last.t").isNotNull() & (flagged | F.coalesce((step < -back) | (step > most), F.lit(False)))
    scan = Scan(samples, stream, [order]).take(_last=("last", says)).also(broken=broken).take(_before=("sum", F.col("broken").cast("int")))
    return scan.also(segment=F.col("_before") + F.col("broken").cast("int")).done("_last", "_before")


def without_overlap(cues: DataFrame, track: str, start: str, duration: str, tie: str) -> DataFrame:
    """WIN-05: a cue that runs into the next one ends where that begins, and lasts one tick at least; cues of no length go."""
    shorter = F.greatest(F.col("_next") - F.col(start), F.lit(1))
    out = Scan(cues, track, [start, tie]).take(_next=("next", F.col(start))).done().withColumn(duration, F.when(F.col(start) + F.col(duration) > F.col("_next"), shorter).otherwise(F.col(duration)))
    return out.where(F.col(duration) > 0).drop("_next")


def _shown_at(packets: DataFrame, pictures: DataFrame, by: list[str], start: str, duration: str, frame_ticks: int) -> DataFrame:
    """``packets`` with ``_from`` and ``_to``: where the output shows their start and end, by the picture nearest to each; null without pictures.

    ``pictures``: (<by>, pts, frame). One sort of pictures and both ends; of two pictures as near, the earlier.
    """
    ends = packets.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_side")).withColumn("_t", F.when(F.col("_side") == 0, F.col(start)).otherwise(F.col(start) + F.col(duration)))
    both = ends.withColumn("_p", F.lit(None).cast("struct<pts:bigint,frame:bigint>")).unionByName(pictures.select(*by, F.col("pts").cast("long").alias("_t"), F.struct(F.col("pts").cast("long").alias("pts"), F.col("frame").cast("long").alias("frame")).alias("_p")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", F.col("_p").isNull())
    both = both.withColumn("_low", F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_high", F.first("_p", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    near = F.when(F.col("_low").isNull() | (F.col("_high.pts") - F.col("_t") < F.col("_t") - F.col("_low.pts")), F.col("_high")).otherwise(F.col("_low"))
    both = both.where("_side is not null").withColumn("_near", near).withColumn("_shown", F.col("_near.frame") * frame_ticks + F.col("_t") - F.col("_near.pts"))
    return both.groupBy(*packets.columns).agg(F.max(F.when(F.col("_side") == 0, F.col("_shown"))).alias("_from"), F.max(F.when(F.col("_side") == 1, F.col("_shown"))).alias("_to"))


def placed_audio(packets: DataFrame, track: str, order: str, start: str, duration: str, pictures: DataFrame | None = None, frame_ticks: int = 1, breaks: str | None = None, delay: int = 0) -> DataFrame:
    """WIN-06: ``lasts``, ``hole`` and ``dropped`` of each packet (unique in ``track`` and ``order``), walked in order.

    A packet that overlaps the time due by more than half its length is dropped. A hole of more than half a packet before a
    packet makes the kept one before it last longer: by as much as the output shows between both, where
    ``pictures`` (track, breaks, pts, frame: the picture's number in the output) say so, and else as long as it is. After a time-base break
    (a change of ``breaks``) timestamps say nothing about the time before: the audio goes where its video is shown, from the
    first packet that is kept, or on without a hole if there is none. ``delay``: where the track begins, in ticks.
    """
    rows = packets.withColumn("_break", F.col(breaks).cast("long") if breaks else F.lit(0).cast("long"))
    if pictures is None:
        rows = rows.withColumn("_from", F.lit(None).cast("long")).withColumn("_to", F.lit(None).cast("long"))
    else:
        shown = pictures.select(track, F.col(breaks).cast("long").alias("_break") if breaks else F.lit(0).cast("long").alias("_break"), "pts", "frame")
        rows = _shown_at(rows, shown, [track, "_break"], start, duration, frame_ticks)
    rows = rows.withColumn("_seen", F.col("_from").isNotNull())
    filled = [(c, F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))) for c in ("_from", "_to", start, duration)]
    rows = rows.select("*", *(v.alias(f"_v{i}") for i, (_, v) in enumerate(filled)))

    def walk(state: tuple | None, broken: np.ndarray, seen: np.ndarray, begins: np.ndarray, ends: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> tuple:
        current, against, placing, expect, shown, due, kept = state or (None, False, False, 0, 0, delay, False)
        holes, dropped = [], []
        for b, has, begin, end, t, n in zip(*(x.tolist() for x in (broken, seen, begins, ends, times, lengths)), strict=True):
            if current is None:
                current, against, expect = b, has, t
            elif b != current:
                current, against, placing, expect = b, has, has, expect if has else t
            own, off = t - expect, 0
            if against and placing:
                off = begin - due
            elif own > n // 2:
                off = begin - shown if against else own
            late = off < -(n // 2) or (not (against and placing) and own < -(n // 2))
            hole = off if not late and off > n // 2 and kept else 0
            holes.append(hole)
            dropped.append(late)
            if not late:
                placing, kept, due, expect, shown = False, True, due + hole + n, t + n, end
        return (current, against, placing, expect, shown, due, kept), holes, dropped

    out = walked(rows, track, [order], ["_break", "_seen", "_v0", "_v1", "_v2", "_v3"], walk, "hole long, dropped boolean")
    w = Window.partitionBy(track).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    following = F.coalesce(F.first(F.when(~F.col("dropped"), F.col("hole")), ignorenulls=True).over(w), F.lit(0))
    return out.withColumn("lasts", F.when(F.col("dropped"), 0).otherwise(F.col(duration) + following).cast("long")).select(*packets.columns, "lasts", "hole", "dropped")


def trimmed_audio(packets: DataFrame, track: str, order: str, duration: str, start: int, end: int | None) -> DataFrame:
    """AUD-09: the packets that start in [start, end) ticks of their track, with ``at``: where each then starts, from 0 on."""
    out = Scan(packets, track, [order]).take(at=("sum", F.col(duration))).done().where(F.col("at") >= start)
    out = out if end is None else out.where(F.col("at") < end)
    return Scan(out.drop("at"), track, [order]).take(at=("sum", F.col(duration))).done().withColumn("at", F.col("at").cast("long"))


def nearest_boundary(packets: DataFrame, track: str, order: str, duration: str, at: str) -> DataFrame:
    """AUD-09: (track, packets, ticks): the packet boundary nearest to ``at`` (ticks, one value for each track): how many packets lie before it and where it is, the earlier on ties."""
    upto = Scan(packets, track, [order]).take(_n=("sum", F.lit(1)), _t=("sum", F.col(duration))).done()
    ends = upto.select(track, F.col(at).alias("_want"), (F.col("_n") + 1).alias("packets"), (F.col("_t") + F.col(duration)).cast("long").alias("ticks"))
    none = packets.groupBy(track).agg(F.first(at).alias("_want")).select(track, "_want", F.lit(0).cast("long").alias("packets"), F.lit(0).cast("long").alias("ticks"))
    best = F.min_by(F.struct("packets", "ticks"), F.struct(F.abs(F.col("ticks") - F.col("_want")), "packets"))
    return ends.union(none).groupBy(track).agg(best.alias("x")).select(track, "x.*")


def joined_audio(first: DataFrame, second: DataFrame, track: str, order: str, duration: str, end: str, skip: str) -> DataFrame:
    """AUD-09: ``first`` up to the packet boundary nearest to ``end`` and then ``second`` from that nearest to ``skip``, with ``piece`` (0 or 1).

    What the first cut keeps too much or too little moves the second one, so that the error does not add up. ``end`` and
    ``skip`` are ticks, one value for each track.
    """
    kept = nearest_boundary(first, track, order, duration, end).join(first.groupBy(track).agg(F.first(end).alias("_end")), track)
    over = kept.select(track, "packets", (F.col("ticks") - F.col("_end")).alias("_over"))
    number = lambda df: Scan(df, track, [order]).take(_n=("sum", F.lit(1))).also(_n=F.col("_n") + 1).done()
    one = number(first).join(over, track).where(F.col("_n") <= F.col("packets")).drop("_n", "packets", "_over", end).withColumn("piece", F.lit(0))
    moved = second.join(over.drop("packets"), track).withColumn("_skip", F.greatest(F.col(skip) + F.col("_over"), F.lit(0)))
    gone = nearest_boundary(moved, track, order, duration, "_skip").select(track, "packets")
    two = number(second).join(gone, track).where(F.col("_n") > F.col("packets")).drop("_n", "packets", skip).withColumn("piece", F.lit(1))
    return one.unionByName(two)


def cut_on_keyframes(packets: DataFrame, stream: str, order: str, ticks: str, key: str, target: int) -> DataFrame:
    """WIN-07: ``segment``: a keyframe opens a new one once ``target`` ticks or more were buffered since the last cut.

    One walk over the sorted packets of a stream, from cut to cut by bisection. A stream that does not begin with a
    keyframe has one segment: what is buffered would not begin with one. Null ticks and keys count as 0 and no.
    """
    if target <= 0:
        raise ValueError("a segment has a length")

    def walk(state: tuple | None, lasts: np.ndarray, keys: np.ndarray) -> tuple:
        at, since, number, opens = state or (0, 0, 0, bool(keys[0]))
        marks = np.zeros(len(lasts), np.int64)
        starts = at + np.cumsum(lasts) - lasts
        if opens:
            places = np.flatnonzero(keys)
            times, i = starts[places], 0
            while (i := i + int(np.searchsorted(times[i:], since + target))) < len(places):
                marks[places[i]], since = 1, int(times[i])
        segment = number + np.cumsum(marks)
        return (at + int(lasts.sum()), since, int(segment[-1]), opens), segment

    rows = packets.withColumn("_ticks", F.coalesce(F.col(ticks).cast("long"), F.lit(0).cast("long"))).withColumn("_key", F.coalesce(F.col(key), F.lit(False)))
    return walked(rows, stream, [order], ["_ticks", "_key"], walk, "segment long").drop("_ticks", "_key")


def cut_by_length(packets: DataFrame, stream: str, order: str, ticks: str, target: int) -> DataFrame:
    """WIN-08: ``segment``: a packet opens a new one once ``target`` ticks or more were buffered: every packet is a place to cut."""
    return cut_on_keyframes(packets.withColumn("_every", F.lit(True)), stream, order, ticks, "_every", target).drop("_every")


def alignment(segments: DataFrame, rendition: str, sequence: str, seconds: str, tolerance: float = 1e-3, base: str | None = None) -> DataFrame:
    """WIN-09, JON-10: at each boundary, how far any rendition's running seconds lie from the base rendition's, and whether all is aligned.

    ``base``: by default the first rendition in order. ``aligned``: within the tolerance, and all renditions have as
    many segments as the base, so that each boundary has them all.
    """
    running = F.sum(seconds).over(Window.partitionBy(rendition).orderBy(sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.row_number().over(Window.partitionBy(rendition).orderBy(sequence))
    ends = segments.select(rendition, running.alias("_end"), place.alias("boundary"))
    counts = ends.groupBy(rendition).agg(F.count("*").alias("_n"))
    first = F.lit(base) if base is not None else F.min(rendition)
    whole = counts.agg(F.count("*").alias("_all"), (F.min("_n") == F.max("_n")).alias("_even"), first.alias("_base"))  # one row
    marked = ends.join(F.broadcast(whole))
    own = F.max(F.when(F.col(rendition) == F.col("_base"), F.col("_end")))
    out = marked.groupBy("boundary").agg(own.alias("_own"), F.max("_end").alias("_high"), F.min("_end").alias("_low"), F.count("*").alias("renditions"), F.first("_all").alias("_all"), F.first("_even").alias("_even"))
    drift = F.greatest(F.col("_high") - F.col("_own"), F.col("_own") - F.col("_low"))
    aligned = F.col("_even") & (F.col("renditions") == F.col("_all")) & F.coalesce(drift <= tolerance, F.lit(False))
    return out.select("boundary", drift.alias("drift"), "renditions", aligned.alias("aligned"))


def duration_check(pairs: DataFrame, video: str, audio: str, soft: float, hard: float = 120.0) -> DataFrame:
    """WIN-10: ``verdict``: fail beyond ``hard`` seconds apart, warn beyond ``soft``, else ok."""
    apart = F.abs(F.col(video) - F.col(audio))
    return pairs.withColumn("verdict", F.when(apart > hard, "fail").when(apart > soft, "warn").otherwise("ok"))


def rebased(cues: DataFrame, start: str, duration: str, first: int, last: int) -> DataFrame:
    """WIN-15: cues clipped to [first, last) and moved to begin at 0; cues outside go."""
    end = F.least(F.col(start) + F.col(duration), F.lit(last))
    begin = F.greatest(F.col(start), F.lit(first))
    return cues.where((F.col(start) < last) & (F.col(start) + F.col(duration) > first)).withColumn("_e", end).withColumn(start, begin - first).withColumn(duration, F.col("_e") - first - F.col(start)).drop("_e")


def variant_rates(video: DataFrame, audio: DataFrame, subtitles: DataFrame) -> DataFrame:
    """AGG-14: ``video`` (rendition, average, peak) with the largest audio and subtitle rates added. What is joined is one row each."""
    tops = [x.agg(F.coalesce(F.max("average"), F.lit(0)).alias(f"_a{i}"), F.coalesce(F.max("peak"), F.lit(0)).alias(f"_p{i}")) for i, x in enumerate((audio, subtitles))]
    out = video.join(F.broadcast(tops[0])).join(F.broadcast(tops[1]))
    return out.select("rendition", (F.col("average") + F.col("_a0") + F.col("_a1")).alias("average"), (F.col("peak") + F.col("_p0") + F.col("_p1")).alias("peak"))


def playlist_head(target: Column, live: bool, init: str | None) -> Column:
    """The lines before the first segment; ``target``: the target duration as text."""
    return F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:"), target, F.lit(f"\n#EXT-X-PLAYLIST-TYPE:{'EVENT' if live else 'VOD'}\n" + (f'#EXT-X-MAP:URI="{init}"\n' if init else "")))


def media_playlist(segments: DataFrame, rendition: str, sequence: str, seconds: str, uri: str, target: int | None = None, init: str | None = "init.mp4", live: bool = False) -> DataFrame:
    """TXT-18, SNK-10, SNK-11: the text of each rendition's media playlist, its segments in order.

    ``live``: an event playlist of the segments so far, without an end; else the finished one. ``target``: the target
    duration, by default the longest segment's, rounded up. Without ``init``, as for subtitles, there is no map.
    """
    line = F.concat(F.lit("#EXTINF:"), F.format_string("%.6f", F.col(seconds).cast("double")), F.lit(",\n"), F.col(uri), F.lit("\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("s"), line.alias("l")))), lambda x: x["l"]), "")
    longest = F.ceil(F.max(seconds)).cast("string") if target is None else F.lit(str(target))
    head = playlist_head(longest, live, init)
    return segments.groupBy(rendition).agg(F.concat(head, body, F.lit("" if live else "#EXT-X-ENDLIST\n")).alias("playlist"))
