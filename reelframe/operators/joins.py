"""Operators that match rows of two tables: overlap, nearest, as-of, rules, defaults, hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .passes import Scan, ranked

#: Members of a bucket of hashes that are compared with as many others at once.
BLOCK = 2048


def overlapping(cues: DataFrame, segments: DataFrame, track: str, cue: tuple[str, str], segment: tuple[str, str]) -> DataFrame:
    """JON-01: each cue with each segment of its track that it overlaps (half-open intervals of whole ticks, less than 2^61 from 0; those that end where they start or before have none).

    Bins are nested: level n cuts the line at the multiples of 2^n. A row is filed in the smallest bin that holds it, whatever its
    length; in that bin it covers the middle, so a bin has only rows that overlap one another. The bins of two rows that overlap
    are one and the same, or one lies in the other: the row with the smaller bin is looked up in the bins above it, a
    copy for each level at which the other side has rows. All joins are equi-joins.
    """
    def filed(df: DataFrame, start: str, end: str) -> DataFrame:
        low, high = (F.col(start).cast("long") + F.lit(1 << 62)), (F.col(end).cast("long") - 1 + F.lit(1 << 62))
        apart = low.bitwiseXOR(high)
        level = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))
        return df.where(F.col(end) > F.col(start)).withColumn("_low", low).withColumn("_level", level).withColumn("_bin", F.expr("shiftright(_low, _level)"))

    def looked_up(df: DataFrame, levels: list[int], own: bool) -> DataFrame:
        above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: n >= F.col("_level") if own else n > F.col("_level"))
        return df.withColumn("_level", F.explode(above)).withColumn("_bin", F.expr("shiftright(_low, _level)"))

    left, right = filed(cues, *cue), filed(segments, *segment)
    levels = [sorted(r[0] for r in df.select("_level").distinct().collect()) for df in (left, right)]  # 63 at most
    meets = (F.col(cue[0]) < F.col(segment[1])) & (F.col(cue[1]) > F.col(segment[0]))
    on = [track, "_level", "_bin"]
    down = left.drop("_low").join(looked_up(right, levels[0], own=True).drop("_low"), on)
    up = looked_up(left, levels[1], own=False).drop("_low").join(right.drop("_low"), on)
    return down.unionByName(up).where(meets).drop("_level", "_bin")


def _around(points: DataFrame, targets: DataFrame, stream: str, point: str, target: str) -> DataFrame:
    """``targets`` with the nearest point at or before (``_before``) and at or after (``_after``) each, from one sort of both."""
    both = points.select(stream, F.col(point).alias("_t"), F.col(point).alias("_p"), F.lit(None).cast("boolean").alias("_target")).distinct()
    both = both.union(targets.select(stream, F.col(target).alias("_t"), F.lit(None), F.lit(True)))
    scan = Scan(both, stream, ["_t", "_target"]).take(_before=("last", F.col("_p")), _after=("next", F.col("_p"))).done()
    return scan.where("_target").select(stream, F.col("_t").alias(target), "_before", "_after")


def nearest(points: DataFrame, targets: DataFrame, stream: str, point: str, target: str) -> DataFrame:
    """JON-04: (stream, target, nearest): the point nearest to each target, the earlier on ties; targets without a point go."""
    out = _around(points, targets, stream, point, target)
    before, after = F.col(target) - F.col("_before"), F.col("_after") - F.col(target)
    pick = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (before <= after), F.col("_before")).otherwise(F.col("_after"))
    return out.withColumn("nearest", pick).where("nearest is not null").drop("_before", "_after")


def as_of(points: DataFrame, targets: DataFrame, stream: str, point: str, target: str, lead_in: int = 0) -> DataFrame:
    """JON-05: (stream, target, point): the last point with point + lead_in <= target; null where there is none."""
    shifted = targets.withColumn("_shifted", F.col(target) - lead_in)
    found = _around(points, shifted, stream, point, "_shifted").select(stream, "_shifted", F.col("_before").alias(point)).distinct()
    return shifted.select(stream, target, "_shifted").join(found, [stream, "_shifted"]).drop("_shifted")


#: Lines of a policy in one expression; a longer policy is a chain of them.
RULES = 256


def with_rules(rungs: DataFrame, rules: DataFrame, fields: list[str], position: str = "position", short_side: str = "short_side") -> DataFrame:
    """JON-06: ``rungs`` with what the ``rules`` that select them say, folded in their order; each row stays one row.

    rules: (ord, selector, value, quality_delta, <fields>), selector any, top, below_top, step, short_le
    or short_ge; other selectors select nothing. quality_delta adds up, held within 16 bits at each step; of each other field the last value that is not
    null holds. The rules are a policy, a job's own lines: they become expressions of ``RULES`` lines each, one after the other, without a join.
    """
    lines, kinds = rules.orderBy("ord").collect(), {f.name: f.dataType for f in rules.schema.fields}
    place, side = F.col(position), F.col(short_side)
    tests = {"any": lambda v: F.lit(True), "top": lambda v: place == 0, "below_top": lambda v: place > 0, "step": lambda v: place == v, "short_le": lambda v: side <= v, "short_ge": lambda v: side >= v}
    kept = [c for c in rungs.columns if c not in ("quality_delta", *fields)]
    out = rungs.select(*kept, F.lit(0).alias("quality_delta"), *(F.lit(None).cast(kinds[f]).alias(f) for f in fields))
    for first in range(0, len(lines), RULES):
        some = lines[first : first + RULES]
        applies = [F.coalesce(tests[r["selector"]](r["value"]), F.lit(False)) if r["selector"] in tests else F.lit(False) for r in some]
        delta = F.array(*(F.when(a, F.lit(int(r["quality_delta"] or 0))).otherwise(F.lit(0)) for a, r in zip(applies, some, strict=True))).cast("array<int>")
        total = F.aggregate(delta, F.col("quality_delta"), lambda a, x: F.least(F.greatest(a + x, F.lit(-32768)), F.lit(32767)))
        last = [F.coalesce(*(F.when(a, F.lit(r[f]).cast(kinds[f])) for a, r in reversed(list(zip(applies, some, strict=True))) if r[f] is not None), F.col(f)).alias(f) for f in fields]
        out = out.select(*kept, total.alias("quality_delta"), *last)
    return out


def with_defaults(jobs: DataFrame, defaults: DataFrame, fields: list[str], on: list[str]) -> DataFrame:
    """JON-07: ``jobs`` whose null fields come from the matching row of ``defaults``."""
    named = defaults.select(*on, *(F.col(f).alias(f"_{f}") for f in fields))
    return jobs.join(named, on, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in jobs.columns))


def distinct_placements(rungs: DataFrame, ladder: str, position: str, placement: list[str]) -> DataFrame:
    """JON-08, SET-03: ``rungs`` with ``same_as``: the position of the first rung of the ladder with the same placement, null for that one.

    First positions are folded before the shuffle, so a ladder with a third of all rungs is no single task.
    """
    by = [ladder, *placement]
    first = rungs.groupBy(*by).agg(F.min(position).alias("_first")).select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return rungs.join(first, same, "left").withColumn("same_as", F.when(F.col(position) != F.col("_first"), F.col("_first"))).drop("_first", *(f"_by{i}" for i in range(len(by))))


def hamming_pairs(hashes: DataFrame, key: str, value: str, most: int, parts: int = 4, bits: int = 64) -> DataFrame:
    """JON-09: (a, b, distance) for pairs of hashes that differ in ``most`` bits at most.

    Equal hashes collapse first: pairs are between representatives (the smallest key of each value);
    ``hamming_members`` says which rows stand behind each. The lowest ``bits`` bits are cut into ``parts``; two hashes so near
    differ by most // parts bits at most in one of them, so each hash is filed, for every part, under the values within
    half of that, rounded up, and the two meet. Wide parts make small files: of n random hashes, n / 2^(bits / parts) times the values.
    Files are dealt out in blocks of ``BLOCK`` members and compared block against block. Null keys and hashes are in no pair.
    """
    if not 0 < parts <= bits <= 64 or bits // parts < 1:
        raise ValueError("parts of one bit or more")
    ship(hashes.sparkSession)
    reach = (most // parts + 1) // 2
    edges = [i * bits // parts for i in range(parts + 1)]
    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    filed = []
    for part, (start, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        flips = [sum(1 << i for i in chosen) for n in range(reach + 1) for chosen in combinations(range(start, end), n)]
        own = signed(((1 << (end - start)) - 1) << start)
        filed.append(F.expr(f"transform(array({', '.join(f'{signed(x)}L' for x in flips)}), x -> struct({part} as part, (h & {own}L) ^ x as file))"))

    def pairs_of(rows: pa.RecordBatch) -> pa.RecordBatch:
        """The pairs within runs of rows of the same block pair: each row with the one d places on, for d of 1, 2, ..., all runs at once."""
        by = [rows.column(i).to_numpy() for i in range(4)]
        own, keys, h = rows.column(4).to_numpy(), rows.column(5), rows.column(6).to_numpy().view(np.uint64)
        run = np.cumsum(np.concatenate([[0], np.logical_or.reduce([c[1:] != c[:-1] for c in by])]))
        inside = by[2] == by[3]  # a block with itself: all pairs; two blocks: those across
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)]
        i, d = np.arange(rows.num_rows), 0
        while len(i):
            d += 1
            i = i[i + d < rows.num_rows]
            i = i[run[i] == run[i + d]]
            p = i[inside[i] | (own[i] != own[i + d])]
            differ = np.bitwise_count(h[p] ^ h[p + d])
            close = differ <= most
            found.append((p[close], p[close] + d, differ[close].astype(np.int32)))
        p, q, distance = (np.concatenate(c) for c in zip(*found, strict=True))
        x, y = keys.take(pa.array(p)), keys.take(pa.array(q))
        first = pc.less(x, y)
        return pa.RecordBatch.from_arrays([pc.if_else(first, x, y), pc.if_else(first, y, x), pa.array(distance)], names=["a", "b", "distance"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pa.concat_batches([waiting, batch])
            if not rows.num_rows:
                continue
            same = np.logical_and.reduce([c == c[-1] for c in (rows.column(i).to_numpy() for i in range(4))])
            last = int(same.argmax())  # the last run may go on
            yield pairs_of(rows.slice(0, last))
            waiting = rows.slice(last)
        if waiting is not None:
            yield pairs_of(waiting)

    one = hashes.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(value).cast("long").alias("h")).agg(F.min(key).alias("key"))
    cut = one.select("key", "h", F.inline(F.concat(*filed)))
    large = cut.groupBy("part", "file").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = cut.join(large, ["part", "file"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "h", "part", "file", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    by, kind = ["part", "file", "one", "two"], one.schema["key"].dataType.simpleString()
    dealt = dealt.select("part", "file", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "key", "h")
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(near, f"a {kind}, b {kind}, distance int").distinct()


def hamming_members(hashes: DataFrame, key: str, value: str, pairs: DataFrame) -> DataFrame:
    """JON-09: (key, class_id, links) for every row: the representative of its hash in ``pairs`` (of ``hamming_pairs``) and how many other rows are near.

    Those with the same hash count, and those behind the representatives that pair up with its own. Keys name
    one row each; a null key or hash has no class and no links.
    """
    rows = hashes.select(key, F.when(F.col(key).isNotNull(), F.col(value)).alias("_h"))
    classes = rows.where("_h is not null").groupBy("_h").agg(F.min(key).alias("class_id"), F.count("*").alias("_n"))
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("_other")).union(pairs.select("b", "a"))
    near = both.join(classes.select(F.col("class_id").alias("_other"), "_n"), "_other").groupBy("class_id").agg(F.sum("_n").alias("_near"))
    classes = classes.join(near, "class_id", "left").select("_h", "class_id", (F.col("_n") - 1 + F.coalesce("_near", F.lit(0))).alias("links"))
    return rows.join(classes, "_h", "left").select(key, "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def prerolled(packets: DataFrame, track: str, order: str, start: str, end: str, edit: tuple[int, int], packets_before: int, ticks_before: int) -> DataFrame:
    """JON-03: the packets that an audio edit needs: those that overlap it, and before the first of these as many as fill both prerolls.

    Ticks of preroll count back from where the edit begins, not from the packet that holds it. An empty edit needs none.
    """
    inside = (F.col(start) < edit[1]) & (F.col(end) > edit[0]) & F.lit(edit[0] < edit[1])
    out = Scan(packets, track, [order]).take(_n=("sum", F.lit(1))).done().withColumn("_in", inside)
    first = out.where("_in").groupBy(track).agg(F.min("_n").alias("_first"))
    out = out.join(first, track)
    early = (F.col("_n") < F.col("_first")) & ((F.col("_n") >= F.col("_first") - packets_before) | (F.col(end) > edit[0] - ticks_before))
    return out.where(F.col("_in") | early).withColumn("preroll", ~F.col("_in")).drop("_n", "_in", "_first")


def shifted_windows(video: DataFrame, audio: DataFrame, clip: str) -> DataFrame:
    """JON-11: ``audio`` (clip, start, end) moved by how late the clip's ``video`` (clip, start) begins."""
    late = video.select(clip, F.greatest(F.col("start"), F.lit(0)).alias("_late"))
    return audio.join(late, clip, "left").withColumn("start", F.col("start") - F.coalesce("_late", F.lit(0))).withColumn("end", F.col("end") - F.coalesce("_late", F.lit(0))).drop("_late")


def continued_tracks(joined: DataFrame, clip: DataFrame, language: str, track: str) -> DataFrame:
    """JON-13: (language, place, track, clip_track): the k-th track of a language, by the number ``track``, goes on with the k-th of the clip; either may lack."""
    number = lambda df, name: ranked(df.select(language, track), language, track, "place").select(language, "place", F.col(track).alias(name))
    return number(joined, "track").join(number(clip, "clip_track"), [language, "place"], "full_outer")


def pairwise_error(left: DataFrame, right: DataFrame, on: list[str], samples: str) -> DataFrame:
    """JON-12, AGG-05/06: mse, psnr and single-window ssim of the sample arrays of rows that pair up; different lengths give no score."""
    both = left.select(*on, F.col(samples).alias("_x")).join(right.select(*on, F.col(samples).alias("_y")), on).where(F.size("_x") == F.size("_y"))
    n = F.size("_x").cast("double")
    total = lambda name: F.aggregate(name, F.lit(0.0), lambda a, v: a + v)
    product = lambda a, b: total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    plain = lambda a: total(F.transform(a, lambda v: v.cast("double")))
    both = both.withColumn("_n", n).withColumn("_sx", plain("_x")).withColumn("_sy", plain("_y")).withColumn("_xx", product("_x", "_x")).withColumn("_yy", product("_y", "_y")).withColumn("_xy", product("_x", "_y"))
    from ..functions.picture import psnr

    mse = F.greatest((F.col("_xx") + F.col("_yy") - 2 * F.col("_xy")) / F.col("_n"), F.lit(0.0))
    mx, my = F.col("_sx") / F.col("_n"), F.col("_sy") / F.col("_n")
    vx, vy, cov = F.col("_xx") / F.col("_n") - mx * mx, F.col("_yy") / F.col("_n") - my * my, F.col("_xy") / F.col("_n") - mx * my
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = ((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    return both.select(*on, mse.alias("mse"), psnr(mse).alias("psnr"), ssim.alias("ssim"))


def only_languages(tracks: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """FLT-06: the tracks whose normalised language is wanted."""
    from ..functions.text import normalised_language

    return normalised_language(tracks, column).where(F.col("tag").isin(wanted)).drop("tag", "name")


def without(rows: DataFrame, denied: DataFrame, on: list[str]) -> DataFrame:
    """FLT-07/08: the rows that no line of the deny list names."""
    return rows.join(denied.select(*on).distinct(), on, "left_anti")


def capable(devices: DataFrame, capabilities: DataFrame, codec: str, pixels: Column) -> DataFrame:
    """FLT-11, COD-05: the devices that code ``codec`` at ``pixels``, from a table (device, codec, most)."""
    return devices.join(capabilities.where(F.col("codec") == codec).select("device", "most"), "device").where(pixels <= F.col("most")).drop("most")
