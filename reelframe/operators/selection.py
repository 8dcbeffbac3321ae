"""Choosing among the rows of a quality sweep, and aggregates over sweeps, devices and reports. One row of each title per candidate."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.picture import ssim_db
from ..session import kept


def sweep_rows(packets: DataFrame, by: list[str], size: str, ssim: str, psnr: str) -> DataFrame:
    """AGG-07: bytes, mean scores, packets, the largest packet and the mean of the others of each candidate."""
    out = packets.groupBy(*by).agg(F.sum(size).alias("bytes"), F.avg(psnr).alias("psnr"), F.avg(ssim).alias("ssim"), F.count("*").alias("packets"), F.max(size).alias("largest"))
    return out.withColumn("mean_other", F.when(F.col("packets") > 1, (F.col("bytes") - F.col("largest")) / (F.col("packets") - 1)).otherwise(0.0))


def _best(rows: DataFrame, title: str, order: list[Column | str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(title).orderBy(*order))).where("_r = 1").drop("_r")


def smallest_above(sweep: DataFrame, title: str, floor: float) -> DataFrame:
    """TOP-01: the fewest bytes with ssim at least ``floor``, the smaller delta on ties."""
    return _best(sweep.where(F.col("ssim") >= floor), title, ["bytes", "delta"])


def base_rows(sweep: DataFrame) -> DataFrame:
    """TOP-02: the row of each title at delta 0."""
    return sweep.where(F.col("delta") == 0)


def within_drop(sweep: DataFrame, title: str, drop: float, floor: float | None = None) -> DataFrame:
    """TOP-03: the fewest bytes no more than ``drop`` dB of ssim below the base row; titles without a base row go."""
    base = base_rows(sweep).select(title, ssim_db("ssim").alias("_base"))
    rows = sweep.join(base, title).where(ssim_db("ssim") >= F.col("_base") - max(0.0, drop)).drop("_base")
    rows = rows if floor is None else rows.where(F.col("ssim") >= floor)
    return _best(rows, title, ["bytes", "delta"])


def cheapest_reaching(sweep: DataFrame, title: str, floor: float) -> DataFrame:
    """TOP-04, TOP-08: the largest delta with ssim at least ``floor``; ``capped`` if it is the last of several candidates."""
    last = sweep.groupBy(title).agg(F.max("delta").alias("_last"), F.count("*").alias("_n"))
    out = _best(sweep.where(F.col("ssim") >= floor), title, [F.desc("delta")]).join(last, title)
    return out.withColumn("capped", (F.col("delta") == F.col("_last")) & (F.col("_n") > 1)).drop("_last", "_n")


def rate_distortion(sweep: DataFrame, title: str, weight: float, samples: Column) -> DataFrame:
    """TOP-05: the least (1 - ssim) + weight * bytes / samples; titles without samples go."""
    cost = (1 - F.col("ssim")) + weight * F.col("bytes") / samples
    return _best(sweep.where(samples > 0).withColumn("cost", cost), title, ["cost", "delta"])


def knee(sweep: DataFrame, title: str) -> DataFrame:
    """TOP-06: the delta after which bytes for each unit of ssim above the floor fall most, the last on ties; titles with two rows or fewer go."""
    w = Window.partitionBy(title)
    price = F.col("bytes") / (F.col("ssim") - (F.min("ssim").over(w) - 0.01))
    rows = sweep.withColumn("_n", F.count("*").over(w)).where("_n >= 3").withColumn("_price", price)
    rows = rows.withColumn("gain", F.lag("_price").over(w.orderBy("delta")) - F.col("_price")).where("gain is not null")
    return _best(rows, title, [F.desc("gain"), F.desc("delta")]).drop("_n", "_price")


def fastest(devices: DataFrame, group: str, rate: str, order: str) -> DataFrame:
    """TOP-09: the device of the highest rate in each group, the earlier on ties."""
    return _best(devices, group, [F.desc(rate), order])


def first_of_each(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """TOP-12: the first ``most`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def smoothed(rows: DataFrame, group: str, order: str, value: str, alpha: float) -> DataFrame:
    """AGG-16: the smoothed value of each group after its last row: the first as it is, then (1 - alpha) of the old and alpha of the new.

    The weight of a row depends on its place from the end alone, so this is one sum: no list of a group is built.
    """
    w = Window.partitionBy(group)
    back = F.row_number().over(w.orderBy(F.desc(order))) - 1
    n = F.count("*").over(w)
    weight = F.when(F.col("_back") == F.col("_n") - 1, F.pow(F.lit(1 - alpha), F.col("_back"))).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("_back")))
    return rows.select(group, value, back.alias("_back"), n.alias("_n")).groupBy(group).agg(F.sum(F.col(value) * weight).alias("smoothed"))


def scaled_weights(devices: DataFrame, group: str, weight: str, measured: str) -> DataFrame:
    """AGG-17: ``rate``: the measured one, or the weight times the mean of measured / weight in the group, 1 where nothing is measured."""
    scale = F.coalesce(F.avg(F.col(measured) / F.col(weight)).over(Window.partitionBy(group)), F.lit(1.0))
    return devices.withColumn("rate", F.coalesce(F.col(measured), F.col(weight) * scale))


def batch_report(outcomes: DataFrame, batch: str, ok: str) -> DataFrame:
    """AGG-10: how many outcomes of each batch are fine, how many failed, and whether all are fine."""
    return outcomes.groupBy(batch).agg(F.count_if(F.col(ok)).alias("fine"), F.count_if(~F.col(ok)).alias("failed"), F.bool_and(F.col(ok)).alias("all_ok"))


def hook_report(records: DataFrame, hook: str, kind: str, verdict: str, error: str) -> DataFrame:
    """AGG-15: records, rejections and errors of each hook and kind."""
    return records.groupBy(hook, kind).agg(F.count("*").alias("records"), F.count_if(F.col(verdict) == "reject").alias("rejected"), F.count_if(F.col(error).isNotNull()).alias("errors"))


def decided(records: DataFrame, subject: str, verdict: str, reason: str, order: str) -> DataFrame:
    """UDF-03: the verdict on each subject: the first rejection with its reason, else accept."""
    first = F.min(F.when(F.col(verdict) == "reject", F.struct(F.col(order).alias("o"), F.col(reason).alias("r"))))
    return records.groupBy(subject).agg(F.when(first.isNotNull(), "reject").otherwise("accept").alias("verdict"), first["r"].alias("reason"))


def one_config(parts: DataFrame, rung: str, order: str, config: str) -> DataFrame:
    """COD-07: the parts of a rung whose configuration is not that of its first part."""
    first = F.first(config).over(Window.partitionBy(rung).orderBy(order))
    return parts.withColumn("_first", first).where(~F.col(config).eqNullSafe(F.col("_first"))).drop("_first")


#: Boxes of a frame that fold in one array; a frame with more goes by a grid.
FOLDED = 512


def _iou(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    w = F.greatest(F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0")), F.lit(0.0))
    h = F.greatest(F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0")), F.lit(0.0))
    area = lambda r: (r("x1") - r("x0")) * (r("y1") - r("y0"))
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-12))


def suppressed(boxes: DataFrame, frame: str, label: str, score: str, overlap: float, most: int | None = None, folded: int = FOLDED) -> DataFrame:
    """TOP-13: boxes (x0, y0, x1, y1) of each frame kept by score, without those that overlap a kept one of their label by more
    than ``overlap`` (from 0 on); ``most`` of a frame over all labels, best first. Of equal scores the smaller coordinates, then label, are better.

    A detector's few hundred boxes of a frame fold in one array. Frames with more than ``folded`` boxes go by ``suppressed_on_grid``: the same rows.
    """
    rows = boxes.select(frame, F.col(label).alias("label"), F.col(score).alias("score"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    large = rows.groupBy(frame).count().where(F.col("count") > folded).select(F.col(frame).alias("_large"))
    if large.isEmpty():
        out = _folded(rows, frame, overlap, most)
    else:
        on = F.col(frame).eqNullSafe(F.col("_large"))
        out = _folded(rows.join(large, on, "left_anti"), frame, overlap, most).unionByName(suppressed_on_grid(rows.join(large, on, "left_semi"), frame, overlap, most))
    return out.select(frame, F.col("label").alias(label), F.col("score").alias(score), "x0", "y0", "x1", "y1")


def _folded(rows: DataFrame, frame: str, overlap: float, most: int | None) -> DataFrame:
    box = F.struct((-F.col("score")).alias("rank"), "x0", "y0", "x1", "y1", "label")
    listed = rows.groupBy(frame).agg(F.array_sort(F.collect_list(box)).alias("all"))
    near = lambda k, b: k["label"].eqNullSafe(b["label"]) & (_iou(lambda c: k[c], lambda c: b[c]) > overlap)
    room = lambda kept: F.lit(True) if most is None else F.size(kept) < most
    fold = F.aggregate("all", F.slice("all", F.lit(1), F.lit(0)), lambda kept, b: F.when(room(kept) & ~F.exists(kept, lambda k: near(k, b)), F.concat(kept, F.array(b))).otherwise(kept))
    return listed.select(frame, F.explode(fold).alias("b")).select(frame, "b.label", (-F.col("b.rank")).alias("score"), "b.x0", "b.y0", "b.x1", "b.y1")


def suppressed_on_grid(rows: DataFrame, frame: str, overlap: float, most: int | None = None) -> DataFrame:
    """TOP-13 for frames of any number of boxes (frame, label, score, x0, y0, x1, y1): pairs by a grid, then rounds of local maxima.

    A box is filed in the cells that it touches of a grid as coarse as its longer side, four at most. Of two boxes that
    overlap by a share s the longer sides differ by 1 / s at most, so the smaller one is looked up in few coarser grids; a
    pair counts in the cell where its common part begins. In each round, boxes without a better undecided neighbour are kept, and
    neighbours of kept ones go. Boxes of no area overlap none. Equal boxes are one first; of others, a place where many overlap gives all their pairs.
    """
    place = F.struct((-F.col("score")).alias("rank"), "x0", "y0", "x1", "y1", "label")
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    same = [frame, "label", "x0", "y0", "x1", "y1"]
    solid = rows.where(~flat).groupBy(*same).agg(F.max("score").alias("score")) if overlap < 1 else rows.where(~flat)
    solid = kept(solid.withColumn("id", F.monotonically_increasing_id()).withColumn("place", place))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    sized = solid.withColumn("level", F.ceil(F.log2(side)).cast("int"))
    levels = [r[0] for r in sized.select("level").distinct().collect()]  # powers of two: some tens
    reach = 4096 if overlap <= 0 else math.ceil(math.log2(1 / overlap)) + 1

    def filed(df: DataFrame) -> DataFrame:
        cell = F.pow(F.lit(2.0), F.col("level"))
        span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
        return df.withColumn("across", F.explode(span("x0", "x1"))).withColumn("down", F.explode(span("y0", "y1")))

    above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: (n >= F.col("level")) & (n <= F.col("level") + reach))
    up = filed(sized.withColumn("own", F.col("level")).withColumn("level", F.explode(above)))
    a, b = filed(sized).alias("a"), up.alias("b")
    here = F.pow(F.lit(2.0), F.col("a.level"))
    first = (F.floor(F.greatest("a.x0", "b.x0") / here) == F.col("a.across")) & (F.floor(F.greatest("a.y0", "b.y0") / here) == F.col("a.down"))
    once = (F.col("b.own") < F.col("a.level")) | (F.col("a.id") < F.col("b.id"))
    on = F.col(f"a.{frame}").eqNullSafe(F.col(f"b.{frame}")) & F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.across") == F.col("b.across")) & (F.col("a.down") == F.col("b.down"))
    near = a.join(b, on).where(first & once & (_iou(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")) > overlap))
    wins = (F.col("a.place") < F.col("b.place")) | ((F.col("a.place") == F.col("b.place")) & (F.col("a.id") < F.col("b.id")))
    edges = kept(near.select(F.when(wins, F.col("a.id")).otherwise(F.col("b.id")).alias("better"), F.when(wins, F.col("b.id")).otherwise(F.col("a.id")).alias("worse")))
    lost = None
    while not edges.isEmpty():
        beaten = edges.select(F.col("worse").alias("better")).distinct()
        tops = edges.join(beaten, "better", "left_anti").select("worse").distinct()  # next to one that nothing undecided beats
        gone = tops.withColumnRenamed("worse", "id")
        lost = gone if lost is None else lost.union(gone)
        left = edges.join(gone, F.col("worse") == F.col("id"), "left_anti").join(gone, F.col("better") == F.col("id"), "left_anti")
        edges, lost = kept(left), kept(lost)
    out = (solid if lost is None else solid.join(lost, "id", "left_anti")).select(*rows.columns).unionByName(rows.where(flat))
    if most is None:
        return out
    best = F.row_number().over(Window.partitionBy(frame).orderBy(place))
    return out.withColumn("_best", best).where(F.col("_best") <= most).drop("_best")
