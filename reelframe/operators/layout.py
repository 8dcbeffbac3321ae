"""How samples lie in a file, and the text of playlists: running sums and run lengths over sorted rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .passes import Scan, walked

# The strength at which a flat area keeps half its state, the difference (as a multiple of the strength) at which retention has
# fallen to 1/e, and entries of the retention table for each code value.
KNEE, EDGE, STEPS = 4.0, 1.5, 8


def interleaved(chunks: DataFrame, asset: str, time: str, track: str, size: str, head: int = 0) -> DataFrame:
    """SNK-02/03: ``place`` of each chunk in the file, by time and then track, and the ``offset`` of its first byte after ``head`` bytes."""
    scan = Scan(chunks, asset, [time, track]).take(place=("sum", F.lit(1)), offset=("sum", F.col(size)))
    return scan.also(place=F.col("place").cast("int"), offset=(F.col("offset") + head).cast("long")).done()


def run_lengths(samples: DataFrame, stream: str, order: str, value: str) -> DataFrame:
    """SNK-04: (stream, run, count, value): equal values in a row, in order."""
    new = F.when(F.col("_was").isNotNull() & F.col("_was.v").eqNullSafe(F.col(value)), 0).otherwise(1)
    scan = Scan(samples.select(stream, order, value), stream, [order]).take(_was=("last", F.struct(F.col(value).alias("v")))).also(_new=new).take(run=("sum", F.col("_new")))
    runs = scan.also(run=F.col("run") + F.col("_new") - 1).done()
    return runs.groupBy(stream, "run").agg(F.count("*").alias("count"), F.first(value).alias(value))


def samples_per_chunk(samples: DataFrame, stream: str, chunk: str) -> DataFrame:
    """SNK-03: (stream, first_chunk, samples): a row wherever the number of samples in a chunk changes; chunks count from 1."""
    sizes = samples.groupBy(stream, chunk).agg(F.count("*").alias("samples"))
    w = Window.partitionBy(stream).orderBy(chunk)
    changed = sizes.withColumn("first_chunk", F.row_number().over(w)).withColumn("_was", F.lag("samples").over(w))
    return changed.where(F.col("_was").isNull() | (F.col("_was") != F.col("samples"))).select(stream, "first_chunk", "samples")


def master_playlist(variants: DataFrame, package: str) -> DataFrame:
    """SNK-09: the master playlist of each package from (package, uri, peak, average, width, height), the highest peak first."""
    line = F.format_string("#EXT-X-STREAM-INF:BANDWIDTH=%d,AVERAGE-BANDWIDTH=%d,RESOLUTION=%dx%d\n%s\n", "peak", "average", "width", "height", "uri")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("peak")).alias("p"), F.col("uri").alias("u"), line.alias("l"))))
    return variants.groupBy(package).agg(F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n"), F.array_join(F.transform(listed, lambda x: x["l"]), "")).alias("playlist"))


def overwritten(outputs: DataFrame, inputs: DataFrame, path: str) -> DataFrame:
    """SNK-17: the outputs that would replace an input: paths are compared without doubled slashes, ``.`` parts and a scheme of ``file``."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "/(\\./)+", "/"), "/+", "/")
    return outputs.withColumn("_p", clean(F.col(path))).join(inputs.select(clean(F.col(path)).alias("_p")).distinct(), "_p", "left_semi").drop("_p")


def carried_state(frames: DataFrame, stream: str, order: str, value: str, strength: float) -> DataFrame:
    """WIN-13 in its linear form: ``smooth``: each value mixed with the smooth one before, out(n) = (1 - s) v(n) + s out(n - 1).

    The recursion is a weighted sum; weights below 1e-12 are left out, so a row looks back over a bounded frame.
    """
    if not 0 < strength < 1:
        return frames.withColumn("smooth", F.col(value).cast("double"))
    import math

    reach = math.ceil(math.log(1e-12) / math.log(strength))
    w = Window.partitionBy(stream).orderBy(order)
    seen = F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-reach, Window.currentRow))
    rows = frames.withColumn("_n", F.row_number().over(w)).withColumn("_seen", seen)
    fold = F.aggregate("_seen", F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("i")), lambda a, x: F.struct(F.when(a["i"] == 0, x).otherwise((1 - strength) * x + strength * a["v"]).alias("v"), (a["i"] + 1).alias("i")), lambda a: a["v"])
    return rows.withColumn("smooth", fold).drop("_n", "_seen")


def denoised(frames: DataFrame, stream: str, order: str, samples: str, strength: float) -> DataFrame:
    """WIN-13: ``smooth``: each sample of a frame blended into the frame before as it came out, less the more they differ.

    out = x + k(|p - x|) (p - x), p the sample before; k(d) falls from strength / (strength + ``KNEE``) with exp(-(d / (``EDGE`` strength))^2), looked up
    in steps of 1 / ``STEPS``, and is 0 from 256 on. The first frame and one of another size start afresh. A stream is one walk, with one
    frame of state. A null frame counts as one without samples.
    """
    curve = np.zeros(256 * STEPS + 1)
    if strength > 0:
        d = (np.arange(256 * STEPS) + 0.5) / STEPS
        curve[:-1] = strength / (strength + KNEE) * np.exp(-((d / (EDGE * strength)) ** 2))

    def walk(state: np.ndarray | None, planes: np.ndarray) -> tuple:
        out = []
        for plane in planes:
            x = np.asarray(plane, np.float64)
            if state is not None and len(state) == len(x):
                apart = state - x
                x = x + curve[np.minimum((np.abs(apart) * STEPS).astype(np.int64), 256 * STEPS)] * apart
            state = x
            out.append(x)
        return state, out

    rows = frames.withColumn("_plane", F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>")))
    return walked(rows, stream, [order], ["_plane"], walk, "smooth array<double>").drop("_plane")
