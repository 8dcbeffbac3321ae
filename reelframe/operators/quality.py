"""Quality of a frame against its reference by a sliding window: a stencil over tiles of both planes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Places of the window in a tile, each way: a tile has so many pixels and ten more, which it shares with its neighbours.
TILE = 64
#: The window's size and spread, and the terms that keep quotients of flat areas bounded.
WINDOW, SIGMA, C1, C2 = 11, 1.5, (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _similarity(mx, my, vx, vy, cov):
    return ((2 * mx * my + C1) * (2 * cov + C2)) / ((mx * mx + my * my + C1) * (vx + vy + C2))


def _tiles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each pair of tiles (n, rows, columns), the sum of the similarity over all places of the window; weighted sums down, then across."""
    weights = np.exp(-((np.arange(WINDOW) - WINDOW // 2) ** 2) / (2 * SIGMA * SIGMA))
    weights /= weights.sum()
    rows, columns = x.shape[1] - WINDOW + 1, x.shape[2] - WINDOW + 1

    def mean(v: np.ndarray) -> np.ndarray:
        down = sum(w * v[:, i : i + rows] for i, w in enumerate(weights))
        return sum(w * down[:, :, i : i + columns] for i, w in enumerate(weights))

    mx, my = mean(x), mean(y)
    return _similarity(mx, my, mean(x * x) - mx * mx, mean(y * y) - my * my, mean(x * y) - mx * my).sum(axis=(1, 2))


def windowed_ssim(pairs: DataFrame, on: Sequence[str], reference: str, distorted: str, width: str, height: str, tile: int = TILE) -> DataFrame:
    """AGG-06: (<on>, ssim): the mean similarity of two planes (numbers from 0 to 255, row by row) over all places of an 11 x 11 Gaussian window inside them.

    ``pairs`` has a row for each pair of planes. A pair is cut into tiles, which overlap by the window less one; tiles are
    scored apart and their sums folded by pair, so that a plane of any size is many small tasks. Planes smaller than the window have one
    window, the plane. Planes of other than width x height numbers, nulls included, have no row; without pixels the score is 1.
    """
    ship(pairs.sparkSession)
    w, h, edge = F.col(width).cast("int"), F.col(height).cast("int"), WINDOW - 1
    fits = (F.size(reference) == w * h) & (F.size(distorted) == w * h)
    whole = (w < WINDOW) | (h < WINDOW)
    down = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(h - edge - 1, F.lit(0)), F.lit(tile)))
    across = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(w - edge - 1, F.lit(0)), F.lit(tile)))
    cut = pairs.where(fits).select(*on, reference, distorted, w.alias("_w"), h.alias("_h"), whole.alias("_whole"), across.alias("_across"), F.explode(down).alias("_top")).withColumn("_left", F.explode("_across"))
    cut = cut.withColumn("_rows", F.when(F.col("_whole"), F.col("_h")).otherwise(F.least(F.lit(tile + edge), F.col("_h") - F.col("_top")))).withColumn("_columns", F.when(F.col("_whole"), F.col("_w")).otherwise(F.least(F.lit(tile + edge), F.col("_w") - F.col("_left"))))
    part = lambda c: F.expr(f"if(_rows * _columns = 0, array(), flatten(transform(sequence(0, _rows - 1), r -> slice({c}, (_top + r) * _w + _left + 1, _columns))))").cast("array<double>")
    tiles = cut.select(*on, "_whole", "_rows", "_columns", part(reference).alias("_x"), part(distorted).alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (whole, rows, columns) = batch.columns[: len(on)], (batch.column(len(on) + i).to_numpy(zero_copy_only=False) for i in range(3))
            total, n = np.zeros(batch.num_rows), np.ones(batch.num_rows, np.int64)
            for shape in set(zip(whole.tolist(), rows.tolist(), columns.tolist(), strict=True)):
                here = np.flatnonzero((whole == shape[0]) & (rows == shape[1]) & (columns == shape[2]))
                x, y = (batch.column(len(on) + i).take(pa.array(here)).flatten().to_numpy().reshape(len(here), shape[1], shape[2]) for i in (3, 4))
                if not shape[0]:
                    total[here], n[here] = _tiles(x, y), (shape[1] - edge) * (shape[2] - edge)
                elif shape[1] * shape[2]:
                    mx, my = (v.mean(axis=(1, 2), keepdims=True) for v in (x, y))
                    total[here] = _similarity(*(v.mean(axis=(1, 2)) for v in (mx, my, (x - mx) ** 2, (y - my) ** 2, (x - mx) * (y - my))))
                else:
                    total[here] = 1
            yield pa.RecordBatch.from_arrays([*keys, pa.array(total), pa.array(n)], names=[*on, "total", "n"])

    scored = tiles.mapInArrow(run, tiles.select(*on).schema.add("total", "double").add("n", "long"))
    return scored.groupBy(*on).agg((F.sum("total") / F.sum("n")).alias("ssim"))
