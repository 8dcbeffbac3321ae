"""Pixel kernels: numpy functions on one 8-bit plane, applied to frame tables in Arrow batches.

A frame is a row with ``width``, ``height`` and the bytes of its luma plane, ``pixels``. Spark deals
the frames out; a kernel sees one plane at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

Kernel = Callable[[np.ndarray], np.ndarray]


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _around(p: np.ndarray, reach: int) -> np.ndarray:
    """Every neighbour of every pixel: (2 reach + 1)^2 shifted planes, edges repeated."""
    wide = np.pad(p.astype(np.float32), reach, mode="edge")
    h, w = p.shape
    return np.stack([wide[y : y + h, x : x + w] for y in range(2 * reach + 1) for x in range(2 * reach + 1)])


def hflip(p: np.ndarray) -> np.ndarray:
    """PIX-03"""
    return p[:, ::-1]


def vflip(p: np.ndarray) -> np.ndarray:
    """PIX-04"""
    return p[::-1]


def invert(p: np.ndarray) -> np.ndarray:
    """PIX-07"""
    return 255 - p


def bilateral(p: np.ndarray, spatial: float = 2.0, tonal: float = 20.0) -> np.ndarray:
    """PIX-12: 5x5, weighted by nearness in place and tone."""
    near = _around(p, 2)
    dy, dx = np.mgrid[-2:3, -2:3]
    weight = np.exp(-(dx**2 + dy**2) / (2 * spatial**2)).reshape(-1, 1, 1) * np.exp(-((near - p) ** 2) / (2 * tonal**2))
    return _bytes((near * weight).sum(axis=0) / weight.sum(axis=0))


def gaussian(p: np.ndarray) -> np.ndarray:
    """PIX-13: 1 4 6 4 1 both ways."""
    taps = np.array([1, 4, 6, 4, 1], np.float32) / 16
    return _bytes((_around(p, 2) * np.outer(taps, taps).reshape(-1, 1, 1)).sum(axis=0))


def median(p: np.ndarray) -> np.ndarray:
    """PIX-14: 3x3."""
    return np.median(_around(p, 1), axis=0).astype(np.uint8)


def blend(kernel: Kernel, strength: float) -> Kernel:
    """PIX-18: so much of the kernel's result, the rest of the source."""
    return lambda p: _bytes(strength * kernel(p).astype(np.float32) + (1 - strength) * p)


def bilinear(w: int, h: int) -> Kernel:
    """SCL-01: pixel centres mapped to pixel centres."""

    def run(p: np.ndarray) -> np.ndarray:
        y, x = np.clip((np.arange(h) + 0.5) * p.shape[0] / h - 0.5, 0, p.shape[0] - 1), np.clip((np.arange(w) + 0.5) * p.shape[1] / w - 0.5, 0, p.shape[1] - 1)
        y0, x0 = y.astype(int), x.astype(int)
        y1, x1 = np.minimum(y0 + 1, p.shape[0] - 1), np.minimum(x0 + 1, p.shape[1] - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        q = p.astype(np.float64)
        return _bytes((q[y0][:, x0] * (1 - fx) + q[y0][:, x1] * fx) * (1 - fy) + (q[y1][:, x0] * (1 - fx) + q[y1][:, x1] * fx) * fy)

    return run


def filtered(frames: DataFrame, chain: Sequence[Kernel]) -> DataFrame:
    """PIX-21: ``frames`` with every plane put through the kernels in turn; width and height follow."""
    ship(frames.sparkSession)
    rest = [c for c in frames.columns if c not in ("width", "height", "pixels")]
    kernels = tuple(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            n = len(rest)
            out = []
            for w, h, data in zip(*(batch.column(n + i).to_pylist() for i in range(3)), strict=True):
                p = np.frombuffer(data, np.uint8).reshape(h, w)
                for k in kernels:
                    p = k(p)
                out.append((p.shape[1], p.shape[0], np.ascontiguousarray(p).tobytes()))
            w, h, data = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(data, pa.binary())], names=[*rest, "width", "height", "pixels"])

    ordered = frames.selectExpr(*rest, "cast(width as int) width", "cast(height as int) height", "pixels")
    return ordered.mapInArrow(run, ordered.schema)
