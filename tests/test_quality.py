"""Sliding-window similarity and fingerprints against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.functions import picture
from reelframe.operators import joins, quality

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def plain_ssim(x, y, w, h):
    """Every place of the window by itself, deviations from its own means."""
    x, y = (np.array(v, float).reshape(h, w) for v in (x, y))
    k = np.array([math.exp(-((i - 5) ** 2) / 4.5) for i in range(11)])
    k = np.outer(k, k) / (k.sum() ** 2)
    if w < 11 or h < 11:
        if not w * h:
            return 1.0
        places, k = [(x, y)], np.full((h, w), 1 / (w * h))
    else:
        places = [(x[r : r + 11, c : c + 11], y[r : r + 11, c : c + 11]) for r in range(h - 10) for c in range(w - 10)]
    out = []
    for a, b in places:
        ma, mb = (k * a).sum(), (k * b).sum()
        va, vb, cov = (k * (a - ma) ** 2).sum(), (k * (b - mb) ** 2).sum(), (k * (a - ma) * (b - mb)).sum()
        out.append((2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2)))
    return sum(out) / len(out)


@pytest.mark.parametrize("tile", [8, 64])
def test_ssim_over_all_windows(spark, tile):
    rng = random.Random(tile)
    made = []
    for i, (w, h) in enumerate([(11, 11), (12, 30), (37, 23), (18, 19), (64, 11), (80, 75), (10, 40), (40, 7), (1, 1), (0, 0), (0, 5)]):
        x = [float(rng.randint(0, 255)) for _ in range(w * h)]
        y = [min(255.0, max(0.0, v + rng.randint(-30, 30))) for v in x]
        made.append((i, w, h, x, x if i == 3 else y))
    made += [(90, 20, 20, [1.0] * 399, [1.0] * 400), (91, 20, 20, None, [1.0] * 400), (92, 20, 20, [0.0] * 400, [255.0] * 400)]
    df = spark.createDataFrame(made, "id int, w int, h int, x array<double>, y array<double>").repartition(3)
    got = {r["id"]: r["ssim"] for r in quality.windowed_ssim(df, ["id"], "x", "y", "w", "h", tile).collect()}
    assert set(got) == {*range(11), 92} and got[3] == pytest.approx(1)
    for i, w, h, x, y in made:
        if i in got:
            assert got[i] == pytest.approx(plain_ssim(x, y, w, h), abs=1e-6)


def plain_fingerprint(luma, w, h):
    """Cells by area, cosine sums, the median of 64."""
    cells = np.zeros((32, 32), np.float32)
    for d in range(32):
        for a in range(32):
            total = area = 0.0
            for r in range(int(d * h / 32), h):
                for c in range(int(a * w / 32), w):
                    share = max(0.0, min((d + 1) * h / 32, r + 1) - max(d * h / 32, r)) * max(0.0, min((a + 1) * w / 32, c + 1) - max(a * w / 32, c))
                    total, area = total + share * luma[r * w + c], area + share
            cells[d, a] = total / area
    basis = [[math.cos(math.pi * (2 * n + 1) * k / 64) for n in range(32)] for k in range(8)]
    low = [sum(sum(float(cells[y, x]) * basis[kx][x] for x in range(32)) * basis[ky][y] for y in range(32)) for ky in range(8) for kx in range(8)]
    median = sum(sorted(low)[31:33]) / 2
    return "".join("1" if v > median else "0" for v in low)


def test_fingerprints_and_their_neighbours(spark):
    rng = random.Random(2)
    made = []
    for i, (w, h) in enumerate([(33, 47), (32, 32), (40, 35), (70, 51)]):
        made.append((i, w, h, [float(rng.randint(0, 255)) for _ in range(w * h)]))
    for i in range(1, 6):  # the first one with a corner brighter and brighter
        made.append((10 + i, 33, 47, [min(255.0, v + 8 * i) if n < 300 else v for n, v in enumerate(made[0][3])]))
    df = spark.createDataFrame(made, "id int, w int, h int, y array<double>").withColumn("hash", picture.fingerprint("y", "w", "h"))
    got = {r["id"]: r["bits"] for r in df.select("id", F.lpad(F.bin("hash"), 64, "0").alias("bits")).collect()}
    assert got == {i: plain_fingerprint(y, w, h) for i, w, h, y in made}
    apart = {(a, b): sum(x != y for x, y in zip(got[a], got[b], strict=True)) for a in got for b in got if a < b}
    first = {i: min(j for j in got if got[j] == got[i]) for i in got}
    want = {(a, b, n) for (a, b), n in apart.items() if 0 < n <= 10 and (first[a], first[b]) == (a, b)}
    assert {(r["a"], r["b"], r["distance"]) for r in joins.hamming_pairs(df, "id", "hash", 10, 5).collect()} == want and want


def test_a_hash_binds_its_plane_once(spark):
    """An expression that makes the plane stands once in the plan, however many pixels are read."""
    made = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * 37 + F.col("id")) % 251).alias("y"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    plan = made.select("id", picture.difference_hash("y", "w", "h").alias("hash"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("251") == 1
