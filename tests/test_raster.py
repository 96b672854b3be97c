"""Statistics and stretches against plain Python on small random rasters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lithograph.operators import raster


def stretch_bounds(bands, bins, low, high):
    """Percent stretch by the loop it is defined by; bands are lists of bin counts; integer bins of width 1."""
    lit = [sum(bands[0]) - b[0] for b in bands]
    while True:
        if low == 0 and high == 0:
            return 0.0, bins - 1.0
        quotas = [(math.floor(low * n), math.floor(high * n)) for n in lit]
        a, b = 0.0, bins - 1.0
        if max(q for q, _ in quotas) > 0:
            sums = [0] * len(bands)
            for i in range(1, bins):
                sums = [s + h[i] for s, h in zip(sums, bands)]
                if any(s >= q for s, (q, _) in zip(sums, quotas)) or i == bins - 1:
                    a = float(i)
                    break
        if max(q for _, q in quotas) > 0:
            sums = [0] * len(bands)
            for i in range(bins - 1, 0, -1):
                sums = [s + h[i] for s, h in zip(sums, bands)]
                if any(s >= q for s, (_, q) in zip(sums, quotas)) or i == 1:
                    b = float(i)
                    break
        if a == b:
            a, b = (max(0.0, a - 1), b) if a >= 1 else (a, b + 1)
        if b > a:
            return a, b
        low, high = (x / 2 if x > 0.0005 else 0.0 for x in (low, high))


def test_percent_bounds_follow_the_loop(spark):
    rng, rows, expected = random.Random(7), [], {}
    for image in range(40):
        bands = []
        for band in range(rng.choice([1, 3])):
            counts = [0] * 16
            counts[0] = rng.choice([0, 50, 5000])
            for _ in range(rng.choice([1, 2, 12])):
                counts[rng.randrange(16)] += rng.choice([1, 3, 200, 2000])
            bands.append(counts)
            rows += [(str(image), band, i, n) for i, n in enumerate(counts) if n]
        expected[str(image)] = stretch_bounds(bands, 16, 0.02, 0.05)
    hist = spark.createDataFrame(rows, "image_id string, band int, bin int, cnt long")
    got = {r["image_id"]: (r["lo"], r["hi"]) for r in raster.percent_bounds(hist, 16, 0.0, 16.0, 2.0, 5.0).collect()}
    assert got == {k: v for k, v in expected.items() if k in got} and set(got) >= {r[0] for r in rows if r[1] == 0}


def test_extrema_leave_nan_out_and_are_repaired(spark):
    nan = float("nan")
    pixels = spark.createDataFrame([("a", 0, nan), ("a", 0, 3.0), ("a", 0, -1.0), ("a", 1, nan), ("a", 2, float("inf"))], "image_id string, band int, dn double")
    got = {r["band"]: (r["mn"], r["mx"]) for r in raster.repaired_extrema(raster.extrema(pixels)).collect()}
    assert got == {0: (-1.0, 3.0), 1: (0.0, 0.0), 2: (0.0, 0.0)}


def test_histogram_counts_what_is_in_range(spark):
    pixels = spark.createDataFrame([("a", 0, v) for v in (-1, 0, 7, 7, 15, 16, 99)], "image_id string, band int, dn int")
    assert {(r["bin"], r["cnt"]) for r in raster.histogram(pixels, 4).collect()} == {(0, 1), (7, 2), (15, 1)}
    filled = raster.zero_filled(raster.histogram(pixels, 4), 16)
    assert filled.count() == 16 and filled.agg(F.sum("cnt")).first()[0] == 4


@pytest.mark.parametrize("v, expected", [(0, 0), (10, 0), (11, 28), (18, 226), (19, 255), (400, 255)])
def test_stretch_truncates_and_includes_its_ends(spark, v, expected):
    df = spark.createDataFrame([(v, 10.0, 19.0)], "v int, lo double, hi double")
    assert df.select(raster.stretched(F.col("v"), F.col("lo"), F.col("hi"))).first()[0] == expected


def test_mask_needs_every_band(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 3.0],), ([0.0, 2.0],), ([0.0, 0.0],)], "bands array<double>")
    masked = lambda black: [r[0] for r in df.select(raster.masked(F.col("bands"), [[1.0, 2.0]], black)).collect()]
    assert masked(False) == [True, False, False, False] and masked(True) == [True, False, True, True]
