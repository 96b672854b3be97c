"""Kernels and resized images against plain loops over fractions; rectangles against slices of arrays."""

from fractions import Fraction

import numpy as np
import pytest

from lithograph.operators import rectangles, resample


def weights(n_in, n_out, kind):
    """Weights by their definition, on the line of input places: line j covers [j, j + 1)."""
    scale, out = Fraction(n_in, n_out), {}
    for i in range(n_out):
        for j in range(n_in):
            if kind == "area":
                v = min((i + 1) * scale, Fraction(j + 1)) - max(i * scale, Fraction(j))
            else:
                v = max(scale, Fraction(1)) - abs(j + Fraction(1, 2) - (i + Fraction(1, 2)) * scale)
            if v > 0:
                out[i, j] = v
    sums = {i: sum(v for (k, _), v in out.items() if k == i) for i in range(n_out)}
    return {(i, j): v / sums[i] for (i, j), v in out.items()}


@pytest.mark.parametrize("kind", ["area", "linear"])
def test_kernels(spark, kind):
    pairs = [(1, 1), (1, 5), (5, 1), (7, 3), (3, 7), (8, 4), (4, 8), (9, 9), (13, 12), (0, 4), (4, 0)]
    rows = resample.kernels(spark.createDataFrame(pairs + pairs[:2], "n_in int, n_out int"), kind).collect()
    got = {(r["n_in"], r["n_out"], r["i"], r["j"]): Fraction(r["weight"], r["norm"]) for r in rows}
    assert len(got) == len(rows)
    assert got == {(a, b, i, j): v for a, b in pairs if a and b for (i, j), v in weights(a, b, kind).items()}


@pytest.mark.parametrize("kind", ["area", "linear"])
def test_resized_images(spark, kind):
    cube = np.random.default_rng(3).integers(0, 65536, (2, 9, 7))
    cube[1] = 65535
    pixels = spark.createDataFrame([("a", b, y, x, int(v)) for (b, y, x), v in np.ndenumerate(cube)] + [("a", 0, 99, 99, 5)], "image_id string, band int, y int, x int, dn int")
    for w, h in ((3, 4), (7, 9), (10, 20)):
        sizes = spark.createDataFrame([("a", 7, 9, w, h), ("none", 3, 3, 2, 2)], "image_id string, width int, height int, out_w int, out_h int")
        got = {(r["band"], r["y"], r["x"]): r["dn"] for r in resample.resized(pixels, sizes, kind).collect()}
        kx, ky = weights(7, w, kind), weights(9, h, kind)
        for b in range(2):
            for y in range(h):
                for x in range(w):
                    exact = sum(vy * vx * int(cube[b, j, k]) for (i, j), vy in ky.items() if i == y for (m, k), vx in kx.items() if m == x)
                    assert abs(got.pop((b, y, x)) - exact) <= Fraction(1, 2) + Fraction(1, 1000), (kind, w, h, b, y, x)
        assert not got
    assert resample.resized(pixels.limit(0), sizes, kind).count() == 0


@pytest.mark.parametrize("kind", ["area", "linear"])
def test_shares_are_the_kernels_rows(spark, kind):
    pairs = [(a, b) for a in range(1, 14) for b in range(1, 14)] + [(40, 3), (3, 40), (0, 4), (4, 0)]
    asked = spark.createDataFrame([(a, b, j) for a, b in pairs for j in range(-1, a + 1)], "n_in long, n_out long, j long")
    columns = ["n_in", "n_out", "i", "j", "weight", "norm"]
    got = sorted(map(tuple, resample.with_norm(resample.shares(asked, kind), kind).select(*columns).collect()))
    assert got == sorted(map(tuple, resample.kernels(asked, kind).select(*columns).collect()))


def test_nothing_is_dealt_by_places_of_a_line(spark):
    pixels = spark.createDataFrame([("a", 0, 0, 0, 1)], "image_id string, band int, y int, x int, dn int")
    sizes = spark.createDataFrame([("a", 1, 1, 2, 2)], "image_id string, width int, height int, out_w int, out_h int")
    plan = resample.resized(pixels, sizes)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and all("hashpartitioning(image_id" in line for line in dealt)


def test_rectangles_are_slices(spark):
    cube = np.random.default_rng(4).integers(1, 1000, (2, 23, 31)).astype(">i2")
    rows = []
    for y in range(0, 23, 6):  # blocks of odd sizes that don't follow the grid; one is missing
        for x in range(0, 31, 9):
            if (y, x) != (6, 9):
                rows += [("p", b, y, x, *cube[b, y : y + 6, x : x + 9].shape, ">i2", cube[b, y : y + 6, x : x + 9].tobytes()) for b in range(2)]
    cube[:, 6:12, 9:18] = 0
    blocks = spark.createDataFrame(rows, "path string, band int, y int, x int, h int, w int, dtype string, data binary")
    images = spark.createDataFrame([("p", 31, 23, 2, ">i2"), ("bare", 5, 4, 1, ">i2")], "path string, width int, height int, bands int, dtype string")
    asked = {"all": (0, 0, 31, 23), "one": (30, 22, 1, 1), "over": (-4, -3, 20, 12), "far": (25, 20, 99, 99), "gap": (10, 7, 3, 2), "out": (31, 0, 5, 5), "none": (3, 3, 0, 4), "left": (-9, 0, 9, 5)}
    wanted = spark.createDataFrame([(k, "p", *v) for k, v in asked.items()] + [("bare", "bare", 1, 1, 2, 9), ("lost", "elsewhere", 0, 0, 1, 1), ("null", None, 0, 0, 1, 1)], "rect_id string, path string, x int, y int, w int, h int")
    for cell, lines in ((4, 5), (16, 1), (100, 100)):
        got = {}
        for r in sorted(rectangles.pixels_of(blocks, wanted, images, cell, lines).collect(), key=lambda r: r["strip"]):
            assert r["h"] <= lines and r["y"] == r["strip"] * lines
            got.setdefault((r["rect_id"], r["band"]), []).append(np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"]))
        bare = got.pop(("bare", 0))
        assert np.array_equal(np.concatenate(bare), np.zeros((3, 2)))
        assert {k for k, _ in got} == {"all", "one", "over", "far", "gap"}
        for (name, b), parts in got.items():
            x, y, w, h = asked[name]
            assert np.array_equal(np.concatenate(parts), cube[b, max(0, y) : y + h, max(0, x) : x + w]), (name, cell, lines)
