"""Images at other sizes, both smaller and larger, by separable kernels that are tables of whole numbers.

A kernel's row tells how much an input line counts for an output line. Weights are whole numbers (distances and overlaps in
units of 1 / (2 * output length)), and values between the two axes are whole multiples of 1 / 65536, so results don't hang on
the order in which rows are added. ``kernels`` gives them as a table; ``resized`` reckons for each input line which output lines
it counts for, so nothing is dealt by the few places of a line. Pixels are dealt once, by image, band and line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.images import dealt_over

#: First and last input line (before they are cut to the image), and the weight of input line j for output line i.
KINDS = {
    "area": ("i * n_in div n_out", "((i + 1) * n_in - 1) div n_out", "least((i + 1) * n_in, (j + 1) * n_out) - greatest(i * n_in, j * n_out)"),
    "linear": (
        "((2 * i + 1) * n_in - n_out - 2 * greatest(n_in, n_out)) div (2 * n_out)", "((2 * i + 1) * n_in - n_out + 2 * greatest(n_in, n_out)) div (2 * n_out)",
        "2 * greatest(n_in, n_out) - abs(2 * n_out * j + n_out - (2 * i + 1) * n_in)",
    ),
}
#: First and last output line i that input line j may count for, and the sum of the weights of output line i: the triangle's
#: two sides are arithmetic series from lo to m and from m + 1 to hi.
SHARES = {
    "area": ("j * n_out div n_in", "((j + 1) * n_out - 1) div n_in", "n_in"),
    "linear": (
        "greatest(0L, ((2 * j + 1) * n_out - n_in - 2 * greatest(n_in, n_out)) div (2 * n_in))", "least(n_out - 1, ((2 * j + 1) * n_out - n_in + 2 * greatest(n_in, n_out)) div (2 * n_in))",
        "(m - lo + 1) * (t - c + n_out * (lo + m)) + (hi - m) * (t + c - n_out * (m + 1 + hi))",
    ),
}
#: Parts of a value that are kept between the axes.
PARTS = 65536


def kernels(lengths: DataFrame, kind: str = "area") -> DataFrame:
    """n_in, n_out, i, j, weight, norm (sum of i's weights) for each pair of lengths (n_in, n_out) above 0.

    ``area`` counts each input line by its overlap with the output line; ``linear`` by a triangle as wide as the coarser of
    the two grids, cut at the image's edge. Line centers are aligned.
    """
    first, last, weight = KINDS[kind]
    pairs = lengths.where("n_in > 0 and n_out > 0").select(F.col("n_in").cast("long"), F.col("n_out").cast("long")).distinct()
    lines = pairs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_out") - 1)).alias("i"))
    told = F.expr(f"filter(transform(sequence(greatest(0L, {first}), least(n_in - 1, {last})), j -> struct(j, {weight} as weight)), p -> p.weight > 0)")
    rows = lines.withColumn("parts", told).withColumn("norm", F.expr("aggregate(parts, 0L, (s, p) -> s + p.weight)"))
    return rows.select("n_in", "n_out", "i", "norm", F.inline("parts"))


def shares(rows: DataFrame, kind: str = "area") -> DataFrame:
    """Rows with n_in, n_out and input line j by the output lines i that it counts for, with its weight; lines outside 0 to
    n_in - 1 and lengths below 1 give no row."""
    first, last, _ = SHARES[kind]
    inside = rows.where("n_in > 0 and n_out > 0 and j >= 0 and j < n_in")
    return inside.select("*", F.explode(F.expr(f"sequence({first}, {last})")).alias("i")).select("*", F.expr(KINDS[kind][2]).alias("weight")).where("weight > 0")


def with_norm(rows: DataFrame, kind: str = "area") -> DataFrame:
    """Rows with n_in, n_out and output line i, with norm: the sum of the weights of i."""
    if kind == "area":
        return rows.withColumn("norm", F.expr(SHARES[kind][2]))
    told = rows.withColumns({"c": F.expr("(2 * i + 1) * n_in - n_out"), "t": F.expr("2 * greatest(n_in, n_out)")})
    told = told.withColumns({"lo": F.expr("greatest(0L, (c - t + 2 * n_out - 1) div (2 * n_out))"), "hi": F.expr("least(n_in - 1, (c + t) div (2 * n_out))")})
    told = told.withColumn("m", F.expr("least(hi, greatest(lo - 1, case when c < 0 then -1L else c div (2 * n_out) end))"))
    return told.withColumn("norm", F.expr(SHARES[kind][2])).drop("c", "t", "lo", "hi", "m")


def resized(pixels: DataFrame, sizes: DataFrame, kind: str = "area") -> DataFrame:
    """image_id, band, y, x, dn of pixels (image_id, band, y, x, dn: 0 to 65535) at the sizes (image_id, width, height, out_w,
    out_h); halves are rounded up. Pixels that don't occur count as 0, pixels outside their image not at all; images without
    a pixel or a size give no row, and repeated pixels are added."""
    sized = sizes.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("width", "height", "out_w", "out_h")])
    placed = pixels.select("image_id", "band", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("dn").cast("long").alias("dn")).join(sized, "image_id")
    line = ["image_id", "band", "y", "height", "out_h"]
    dealt = placed.repartition(dealt_over(pixels.sparkSession), "image_id", "band", "y").select(*line, F.col("width").alias("n_in"), F.col("out_w").alias("n_out"), F.col("x").alias("j"), "dn")
    across = shares(dealt, kind).groupBy(*line, "n_in", "n_out", "i").agg(F.sum(F.expr("dn * weight")).alias("s"))
    lines = with_norm(across, kind).select("image_id", "band", F.col("height").alias("n_in"), F.col("out_h").alias("n_out"), F.col("y").alias("j"), F.col("i").alias("ox"), F.expr(f"s * {PARTS} div norm").alias("v"))
    down = shares(lines, kind).groupBy("image_id", "band", "n_in", "n_out", "i", "ox").agg(F.sum(F.expr("v * weight")).alias("s"))
    return with_norm(down, kind).select("image_id", "band", F.col("i").alias("y"), F.col("ox").alias("x"), F.expr(f"(2 * s + {PARTS} * norm) div (2 * {PARTS} * norm)").alias("dn"))
