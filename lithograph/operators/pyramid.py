"""Tile pyramids: level and tile geometry as tables, and the reduction of a raster level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_level(w: Column, h: Column) -> Column:
    """ceil(log2(max(w, h))) in whole numbers: the length of the binary form of max - 1."""
    return F.when(F.greatest(w, h) <= 1, 0).otherwise(F.length(F.bin(F.greatest(w, h) - 1)))


def levels(images: DataFrame, tile: int = 254) -> DataFrame:
    """image_id, level, w, h, cols, rows for level 0 (1 x 1) to the full size."""
    every = images.select("image_id", F.col("width").alias("W"), F.col("height").alias("H"), F.explode(F.sequence(F.lit(0), top_level(F.col("width"), F.col("height")))).alias("level"), top_level(F.col("width"), F.col("height")).alias("top"))
    f = F.expr("shiftleft(1L, top - level)")
    up = lambda a, b: F.floor((a + b - 1) / b).cast("long")
    sized = every.select("image_id", "level", up(F.col("W"), f).alias("w"), up(F.col("H"), f).alias("h"))
    return sized.select("*", up(F.col("w"), F.lit(tile)).alias("cols"), up(F.col("h"), F.lit(tile)).alias("rows"))


def tile_rects(level_table: DataFrame, tile: int = 254, overlap: int = 1) -> DataFrame:
    """image_id, level, col, row, x, y, tw, th: tiles reach over into inner neighbours and end with the level."""
    cells = level_table.select("*", F.explode(F.expr("sequence(0L, cols - 1)")).alias("col")).select("*", F.explode(F.expr("sequence(0L, rows - 1)")).alias("row"))

    def start(i: str) -> Column:
        return F.col(i) * tile - F.when(F.col(i) > 0, overlap).otherwise(0)

    def size(i: str, end: str) -> Column:
        return F.least(F.lit(tile) + F.when(F.col(i) == 0, overlap).otherwise(2 * overlap), F.col(end) - start(i))

    return cells.select("image_id", "level", "col", "row", start("col").alias("x"), start("row").alias("y"), size("col", "w").alias("tw"), size("row", "h").alias("th"))


def tiles_per_level(level_table: DataFrame) -> DataFrame:
    return level_table.select("image_id", "level", (F.col("cols") * F.col("rows")).alias("tiles"))


def single_tile_level(level_table: DataFrame) -> DataFrame:
    """The highest level that is one tile."""
    return level_table.where("cols * rows = 1").groupBy("image_id").agg(F.max("level").alias("level"))


def first_fitting_level(level_table: DataFrame, share: float, tile: int = 254, overlap: int = 1) -> DataFrame:
    """image_id, level: the lowest level whose first tile covers no side of the full image longer than
    floor(sqrt(share * area)); one more than the top level if none does (share 0), level 0 if all may be held (share 1)."""
    sized = level_table.withColumn("top", F.max("level").over(Window.partitionBy("image_id")))  # a row per level
    full = sized.select("*", F.max("w").over(Window.partitionBy("image_id")).alias("full_w"), F.max("h").over(Window.partitionBy("image_id")).alias("full_h"))
    most = F.floor(F.sqrt(F.col("full_w") * F.col("full_h") * F.lit(float(share))))

    def covered(side: str, whole: str) -> Column:
        return F.least(F.least(F.lit(tile + overlap), F.col(side)) * F.expr("shiftleft(1L, top - level)"), F.col(whole))

    fits = (covered("w", "full_w") <= most) & (covered("h", "full_h") <= most)
    found = F.coalesce(F.min(F.when(fits, F.col("level"))), F.max("top") + 1)
    return full.groupBy("image_id").agg((F.lit(0) if share >= 1 else F.max("top") + 1 if share <= 0 else found).cast("int").alias("level"))


def pixel_tiles(pixels: DataFrame, tile: int = 254, overlap: int = 1) -> DataFrame:
    """Pixels with the (col, row) of every full-size tile that has them: 1, 2 or 4."""
    low = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - overlap) / tile))
    high = lambda c, end: F.least(F.floor((F.col(c) + overlap) / tile), F.floor((F.col(end) - 1) / tile))
    return pixels.select("*", F.explode(F.sequence(low("x"), high("x", "width"))).alias("col")).select("*", F.explode(F.sequence(low("y"), high("y", "height"))).alias("row"))


def downsampled(pixels: DataFrame, steps: int) -> DataFrame:
    """Pixels of ``steps`` coarser levels below the given one (step 0): whole-number means of 2 x 2 cells, rounded down.

    Each step is made from the one before. A step shuffles a quarter of the rows before it, after map-side sums.
    """
    now = pixels.select("image_id", F.lit(0).alias("step"), "y", "x", "band", F.col("dn").cast("long").alias("dn"))
    out = now
    for step in range(1, steps + 1):
        cells = now.groupBy("image_id", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), "band").agg(F.sum("dn").alias("s"), F.count(F.lit(1)).alias("n"))
        now = cells.select("image_id", F.lit(step).alias("step"), "y", "x", "band", F.expr("s div n").alias("dn"))
        out = out.unionByName(now)
    return out


def windows_of(rects: DataFrame, window: int, margin: int = 0) -> DataFrame:
    """Requested rectangles (rect_id, x, y, w, h) by the windows of a grid that they meet, with the common part.

    Windows are found from the rectangle's own corners, so no rectangle meets windows that it doesn't overlap. A window
    also holds ``margin`` pixels around it: a rectangle that the window of its middle holds whole is served by that alone.
    """

    def windows(at: str, size: str) -> Column:
        middle = F.expr(f"({at} + {size} div 2) div {window}")
        held = (F.col(at) >= middle * window - margin) & (F.col(at) + F.col(size) <= (middle + 1) * window + margin)
        met = F.expr(f"sequence({at} div {window}, ({at} + {size} - 1) div {window})")
        return F.when(held, F.array(middle)).otherwise(met) if margin else met

    met = rects.select("*", F.explode(windows("x", "w")).alias("wx")).select("*", F.explode(windows("y", "h")).alias("wy"))
    first = lambda at, i: F.greatest(F.col(at), F.col(i) * window - margin)
    last = lambda at, size, i: F.least(F.col(at) + F.col(size), (F.col(i) + 1) * window + margin)
    return met.select(
        "rect_id", "wx", "wy", first("x", "wx").alias("px"), first("y", "wy").alias("py"),
        (last("x", "w", "wx") - first("x", "wx")).alias("pw"), (last("y", "h", "wy") - first("y", "wy")).alias("ph"),
    )


def thumbnail(images: DataFrame, source_w: str, source_h: str, height: int = 160) -> DataFrame:
    """image_id, tw, th of a thumbnail made from a source tile of source_w x source_h."""
    aspect = F.col("width") / F.col("height")
    h = F.greatest(F.lit(1), F.least(F.lit(height), F.col(source_h), F.col("height"))).cast("long")
    w = F.greatest(F.lit(1), F.floor(h * aspect + 0.5)).cast("long")
    bound = F.least(F.col(source_w), F.col("width")).cast("long")
    return images.select("image_id", F.least(w, bound).alias("tw"), F.when(w > bound, F.floor(bound / aspect)).otherwise(h).cast("long").alias("th"))
