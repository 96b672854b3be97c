"""Whole tile pyramids from pixels: blocks of tile size, reduced level by level, given their overlap, and encoded.

A core is a tile without overlap: image_id, full_w, full_h (size of its image), level, col, row, w, h, bands, data (8-bit samples, band by
band). Pixels are packed into cores once; each coarser level is made from four cores of the one below, so it moves a
quarter of its bytes. Levels of one tile are made in the task that has the tile. For the overlap, each core gives its
neighbours the strips they reach into, in one shuffle for all levels.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import png
from .pyramid import top_level

CORE = "image_id string, full_w long, full_h long, level int, col int, row int, w int, h int, bands int, data binary"
NAMES = [c.split()[0] for c in CORE.split(", ")]
TILE = "image_id string, level int, col int, row int, w int, h int, format string, data binary"
#: Image bytes that one core may hold: more bands than this allows don't fit the tile formats.
MOST_BANDS = 4


def halved(cube: np.ndarray) -> np.ndarray:
    """Half the lines and samples, rounded up: whole-number means of what there is of each 2 x 2 cell."""
    bands, h, w = cube.shape
    even = np.pad(cube.astype(np.int64), ((0, 0), (0, h % 2), (0, w % 2)))
    there = np.pad(np.ones((h, w), np.int64), ((0, h % 2), (0, w % 2)))
    cells = lambda a: a.reshape(*a.shape[:-2], a.shape[-2] // 2, 2, a.shape[-1] // 2, 2).sum(axis=(-3, -1))
    return (cells(even) // cells(there)).astype(np.uint8)


def cube_of(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(r.bands, r.h, r.w)


def cores(pixels: DataFrame, images: DataFrame, bands: int, tile: int = 254) -> DataFrame:
    """Cores of the full-size level from 8-bit pixels (image_id, y, x, band, out) and image sizes (image_id, width, height).

    Pixels that don't occur are 0, also where a whole tile has none: the grid of tiles comes from the sizes. A core is one
    group of tile * tile pixels at most.
    """
    if tile % 2 or not 0 < bands <= MOST_BANDS:
        raise ValueError("tiles are even in size and have 1 to 4 bands")
    sized = images.select("image_id", F.col("width").cast("long").alias("full_w"), F.col("height").cast("long").alias("full_h"), top_level(F.col("width"), F.col("height")).cast("int").alias("level"))
    placed = pixels.join(sized, "image_id").select("image_id", "full_w", "full_h", "level", F.expr(f"cast(x div {tile} as int)").alias("col"), F.expr(f"cast(y div {tile} as int)").alias("row"), "y", "x", "band", "out")
    side = lambda size: F.explode(F.sequence(F.lit(0), F.expr(f"cast(({size} - 1) div {tile} as int)")))
    grid = sized.where("full_w > 0 and full_h > 0").select("*", side("full_w").alias("col")).select("*", side("full_h").alias("row"))
    none = lambda name: F.lit(-1).cast(placed.schema[name].dataType).alias(name)
    placed = placed.unionByName(grid.select("image_id", "full_w", "full_h", "level", "col", "row", *map(none, ("y", "x", "band", "out"))))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, W, H, level, col, row = key
        h, w = min(tile, H - row * tile), min(tile, W - col * tile)
        cube = np.zeros((bands, h, w), np.uint8)
        rows = rows[rows["y"] >= 0]
        cube[rows["band"], rows["y"] - row * tile, rows["x"] - col * tile] = rows["out"]
        return pd.DataFrame([(image, W, H, level, col, row, w, h, bands, cube.tobytes())], columns=NAMES)

    return placed.groupBy("image_id", "full_w", "full_h", "level", "col", "row").applyInPandas(pack, CORE)


def is_single(tile: int) -> Column:
    """Whether a core's level is one tile."""
    shrunk = F.expr("shiftleft(1L, greatest(0, cast(ceil(log2(greatest(full_w, full_h))) as int) - level))")
    return (F.col("full_w") <= tile * shrunk) & (F.col("full_h") <= tile * shrunk)


def parents(children: DataFrame, tile: int) -> DataFrame:
    """Cores of the next coarser level."""

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, W, H, level, col, row = key
        at = {(r.col - 2 * col, r.row - 2 * row): cube_of(r) for r in rows.itertuples()}
        w = sum(at[c, 0].shape[2] for c in (0, 1) if (c, 0) in at)
        h = sum(at[0, r].shape[1] for r in (0, 1) if (0, r) in at)
        whole = np.zeros((at[0, 0].shape[0], h, w), np.uint8)
        for (c, r), cube in at.items():
            whole[:, r * tile : r * tile + cube.shape[1], c * tile : c * tile + cube.shape[2]] = cube
        cube = halved(whole)
        return pd.DataFrame([(image, W, H, level, col, row, cube.shape[2], cube.shape[1], cube.shape[0], cube.tobytes())], columns=NAMES)

    up = children.withColumn("up_level", F.col("level") - 1).withColumn("up_col", F.expr("cast(col div 2 as int)")).withColumn("up_row", F.expr("cast(row div 2 as int)"))
    return up.groupBy("image_id", "full_w", "full_h", "up_level", "up_col", "up_row").applyInPandas(join, CORE)


def coarser(single: DataFrame) -> DataFrame:
    """All levels below a level of one core, down to one pixel."""

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                cube, out = cube_of(r), []
                for level in range(r.level - 1, -1, -1):
                    cube = halved(cube)
                    out.append((r.image_id, r.full_w, r.full_h, level, 0, 0, cube.shape[2], cube.shape[1], r.bands, cube.tobytes()))
                yield pd.DataFrame(out, columns=NAMES)

    return single.mapInPandas(shrink, CORE)


def all_levels(top: DataFrame, largest: int, tile: int, folder: str) -> DataFrame:
    """Cores of all levels from those of the full size. ``largest``: the longest side of any image, which tells how many
    times levels are written to ``folder`` (seven for a side of 32,000)."""
    spark, root = top.sparkSession, f"{folder}/levels-{uuid.uuid4().hex}"

    def kept(df: DataFrame, number: int) -> DataFrame:
        df.write.parquet(f"{root}/{number}")
        return spark.read.schema(df.schema).parquet(f"{root}/{number}")

    made = [kept(top, 0)]
    while largest > tile:
        largest = -(-largest // 2)
        made.append(kept(parents(made[-1].where(~is_single(tile)), tile), len(made)))
    every = reduce(DataFrame.unionByName, made)
    return every.unionByName(coarser(every.where(is_single(tile))))


def overlapped(every: DataFrame, tile: int = 254, overlap: int = 1) -> DataFrame:
    """TILE rows (PNG): each core with ``overlap`` pixels of its inner neighbours."""
    piece = CORE + ", x int, y int, tw int, th int"
    names = [c.split()[0] for c in piece.split(", ")]

    def span(i: int, n: int) -> tuple[int, int]:
        return max(0, i * tile - overlap), min(n, (i + 1) * tile + overlap)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                shrunk = 1 << max(0, (max(r.full_w, r.full_h) - 1).bit_length() - r.level)
                w, h, cube = -(-r.full_w // shrunk), -(-r.full_h // shrunk), cube_of(r)
                for col in range(max(0, r.col - 1), min(-(-w // tile), r.col + 2)):
                    for row in range(max(0, r.row - 1), min(-(-h // tile), r.row + 2)):
                        (x0, x1), (y0, y1) = span(col, w), span(row, h)
                        left, top = max(x0, r.col * tile), max(y0, r.row * tile)
                        part = cube[:, top - r.row * tile : y1 - r.row * tile, left - r.col * tile : x1 - r.col * tile]
                        if part.size:
                            out.append((r.image_id, r.full_w, r.full_h, r.level, col, row, part.shape[2], part.shape[1], r.bands, part.tobytes(), left - x0, top - y0, x1 - x0, y1 - y0))
            yield pd.DataFrame(out, columns=names)

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, level, col, row, tw, th = key
        whole = np.zeros((rows["bands"].iloc[0], th, tw), np.uint8)
        for r in rows.itertuples():
            whole[:, r.y : r.y + r.h, r.x : r.x + r.w] = cube_of(r)
        data = png(whole)
        return pd.DataFrame([(image, level, col, row, tw, th, "png", data)], columns=[c.split()[0] for c in TILE.split(", ")])

    return every.mapInPandas(deal, piece).groupBy("image_id", "level", "col", "row", "tw", "th").applyInPandas(draw, TILE)


def tile_pyramid(pixels: DataFrame, images: DataFrame, bands: int, folder: str, tile: int = 254, overlap: int = 1) -> DataFrame:
    """TILE rows of all levels of all images: pixels to encoded tiles."""
    largest = images.agg(F.max(F.greatest("width", "height"))).first()[0] or 1
    return overlapped(all_levels(cores(pixels, images, bands, tile), largest, tile, folder), tile, overlap)
