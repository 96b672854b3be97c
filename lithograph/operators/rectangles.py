"""Pixels of requested rectangles, copied as slices of blocks: no pixel is ever a row.

Blocks and rectangles meet by the cells of a grid that both touch, each pair once. What a block gives to a rectangle is cut
into strips of some lines, and strips are put together on their own, so that a task holds a strip, however large a rectangle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "rect_id string, band int, strip int, y int, x int, h int, w int, rect_w int, strip_h int, dtype string, data binary"
STRIP = "rect_id string, band int, strip int, y int, h int, w int, dtype string, data binary"
#: Bytes of data after which a batch of rows is passed on.
MOST_BYTES = 1 << 24


def batched(rows: Iterator[dict], fields: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most 1,000, or of some more than MOST_BYTES of data."""
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in fields.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["data"])
        if len(held) == 1000 or size > MOST_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def clipped(rectangles: DataFrame, images: DataFrame) -> DataFrame:
    """rect_id, path, x, y, w, h of rectangles cut to their images (path, width, height), with ``bands`` and ``dtype``; those
    outside their image are left out."""
    sized = images.select("path", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "bands", "dtype")
    met = rectangles.select(F.col("rect_id").cast("string").alias("rect_id"), "path", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h")]).join(sized, "path")
    right, below = F.least(F.col("x") + F.col("w"), F.col("width")), F.least(F.col("y") + F.col("h"), F.col("height"))
    cut = met.select("rect_id", "path", F.greatest("x", F.lit(0)).alias("x0"), F.greatest("y", F.lit(0)).alias("y0"), right.alias("x1"), below.alias("y1"), "bands", "dtype")
    return cut.where("x1 > x0 and y1 > y0").selectExpr("rect_id", "path", "cast(x0 as int) x", "cast(y0 as int) y", "cast(x1 - x0 as int) w", "cast(y1 - y0 as int) h", "bands", "dtype")


def pixels_of(blocks: DataFrame, rectangles: DataFrame, images: DataFrame, cell: int = 256, lines: int = 256) -> DataFrame:
    """STRIP rows of rectangles (rect_id, path, x, y, w, h) from blocks (path, band, y, x, h, w, dtype, data) and images (path,
    width, height, bands, dtype).

    ``y`` counts from the rectangle's top (cut to the image), ``data`` holds h lines of w samples. Pixels of no block are 0;
    of two blocks that overlap, either counts. ``rect_id`` must tell rectangles apart. ``cell`` should be about a block's side.
    """
    asked = clipped(rectangles, images)
    cells = lambda at, size, name: F.explode(F.sequence(F.expr(f"{at} div {cell}"), F.expr(f"({at} + {size} - 1) div {cell}"))).alias(name)
    wanted = asked.select("rect_id", "path", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"), cells("y", "h", "cy")).select("*", cells("rx", "rw", "cx"))
    given = blocks.where("h > 0 and w > 0").select("path", "band", "y", "x", "h", "w", "dtype", "data", cells("y", "h", "cy")).select("*", cells("x", "w", "cx"))
    met = wanted.join(given, ["path", "cy", "cx"]).where("ry < y + h and y < ry + rh and rx < x + w and x < rx + rw")
    once = met.where(f"cy = greatest(ry, y) div {cell} and cx = greatest(rx, x) div {cell}").drop("path", "cy", "cx")  # the cell where their overlap begins

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[dict]:
            for r in (r for batch in batches for r in batch.to_pylist()):
                block = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"])
                x0, x1 = max(r["rx"], r["x"]), min(r["rx"] + r["rw"], r["x"] + r["w"])
                top, bottom = max(r["ry"], r["y"]) - r["ry"], min(r["ry"] + r["rh"], r["y"] + r["h"]) - r["ry"]  # in the rectangle
                for strip in range(top // lines, (bottom - 1) // lines + 1):
                    y0, y1 = max(top, strip * lines), min(bottom, (strip + 1) * lines)
                    part = block[y0 + r["ry"] - r["y"] : y1 + r["ry"] - r["y"], x0 - r["x"] : x1 - r["x"]]
                    yield {
                        "rect_id": r["rect_id"], "band": r["band"], "strip": strip, "y": y0 - strip * lines, "x": x0 - r["rx"], "h": y1 - y0, "w": x1 - x0,
                        "rect_w": r["rw"], "strip_h": min(lines, r["rh"] - strip * lines), "dtype": r["dtype"], "data": part.tobytes(),
                    }

        return batched(slices(), PART)

    parts = once.mapInArrow(cut, PART)
    every = asked.select("rect_id", "w", "h", "dtype", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band")).select("*", F.explode(F.expr(f"sequence(0, cast((h - 1) div {lines} as int))")).alias("strip"))
    zero = F.lit(0)
    empty = every.select("rect_id", "band", "strip", *[zero.alias(c) for c in ("y", "x", "h", "w")], F.col("w").alias("rect_w"), F.least(F.lit(lines), F.expr(f"h - strip * {lines}")).alias("strip_h"), "dtype", F.lit(b"").alias("data"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def strips() -> Iterator[dict]:
            rows = (r for batch in batches for r in batch.to_pylist())
            for (rect, band, strip), group in groupby(rows, key=lambda r: (r["rect_id"], r["band"], r["strip"])):
                out = None
                for r in group:
                    if out is None:
                        out, kind = np.zeros((r["strip_h"], r["rect_w"]), r["dtype"]), r["dtype"]
                    if r["h"]:
                        out[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"])
                yield {"rect_id": rect, "band": band, "strip": strip, "y": strip * lines, "h": out.shape[0], "w": out.shape[1], "dtype": kind, "data": out.tobytes()}

        return batched(strips(), STRIP)

    keys = ["rect_id", "band", "strip"]
    return parts.unionByName(empty).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, STRIP)
