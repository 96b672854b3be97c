"""Whole images as single PNG files that no task holds: strips are packed in parallel and written each at its place.

A strip of lines becomes an IDAT chunk of its own with its CRC: a piece of one deflate stream, ended by a full flush, so that
pieces can stand one after another. What hangs on the whole are three small things, made of the strips' numbers by window
functions: each piece's offset (a prefix sum of lengths), the stream's two header bytes (in the first piece), and its Adler-32
(in the last one). With sums taken modulo 65521, and lengths n,

    a - 1 = sum of (a_i - 1),   b = sum of (b_i + n_i * (a_1 + ... + a_(i-1) - (i - 1)))

so the checksum of all strips is a sum over strips, too.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .images import PNG_MAGIC, chunk

STRIP = "image_id string, strip int, strips int, full_w int, full_h int, raw long, a long, b long, deflated binary"
ADLER, STREAM_HEAD = 65521, b"\x78\x01"
#: PNG color types by number of bands.
COLORS = {1: 0, 2: 4, 3: 2, 4: 6}


def deflated(raw: bytes, last: bool) -> bytes:
    """A piece of a raw deflate stream: it ends at a byte, and refers to nothing before it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def strips(pixels: DataFrame, images: DataFrame, bands: int, lines: int = 64) -> DataFrame:
    """STRIP rows of 8-bit pixels (image_id, y, x, band, out) and image sizes (image_id, width, height).

    Pixels that don't occur are 0. A group is ``lines`` lines of one image.
    """
    if bands not in COLORS or lines < 1:
        raise ValueError("images have 1 to 4 bands, strips one line or more")
    sized = images.where("width > 0 and height > 0").select("image_id", F.col("width").cast("int").alias("full_w"), F.col("height").cast("int").alias("full_h"))
    sized = sized.withColumn("strips", F.expr(f"cast((full_h - 1) div {lines} + 1 as int)"))
    keys = ["image_id", "full_w", "full_h", "strips"]
    placed = pixels.join(sized, "image_id").select(*keys, F.expr(f"cast(y div {lines} as int)").alias("strip"), "y", "x", "band", "out")
    none = lambda name: F.lit(-1).cast(placed.schema[name].dataType).alias(name)
    every = sized.select(*keys, F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip")).select("*", *map(none, ("y", "x", "band", "out")))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, width, height, n, strip = key
        h = min(lines, height - strip * lines)
        rows = rows[rows["y"] >= 0]
        data = np.zeros((h, 1 + width * bands), np.uint8)  # each line is led by its filter: none
        data[rows["y"] - strip * lines, 1 + rows["x"] * bands + rows["band"]] = rows["out"]
        raw = data.tobytes()
        adler = zlib.adler32(raw)
        return pd.DataFrame([(image, strip, n, width, height, len(raw), adler & 0xFFFF, adler >> 16, deflated(raw, strip == n - 1))], columns=[c.split()[0] for c in STRIP.split(", ")])

    return placed.unionByName(every).groupBy(*keys, "strip").applyInPandas(pack, STRIP)


def pieces(packed: DataFrame, bands: int) -> DataFrame:
    """image_id, strip, strips, offset, data: the bytes of each image's file, a piece for each strip.

    ``packed`` should be a written table: it is read for its numbers and again for its data.
    """
    order = Window.partitionBy("image_id").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("image_id")
    before = lambda value: F.coalesce(F.sum(value).over(order), F.lit(0))
    first, last = F.col("strip") == 0, F.col("strip") == F.col("strips") - 1
    # signature and IHDR chunk ahead, the stream's head in the first chunk, its checksum in the last one, and IEND behind
    size = F.octet_length("deflated").cast("long") + 12 + F.when(first, len(PNG_MAGIC) + 25 + len(STREAM_HEAD)).otherwise(0) + F.when(last, 4 + 12).otherwise(0)
    numbers = packed.select("image_id", "strip", "strips", "raw", "a", "b", size.alias("size"))
    numbers = numbers.withColumn("offset", before("size")).withColumn("ahead", before(F.col("a") - 1) % ADLER)
    numbers = numbers.withColumn("sum_a", F.sum(F.col("a") - 1).over(whole) % ADLER + 1).withColumn("sum_b", F.sum((F.col("b") + F.col("raw") % ADLER * F.col("ahead")) % ADLER).over(whole) % ADLER)
    told = numbers.select("image_id", "strip", "offset", (F.col("sum_b") * 65536 + F.col("sum_a") % ADLER).alias("adler"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                body, data = r["deflated"], b""
                if r["strip"] == 0:
                    data = PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", r["full_w"], r["full_h"], 8, COLORS[bands], 0, 0, 0))
                    body = STREAM_HEAD + body
                if r["strip"] == r["strips"] - 1:
                    data += chunk(b"IDAT", body + struct.pack(">I", r["adler"])) + chunk(b"IEND", b"")
                else:
                    data += chunk(b"IDAT", body)
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]]), pa.array([r["strip"]], pa.int32()), pa.array([r["strips"]], pa.int32()), pa.array([r["offset"]], pa.int64()), pa.array([data], pa.binary())], ["image_id", "strip", "strips", "offset", "data"])

    rows = packed.join(told, ["image_id", "strip"]).select("image_id", "strip", "strips", "full_w", "full_h", "deflated", "offset", "adler")
    return rows.mapInArrow(put, "image_id string, strip int, strips int, offset long, data binary")


def write_images(parts: DataFrame, root: str) -> DataFrame:
    """Write ``pieces`` as files ``root``/IMAGE.png, each piece at its offset; image_id, path, bytes of each image.

    ``root`` is a folder (or a file: URI) that all executors share and that takes writes at any place of a file. A task that
    is retried writes the same bytes at the same places. Images stand under their name when all their pieces are written.
    """
    base = re.sub(r"^file:(//)?", "", root).rstrip("/")
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", base):
        raise ValueError("this file system takes no writes in the midst of files; store the pieces, which are in order")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(base, exist_ok=True)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                place = os.open(f"{base}/.{r['image_id']}.part", os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    data, at = memoryview(r["data"]), r["offset"]
                    while data:
                        n = os.pwrite(place, data, at)
                        data, at = data[n:], at + n
                finally:
                    os.close(place)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([r["offset"] + len(r["data"]) for r in rows], pa.int64())], ["image_id", "end"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("image_id").to_pylist()
            for image in ids:
                part, path = f"{base}/.{image}.part", f"{base}/{image}.png"
                if os.path.exists(part):  # a retry may have named it already
                    os.replace(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([f"{base}/{i}.png" for i in ids], pa.string()), batch.column("bytes")], ["image_id", "path", "bytes"])

    ends = parts.where(~F.col("image_id").rlike(r"[/\\]|^[.]|^$")).mapInArrow(put, "image_id string, end long")
    return ends.groupBy("image_id").agg(F.max("end").alias("bytes")).mapInArrow(name, "image_id string, path string, bytes long")
