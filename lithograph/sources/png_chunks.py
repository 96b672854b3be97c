"""Chunks of PNG files as rows: a walk by ranges of bytes that stops at the first image data, so pixels aren't read.

``chunks_of`` gives CHUNK rows; ``values`` adds what header, gamma, chromaticities and rendering intent tell, as plain
column expressions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import PNG_MAGIC, with_gamma
from .raster_source import opened

CHUNK = "path string, n int, name string, offset long, length long, body binary, crc_ok boolean, error string"
#: Bodies up to this size are passed on; of longer ones and of image data, place and length alone.
MOST_BODY = 1 << 16
#: What numbers in chunks stand for.
COLORS = {0: "gray", 2: "RGB", 3: "PLT", 4: "gray + alpha", 6: "RGBA"}
INTERLACES = {0: "none", 1: "Adam7"}
INTENTS = {0: "Perceptual", 1: "Relative colorimetric", 2: "Saturation", 3: "Absolute colorimetric"}


def walk(source: pa.NativeFile, most_body: int = MOST_BODY, to_end: bool = False) -> Iterator[dict]:
    """CHUNK fields but the path, in file order, up to the first image data or (``to_end``) the end.

    A file without the magic number, or that ends inside a chunk, ends with a row that has an error and no name.
    """
    if source.read(8) != PNG_MAGIC:
        yield {"n": 0, "offset": 0, "error": "no PNG file"}
        return
    at, n, end = 8, 0, source.size()
    while at < end:
        source.seek(at)
        head = source.read(8)
        length, name = struct.unpack(">I", head[:4])[0] if len(head) == 8 else end, head[4:]
        if at + 12 + length > end:
            yield {"n": n, "offset": at, "error": "the file ends inside a chunk"}
            return
        row = {"n": n, "name": name.decode("latin-1"), "offset": at, "length": length}
        if name != b"IDAT" and length <= most_body:
            rest = source.read(length + 4)
            row |= {"body": rest[:-4], "crc_ok": zlib.crc32(name + rest[:-4]) == struct.unpack(">I", rest[-4:])[0]}
        yield row
        if name == b"IEND" or (name == b"IDAT" and not to_end):
            return
        at, n = at + 12 + length, n + 1


def chunks_of(paths: DataFrame, most_body: int = MOST_BODY, to_end: bool = False) -> DataFrame:
    """CHUNK rows of the files that ``paths`` (path) names. Rows are yielded in batches of 1,000, whatever a file holds."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in CHUNK.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as source:
                    for row in walk(source, most_body, to_end):
                        rows.append({"path": path} | row)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return paths.select("path").mapInArrow(read, CHUNK)


def number(body: Column, place: int, size: int = 4) -> Column:
    """The unsigned big-endian number of ``size`` bytes at a place (from 0); null where the body ends before."""
    return F.when(F.octet_length(body) >= place + size, F.conv(F.hex(F.substring(body, place + 1, size)), 16, 10).cast("long"))


def named(value: Column, names: dict[int, str]) -> Column:
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.when(value.isNotNull(), F.coalesce(known[value.cast("int")], F.lit("(invalid)")))


def values(chunks: DataFrame) -> DataFrame:
    """CHUNK rows without body, with width, height, depth, color, compression, filter, interlace (of IHDR), gamma (gAMA),
    white, red, green, blue (cHRM: x and y each) and intent (sRGB); null for what a chunk doesn't tell."""
    body = F.col("body")
    of = lambda name, value: F.when(F.col("name") == name, value)
    part = lambda place: number(body, place) / 1e5
    points = {name: of("cHRM", F.array(part(8 * i), part(8 * i + 4))) for i, name in enumerate(("white", "red", "green", "blue"))}
    told = {
        "width": of("IHDR", number(body, 0)), "height": of("IHDR", number(body, 4)), "depth": of("IHDR", number(body, 8, 1)), "color": of("IHDR", named(number(body, 9, 1), COLORS)),
        "compression": of("IHDR", number(body, 10, 1)), "filter": of("IHDR", number(body, 11, 1)), "interlace": of("IHDR", named(number(body, 12, 1), INTERLACES)),
        "gamma": of("gAMA", part(0)), **points, "intent": of("sRGB", named(number(body, 0, 1), INTENTS)),
    }
    return chunks.select("path", "n", "name", "offset", "length", "crc_ok", "error", *[value.alias(name) for name, value in told.items()])


def told_gamma(files: DataFrame, gamma: float) -> DataFrame:
    """PNG files (path, content) with ``gamma`` told ahead of their image data, in place of other color chunks."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [with_gamma(bytes(data), gamma) for data in batch["content"]]})

    return files.select("path", "content").mapInPandas(tell, "path string, content binary")
