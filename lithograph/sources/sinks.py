"""What is written: descriptors and metadata as text columns, tiles as PNG, cache tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import dealt_over, png

#: Tiles that a task passes on as one batch.
TILES_AT_ONCE = 256
TILE = "image_id string, level int, col int, row int, w int, h int, format string, data binary"


def descriptor(tile: int, overlap: int, fmt: str, width: Column, height: Column) -> Column:
    """Deep-zoom descriptor XML."""
    head = f'<?xml version="1.0" encoding="UTF-8"?><Image xmlns="http://schemas.microsoft.com/deepzoom/2008" TileSize="{tile}" Overlap="{overlap}" Format="{fmt}"><Size Width="'
    return F.concat(F.lit(head), width.cast("string"), F.lit('" Height="'), height.cast("string"), F.lit('"/></Image>'))


def with_url(xml: Column, url: Column) -> Column:
    """A descriptor that tells where its tiles are."""
    return F.regexp_replace(xml, "<Image ", F.concat(F.lit('<Image Url="'), url, F.lit('" ')))


def metadata(product: DataFrame) -> DataFrame:
    """image_id and metadata: all other columns as one JSON object without nulls."""
    return product.select("image_id", F.to_json(F.struct(*[c for c in product.columns if c != "image_id"])).alias("metadata"))


#: What a product's metadata tell besides its spec, in order; stretched products have the last ones too.
RECORD = (
    "processing_timestamp cache_hash custom tiler_version rdr_bytes rdr_timestamp rdr_etag is_overlay width height original_is_float original_bits original_bands "
    "original_gamma stretch_type overlay_bands min_max_estimated unstretched_min unstretched_max stretch_low stretch_high linear_to_srgb srgb_to_linear "
    "tile_header_gamma tile_data_gamma histogram_bins histogram_low_inclusive histogram_high_exclusive histogram"
).split()
STRETCH_NAMES = {"percent": "histogram_percent", "relative": "relative", "extrema": "extrema", "none": "none"}


def product_metadata(products: DataFrame, spec_fields: list[str]) -> DataFrame:
    """image_id and metadata of finished products: their spec's fields, then RECORD, as far as there, without nulls.

    Times are told to the minute; a stretched product's percentages or shares are told under names of their own.
    """
    named = F.coalesce(*[F.when(F.col("stretch_type") == k, F.lit(v)) for k, v in STRETCH_NAMES.items()])
    asked = {"percent": ("stretch_low_percent", "stretch_high_percent"), "relative": ("stretch_low_relative", "stretch_high_relative")}
    more = [F.when(F.col("stretch_type") == kind, F.col(c)).alias(n) for kind, names in asked.items() for c, n in zip(("asked_low", "asked_high"), names, strict=True) if c in products.columns]
    shown = []
    for name in RECORD:
        if name in products.columns and name not in spec_fields:
            column = F.date_format(name, "yyyy-MM-dd'T'HH:mm'Z'") if name.endswith("_timestamp") else named if name == "stretch_type" else F.col(name)
            shown.append(column.alias(name))
    return products.select("image_id", F.to_json(F.struct(*spec_fields, *shown, *more)).alias("metadata"))


def transformed(tiles: DataFrame, change: Callable[[bytes], bytes], fmt: str = "png") -> DataFrame:
    """Tiles with the data of those of one format changed, such as by ``images.with_gamma``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, kinds = batch.column(batch.schema.names.index("data")).to_pylist(), batch.column(batch.schema.names.index("format")).to_pylist()
            new = pa.array([change(d) if k == fmt and d is not None else d for d, k in zip(data, kinds, strict=True)], pa.binary())
            yield batch.set_column(batch.schema.names.index("data"), "data", new)

    return tiles.mapInArrow(run, tiles.schema)


def png_tiles(pixels: DataFrame, bands: int) -> DataFrame:
    """TILE rows with PNG data from 8-bit pixels (image_id, level, col, row, y, x, band, out).

    Pixels are dealt by tile and sorted, so that a task meets the pixels of a tile one after another: it holds one tile and
    one batch of rows, and passes on tiles by TILES_AT_ONCE.
    """
    key = ["image_id", "level", "col", "row"]
    kinds = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.binary()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(TILE.split(", "), kinds, strict=True)])

    def draw(rows: pa.Table) -> tuple:
        y, x, band, out = (rows.column(n).to_numpy() for n in ("y", "x", "band", "out"))
        y, x = y - y.min(), x - x.min()
        cube = np.zeros((bands, int(y.max()) + 1, int(x.max()) + 1), np.uint8)
        cube[band, y, x] = out
        return (*[rows.column(n)[0].as_py() for n in key], cube.shape[2], cube.shape[1], "png", png(cube))

    def told(tiles: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*tiles, strict=True), kinds, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, tiles = [], []  # pieces of the tile whose end isn't met yet
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            starts = [0, *starts_of(rows.select(key)), rows.num_rows]
            for i, (first, end) in enumerate(zip(starts, starts[1:], strict=False)):
                piece = rows.slice(first, end - first)
                if waiting and (i or any(waiting[0].column(n)[0] != piece.column(n)[0] for n in key)):
                    tiles.append(draw(pa.concat_tables(waiting)))
                    waiting = []
                waiting.append(piece)
                if len(tiles) >= TILES_AT_ONCE:
                    yield told(tiles)
                    tiles = []
        if waiting:
            tiles.append(draw(pa.concat_tables(waiting)))
        if tiles:
            yield told(tiles)

    dealt = pixels.select(*key, "y", "x", "band", "out").repartition(dealt_over(pixels.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, TILE)


def starts_of(keys: pa.Table) -> list[int]:
    """Places of rows that differ from the row before, but for the first; nulls equal nulls."""
    n, changed = keys.num_rows, np.zeros(max(0, keys.num_rows - 1), bool)
    for column in keys.columns:
        codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed |= codes[1:n] != codes[: n - 1]
    return (np.flatnonzero(changed) + 1).tolist()


def tile_path(level: Column, col: Column, row: Column, fmt: str) -> Column:
    return F.concat(F.lit("image_files/"), level.cast("string"), F.lit("/"), col.cast("string"), F.lit("_"), row.cast("string"), F.lit("." + fmt))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as Parquet by image and level: a subtree can be read or dropped without the others."""
    tiles.write.mode("append").partitionBy("image_id", "level").parquet(path)


def write_tile_files(tiles: DataFrame, root: str, hash_column: str = "image_id") -> DataFrame:
    """Write each tile as a file ROOT/HASH/image_files/LEVEL/COL_ROW.FORMAT; gives (image_id, level, col, row, path, bytes).

    ``root`` is a URI of a file system that all executors share. A retried task writes the same files again.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                folder = f"{base}/{r['hash']}/image_files/{r['level']}"
                store.create_dir(folder, recursive=True)
                r["path"], r["bytes"] = f"{folder}/{r['col']}_{r['row']}.{r['format']}", len(r["data"])
                with store.open_output_stream(r["path"]) as stream:
                    stream.write(r["data"])
            fields = [("image_id", pa.string()), ("level", pa.int32()), ("col", pa.int32()), ("row", pa.int32()), ("path", pa.string()), ("bytes", pa.int64())]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in fields} for r in rows], pa.schema(fields))

    chosen = tiles.select("image_id", F.col(hash_column).alias("hash"), "level", "col", "row", "format", "data")
    return chosen.mapInArrow(put, "image_id string, level int, col int, row int, path string, bytes long")


def written_per_level(manifest: DataFrame) -> DataFrame:
    """How many different tiles of each image and level were written.

    The tiles of a square of 8 x 8 are bits of one number, so a square is shuffled as one row and repeated tiles count once.
    """
    part = lambda c: F.col(c).cast("long").bitwiseAND(F.lit(7))
    bit = manifest.select("image_id", "level", F.shiftright("col", 3).alias("sc"), F.shiftright("row", 3).alias("sr"), (part("row") * 8 + part("col")).cast("int").alias("_bit"))
    squares = bit.groupBy("image_id", "level", "sc", "sr").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("tiles"))
    return squares.groupBy("image_id", "level").agg(F.sum(F.bit_count("tiles").cast("long")).alias("tiles"))


def write_texts(rows: DataFrame, path: str, text: str, by: str) -> None:
    """A text column as text files, in a folder for each value of ``by``."""
    rows.select(F.col(text).alias("value"), by).write.mode("append").partitionBy(by).text(path)


def without(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A table without the subtrees of the removed keys, to be written in its place."""
    return table.join(removed.select(key).distinct(), key, "left_anti")
