"""TIFF files by their strips and tiles: directories become rows, pieces of one file are read and decoded by many tasks.

``layouts`` reads the first directory of each file by ranges of bytes, ``pieces_of`` makes a row of each strip or tile (plain
DataFrame functions; filter these rows to read less), ``read_pieces`` fetches and decodes those, as WINDOW rows of
``raster_source``. Both byte orders, 32-bit and 64-bit offsets, samples of 8 to 64 bits, bands together or apart, LZW,
PackBits, deflate or nothing, with or without horizontal differences. Samples are given as they are stored: palette indexes
aren't looked up, and what photometric interpretation is meant isn't applied. What isn't decoded is told in ``error``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster_source import FIELDS, WINDOW, opened

LAYOUT = (
    "path string, width int, height int, bands int, dtype string, packing int, predictor int, apart boolean, tiled boolean, piece_w int, piece_h int, "
    "offsets array<long>, lengths array<long>, error string"
)
PIECE = "path string, piece int, band int, y int, x int, h int, w int, stored_h int, stored_w int, samples int, dtype string, packing int, predictor int, offset long, length long"
#: Packings by number, sizes and letters of the types of whole numbers in a directory.
PACKINGS = {1: "none", 5: "lzw", 8: "deflate", 32773: "packbits", 32946: "deflate"}
NUMBERS = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
#: LZW codes that clear the table and end the data.
CLEAR, END = 256, 257


# -- packings -----------------------------------------------------------------------------------------------------------


def from_packbits(data: bytes, size: int) -> bytes:
    """Runs and literals up to ``size`` bytes; ends early where the data do."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def to_packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = at + 1
        while run < len(data) and run - at < 128 and data[run] == data[at]:
            run += 1
        if run - at > 1:
            out += bytes((257 - (run - at), data[at]))
        else:
            while run < len(data) and run - at < 128 and (run + 1 >= len(data) or data[run] != data[run + 1]):
                run += 1
            out += bytes((run - at - 1,)) + data[at:run]
        at = run
    return bytes(out)


def code_width(entries: int) -> int:
    """Bits of the next code when a reader's table has ``entries`` entries: codes widen one entry early."""
    return min(12, max(9, (entries + 1).bit_length()))


def from_lzw(data: bytes, size: int) -> bytes:
    table, before, width = [bytes((i,)) for i in range(256)] + [b"", b""], b"", 9
    out, n, held, bits = [], 0, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == END or n >= size:
            break
        if code == CLEAR:
            del table[END + 1 :]
            before, width = b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError(f"LZW code {code} has no entry yet")
        if before:
            table.append(before + entry[:1])
            width = code_width(len(table))
        out.append(entry)
        n, before = n + len(entry), entry
    return b"".join(out)


def to_lzw(data: bytes) -> bytes:
    fresh = {bytes((i,)): i for i in range(256)}
    codes, table, known, entries = [(CLEAR, 9)], dict(fresh), b"", END + 1  # entries: what a reader has by then
    for byte in data:
        longer = known + bytes((byte,))
        if longer in table:
            known = longer
            continue
        codes.append((table[known], code_width(entries)))
        entries += len(codes) > 1 and codes[-2][0] != CLEAR
        table[longer] = len(table) + 2
        if len(table) + 2 == 4095:
            codes.append((CLEAR, code_width(entries)))
            table, entries = dict(fresh), END + 1
        known = bytes((byte,))
    if known:
        codes.append((table[known], code_width(entries)))
        entries += codes[-2][0] != CLEAR
    codes.append((END, code_width(entries)))
    out, held, bits = bytearray(), 0, 0
    for code, width in codes:
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpacked(data: bytes, packing: int, size: int) -> bytes:
    """The first ``size`` bytes of a packed piece; a ValueError where it has fewer."""
    kind = PACKINGS[packing]
    if kind == "deflate":
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as broken:
            raise ValueError(str(broken)) from None
    else:
        out = data if kind == "none" else (from_lzw if kind == "lzw" else from_packbits)(data, size)
    if len(out) < size:
        raise ValueError(f"a piece has {len(out)} bytes of {size}")
    return out[:size]


def packed(data: bytes, packing: int) -> bytes:
    kind = PACKINGS[packing]
    return data if kind == "none" else zlib.compress(data) if kind == "deflate" else to_lzw(data) if kind == "lzw" else to_packbits(data)


# -- directories --------------------------------------------------------------------------------------------------------


def directory(source: pa.NativeFile) -> tuple[str, dict[int, tuple[int, ...]]]:
    """Byte order and the tags of whole numbers of a file's first directory; only these bytes are read."""

    def at(place: int, n: int) -> bytes:
        source.seek(place)
        data = source.read(n)
        if len(data) < n:
            raise ValueError("the file ends inside its directory")
        return data

    head = source.read(16)
    if head[:2] not in (b"II", b"MM") or len(head) < 8:
        raise ValueError("no TIFF file")
    e = "<" if head[:2] == b"II" else ">"
    version = struct.unpack(e + "H", head[2:4])[0]
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version}")
    wide = version == 43
    number, word = ("Q", 8) if wide else ("I", 4)
    start = struct.unpack(e + number, head[8:16] if wide else head[4:8])[0]
    count = struct.unpack(e + ("Q" if wide else "H"), at(start, 8 if wide else 2))[0]
    if count > 65_535:
        raise ValueError(f"a directory of {count} entries")
    step, limit = 4 + 2 * word, source.size()
    entries, tags = at(start + (8 if wide else 2), count * step), {}
    for i in range(count):
        tag, kind, n = struct.unpack(e + "HH" + number, entries[i * step : i * step + 4 + word])
        letter = NUMBERS.get(kind)
        if not letter or tag in tags:
            continue
        size = n * struct.calcsize(letter)
        value = entries[i * step + 4 + word : (i + 1) * step]
        if size > limit:
            raise ValueError(f"tag {tag} is longer than the file")
        if size > word:
            value = at(struct.unpack(e + number, value)[0], size)
        tags[tag] = struct.unpack(f"{e}{n}{letter}", value[:size])
    return e, tags


def layout_of(source: pa.NativeFile) -> dict:
    """LAYOUT fields of a file but its path; a ValueError where its pieces can't be decoded."""
    e, tags = directory(source)
    first = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height = first(256), first(257)
    if not width or not height:
        raise ValueError("no size")
    bands = first(277, 1)
    bits, formats = tags.get(258, (1,)), tags.get(339, (1,))
    if len(set(bits)) != 1 or len(set(formats)) != 1:
        raise ValueError(f"bands of {bits} bits and formats {formats}")
    kind = {1: "u", 2: "i", 3: "f", 4: "u"}.get(formats[0])
    if kind is None or bits[0] not in (8, 16, 32, 64) or (kind == "f" and bits[0] == 8):
        raise ValueError(f"samples of {bits[0]} bits, format {formats[0]}")
    packing, predictor = first(259, 1), first(317, 1)
    if packing not in PACKINGS or predictor not in (1, 2) or first(266, 1) != 1:
        raise ValueError(f"packing {packing}, predictor {predictor}, order of bits {first(266, 1)}")
    tiled, apart = 324 in tags, first(284, 1) == 2 and bands > 1
    piece_w, piece_h = (first(322), first(323)) if tiled else (width, min(first(278, height), height))
    offsets, lengths = (tags.get(324, ()), tags.get(325, ())) if tiled else (tags.get(273, ()), tags.get(279, ()))
    if not piece_w or not piece_h:
        raise ValueError("pieces without a size")
    pieces = -(-width // piece_w) * -(-height // piece_h) * (bands if apart else 1)
    if not lengths and packing == 1:
        lengths = (piece_w * piece_h * bits[0] // 8 * (1 if apart else bands),) * len(offsets) if tiled or pieces > 1 else (width * height * bands * bits[0] // 8,)
    if len(offsets) != pieces or len(lengths) != pieces:
        raise ValueError(f"{len(offsets)} offsets and {len(lengths)} lengths of {pieces} pieces")
    return {
        "width": width, "height": height, "bands": bands, "dtype": f"{e}{kind}{bits[0] // 8}", "packing": packing, "predictor": predictor,
        "apart": apart, "tiled": tiled, "piece_w": piece_w, "piece_h": piece_h, "offsets": list(offsets), "lengths": list(lengths), "error": None,
    }


def layouts(paths: DataFrame) -> DataFrame:
    """LAYOUT rows of the files that ``paths`` (path) names. A file whose pieces can't be decoded has an error and no more;
    one that can't be read at all raises, so that the task is tried again."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in LAYOUT.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as source:
                    try:
                        told = layout_of(source)
                    except (ValueError, struct.error) as broken:
                        told = {"error": str(broken)}
                yield pa.RecordBatch.from_pylist([{"path": path} | told], schema)

    return paths.select("path").mapInArrow(read, LAYOUT)


def pieces_of(told: DataFrame) -> DataFrame:
    """PIECE rows of LAYOUT rows without error: where each strip or tile lies in its file and in the image.

    ``band`` is the first band of the piece, ``samples`` how many it has; h and w leave out what sticks out of the image.
    """
    across, down = F.expr("(width - 1) div piece_w + 1"), F.expr("(height - 1) div piece_h + 1")
    known = told.where("error is null").select("*", across.cast("int").alias("across"), down.cast("int").alias("down"))
    rows = known.select("*", F.posexplode(F.arrays_zip("offsets", "lengths")).alias("piece", "place"))
    rows = rows.withColumn("at", F.expr("piece % (across * down)"))
    rows = rows.withColumn("y", F.expr("cast(at div across * piece_h as int)")).withColumn("x", F.expr("cast(at % across * piece_w as int)"))
    h, w = F.least("piece_h", F.col("height") - F.col("y")), F.least("piece_w", F.col("width") - F.col("x"))
    stored_h = F.when(F.col("tiled"), F.col("piece_h")).otherwise(h)
    return rows.select(
        "path", "piece", F.when(F.col("apart"), F.expr("cast(piece div (across * down) as int)")).otherwise(F.lit(0)).alias("band"), "y", "x", h.alias("h"), w.alias("w"),
        stored_h.alias("stored_h"), F.col("piece_w").alias("stored_w"), F.when(F.col("apart"), F.lit(1)).otherwise(F.col("bands")).alias("samples"),
        "dtype", "packing", "predictor", F.col("place.offsets").alias("offset"), F.col("place.lengths").alias("length"),
    )


def decoded(data: bytes, row: dict) -> np.ndarray:
    """samples x h x w of the bytes of a PIECE row."""
    shape, kind = (row["stored_h"], row["stored_w"], row["samples"]), np.dtype(row["dtype"])
    flat = np.frombuffer(unpacked(data, row["packing"], shape[0] * shape[1] * shape[2] * kind.itemsize), kind)
    cube = flat.reshape(shape)
    if row["predictor"] == 2:  # each sample is told as what it exceeds the one to its left by
        whole = cube.view(f"{kind.str[0]}u{kind.itemsize}").astype(f"=u{kind.itemsize}")
        cube = np.cumsum(whole, axis=1, dtype=whole.dtype).astype(f"{kind.str[0]}u{kind.itemsize}").view(kind)
    return cube[: row["h"], : row["w"]].transpose(2, 0, 1)


def read_pieces(pieces: DataFrame) -> DataFrame:
    """WINDOW rows (path, band, y, x, h, w, dtype, data) of PIECE rows: each piece's bytes alone are read, once.

    Pieces are dealt evenly, also those of one large file; a task holds one piece at a time. A piece that doesn't decode
    raises, with its file's name.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as source:
                    source.seek(row["offset"])
                    data = source.read(row["length"])
                try:
                    cube = decoded(data, row)
                except ValueError as broken:
                    raise ValueError(f"{row['path']}, piece {row['piece']}: {broken}") from None
                rows = [{"path": row["path"], "band": row["band"] + i, "y": row["y"], "x": row["x"], "h": row["h"], "w": row["w"], "dtype": row["dtype"], "data": part.tobytes()} for i, part in enumerate(cube)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(FIELDS))

    return pieces.repartition("path", "piece").mapInArrow(read, WINDOW)


# -- files made from pixels ---------------------------------------------------------------------------------------------


def tiff_file(cube: np.ndarray, packing: int = 5, predictor: int = 1, tile: tuple[int, int] | None = None, lines: int = 64, apart: bool = False, order: str = "<", wide: bool = False) -> bytes:
    """bands x lines x samples as a TIFF file: strips of ``lines`` lines, or tiles of (width, height)."""
    bands, height, width = cube.shape
    kind = np.dtype(cube.dtype).newbyteorder(order)
    piece_w, piece_h = tile or (width, min(lines, height))
    parts = []
    for group in [cube[i : i + 1] for i in range(bands)] if apart else [cube]:
        for y in range(0, height, piece_h):
            for x in range(0, width, piece_w):
                part = group[:, y : y + piece_h, x : x + piece_w].transpose(1, 2, 0)
                if tile:
                    part = np.pad(part, ((0, piece_h - part.shape[0]), (0, piece_w - part.shape[1]), (0, 0)))
                part = np.ascontiguousarray(part)
                if predictor == 2:
                    whole = part.view(f"u{kind.itemsize}")
                    part = np.concatenate([whole[:, :1], np.diff(whole, axis=1)], axis=1).view(part.dtype)
                parts.append(packed(part.astype(kind).tobytes(), packing))
    number, word, head = ("Q", 8, 16) if wide else ("I", 4, 8)
    offsets = [head + sum(map(len, parts[:i])) for i in range(len(parts))]
    places, lengths = (324, 325) if tile else (273, 279)
    formats = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags = {256: [width], 257: [height], 258: [8 * kind.itemsize] * bands, 259: [packing], 262: [2 if bands == 3 else 1], places: offsets, 277: [bands], lengths: [len(p) for p in parts]}
    tags |= {284: [2 if apart else 1], 317: [predictor], 339: [formats] * bands} | ({322: [piece_w], 323: [piece_h]} if tile else {278: [piece_h]})
    body, start = b"".join(parts), head + sum(map(len, parts))
    values_at = start + (8 if wide else 2) + len(tags) * (4 + 2 * word) + word
    entries, values = b"", b""
    for tag, numbers in sorted(tags.items()):
        data = struct.pack(f"{order}{len(numbers)}{number}", *numbers)
        told = data.ljust(word, b"\0") if len(data) <= word else struct.pack(order + number, values_at + len(values))
        values += data if len(data) > word else b""
        entries += struct.pack(order + "HH" + number, tag, 16 if wide else 4, len(numbers)) + told
    first = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, start) if wide else struct.pack(order + "HI", 42, start))
    return first + body + struct.pack(order + ("Q" if wide else "H"), len(tags)) + entries + bytes(word) + values


def encode(pixels: DataFrame, lines: int = 256) -> DataFrame:
    """path (image/strip), content: a 16-bit file for each strip of ``lines`` lines of an image (image_id, y, x, band, dn);
    packings, tiles, byte orders and planes take turns from strip to strip."""
    kinds = sorted(PACKINGS)

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        strip = int(key[1])
        y = rows["y"] - strip * lines
        cube = np.zeros((rows["band"].max() + 1, y.max() + 1, rows["x"].max() + 1), np.int16)
        cube[rows["band"], y, rows["x"]] = rows["dn"]
        data = tiff_file(cube, kinds[strip % len(kinds)], 1 + strip % 2, (16, 16) if strip % 3 == 0 else None, 8, strip % 4 == 0, "<>"[strip // 2 % 2], strip % 7 == 0)
        return pd.DataFrame({"path": [f"{key[0]}/{strip}"], "content": [data]})

    strips = pixels.select("image_id", F.expr(f"y div {lines}").alias("strip"), "y", "x", "band", "dn")
    return strips.groupBy("image_id", "strip").applyInPandas(write, "path string, content binary")
