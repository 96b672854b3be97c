"""Image files as tables: listings, headers and decoded blocks.

Files are read by Spark's binaryFile source, so any Hadoop file system works; decoding runs in Arrow tasks, a file at a
time. Labelled rasters (LBLSIZE=... text, then BSQ, BIL or BIP samples) and PNG are decoded; of JPEG, headers. ``tiff`` decodes
TIFF files by their pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "path string, format string, width int, height int, bands int, bytes_per_sample int, is_float boolean, has_alpha boolean, error string"
BLOCK = "path string, band int, ty int, tx int, h int, w int, dtype string, data binary"
PIXEL = "path string, band int, y int, x int, dn double"
#: Sample formats of labels by name, bytes and kind. FULL and LONG are four-byte whole numbers here.
SAMPLES = {"BYTE": (1, "u"), "HALF": (2, "i"), "WORD": (2, "i"), "FULL": (4, "i"), "LONG": (4, "i"), "REAL": (4, "f"), "COMP": (8, "c"), "DOUB": (8, "f")}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length of files; contents aren't read."""
    return files(spark, path, glob, recursive).select("path", "modificationTime", "length")


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)


def with_digest(found: DataFrame) -> DataFrame:
    """Files with the MD5 of their content as etag."""
    return found.select("path", "modificationTime", "length", F.md5("content").alias("etag"))


def label_text(data: bytes, start: int = 0) -> str:
    """The label that begins at ``start``, as long as its LBLSIZE tells; '' if none begins there."""
    found = re.match(rb"LBLSIZE\s*=\s*(\d+)", data[start : start + 100])
    return data[start : start + int(found[1])].split(b"\0")[0].decode("latin-1") if found else ""


def items_in(text: str) -> Iterator[tuple[str, str]]:
    return iter(re.findall(r"(\w+)\s*=\s*('(?:[^']|'')*'|\([^)]*\)|[^\s]+)", text))


def label_items(data: bytes) -> dict[str, str]:
    """Leading items of a label, up to its first group; quotes are taken off strings."""
    out = {}
    for name, value in items_in(label_text(data)):
        if name in ("PROPERTY", "TASK"):
            break
        out.setdefault(name, value[1:-1].replace("''", "'") if value[:1] == "'" else value)
    return out


def end_label(data: bytes) -> str:
    """The second label, which stands behind the samples if the first one's EOL is 1; '' without one."""
    inner = unwrapped(data)
    items = label_items(inner)
    if items.get("EOL") != "1":
        return ""
    org = items.get("ORG", "BSQ")
    nl, ns, nb = (int(items.get(k, 0)) for k in ("NL", "NS", "NB"))
    n2 = int(items.get("N2", {"BSQ": nl, "BIL": nb, "BIP": ns}[org]))
    n3 = int(items.get("N3", nb if org == "BSQ" else nl))
    first = len(data) - len(inner) + int(re.match(rb"LBLSIZE\s*=\s*(\d+)", inner)[1])
    if inner is not data and (place := wrapper_places(data)[1]):
        first = place
    return label_text(data, first + int(items.get("RECSIZE", 0)) * (int(items.get("NLB", 0)) + n2 * n3))


def wrapper_lines(data: bytes) -> list[tuple[str, str, str]]:
    """(object or group the item is in, name, value) of a wrapper's text label, up to its END line; values of one line."""
    found, inside = [], []
    for line in re.split(rb"[\r\n\v\f]+", data):
        text = line.decode("latin-1").strip()
        if text == "END":
            break
        name, _, value = (part.strip() for part in text.partition("="))
        if name in ("OBJECT", "GROUP"):
            inside.append(value)
        elif name in ("END_OBJECT", "END_GROUP"):
            inside[-1:] = []
        elif value:
            found.append((inside[-1] if inside else "", name, value.strip("\"'")))
    return found


def wrapper_places(data: bytes) -> tuple[int, int]:
    """Where a wrapper tells that the inner label and the samples begin, in bytes; 0 for what it doesn't tell."""
    told = {name: value for _, name, value in wrapper_lines(data)}
    record = int(told.get("RECORD_BYTES", 0) or 0)

    def place(name: str) -> int:
        number = re.search(r"\d+\s*\)?$", told.get(name, ""))
        return record * (int(number[0].rstrip(") ")) - 1) if number and record else 0

    return place("^IMAGE_HEADER"), place("^IMAGE")


def is_wrapper(data: bytes) -> bool:
    return re.match(rb"\s*(?:ODL_VERS|PDS_VERS|RECORD_TYPE)", data[:64]) is not None


def unwrapped(data: bytes) -> bytes:
    """The labelled raster inside a wrapper whose first lines tell its record size and place, or the data itself."""
    if data[:7] == b"LBLSIZE":
        return data
    start = wrapper_places(data)[0] if is_wrapper(data) else 0
    return data[start:] if start else b""


def wrapper_header(data: bytes) -> dict:
    """Header fields that a wrapper's own IMAGE object tells; used where it has no inner label."""
    image = {name: value for place, name, value in wrapper_lines(data) if place == "IMAGE"}
    bits = int(image["SAMPLE_BITS"])
    if bits not in (8, 16, 32, 64):
        return {"error": f"sample bits {bits}"}
    size = {"width": int(image["LINE_SAMPLES"]), "height": int(image["LINES"]), "bands": int(image.get("BANDS", 1))}
    return {"format": "label"} | size | {"bytes_per_sample": bits // 8, "is_float": image.get("SAMPLE_TYPE") in ("IEEE_REAL", "PC_REAL"), "has_alpha": False}


def details(data: bytes, bands: int, bits: int, gamma: float | None, black: bool) -> dict:
    """significant_bits, gamma and invalid (values of all bands each) that a label tells, with defaults for what it doesn't.

    Invalid and missing constants may be a number for all bands or one for each; UNK and unreadable ones don't count.
    """
    texts = [label_text(unwrapped(data))] if unwrapped(data) else [f"{n}='{v}'" for _, n, v in wrapper_lines(data)]
    told: dict[str, str] = {}
    for text in texts:
        for name, value in items_in(text):
            told.setdefault(name, value.strip("'\"(){} "))
    mask = re.fullmatch(r"2#0*(1+)#", told.get("SAMPLE_BIT_MASK", ""))
    shown, known = told.get("GAMMA_CORRECTION", told.get("GAMMA", "")), gamma
    if shown.lower() == "srgb":
        known = 0.45
    elif re.fullmatch(r"[0-9.]+([eE][+-]?\d+)?", shown) and float(shown):
        known = 1 / float(shown)
    invalid = []
    for name in ("INVALID_CONSTANT", "MISSING_CONSTANT"):
        try:
            values = [float(v) for v in told.get(name, "").split(",") if v.strip()]
        except ValueError:
            continue
        if values:
            invalid.append(values if len(values) == bands else [values[0]] * bands)
    if black:
        invalid.append([0.0] * bands)
    return {"significant_bits": len(mask[1]) if mask else bits, "gamma": known, "invalid": [v for i, v in enumerate(invalid) if v not in invalid[:i]]}


DETAILS = "path string, significant_bits int, gamma double, invalid array<array<double>>"


def label_details(found: DataFrame, bits: int = 12, gamma: float | None = None, black: bool = False) -> DataFrame:
    """DETAILS of labelled files (path, content); floats have all their bits. Other files give no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("significant_bits", pa.int32()), ("gamma", pa.float64()), ("invalid", pa.list_(pa.list_(pa.float64())))])
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = header(data)
                if head.get("format") == "label":
                    rows.append({"path": path} | details(data, head["bands"], 8 * head["bytes_per_sample"] if head["is_float"] else bits, gamma, black))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return found.select("path", "content").mapInArrow(read, DETAILS)


def labels_of(found: DataFrame) -> DataFrame:
    """path, part (0: the leading label, 1: the one behind the samples), text of labelled files (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = (label_text(unwrapped(data)), end_label(data))
                rows += [(path, part, text) for part, text in enumerate(texts) if text]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "part", "text"])

    return found.select("path", "content").mapInArrow(read, "path string, part int, text string")


def header(data: bytes) -> dict:
    """Header fields of a file's first bytes; ``error`` tells why there are none."""
    if data[:8] == PNG_MAGIC:
        width, height, depth, color = struct.unpack(">IIBB", data[16:26])
        bands = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[color]
        return {"format": "png", "width": width, "height": height, "bands": bands, "bytes_per_sample": max(1, depth // 8), "is_float": False, "has_alpha": color in (4, 6)}
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                depth, height, width, bands = struct.unpack(">BHHB", data[at + 4 : at + 10])
                return {"format": "jpeg", "width": width, "height": height, "bands": bands, "bytes_per_sample": depth // 8, "is_float": False, "has_alpha": False}
            at += 2 + size
        return {"error": "no frame header"}
    if data[:4] in (b"II*\0", b"MM\0*"):
        e = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(e + "I", data[4:8])[0]
        tags = {}
        for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
            tag, kind, n = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            value = data[at + 10 + 12 * i : at + 14 + 12 * i]
            size = {1: 1, 3: 2, 4: 4}.get(kind, 0)
            if size and n * size > 4:
                value = data[struct.unpack(e + "I", value)[0] :][: n * size]
            tags[tag] = struct.unpack(e + {1: "B", 3: "H", 4: "I"}.get(kind, "x") * (n if size else 0), value[: n * size]) if size else ()
        bits = tags.get(258, (1,))
        if len(set(bits)) != 1 or bits[0] not in (8, 16, 32, 64):
            return {"error": f"bits per sample {bits}"}
        bands = tags.get(277, (len(bits),))[0]
        return {"format": "tiff", "width": tags[256][0], "height": tags[257][0], "bands": bands, "bytes_per_sample": bits[0] // 8, "is_float": tags.get(339, (1,))[0] == 3, "has_alpha": bool(tags.get(338))}
    items = label_items(unwrapped(data))
    if not items:
        return wrapper_header(data) if is_wrapper(data) else {"error": "no known format"}
    if items.get("FORMAT") not in SAMPLES:
        return {"error": f"sample format {items.get('FORMAT')}"}
    size, kind = SAMPLES[items["FORMAT"]]
    return {"format": "label", "width": int(items["NS"]), "height": int(items["NL"]), "bands": int(items["NB"]), "bytes_per_sample": size, "is_float": kind == "f", "has_alpha": False}


def headers(found: DataFrame, prefix: int = 1 << 16) -> DataFrame:
    """HEADER of files (path, content); files that can't be read have an error.

    PNG headers and the first label stand at a file's beginning, so ``prefix`` bytes are passed on; TIFF and JPEG files,
    whose headers may stand anywhere, and longer labels are passed on whole.
    """
    label_size = F.regexp_extract(F.decode(F.substring("content", 1, 64), "ISO-8859-1"), r"^LBLSIZE\s*=\s*([0-9]+)", 1).try_cast("long")
    first = F.hex(F.substring("content", 1, 4))
    whole = first.isin("49492A00", "4D4D002A") | first.startswith("FFD8") | (F.coalesce(label_size, F.lit(0)) > prefix)
    head = F.when(whole, F.col("content")).otherwise(F.substring("content", 1, prefix)).alias("head")

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in HEADER.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"path": path} | header(data))
                except (struct.error, KeyError, ValueError, IndexError) as broken:
                    rows.append({"path": path, "error": f"{type(broken).__name__}: {broken}"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return found.select("path", head).mapInArrow(read, HEADER)


def with_known_headers(found: DataFrame, known: DataFrame, prefix: int = 1 << 16) -> DataFrame:
    """HEADER and modificationTime of files (path, modificationTime, content): from ``known`` (an earlier result) where path
    and time are the same, else read anew. What is known isn't opened again."""
    at = ["path", "modificationTime"]
    fresh = found.join(known.select(*at), at, "left_anti")
    read = headers(fresh, prefix).join(fresh.select(*at), "path")
    same = known.join(found.select(*at), at, "left_semi")
    return same.unionByName(read.select(same.columns))


def samples(data: bytes) -> np.ndarray:
    """bands x lines x samples of a labelled raster or a PNG without interlace; palettes give their colors."""
    if data[:8] == PNG_MAGIC:
        return png_samples(data)
    data = unwrapped(data)
    items = label_items(data)
    lines, width, bands = (int(items[k]) for k in ("NL", "NS", "NB"))
    size, kind = SAMPLES[items["FORMAT"]]
    big = items.get("INTFMT", "HIGH") == "HIGH" if kind in "ui" else items.get("REALFMT", "IEEE") == "IEEE"
    record, prefix = int(items.get("RECSIZE", 0)), int(items.get("NBB", 0))
    start = int(items["LBLSIZE"]) if "LBLSIZE" in items else int(re.match(rb"LBLSIZE\s*=\s*(\d+)", data)[1])
    start += int(items.get("NLB", 0)) * record
    n1, n2, n3 = {"BSQ": (width, lines, bands), "BIL": (width, bands, lines), "BIP": (bands, width, lines)}[items.get("ORG", "BSQ")]
    rows = np.frombuffer(data, np.uint8, n2 * n3 * (n1 * size + prefix), start).reshape(n3, n2, n1 * size + prefix)[:, :, prefix:]
    cube = np.ascontiguousarray(rows).view(np.dtype(f"{'>' if big else '<'}{kind}{size}")).reshape(n3, n2, n1)
    return cube.transpose({"BSQ": (0, 1, 2), "BIL": (1, 0, 2), "BIP": (2, 0, 1)}[items.get("ORG", "BSQ")])


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png_samples(data: bytes) -> np.ndarray:
    parts = list(chunks(data))
    width, height, depth, color, *_, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if depth not in (1, 2, 4, 8, 16) or interlace:
        raise ValueError(f"PNG of depth {depth}, color type {color}, interlace {interlace} isn't decoded")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    line_bytes, step = -(-width * bands * depth // 8), max(1, bands * depth // 8)
    raw = zlib.decompress(b"".join(body for name, body in parts if name == b"IDAT"))
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + line_bytes)
    out = np.zeros((height, line_bytes), np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(line_bytes, np.int64)
        if kind in (0, 2):
            out[y] = (line + (up if kind == 2 else 0)) & 255
            continue
        now = out[y]
        if kind == 1:  # running sums of each byte place
            out[y] = (np.cumsum(line.reshape(-1, step), axis=0) & 255).reshape(-1)
            continue
        for i in range(line_bytes):  # these filters hang on the sample to the left
            a, b, c = (int(now[i - step]) if i >= step else 0), int(up[i]), (int(up[i - step]) if i >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now[i] = (int(line[i]) + ((a + b) // 2 if kind == 3 else near)) & 255
    if depth < 8:  # samples share bytes, the first one in the highest bits
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)[:, :width]
        out = (bits * (1 << np.arange(depth - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)
    cube = out.view(f">u{max(1, depth // 8)}").reshape(height, width, bands).transpose(2, 0, 1)
    if color != 3:
        return cube
    palette = np.frombuffer(next(body for name, body in parts if name == b"PLTE"), np.uint8).reshape(-1, 3)
    if cube.max(initial=0) >= len(palette):
        raise ValueError("a sample lies beyond the palette")
    return palette[cube[0]].transpose(2, 0, 1)


def png(cube: np.ndarray) -> bytes:
    """PNG of bands x lines x samples of u8 or u16 (1 to 4 bands)."""
    bands, height, width = cube.shape
    size = cube.dtype.itemsize
    rows = np.ascontiguousarray(cube.transpose(1, 2, 0)).astype(f">u{size}").view(np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8 * size, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def with_gamma(data: bytes, gamma: float) -> bytes:
    """A PNG without sRGB, cHRM and iCCP chunks and with its gamma ahead of the first image data."""
    out, told = [PNG_MAGIC], False
    for name, body in chunks(data):
        if name in (b"sRGB", b"cHRM", b"iCCP", b"gAMA"):
            continue
        if name == b"IDAT" and not told:
            out.append(chunk(b"gAMA", struct.pack(">I", round(gamma * 100_000))))
            told = True
        out.append(chunk(name, body))
    return b"".join(out)


#: Bytes of samples, and values, that are held before they go on as one batch.
BATCH_BYTES, BATCH_VALUES = 1 << 23, 1 << 17


def dealt_over(spark: SparkSession) -> int:
    """Partitions for work that takes long in Python on few bytes: a stated number, since small ones would else be joined."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks(found: DataFrame, size: int = 256) -> DataFrame:
    """BLOCK rows of files (path, content): squares of one band, so that later work deals with parts of images."""
    kinds = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.binary()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(BLOCK.split(", "), kinds, strict=True)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
        rows, held = [], 0
        for found in batches:
            for path, data in zip(*(found.column(i) for i in range(2)), strict=True):
                path, cube = path.as_py(), samples(data.as_py())
                for band in range(cube.shape[0]):
                    for y in range(0, cube.shape[1], size):
                        for x in range(0, cube.shape[2], size):
                            part = cube[band, y : y + size, x : x + size]
                            rows.append((path, band, y // size, x // size, *part.shape, part.dtype.str, part.tobytes()))
                            held += part.nbytes
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return found.select("path", "content").mapInArrow(cut, BLOCK)


def pixels(block_table: DataFrame, size: int = 256) -> DataFrame:
    """PIXEL rows of blocks; many small blocks share a batch, and a batch has one block more than BATCH_VALUES hold at most."""
    names = ["path", "band", "ty", "tx", "w", "dtype", "data"]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        counts = np.array([len(values) for *_, values in found])
        paths, bands, tys, txs, widths = (list(c) for c in list(zip(*found, strict=True))[:5])
        each = lambda c: np.repeat(np.array(c, np.int64), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        y, x = np.divmod(place, each(widths))
        told = pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(found)), counts)))
        columns = [told, *[pa.array(c.astype(np.int32)) for c in (each(bands), y + each(tys) * size, x + each(txs) * size)], pa.array(np.concatenate([v for *_, v in found]))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIXEL.split(", ")])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for rows in batches:
            for *told, dtype, data in zip(*(rows.column(n) for n in names), strict=True):
                values = np.frombuffer(data.as_buffer(), dtype.as_py()).astype(float)
                if len(values):
                    found.append((*[v.as_py() for v in told], values))
                    held += len(values)
                if held >= BATCH_VALUES:
                    yield batch(found)
                    found, held = [], 0
        if found:
            yield batch(found)

    return block_table.select(*names).mapInArrow(spread, PIXEL)
