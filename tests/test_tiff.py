"""TIFF files by their pieces, and PNG chunks: round trips, published examples of packings, damage."""

import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithograph.sources import images, png_chunks, raster_source, tiff


class Counting:
    """A file in memory that notes which bytes were read."""

    def __init__(self, data):
        self.data, self.at, self.spans = data, 0, []

    def seek(self, at):
        self.at = at

    def size(self):
        return len(self.data)

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.spans.append((self.at, self.at + len(out)))
        self.at += len(out)
        return out


def whole(data):
    """The cube of a file in memory, by its layout and pieces in plain Python."""
    told = tiff.layout_of(pa.BufferReader(data))
    across, down = -(-told["width"] // told["piece_w"]), -(-told["height"] // told["piece_h"])
    cube = np.zeros((told["bands"], told["height"], told["width"]), np.dtype(told["dtype"]).newbyteorder("="))
    for i, (offset, length) in enumerate(zip(told["offsets"], told["lengths"], strict=True)):
        band, at = divmod(i, across * down)
        y, x = at // across * told["piece_h"], at % across * told["piece_w"]
        h, w = min(told["piece_h"], told["height"] - y), min(told["piece_w"], told["width"] - x)
        row = told | {"h": h, "w": w, "stored_h": told["piece_h"] if told["tiled"] else h, "stored_w": told["piece_w"], "samples": 1 if told["apart"] else told["bands"]}
        part = tiff.decoded(data[offset : offset + length], row)
        cube[band : band + len(part), y : y + h, x : x + w] = part
    return cube


@pytest.mark.parametrize("packing", sorted(tiff.PACKINGS))
def test_files_of_all_kinds_read_back(packing):
    made = np.random.default_rng(packing).integers(0, 200, (3, 37, 21))
    for kind, predictor, tile, apart, order, wide in itertools.product(("u1", "i2", "f8"), (1, 2), (None, (16, 16)), (False, True), "<>", (False, True)):
        data = tiff.tiff_file(made.astype(kind), packing, predictor, tile, 10, apart, order, wide)
        assert np.array_equal(whole(data), made.astype(kind)), (kind, predictor, tile, apart, order, wide)


def test_packings_by_published_examples():
    """The runs of the PackBits note and the first example of the LZW section of the format's specification."""
    assert tiff.from_packbits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.from_lzw(data, 99) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6)) and tiff.to_lzw(bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))) == data


@pytest.mark.parametrize("n", [0, 1, 2, 254, 255, 256, 3836, 3837, 3838, 3839, 50_000])
def test_packed_bytes_come_back(n):
    """Also where codes widen and where the table is cleared; noise adds an entry for nearly each byte."""
    for values in (np.random.default_rng(n).integers(0, 256, n), np.random.default_rng(n).integers(0, 2, n), np.zeros(n)):
        data = values.astype("u1").tobytes()
        assert tiff.from_lzw(tiff.to_lzw(data), n) == data and tiff.from_packbits(tiff.to_packbits(data), n) == data


def test_directories_are_read_alone():
    data = tiff.tiff_file(np.zeros((1, 400, 300), "u2"), 1)
    source = Counting(data)
    assert tiff.layout_of(source)["height"] == 400
    assert sum(b - a for a, b in source.spans) < 600 < len(data)


def test_rows_of_files(spark, tmp_path):
    made = np.arange(3 * 40 * 30).reshape(3, 40, 30).astype("u2")
    files = {"strips.tif": tiff.tiff_file(made, 5, 2, lines=7), "tiles.tif": tiff.tiff_file(made, 8, 1, (16, 16), apart=True), "broken.tif": tiff.tiff_file(made)[:100], "other.tif": b"", "odd.tif": tiff.tiff_file(made).replace(struct.pack("<HHII", 259, 4, 1, 5), struct.pack("<HHII", 259, 4, 1, 7))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    told = tiff.layouts(spark.createDataFrame([(str(tmp_path / n),) for n in files], "path string"))
    assert {r["path"].rsplit("/", 1)[1] for r in told.where("error is not null").collect()} == {"broken.tif", "other.tif", "odd.tif"}
    for name in ("strips.tif", "tiles.tif"):
        back = np.full(made.shape, -1)
        for r in tiff.read_pieces(tiff.pieces_of(told.where(F.col("path").endswith(name)))).collect():
            back[r["band"], r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"])
        assert np.array_equal(back, made)
    few = raster_source.window_sums(tiff.read_pieces(tiff.pieces_of(told).where("y = 7 and path like '%strips.tif'"))).collect()
    assert [(r["band"], r["s"]) for r in sorted(few)] == [(b, float(made[b, 7:14].sum())) for b in range(3)]
    assert tiff.read_pieces(tiff.pieces_of(told.limit(0))).count() == 0


def test_pieces_that_are_cut_short_raise():
    for packing in tiff.PACKINGS:
        with pytest.raises(ValueError):
            tiff.unpacked(tiff.packed(bytes(range(200)), packing)[:50], packing, 200)
    with pytest.raises(ValueError):
        tiff.from_lzw(int(f"{256:09b}{300:09b}".ljust(24, "0"), 2).to_bytes(3, "big"), 9)


def png_of(head, *more):
    return images.PNG_MAGIC + images.chunk(b"IHDR", head) + b"".join(images.chunk(n, b) for n, b in more) + images.chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
@pytest.mark.parametrize("color", [0, 3])
@pytest.mark.parametrize("kind", range(5))
def test_small_depths_and_palettes(depth, color, kind):
    """Lines of all filters, made by the filters' definition."""
    values = np.random.default_rng(depth).integers(0, 1 << depth, (5, 13)).astype("u1")
    palette = np.random.default_rng(9).integers(0, 256, (1 << depth, 3)).astype("u1")
    bits = np.unpackbits(values[:, :, None], axis=2)[:, :, 8 - depth :].reshape(5, -1)
    lines, raw, up = np.packbits(bits, axis=1).astype(int), b"", None
    for line in lines:
        up = np.zeros_like(line) if up is None else up
        left, corner = np.r_[0, line[:-1]], np.r_[0, up[:-1]]
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        told = (line - (0, left, up, (left + up) // 2, near)[kind]) & 255
        raw, up = raw + bytes((kind,)) + told.astype("u1").tobytes(), line
    data = png_of(struct.pack(">IIBBBBB", 13, 5, depth, color, 0, 0, 0), (b"PLTE", palette.tobytes()), (b"IDAT", zlib.compress(raw)))
    assert np.array_equal(images.samples(data), palette[values].transpose(2, 0, 1) if color == 3 else values[None])
    if color == 3:
        with pytest.raises(ValueError):
            images.samples(data.replace(images.chunk(b"PLTE", palette.tobytes()), images.chunk(b"PLTE", palette[: values.max()].tobytes())))


def test_chunks_up_to_the_image_data(spark, tmp_path):
    points = [31270, 32900, 64000, 33000, 30000, 60000, 15000, 6000]
    ahead = [(b"gAMA", struct.pack(">I", 45455)), (b"cHRM", struct.pack(">8I", *points)), (b"sRGB", b"\1"), (b"tEXt", b"a" * 70_000), (b"sRGB", b"\7")]
    good = png_of(struct.pack(">IIBBBBB", 1 << 31, 7, 4, 3, 0, 0, 1), *ahead, (b"IDAT", bytes(100_000)), (b"tIME", bytes(7)))
    (tmp_path / "good.png").write_bytes(good)
    (tmp_path / "bad_sum.png").write_bytes(good.replace(struct.pack(">I", 45455), struct.pack(">I", 45456)))
    (tmp_path / "cut.png").write_bytes(good[:60])
    (tmp_path / "none.png").write_bytes(b"text")
    (tmp_path / "empty.png").write_bytes(b"")
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir() if p.suffix == ".png"], "path string")
    rows = {}
    for r in sorted(png_chunks.values(png_chunks.chunks_of(paths)).collect(), key=lambda r: r["n"]):
        rows.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    told = rows["good.png"]
    assert [r["name"] for r in told] == ["IHDR", "gAMA", "cHRM", "sRGB", "tEXt", "sRGB", "IDAT"]
    assert (told[0]["width"], told[0]["height"], told[0]["depth"], told[0]["color"], told[0]["interlace"]) == (1 << 31, 7, 4, "PLT", "Adam7")
    assert told[1]["gamma"] == 0.45455 and told[2]["white"] + told[2]["blue"] == [p / 1e5 for p in points[:2] + points[6:]]
    assert [told[i]["intent"] for i in (3, 5)] == ["Relative colorimetric", "(invalid)"]
    assert [r["crc_ok"] for r in told] == [True] * 4 + [None, True, None] and told[6]["length"] == 100_000
    assert [r["crc_ok"] for r in rows["bad_sum.png"][:3]] == [True, False, True]
    assert rows["cut.png"][-1]["error"] and rows["none.png"][0]["error"] and rows["empty.png"][0]["error"]
    source = Counting(good)
    assert len(list(png_chunks.walk(source))) == 7 and sum(b - a for a, b in source.spans) < 300
    assert [r["name"] for r in png_chunks.walk(Counting(good), to_end=True)][-2:] == ["tIME", "IEND"]
