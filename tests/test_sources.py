import json
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from lithograph.sources import images, labelled, raster_source, tile_sink, whole_image
from lithograph.sources.raster_source import RasterReader, layout_of
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

CUBE = np.random.default_rng(4).integers(-3000, 3000, (3, 21, 17), np.int16)


def prefixed(org):
    """A labelled raster with a record ahead of the samples and five bytes ahead of each record."""
    order = {"BSQ": (0, 1, 2), "BIL": (1, 0, 2), "BIP": (1, 2, 0)}[org]
    body = CUBE.transpose(order).astype(">i2")
    record = body.shape[2] * 2 + 5
    rows = b"".join(b"\xff" * 5 + body[i, j].tobytes() for i in range(body.shape[0]) for j in range(body.shape[1]))
    text = f"LBLSIZE=400 FORMAT='HALF' ORG='{org}' NL=21 NS=17 NB=3 RECSIZE={record} NLB=1 NBB=5 INTFMT='HIGH' "
    return text.encode().ljust(400, b"\0") + b"x" * record + rows


def wrapped(data):
    head = b"PDS_VERSION_ID = PDS3\r\nRECORD_TYPE = FIXED_LENGTH\r\nRECORD_BYTES = 100\r\n^IMAGE_HEADER = 4\r\nEND\r\n"
    return head.ljust(300) + data


class Counting(pa.BufferReader):
    """What is read, and from where."""

    def __init__(self, data):
        super().__init__(data)
        self.spans = []

    def read(self, n=None):
        at = self.tell()
        data = super().read(n)
        self.spans.append((at, at + len(data)))
        return data


FILES = {f"{kind}-{org}": make(org) for org in ("BSQ", "BIL", "BIP") for kind, make in (("plain", lambda o: labelled.labelled_file(CUBE, o)), ("prefixed", prefixed), ("wrapped", lambda o: wrapped(prefixed(o))))}


@pytest.mark.parametrize("name", FILES)
def test_windows_read_their_own_bytes_alone(name):
    data = FILES[name]
    layout = layout_of(name, pa.BufferReader(data))
    assert (layout.width, layout.height, layout.bands) == (17, 21, 3)
    for bands, y, x, h, w in (([0, 1, 2], 0, 0, 21, 17), ([1], 3, 0, 5, 17), ([2], 20, 16, 1, 1), ([0, 2], 4, 5, 6, 7)):
        source = Counting(data)
        got = layout.window(source, bands, y, x, h, w)
        assert np.array_equal(got, CUBE[bands, y : y + h, x : x + w])
        per_sample = 2 * h * w
        prefix = layout.prefix
        most = {"BSQ": len(bands) * (per_sample + prefix * h), "BIL": len(bands) * (per_sample + prefix * h), "BIP": h * w * (6 + prefix)}[layout.org]
        assert sum(b - a for a, b in source.spans) <= most and all(a >= layout.start for a, _ in source.spans)


def test_what_is_broken_is_told():
    data = labelled.labelled_file(CUBE)
    layout = layout_of("x", pa.BufferReader(data))
    with pytest.raises(ValueError, match="ends before"):
        layout.window(pa.BufferReader(data[:-9]), [2], 0, 0, 21, 17)
    for bad in (b"", b"LBLSIZE=99999999999 ", b"no label at all"):
        with pytest.raises(ValueError, match="no label"):
            layout_of("x", pa.BufferReader(bad))


@pytest.fixture(scope="module")
def rasters(tmp_path_factory):
    folder = tmp_path_factory.mktemp("rasters")
    for name, data in FILES.items():
        (folder / "deep").mkdir(exist_ok=True)
        (folder / "deep" / f"{name}.IMG").write_bytes(data)
    (folder / "other.txt").write_text("no raster")
    return f"file://{folder}"


def whole(rows):
    """path: the image that windows make up."""
    out = {}
    for r in rows:
        out.setdefault(os.path.basename(r.path), np.zeros_like(CUBE))[r.band, r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(bytes(r.data), r.dtype).reshape(r.h, r.w)
    return out


def test_both_ways_give_the_images(spark, rasters):
    frame = raster_source.read_rasters(spark, rasters, lines=8, samples=10)
    rows = frame.collect()
    found = whole(rows)
    assert found.keys() == {f"{n}.IMG" for n in FILES} and all(np.array_equal(c, CUBE) for c in found.values()) and len(rows) == 9 * 3 * 6
    paths = images.listing(spark, rasters, "*.IMG").select("path")
    by_rows = raster_source.read_windows(raster_source.windows_of(raster_source.layouts(paths), 8, 10).where("y = 8"), [0, 2]).collect()
    key = lambda r: (os.path.basename(r.path), r.band, r.y, r.x, r.h, r.w, bytes(r.data))
    assert sorted(map(key, by_rows)) == sorted(key(r) for r in rows if r.y == 8 and r.band != 1)
    sums = raster_source.window_sums(frame).agg(F.sum("s"), F.sum("n")).first()
    assert tuple(sums) == (9 * CUBE.sum(dtype=float), 9 * CUBE.size)


def test_filters_leave_windows_unread(spark, rasters):
    reader = RasterReader({"path": rasters, "lines": "8", "samples": "10"})
    every = len(reader.partitions())
    left = list(reader.pushFilters([EqualTo(("band",), 1), GreaterThanOrEqual(("y",), 8), LessThan(("x",), 10), StringContains(("path",), "plain")]))
    planned = reader.partitions()
    assert every == 9 * 6 and len(planned) == 9 * 2 and {(w.y, w.x, tuple(w.bands)) for w in planned} == {(8, 0, (1,)), (16, 0, (1,))} and left == [StringContains(("path",), "plain")]
    one = [p.layout.path for p in planned][:1]
    list(reader.pushFilters([In(("path",), tuple(one))]))
    assert {w.layout.path for w in reader.partitions()} == set(one)
    frame = raster_source.read_rasters(spark, rasters, lines=8, samples=10).where("band = 1 and y >= 8 and path like '%plain%' and h > 0")
    assert {(r.band, r.y) for r in frame.collect()} == {(1, 8), (1, 16)} and frame.rdd.getNumPartitions() == 9 * 4
    assert raster_source.read_rasters(spark, rasters).where("band = 7").count() == 0


def test_many_windows_share_tasks(spark, rasters):
    few = {"path": rasters, "lines": "2", "samples": "3", "tasks": "7"}
    planned = RasterReader(few).partitions()
    alone = RasterReader(few | {"tasks": "1000000"}).partitions()
    assert len(planned) == 7 and len(alone) > 256 and [w for p in planned for w in p.windows] == alone and max(len(p.windows) for p in planned) < 2 * len(alone) / 7
    frame = raster_source.read_rasters(spark, rasters, lines=2, samples=3)
    found = whole(frame.collect())
    assert frame.rdd.getNumPartitions() <= 256 and found.keys() == {f"{n}.IMG" for n in FILES} and all(np.array_equal(c, CUBE) for c in found.values())


TILE = "image_id string, level int, col int, row int, w int, h int, format string, data binary"


def some_tiles(spark, n, mark, image="i"):
    return spark.createDataFrame([(image, 3, i % 4, i // 4, 2, 2, "png", bytes([mark, i])) for i in range(n)], TILE)


def test_the_manifest_tells_what_counts(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    assert tile_sink.committed(spark, root).count() == 0
    tile_sink.write_tiles(some_tiles(spark, 10, 1), root)
    tile_sink.write_tiles(some_tiles(spark, 3, 2), root)  # replaces three
    tile_sink.write_tiles(some_tiles(spark, 0, 3), root)
    rows = raster_source.contents(tile_sink.committed(spark, root)).collect()
    assert sorted(bytes(r.content) for r in rows) == sorted([bytes([2, i]) for i in range(3)] + [bytes([1, i]) for i in range(3, 10)])
    assert not [f for f in tmp_path.rglob(".*") if f.is_file() and "crc" not in f.name] and len(tile_sink.commits(root)) == 3
    with pytest.raises(Exception, match="no name for a folder"):
        tile_sink.write_tiles(some_tiles(spark, 2, 4, "../up"), root)
    with pytest.raises(Exception, match="lack the columns"):
        tile_sink.write_tiles(some_tiles(spark, 2, 4).drop("data"), root)
    assert tile_sink.committed(spark, root).count() == 10 and not (tmp_path / "up").exists()


def test_a_job_that_fails_leaves_what_was_committed(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    tile_sink.write_tiles(some_tiles(spark, 4, 1), root)

    def broken(batches):
        from pyspark import TaskContext

        for batch in batches:
            yield batch
            if TaskContext.get().partitionId() == 1:
                import time

                time.sleep(3)  # the others end first
                raise RuntimeError("no more tiles")

    with pytest.raises(Exception, match="no more tiles"):
        tile_sink.write_tiles(some_tiles(spark, 12, 2).repartition(3, "row").mapInArrow(broken, TILE), root)
    rows = tile_sink.committed(spark, root).collect()
    assert len(rows) == 4 and all((tmp_path / "out/i/image_files/3" / f"{r.col}_{r.row}.png").exists() for r in rows)
    assert len(list((tmp_path / "out").rglob("*.png"))) == 4 and len(list((tmp_path / "out/_manifest").glob("*.json"))) == 1


SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from lithograph.sources import tile_sink
rows = [("i", 1, i, 0, 1, 1, "png", bytes([i])) for i in range(40)]
tiles = spark.createDataFrame(rows, {kind!r}).repartition(4, "col")
def dies(batches):
    from pyspark import TaskContext
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)
            if i == 5 and TaskContext.get().attemptNumber() < 2:
                os._exit(3) if TaskContext.get().attemptNumber() else (_ for _ in ()).throw(RuntimeError("first attempt"))
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
tile_sink.write_tiles(tiles.mapInArrow(dies, {kind!r}), {root!r})
found = tile_sink.committed(spark, {root!r}).collect()
print("FOUND", len(found), len({{r.path for r in found}}))
"""


def test_tasks_that_die_are_written_exactly_once(tmp_path):
    """A first attempt fails, a second loses its worker, the third one counts."""
    script = SCRIPT.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), kind=TILE, root=f"file://{tmp_path}/out")
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert "FOUND 40 40" in done.stdout, done.stderr[-2000:]
    assert sorted(f.read_bytes() for f in (tmp_path / "out").rglob("*.png")) == [bytes([i]) for i in range(40)]
    (commit,) = (tmp_path / "out/_manifest").glob("*.json")
    assert json.loads(commit.read_text())["tiles"] == 40


@pytest.mark.parametrize(("bands", "lines"), [(1, 1), (3, 4), (4, 100)])
def test_one_file_made_of_strips(spark, tmp_path, bands, lines):
    cube = np.random.default_rng(bands).integers(0, 256, (bands, 23, 19), np.uint8)
    cube[:, 8:16] = 0  # lines without any pixel row
    rows = [("i", y, x, b, int(cube[b, y, x])) for b in range(bands) for y in range(23) for x in range(19) if not 8 <= y < 16]
    pixels = spark.createDataFrame(rows, "image_id string, y int, x int, band int, out int")
    sizes = spark.createDataFrame([("i", 19, 23), ("black", 3, 9), ("none", 0, 5)], "image_id string, width int, height int")
    whole_image.strips(pixels, sizes, bands, lines).write.parquet(f"{tmp_path}/strips")
    parts = whole_image.pieces(spark.read.parquet(f"{tmp_path}/strips"), bands)
    made = {r.image_id: r for r in whole_image.write_images(parts, f"file://{tmp_path}/out").collect()}
    assert made.keys() == {"i", "black"} and not list((tmp_path / "out").glob(".*"))
    data = open(made["i"].path, "rb").read()
    assert len(data) == made["i"].bytes and sum(name == b"IDAT" for name, _ in images.chunks(data)) == -(-23 // lines)
    assert np.array_equal(images.samples(data), cube)  # which checks the stream's own checksum
    assert np.array_equal(images.samples(open(made["black"].path, "rb").read()), np.zeros((bands, 9, 3)))
    if lines > 1:
        assert max(len(bytes(r.data)) for r in parts.collect()) < 200 + lines * 19 * bands * 2
    with pytest.raises(ValueError, match="no writes in the midst"):
        whole_image.write_images(parts, "s3://bucket/x")
