"""Files: labelled rasters in all orders, PNG round trips, headers, pyramids and URL policy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithograph.functions import labels, units, urls
from lithograph.operators import catalog, pyramid, tiles
from lithograph.sources import images, labelled, sinks
from lithograph.streaming import ingest, state


def cube(bands, h, w, kind):
    return (np.arange(bands * h * w) * 37 % 251).reshape(bands, h, w).astype(kind)


@pytest.mark.parametrize("org", ["BSQ", "BIL", "BIP"])
@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "f4", "f8"])
def test_labelled_rasters_read_back(org, kind):
    made = cube(3, 5, 7, kind)
    data = labelled.labelled_file(made, org)
    assert np.array_equal(images.samples(data), made)
    assert images.header(data) == {"format": "label", "width": 7, "height": 5, "bands": 3, "bytes_per_sample": np.dtype(kind).itemsize, "is_float": kind[0] == "f", "has_alpha": False}


def test_wrapped_label_and_broken_files():
    inner = labelled.labelled_file(cube(1, 2, 3, "i2"))
    wrapped = b"RECORD_TYPE = FIXED\nRECORD_BYTES = 200\n^IMAGE_HEADER = 2\n".ljust(200) + inner
    assert np.array_equal(images.samples(wrapped), cube(1, 2, 3, "i2"))
    assert images.header(b"nothing")["error"] and images.header(inner.replace(b"HALF", b"ODD "))["error"]


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_png_round_trip_and_gamma(bands, kind):
    made = cube(bands, 6, 5, kind)
    data = images.with_gamma(images.png(made), 0.45)
    assert np.array_equal(images.samples(data), made)
    assert [n for n, _ in images.chunks(data)] == [b"IHDR", b"gAMA", b"IDAT", b"IEND"]
    assert images.with_gamma(data, 0.45) == data


def test_files_become_pixels(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(labelled.labelled_file(cube(2, 300, 270, "i2")))
    (tmp_path / "b.png").write_bytes(images.png(cube(3, 4, 4, "u1")))
    (tmp_path / "c.txt").write_bytes(b"no image")
    found = images.files(spark, str(tmp_path))
    heads = {r["path"].rsplit("/", 1)[1]: r for r in images.headers(found).collect()}
    assert (heads["a.img"]["width"], heads["b.png"]["bands"]) == (270, 3) and heads["c.txt"]["error"]
    pixels = images.pixels(images.blocks(images.files(spark, str(tmp_path), "*.img")))
    assert pixels.count() == 2 * 300 * 270
    assert pixels.where("band = 1 and y = 299 and x = 269").first()["dn"] == cube(2, 300, 270, "i2")[1, 299, 269]
    assert images.listing(spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize("w, h, top", [(1, 1, 0), (1, 4, 2), (254, 1, 8), (255, 3, 8), (256, 256, 8), (257, 1, 9), (1000, 3, 10), (1 << 29, 1, 29)])
def test_levels_start_with_one_pixel(spark, w, h, top):
    rows = pyramid.levels(spark.createDataFrame([("a", w, h)], "image_id string, width long, height long")).orderBy("level").collect()
    assert [r["level"] for r in rows] == list(range(top + 1)) and (rows[0]["w"], rows[0]["h"]) == (1, 1) and (rows[-1]["w"], rows[-1]["h"]) == (w, h)


def test_tiles_cover_their_level_and_overlap_inside(spark):
    rects = pyramid.tile_rects(pyramid.levels(spark.createDataFrame([("a", 508, 509)], "image_id string, width long, height long"))).where("level = 9").collect()
    by = {(r["col"], r["row"]): (r["x"], r["y"], r["tw"], r["th"]) for r in rects}
    assert by[0, 0] == (0, 0, 255, 255) and by[1, 1] == (253, 253, 255, 256) and by[1, 2] == (253, 507, 255, 2)


HOSTS = {
    "http://localhost/a.img": "unsafe_host", "http://LOCALHOST./a.img": "unsafe_host", "http://x.localhost/a.img": "unsafe_host", "http://127.0.0.1/a.img": "unsafe_host", "http://127.1/a.img": "unsafe_host",
    "http://2130706433/a.img": "unsafe_host", "http://100.64.0.1/a.img": "unsafe_host", "http://example.com@127.0.0.1/a.img": "unsafe_host", "http://metadata.google.internal/a.img": "unsafe_host",
    "http://100.63.0.1/a.img": "ok", "http://172.15.0.1/a.img": "ok", "http://198.18.0.1/a.img": "unsafe_host", "http://223.1.1.1/a.img": "ok", "http://224.1.1.1/a.img": "unsafe_host",
    "/etc/passwd.img": "absolute_path", "file:///etc/passwd.img": "absolute_path", "a/../b.img": "dotdot", "a/b.txt": "unsupported_ext", "a/b.IMG?x=1": "ok", "s3://b/k.vic": "ok",
}


def test_url_policy(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "url string")
    got = {r[0]: r[1] for r in df.select("url", urls.policy(F.col("url"), [".*"], ["ignored"], [])).collect()}
    assert got == HOSTS


def test_paths_and_hashes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(urls.set_ext(F.lit("a.b/c?q=1.2"), "png")) == "a.b/c.png?q=1.2"
    assert one(urls.cache_hash(F.lit("x/y.VIC"))) == one(urls.cache_hash(F.lit("file://x/y.img")))
    assert one(urls.cache_hash(F.lit("https://b.s3.eu-west-1.amazonaws.com/k/y.vic"))) == one(urls.cache_hash(F.lit("s3://b/k/y.IMG")))
    assert one(units.parse_bytes(F.lit("16m"))) == 16 << 20 and one(units.parse_seconds(F.lit("1h"))) == 3600 and one(units.parse_bytes(F.lit("auto"))) is None
    assert one(units.significant_bits(F.lit("2#0000111111111111#"))) == 12 and one(units.label_gamma(F.lit("sRGB"))) == 0.45 and one(units.trimmed(F.lit(' "{a}" '))) == "a"
    with pytest.raises(Exception, match="not a size"):
        one(units.parse_bytes(F.lit("many")))


def test_labels_nest(spark):
    text = "LBLSIZE=400 A='it''s' B=3 PROPERTY='P' C=1.5D2 D=(1,2,3) E=('x','y') TASK='T' USER='u' TASK='V' F=-2"
    df = spark.createDataFrame([("p", text)], "path string, text string")
    items = {r["name"]: r for r in labels.typed(labels.items(df)).collect()}
    assert "LBLSIZE" not in items and items["A"]["s"] == "it's" and items["B"]["i"] == 3 and items["C"]["d"] == 150.0 and items["D"]["n"] == 3 and items["E"]["n"] == 2
    nested = labels.nested(labels.items(df)).first()
    assert nested["system"] == {"A": "'it''s'", "B": "3"} and set(nested["properties"]) == {"P"} and [t["title"] for t in nested["tasks"]] == ["T", "V"]
    wrong = spark.createDataFrame([("p", "TASK='T' PROPERTY='P'")], "path string, text string")
    assert labels.grouped(labels.items(wrong)).where("error").count() == 1


def test_page_returns(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([1, 2, 3, 1, 4, 2, 1])], "owner long, seq long, page long")
    assert [r["gap"] for r in catalog.page_returns(df).orderBy("seq").collect()] == [None, None, None, 2, None, 3, 2]


def test_notifications_are_decided_by_time(spark):
    record = lambda name, t, key: f'{{"eventName":"{name}","eventTime":"{t}","s3":{{"bucket":{{"name":"b"}},"object":{{"key":"{key}"}}}}}}'
    plain = '{"Records":[' + record("ObjectCreated:Put", "2024-01-02T00:00:00Z", "a+b%2Fc") + "," + record("ObjectRemoved:Delete", "2024-01-01T00:00:00Z", "a+b%2Fc") + "]}"
    wrapped = '{"Message": ' + __import__("json").dumps('{"Records":[' + record("ObjectRemoved:Delete", "2024-01-03T00:00:00Z", "d") + "]}") + "}"
    got = ingest.decided(ingest.notifications(spark.createDataFrame([(plain,), (wrapped,), ("{}",)], "body string"))).select("key", "action").collect()
    assert {tuple(r) for r in got} == {("a b/c", "build"), ("d", "delete")}
    batch = ingest.decided(ingest.notifications(spark.createDataFrame([(plain,)], "body string")))
    assert ingest.applied(batch, batch).collect() == batch.collect()


def test_watched_tasks_stream(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    kinds = "task string, progress double, ts timestamp"
    batches = [[("a", 10.0, at(0)), ("b", 100.0, at(0)), ("z", 5.0, at(0))], [("a", 20.0, at(5)), ("c", 1.0, at(200))], [("a", 30.0, at(201))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.watched_tasks(stream).writeStream.format("memory").queryName("watched").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    rows = {tuple(r) for r in spark.sql("select * from watched").collect()}
    assert {("a", 1, "running"), ("b", 1, "done"), ("a", 2, "running"), ("c", 1, "running"), ("z", 1, "zombie")} <= rows
    assert rows - {("z", 1, "running"), ("a", 3, "failed"), ("a", 2, "zombie"), ("a", 1, "running")} == {("b", 1, "done"), ("a", 2, "running"), ("c", 1, "running"), ("z", 1, "zombie")}


def test_ingest_recovers_from_its_checkpoint(spark, tmp_path):
    kinds = "bucket string, key string, event_name string, ts timestamp"
    at = lambda day: dt.datetime(2024, 1, day)
    put, gone = "ObjectCreated:Put", "ObjectRemoved:Delete"

    def add(name, rows):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{name}"))

    def run():
        stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = ingest.run_batches(stream, ingest.appended_to(str(tmp_path / "table")), str(tmp_path / "c"))
        assert query.awaitTermination(120)
        return {tuple(r) for r in ingest.current(spark, str(tmp_path / "table")).select("key", "action").collect()}

    add("0", [("b", "x", put, at(1)), ("b", "y", put, at(2))])
    assert run() == {("x", "build"), ("y", "build")}
    add("1", [("b", "x", gone, at(3)), ("b", "y", put, at(1))])
    assert run() == {("x", "delete"), ("y", "build")}  # a new query, which goes on where the last one ended
    assert spark.read.parquet(str(tmp_path / "table")).groupBy("batch").count().count() == 2


def test_single_flight_stream(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    kinds = "cache_hash string, ts timestamp"
    for i, rows in enumerate([[("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(3)), ("c", at(300))]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.single_flight(stream).writeStream.format("memory").queryName("flights").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r["cache_hash"] for r in spark.sql("select * from flights").collect()) == ["a", "b", "c"]


def test_outcomes_of_a_batch(spark, tmp_path):
    decisions = spark.createDataFrame([("b", k, a) for k, a in zip("opqrstu", ["build"] * 5 + ["delete", "ignore"], strict=True)], "bucket string, key string, action string")
    sources = spark.createDataFrame(
        [("b", "o", True, False, None), ("b", "p", True, True, None), ("b", "q", True, False, "cancelled"), ("b", "r", True, False, "no compatible image reader for r"), ("b", "s", True, False, "disk full")],
        "bucket string, key string, supported boolean, oversize boolean, error string",
    )
    routed = ingest.routed(decisions, sources)
    assert {(r["key"], r["outcome"]) for r in routed.collect()} == {("o", "processed"), ("p", "forwarded"), ("q", "cancelled"), ("r", "failed"), ("s", "retry"), ("t", "processed"), ("u", "ignored")}
    ingest.split_by_outcome(routed, str(tmp_path / "q"), 0)
    assert spark.read.parquet(str(tmp_path / "q/forward")).count() == 1 and spark.read.parquet(str(tmp_path / "q/retry")).count() == 1
    counted = catalog.outcomes(routed.withColumn("batch", F.lit(0))).first().asDict()
    assert counted == {"batch": 0, "events": 7, "processed": 2, "cancelled": 1, "rejected": 0, "forwarded": 1, "retry": 1}
    sent = spark.createDataFrame([("m",), ("m",), ("m",), ("n",)], "message string")
    assert {tuple(r) for r in ingest.retry_counts(sent, ["message"]).collect()} == {("m", 3, "fail_queue"), ("n", 1, "process")}


def test_second_labels_wrappers_and_late_directories(spark, tmp_path):
    made = cube(2, 4, 6, "i2")
    one = labelled.labelled_file(made).replace(b"EOL=0", b"EOL=1") + b"LBLSIZE=96       TASK='LATE' USER='u'".ljust(96, b"\0")
    assert images.end_label(one).startswith("LBLSIZE=96") and "LATE" in images.end_label(one)
    size = len(one) - len(one) % 100 + 100
    wrapped = f"PDS_VERSION_ID = PDS3\r\nRECORD_TYPE = FIXED_LENGTH\r\nRECORD_BYTES = {size}\r\n^IMAGE_HEADER = 2\r\nEND\r\n".encode().ljust(size) + one
    assert images.header(wrapped.replace(b"PDS_VERSION_ID", b"PDS_VERS      "))["width"] == 6
    bare = b"PDS_VERS = 3\r\nRECORD_TYPE = FIXED_LENGTH\r\nOBJECT = IMAGE\r\n LINES = 3\r\n LINE_SAMPLES = 5\r\n BANDS = 1\r\n SAMPLE_BITS = 16\r\n SAMPLE_TYPE = MSB_INTEGER\r\nSAMPLE_BIT_MASK = 2#0000111111111111#\r\nINVALID_CONSTANT = (7)\r\nEND_OBJECT = IMAGE\r\nEND\r\n"
    assert images.header(bare) == {"format": "label", "width": 5, "height": 3, "bands": 1, "bytes_per_sample": 2, "is_float": False, "has_alpha": False}
    assert images.details(bare, 1, 15, None, True) == {"significant_bits": 12, "gamma": None, "invalid": [[7.0], [0.0]]}
    import struct

    entries = [(256, 4, 1, 40), (257, 4, 1, 30), (258, 3, 1, 8), (277, 3, 1, 1)]
    late = b"II*\0" + struct.pack("<I", 200_000) + b"\0" * (200_000 - 8) + struct.pack("<H", 4) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4
    (tmp_path / "a.tif").write_bytes(late)
    (tmp_path / "b.img").write_bytes(one)
    found = images.files(spark, str(tmp_path))
    assert {r["width"] for r in images.headers(found).collect()} == {40, 6}
    assert images.labels_of(found).count() == 2 and images.label_details(found).first()["significant_bits"] == 12


def test_png_of_every_filter():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (3, 6, 7), np.uint8)
    rows, raw = want.transpose(1, 2, 0).reshape(6, 21).astype(int), b""
    for y, kind in enumerate([0, 1, 2, 3, 4, 1]):
        up = rows[y - 1] if y else np.zeros(21, int)
        left, corner = np.concatenate([[0] * 3, rows[y][:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        raw += bytes([kind]) + bytes(((rows[y] - (0, left, up, (left + up) // 2, near)[kind]) & 255).astype(np.uint8) if kind else rows[y].astype(np.uint8))
    data = images.PNG_MAGIC + images.chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 6, 8, 2, 0, 0, 0)) + images.chunk(b"IDAT", zlib.compress(raw)) + images.chunk(b"IEND", b"")
    assert np.array_equal(images.samples(data), want)


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_pyramid_of_an_odd_image(spark, tmp_path, overlap):
    image = np.random.default_rng(2).integers(0, 256, (1, 37, 21), np.uint8)
    rows = [("i", y, x, 0, int(image[0, y, x])) for y in range(37) for x in range(21)]
    pixels = spark.createDataFrame(rows, "image_id string, y int, x int, band int, out int")
    sizes = spark.createDataFrame([("i", 21, 37), ("e", 1, 1)], "image_id string, width int, height int")
    made = {(r["level"], r["col"], r["row"]): images.samples(bytes(r["data"])) for r in tiles.tile_pyramid(pixels, sizes, 1, f"file://{tmp_path}", 8, overlap).where("image_id = 'i'").collect()}
    level = image
    for number in range(6, -1, -1):
        cols, rows = -(-level.shape[2] // 8), -(-level.shape[1] // 8)
        assert {k for k in made if k[0] == number} == {(number, c, r) for c in range(cols) for r in range(rows)}
        for c in range(cols):
            for r in range(rows):
                want = level[:, max(0, r * 8 - overlap) : r * 8 + 8 + overlap, max(0, c * 8 - overlap) : c * 8 + 8 + overlap]
                assert np.array_equal(made[number, c, r], want)
        level = tiles.halved(level)
    found = tiles.tile_pyramid(pixels, sizes, 1, f"file://{tmp_path}", 8, overlap)
    manifest = sinks.write_tile_files(found, f"file://{tmp_path}/out")
    assert {(r["level"], r["tiles"]) for r in sinks.written_per_level(manifest).collect()} == {(6, 15), (5, 6), (4, 2), (3, 1), (2, 1), (1, 1), (0, 1)}
    assert (tmp_path / "out/i/image_files/6/2_4.png").exists()


def test_tiles_and_metadata(spark, tmp_path):
    pixels = spark.createDataFrame([("i", 0, 0, 0, y, x, 0, (y * 3 + x) * 20) for y in range(2) for x in range(3)], "image_id string, level int, col int, row int, y int, x int, band int, out int")
    tiles = sinks.png_tiles(pixels, 1)
    sinks.write_tiles(tiles, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).first()
    assert images.samples(bytes(back["data"]))[0].tolist() == [[0, 20, 40], [60, 80, 100]] and back["image_id"] == "i"
    doc = spark.createDataFrame([("i", 3, None, dt.datetime(2024, 5, 6, 7, 8, 9))], "image_id string, w int, gamma double, ts timestamp")
    assert sinks.metadata(doc.withColumn("ts", units.iso_minute("ts"))).first()["metadata"] == '{"w":3,"ts":"2024-05-06T07:08Z"}'


def test_small_tiles_are_drawn_by_batches_in_many_tasks(spark, tmp_path):
    from lithograph.sources import raster_source

    rng, rows, wanted = np.random.default_rng(5), [], {}
    for image in ("a", "b", None):
        for col in range(5):
            wanted[image, col] = rng.integers(0, 256, (2, 3, 4), np.uint8)
            rows += [(image, 1, col, 0, y + 7, x + 4 * col, b, int(v)) for (b, y, x), v in np.ndenumerate(wanted[image, col])]
    pixels = spark.createDataFrame(rows, "image_id string, level int, col int, row int, y int, x int, band int, out int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # tiles reach over batches
    try:
        tiles = sinks.png_tiles(pixels, 2)
        found = tiles.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 15 and all(np.array_equal(images.samples(bytes(r.data)), wanted[r.image_id, r.col]) and (r.w, r.h, r.row, r.format) == (4, 3, 0, "png") for r in found)
    many = images.dealt_over(spark)
    paths = raster_source.write_files(tiles.where("image_id is not null").select(F.concat_ws("-", "image_id", "col").alias("path"), F.col("data").alias("content")), f"file://{tmp_path}/few")
    files = raster_source.contents(paths)
    assert many >= 8 and tiles.rdd.getNumPartitions() == many and files.rdd.getNumPartitions() == many
    got = {(r["path"].rsplit("/", 1)[1], r["band"], r["y"], r["x"]): r["dn"] for r in images.pixels(images.blocks(files, 2), 2).collect()}
    assert got == {(f"{i}-{c}", b, y, x): v for (i, c), cube in wanted.items() if i for (b, y, x), v in np.ndenumerate(cube)}


def test_tiles_are_counted_as_bits_of_squares(spark):
    made = [("i", 9, c, r) for c in range(19) for r in range(23) if (c + r) % 3] * 2 + [("i", 2, 0, 0), ("j", 2, 7, 8)]
    counted = sinks.written_per_level(spark.createDataFrame(made, "image_id string, level int, col int, row int"))
    assert {tuple(r) for r in counted.collect()} == {("i", 9, len(set(made[:-2]))), ("i", 2, 1), ("j", 2, 1)}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(" in line and "col#" in line for line in plan.splitlines())


def test_ranges_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from lithograph.sources import http as ranged

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/file")
                self.end_headers()
                return
            first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            data = bytes(range(256))[first : last + 1]
            self.send_response(206 if self.path == "/file" else 200)
            self.send_header("Content-Range", f"bytes {first}-{last}/256")
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        wanted = spark.createDataFrame([(f"{base}/file", 10, 5), (f"{base}/moved", 0, 3), (f"{base}/whole", 0, 3), ("ftp://x/y", 0, 1)], "url string, start long, length long")
        rows = {r["url"].rsplit("/", 1)[1]: r for r in ranged.ranges(wanted, lambda host, port: ["127.0.0.1"]).collect()}
        assert bytes(rows["file"]["data"]) == bytes(range(10, 15)) and rows["file"]["total"] == 256 and bytes(rows["moved"]["data"]) == bytes(range(3))
        assert rows["whole"]["status"] == 200 and rows["whole"]["data"] == b"" and "not an HTTP URL" in rows["y"]["error"]
        refused = ranged.ranges(wanted.limit(1)).first()
        assert refused["data"] is None and "public" in refused["error"]
    finally:
        server.shutdown()
    unsafe = ["127.0.0.1", "10.1.2.3", "100.64.0.1", "169.254.169.254", "192.0.0.8", "198.18.0.1", "224.0.0.1", "::1", "fe80::1", "fec0::1", "fd00:ec2::254", "::ffff:10.0.0.1", "64:ff9b::a9fe:a9fe", "2002:a9fe:a9fe::", "2001::1", "64:ff9b:1::1", "::7f00:1"]
    assert not any(map(ranged.public, unsafe)) and all(map(ranged.public, ["8.8.8.8", "2606:4700::1111", "::ffff:8.8.8.8", "64:ff9b::808:808"]))


def test_hosts_of_the_service_tests(spark):
    """URLs that a source filter with an open whitelist must reject, as a running service was tried with."""
    hosts = "localhost:8080 LOCALHOST.:8080 foo.localhost 127.0.0.1:8080 127.1 2130706433 0.0.0.0 10.1.2.3 172.16.0.1 192.168.1.1 100.100.100.200 169.254.169.254 metadata.google.internal example.com@127.0.0.1 no-such-host.invalid"
    hosts += " [::1]:8080 [fe80::1] [fd00:ec2::254] [::ffff:169.254.169.254] [64:ff9b::a9fe:a9fe] [2002:a9fe:a9fe::] [nonsense] [::1 0x7f.1 1.2.3.4.5"
    df = spark.createDataFrame([(f"http://{h}/x.IMG",) for h in hosts.split()] + [("http://[2606:4700::1111]/x.IMG",), ("http://example.com/x.IMG",)], "url string")
    got = {r[0]: r[1] for r in df.select("url", urls.policy(F.col("url"), [".*"], [], [])).collect()}
    assert {u for u, reason in got.items() if reason == "ok"} == {"http://[2606:4700::1111]/x.IMG", "http://example.com/x.IMG"}


def test_first_group_zero_isn_t_unsafe_by_itself(spark):
    """Answers of the reference's isSafeAddress: all ten first bytes must be zero for an IPv4 address to be held."""
    told = {"0:1fab:100::1": True, "0:0:0:0:1::1": True, "::10.0.0.1": False, "0:0:0:0:0:0:808:808": True, "::1": False, "64:ff9b:100::1": True}
    df = spark.createDataFrame([(a,) for a in told], "ip string")
    assert {r[0]: r[1] for r in df.select("ip", urls.safe_ipv6(F.col("ip"))).collect()} == told


def test_known_headers_aren_t_read_again(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(labelled.labelled_file(cube(1, 2, 3, "i2")))
    (tmp_path / "b.img").write_bytes(labelled.labelled_file(cube(1, 4, 5, "i2")))
    found = images.files(spark, str(tmp_path))
    known = images.headers(found).join(found.select("path", "modificationTime"), "path").where("width = 3").withColumn("bands", F.lit(99))
    assert {(r["width"], r["bands"]) for r in images.with_known_headers(found, known).collect()} == {(3, 99), (5, 1)}


def test_bodies_and_settings():
    from lithograph.operators import spec

    made = spec.configured({"TILES_TILE_SIZE": "512", "TILES_QUICKLOOK": ".*/q/.*, .*/r/.*", "PATH": "x"})
    assert made.values == {"tile_size": "512"} and made.quicklook == (".*/q/.*", ".*/r/.*")


def test_bodies_of_the_wrong_type_raise(spark):
    from lithograph.operators import spec

    for body in ('{"tile_size": 3}', '{"rdr_url": "u", "tile_size": "3"}', '{"rdr_url": "u", "force": 1}'):
        with pytest.raises(Exception, match="rdr_url|wrong type"):
            spark.createDataFrame([(body,)], "body string").select(spec.args_of_body(F.col("body"))).collect()
