"""Cases in which a plain reading of the rules is easily missed."""

import numpy as np
import pytest
from lithograph.functions import units
from lithograph.operators import raster, spec, tiles
from lithograph.sources import images
from lithograph.streaming import ingest
from pyspark.sql import functions as F

EVENTS = "bucket string, key string, event_name string, ts long"


def test_ignored_events_never_undo_what_others_tell(spark, tmp_path):
    rows = [("b", "k", "ObjectCreated:Put", 1), ("b", "k", "ObjectTagging:Put", 2), ("b", "gone", "ObjectCreated:Put", 1), ("b", "gone", "ObjectRemoved:Delete", 3), ("b", "none", "ObjectTagging:Put", 2)]
    first = ingest.decided(spark.createDataFrame(rows, EVENTS))
    assert {(r.key, r.ts, r.action) for r in first.collect()} == {("k", 1, "build"), ("gone", 3, "delete"), ("none", 2, "ignore")}
    later = ingest.decided(spark.createDataFrame([("b", "gone", "ObjectTagging:Put", 9), ("b", "k", "ObjectRemoved:Delete", 8)], EVENTS))
    wanted = {("k", "delete"), ("gone", "delete"), ("none", "ignore")}
    assert {(r.key, r.action) for r in ingest.applied(first, later).collect()} == wanted
    for number, batch in enumerate((later, first)):  # in any order
        ingest.appended_to(f"file://{tmp_path}/t")(batch, number)
    assert {(r.key, r.action) for r in ingest.current(spark, f"file://{tmp_path}/t").collect()} == wanted


def resolved(spark, config=None, **args):
    row = ("a/x.IMG", "RAS", "RAS", "N", True, {k: v for k, v in args.items()})
    products = spark.createDataFrame([row], "url string, product_type string, rdr_type string, instrument string, overlayable boolean, args map<string,string>")
    return spec.resolved(products, config or spec.Config()).first()


def test_other_types_make_a_spec_custom(spark):
    assert resolved(spark).nominal and resolved(spark, product_type="ras", rdr_type="auto").nominal
    got = resolved(spark, product_type="ECM")
    assert not got.nominal and (got.product_type, got.rdr_type, got.is_raw, got.stretch_type) == ("ECM", "ECM", True, "none")
    got = resolved(spark, rdr_type="XYZ")
    assert not got.nominal and (got.product_type, got.rdr_type) == ("RAS", "XYZ")
    overlays = spec.Config(rdr_types={"XYM": "XYZ"}, overlayable_types=("XYZ",))
    got = resolved(spark, overlays, product_type="XYM")
    assert (got.rdr_type, got.overlayable, got.nominal) == ("XYZ", True, False) and not resolved(spark, overlays).overlayable


def test_older_ways_to_ask_for_a_stretch(spark):
    assert resolved(spark, stretch_type="Histogram_Percent").stretch_type == "percent"
    got = resolved(spark, stretch_type="none", extrema_stretch="true", stretch_low="1000", stretch_high="3000")
    assert (got.stretch_type, got.stretch_low, got.stretch_high) == ("extrema", 1000.0, 3000.0)
    assert resolved(spark, extrema_stretch="yes").stretch_type == "percent"
    assert resolved(spark, spec.Config({"stretch_type": "histogram_percent"})).stretch_type == "percent" and resolved(spark, spec.Config({"extrema_stretch": "True"})).stretch_type == "extrema"


def test_query_arguments_have_the_services_names(spark):
    text = "image=s3%3A%2F%2Fb%2Fx.IMG&rdr=XYZ&format=jpg&stretchType=percent&extremaStretch=true&stretchLow=1&tileSize=&overlayPreference=a:b%3Dc&overlayPreference=d:e=f&maxWaitSec=5&noDZI=true&other=1&format=png"
    args = spark.range(1).select(spec.args_of_query(F.lit(text)).alias("a")).first().a
    assert args == {"rdr_url": "s3://b/x.IMG", "rdr_type": "XYZ", "tile_format": "jpg", "stretch_type": "extrema", "stretch_low": "1", "tile_size": "", "overlay_preferences": "a:b=c\nd:e=f", "max_wait_sec": "5", "no_dzi": "true"}
    with pytest.raises(Exception, match="missing image"):
        spark.range(1).select(spec.args_of_query(F.lit("rdr=XYZ"))).collect()


def test_only_true_is_true(spark):
    texts = ["true", " TRUE ", "1", "yes", "maybe", "false", "auto", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", units.parsed(F.col("t"), "boolean", None, F.lit(True)).alias("b")).orderBy("i").collect()
    assert [r.b for r in rows] == [True, True, False, False, False, False, True, True, True]


def test_tiles_without_pixels_are_black(spark, tmp_path):
    pixels = spark.createDataFrame([("i", 18, 17, 0, 200)], "image_id string, y int, x int, band int, out int")
    sizes = spark.createDataFrame([("i", 20, 20), ("none", 5, 9), ("empty", 0, 4)], "image_id string, width int, height int")
    made = {(r.image_id, r.level, r.col, r.row): images.samples(bytes(r.data)) for r in tiles.tile_pyramid(pixels, sizes, 1, f"file://{tmp_path}", 4, 1).collect()}
    assert {k for k in made if k[1] == 5} == {("i", 5, c, r) for c in range(5) for r in range(5)} and {k[0] for k in made} == {"i", "none"}
    assert not made["i", 5, 0, 0].any() and made["i", 5, 4, 4][0, 3, 2] == 200 and made["i", 4, 2, 2].max() == 50
    assert all(not v.any() for k, v in made.items() if k[0] == "none") and sum(k[:2] == ("none", 4) for k in made) == 6
    whole = np.zeros((1, 20, 20), np.uint8)
    whole[0, 18, 17] = 200
    for _ in range(5):
        whole = tiles.halved(whole)
    assert np.array_equal(made["i", 0, 0, 0], whole)


def test_lines_are_limited_by_what_32_bits_count(spark):
    rows = [(True, 1 << 16, 1 << 16, 1, 1), (False, 1 << 16, 1 << 16, 1, 2), (False, 100, 100, 3, 1), (True, 3_000_000_000, 2, 1, 1), (False, 40_000, 40_000, 1, 1)]
    header = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "image_id int, is_pds boolean, width long, height long, bands int, bytes_per_sample int, file_bytes long")
    got = raster.with_line_limit(header, most_image_bytes=2_147_400_000).orderBy("image_id").collect()
    assert [(r.line_limit, r.lines, r.reason) for r in got] == [(32767, 32767, "image_bytes"), (16383, 16383, None), (None, 100, None), (0, 0, "width"), (None, 40_000, None)]
    pixels = spark.createDataFrame([(2, y) for y in range(150)], "image_id int, y int")
    assert raster.within_line_limits(pixels, raster.with_line_limit(header)).count() == 100
