"""Named queries over a folder of tables, one per operator or close family of operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as label_functions
from ..functions import units, urls
from ..operators import catalog, pyramid, raster
from ..sources import images as image_files
from ..sources import sinks
from ..streaming import ingest
from . import tables
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def color(spark, d):
    return raster.drop_alpha(tables.vectors(spark, d))


def color_histogram(spark, d):
    return raster.histogram(color(spark, d), 12)


def bounds(spark, d):
    return raster.percent_bounds(color_histogram(spark, d), 4096, 0.0, 4096.0)


@query
def apply_stretch(spark, d):
    """The flagship: histogram, percent stretch, 8-bit pixels, counted by image, band and value."""
    return raster.stretch(color(spark, d), bounds(spark, d)).groupBy("image_id", "band", "out").agg(F.count(F.lit(1)).alias("n"))


@query
def drop_alpha(spark, d):
    return color(spark, d).groupBy("image_id", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("dn").alias("s"))


@query
def band_extrema(spark, d):
    e = raster.extrema(tables.measures(spark, d))
    return e.select("image_id", "band", (F.col("mn") + 0.0).alias("mn"), (F.col("mx") + 0.0).alias("mx"))


@query
def extrema_repair(spark, d):
    odd = table(spark, d, "nation").select(F.col("n_name").alias("image_id"), (F.col("n_nationkey") % 3).cast("int").alias("band"), F.when(F.col("n_nationkey") % 4 == 0, float("nan")).when(F.col("n_nationkey") % 4 == 1, 50.0).otherwise(F.col("n_nationkey").cast("double")).alias("mn"), F.when(F.col("n_nationkey") % 5 == 0, float("inf")).otherwise(F.col("n_nationkey") * 2.0).alias("mx"))
    return raster.repaired_extrema(odd)


@query
def global_extrema(spark, d):
    return raster.global_extrema(raster.extrema(tables.vectors(spark, d)))


@query
def band_histogram(spark, d):
    return raster.histogram(tables.orders_raster(spark, d), 17)


@query
def float_histogram(spark, d):
    h = raster.float_histogram(table(spark, d, "events").select(F.col("event_type").alias("image_id"), F.lit(0).alias("band"), F.col("value").alias("dn")), bins=64)
    return h.select("image_id", "bin", "cnt")


@query
def histogram_zero_filled(spark, d):
    h = raster.zero_filled(raster.histogram(color(spark, d), 12, 256), 256)
    return h.groupBy("image_id", "band").agg(F.count(F.lit(1)).alias("bins"), F.sum("cnt").alias("cnt"), F.sum(F.when(F.col("cnt") == 0, 1).otherwise(0)).alias("empty"))


@query
def extrema_from_histogram(spark, d):
    return raster.extrema_from_histogram(raster.histogram(color(spark, d), 12, 1024), 0.0, 4.0)


@query
def percent_stretch_bounds(spark, d):
    return bounds(spark, d)


@query
def relative_stretch_bounds(spark, d):
    return raster.relative_bounds(raster.extrema(color(spark, d)), 0.9, 0.75, 4095.0)


@query
def literal_stretch_bounds(spark, d):
    return raster.literal_bounds(color(spark, d).select("image_id").distinct(), None, 3000.0, 0.0, 4095.0)


@query
def srgb_lut(spark, d):
    """Both conversions of each 8-bit value that the table's images hold, and how many samples have it."""
    held = color(spark, d).groupBy(F.expr("cast(dn div 16 as int)").alias("dn")).agg(F.count(F.lit(1)).alias("n"))
    return held.select("dn", "n", raster.linear_to_srgb(F.col("dn")).alias("srgb"), raster.srgb_to_linear(F.col("dn")).alias("linear"))


@query
def gamma_modes(spark, d):
    k = F.col("n_nationkey")
    gamma = F.get(F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.4501), F.lit(2.2)), (k % 4).cast("int"))
    n = table(spark, d, "nation").select("n_name", gamma.alias("gamma"), (k % 5 > 0).alias("stretchable_pds"), F.when(k % 3 == 0, "jpg").otherwise("png").alias("tile_format"))
    modes = F.array(*map(F.lit, ("none", "passthrough", "convert", "lineartosrgb", "srgbtolinear")))
    flags = raster.gamma_flags(n.withColumn("gamma_mode", F.explode(modes)))
    return flags.select("n_name", "gamma_mode", "gamma_class", *[F.col(c).cast("int").alias(c) for c in ("srgb_to_linear", "linear_to_srgb", "output_linear")], "tile_header_gamma", "tile_data_gamma")


@query
def mono_to_rgb(spark, d):
    return color(spark, d).where("band = 0").select("image_id", "y", "x", raster.mono_to_rgb(F.col("dn")).alias("rgb")).groupBy("image_id").agg(F.sum(F.expr("rgb[0] + rgb[1] + rgb[2]")).alias("s"))


@query
def pack_argb(spark, d):
    p = raster.wide(tables.vectors(spark, d), 4)
    v = lambda i: F.floor(F.expr(f"bands[{i}]") / 16)
    return p.select("image_id", "y", "x", raster.packed_argb(raster.alpha_of(F.expr("bands[3]"), 0.0, 4095.0), v(0), v(1), v(2)).alias("argb"))


@query
def mask_pixels(spark, d):
    p = raster.wide(color(spark, d), 3).select("image_id", "y", "x", F.transform("bands", lambda b: F.expr("0") + (b % 3)).alias("bands"))
    return p.where(raster.masked(F.col("bands"), [[1.0, 2.0, 1.0]], True)).select("image_id", "y", "x")


@query
def masked_count(spark, d):
    p = raster.wide(color(spark, d), 3).select("image_id", F.transform("bands", lambda b: b % 3).alias("bands"))
    return p.groupBy("image_id").agg(F.count_if(raster.masked(F.col("bands"), [[1.0, 2.0, 1.0]], True)).alias("masked"), F.count(F.lit(1)).alias("pixels"))


@query
def mask_alpha(spark, d):
    p = raster.wide(tables.vectors(spark, d), 4)
    is_masked = F.expr("bands[0] % 3 = 1")
    return p.select("image_id", "y", "x", raster.masked_alpha(F.floor(F.expr("bands[3]") / 16), is_masked, 0.25, 0.75).alias("alpha"))


@query
def threshold_combine(spark, d):
    p = raster.wide(color(spark, d), 3).select("image_id", F.transform("bands", lambda b: raster.threshold_replaced(F.floor(b / 16), 120.0, 128.0, 0.0)).alias("bands"))
    return p.groupBy("image_id", raster.combined(F.col("bands")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query
def crop_rect(spark, d):
    return raster.crop(tables.orders_raster(spark, d), 8, 4, 20, 10).select("y", "x", "band", "dn")


@query
def limit_height(spark, d):
    return raster.limit_height(tables.orders_raster(spark, d), 12).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("last"))


@query
def invalid_values_distinct(spark, d):
    h = table(spark, d, "nation").select(F.col("n_name").alias("image_id"), F.array((F.col("n_nationkey") % 3).cast("double"), F.lit(-32768.0)).alias("invalid"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0))).alias("missing"))
    return raster.invalid_values(h, True).select("image_id", F.array_join("invalid", ";").alias("invalid"), F.size("invalid").alias("n"))


@query
def pyramid_levels(spark, d):
    return pyramid.levels(tables.images(spark, d))


@query
def tiles_per_level(spark, d):
    return pyramid.tiles_per_level(pyramid.levels(tables.images(spark, d)))


@query
def tile_rects_overlap(spark, d):
    return pyramid.tile_rects(pyramid.levels(tables.images(spark, d)))


@query
def single_tile_level(spark, d):
    return pyramid.single_tile_level(pyramid.levels(tables.images(spark, d)))


@query
def first_fitting_level(spark, d):
    return pyramid.first_fitting_level(pyramid.levels(tables.images(spark, d)), 0.1)


@query
def pyramid_downsample(spark, d):
    return pyramid.downsampled(tables.orders_raster(spark, d), 3)


@query
def pixel_tiles(spark, d):
    p = tables.orders_raster(spark, d).select("x", "y", F.lit(64).alias("width"), F.lit(1_000_000).alias("height")).distinct()
    return pyramid.pixel_tiles(p, 16, 1).groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"))


@query
def window_lookup(spark, d):
    return pyramid.windows_of(tables.rectangles(spark, d), 512)


@query
def thumb_dims(spark, d):
    return pyramid.thumbnail(tables.images(spark, d).select("*", F.least("width", F.lit(254)).alias("sw"), F.least("height", F.lit(254)).alias("sh")), "sw", "sh")


@query
def url_filter(spark, d):
    u = tables.urls(spark, d)
    return u.select("page_id", urls.policy(F.col("url"), ["(?i)(s3|https)://.*", "[^/].*"], ["a"], [".*/quick.*"]).alias("reason"))


@query
def url_parts(spark, d):
    u = tables.urls(spark, d)
    return u.select("page_id", urls.has_ext(F.col("url"), urls.PDS_EXTS).cast("int").alias("is_pds"), urls.set_ext(F.col("url"), "png").alias("as_png"), urls.strip_file_scheme(F.col("url")).alias("stripped"), urls.filename(F.col("url")).alias("filename"))


@query
def cache_hash(spark, d):
    return tables.urls(spark, d).select("page_id", urls.cache_hash(F.col("url")).alias("cache_hash"))


@query
def ssrf_ipv4(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.concat_ws(".", F.col("o_orderkey") % 256, F.col("o_custkey") % 256, F.col("o_orderkey") % 7, F.lit(9)).alias("ip"))
    return a.select("o_orderkey", urls.safe_ipv4(F.col("ip")).cast("int").alias("safe"))


@query
def size_units(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.col("n_nationkey"), F.element_at(F.array(*map(F.lit, ("k", "m", "g", ""))), (F.col("n_nationkey") % 4 + 1).cast("int"))).alias("size"), F.concat(F.col("n_nationkey"), F.element_at(F.array(*map(F.lit, ("s", "m", "h"))), (F.col("n_nationkey") % 3 + 1).cast("int"))).alias("time"))
    b = units.parse_bytes(F.col("size"))
    return n.select("n_nationkey", b.alias("bytes"), units.parse_seconds(F.col("time")).alias("seconds"), units.kmg(b).alias("shown"))


@query
def spec_defaults(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 500 - 100).cast("int")).alias("tile_size"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 150 / 1.0).alias("low"))
    size = units.defaulted(F.col("tile_size"), F.col("tile_size") > 0, F.lit(254))
    low = units.defaulted(F.col("low"), F.col("low").between(0, 100), F.lit(0.5))
    return c.select("c_custkey", size.alias("tile_size"), low.alias("stretch_low"), ((size == 254) & (low == 0.5)).cast("int").alias("nominal"))


@query
def sol_range(spark, d):
    return catalog.sol_range(table(spark, d, "orders").select(F.lpad((F.col("o_orderkey") % 700 + 50).cast("string"), 5, "0").alias("dir")))


@query
def sol_decode(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("NLF_"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.expr("char(65 + p_partkey % 8)"), F.lpad((F.col("p_partkey") % 366).cast("string"), 3, "0"))).otherwise(F.lpad((F.col("p_partkey") % 1700).cast("string"), 4, "0")), F.lit("_X")).alias("id"))
    s = catalog.sol_of(F.col("id"), F.lit(False))
    return p.select("p_partkey", s["sol"].alias("sol"), s["sol_doy"].cast("int").alias("doy"), s["year"].alias("year"))


@query
def catalog_by_sol(spark, d):
    return catalog.products_of_sol(table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 700).alias("sol")), 51).select("o_orderkey", "o_custkey")


@query
def edr_rdr_join(spark, d):
    source = table(spark, d, "orders").select(F.col("o_orderkey").alias("group_id"))
    derived = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("product"))
    return catalog.derived_products(source, derived, "group_id").select("group_id", F.size("products").alias("n"), F.array_join("products", ",").alias("products"))


@query
def product_type_lookup(spark, d):
    types = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("product_type"), F.col("n_name").alias("image_type"), (F.col("n_regionkey") == 1).alias("overlayable"))
    products = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 5).cast("string").alias("product_type"))  # five types are unknown
    return catalog.typed_products(products, types).groupBy("image_type", F.col("overlayable").cast("int").alias("overlayable")).agg(F.count(F.lit(1)).alias("n"))


@query
def label_tokens(spark, d):
    t = label_functions.typed(label_functions.items(tables.labels(spark, d)))
    return t.select("path", "pos", "name", "kind", "s", "i", "d", "n")


@query
def label_groups(spark, d):
    g = label_functions.grouped(label_functions.items(tables.labels(spark, d)))
    return g.select("path", "name", "section", "title", "number")


@query
def cache_anti_join(spark, d):
    return catalog.uncached(tables.requests(spark, d).select("cache_hash"), tables.tasks(spark, d).where("finished"))


@query
def source_semi_join(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("url"))
    return catalog.existing(r, table(spark, d, "customer").select(F.col("c_custkey").alias("url"), (F.col("c_custkey") % 4).alias("length"))).select("o_orderkey")


@query
def latest_event_wins(spark, d):
    return catalog.latest_events(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


@query
def cache_state(spark, d):
    r = tables.requests(spark, d).select("cache_hash").distinct()
    state = catalog.cache_state(r, tables.tasks(spark, d), F.timestamp_seconds(F.lit(1_700_006_000)))
    return state.select("cache_hash", "state", F.col("is_cached").cast("int").alias("is_cached"))


@query
def admission_window(spark, d):
    return catalog.admitted(tables.requests(spark, d), 300_000, ["o_custkey"], ["requested", "o_orderkey"]).select("o_orderkey", "used", F.col("admitted").cast("int").alias("admitted"))


@query
def retry_gate(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return catalog.retry_gate(e, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "receive_count", "route")


@query
def progress_summary(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("worker"), (k % 5).alias("histogram_steps"), (k % 2 * 4).alias("histogram_expected"), (k % 3).alias("extrema_steps"), (k % 4).alias("extrema_expected"),
        (F.greatest(F.lit(0), k % 80 - 10)).alias("tiles_done"), F.lit(64).alias("tiles_expected"), (k % 50 == 0).alias("done"),
    )
    return catalog.progress(t).groupBy("worker").agg(F.min("percent").alias("least"), F.max("percent").alias("most"), F.sum("percent").alias("total"), F.count(F.lit(1)).alias("tasks"))


@query
def delete_batches(spark, d):
    b = catalog.delete_batches(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 100, 1)
    return b.groupBy("o_orderstatus", "part", "number").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query
def metadata_json(spark, d):
    i = pyramid.levels(tables.images(spark, d)).groupBy("image_id").agg(F.max("w").alias("width"), F.max("h").alias("height"), F.max("level").alias("levels"))
    back = F.from_json("metadata", "width long, height long, levels int")
    return sinks.metadata(i).select("image_id", back["width"].alias("width"), back["height"].alias("height"), back["levels"].alias("levels"))


@query
def dzi_descriptor(spark, d):
    i = tables.images(spark, d)
    return i.select("image_id", sinks.descriptor(254, 1, "png", F.col("width"), F.col("height")).alias("dzi"))


@query
def tile_requests(spark, d):
    paths = tables.requests(spark, d).select("o_orderkey", F.concat(F.lit("/"), F.col("cache_hash"), F.when(F.col("o_orderkey") % 2 == 0, "/data_proxy_image_files/").otherwise("/image_files/"), (F.col("o_orderkey") % 9).cast("string"), F.lit("/"), (F.col("o_custkey") % 7).cast("string"), F.lit("_3.png")).alias("path"))
    parts = urls.tile_request(F.col("path"))
    return paths.select("o_orderkey", *[parts[k].alias(k) for k in ("hash", "proxy", "level", "col", "row", "ext")])


@query
def label_decode(spark, d):
    """Labelled rasters made from strips of the table's images, as files in memory, decoded to pixels and summed by band."""
    from ..sources import labelled

    made = labelled.encode(color(spark, d), 32)
    name = F.substring_index("path", "/", 1)
    return image_files.pixels(image_files.blocks(made)).groupBy(name.alias("path"), "band").agg(F.sum("dn").cast("long").alias("s"), F.count(F.lit(1)).alias("n"))


@query
def png_tiles(spark, d):
    """8-bit tiles of 32 pixels as PNG, decoded again and summed by image and band."""
    p = raster.stretch(color(spark, d), bounds(spark, d)).select("image_id", F.lit(0).alias("level"), F.expr("cast(x div 32 as int)").alias("col"), F.expr("cast(y div 32 as int)").alias("row"), "y", "x", "band", "out")
    tiles = sinks.png_tiles(p, 3).select(F.col("image_id").alias("path"), F.col("data").alias("content"))
    return image_files.pixels(image_files.blocks(tiles)).groupBy(F.col("path").alias("image_id"), "band").agg(F.sum("dn").cast("long").alias("s"))


def shared_folder(spark) -> str:
    """The folder that driver and executors share; sessions on one machine may do without a named one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="lithograph-")).rstrip("/")


@query
def stream_ingest(spark, d):
    """Events as a stream of notifications: micro-batches applied to a table, which ends as one batch would leave it."""
    root = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    name = F.when(F.col("event_type") == "purchase", "ObjectRemoved:Delete").when(F.col("event_type").isin("click", "view"), "ObjectCreated:Put").otherwise("Other")
    events = stream.select(F.lit("b").alias("bucket"), F.col("user_id").cast("string").alias("key"), name.alias("event_name"), "ts")
    ingest.run_batches(events, ingest.appended_to(f"{root}/table"), f"{root}/checkpoint").awaitTermination()
    return ingest.current(spark, f"{root}/table").select("key", "action")


def in_files(rows, folder: str, files: int, by: str):
    """A stream of a table's rows that reads ``files`` files one by one."""
    rows.repartition(files, by).write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def stream_table(spark, d):
    """Events as many batches that a table is kept from: versions, merged runs, the last decision of each key."""
    from ..streaming import stream_table as kept

    root = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    stream = in_files(table(spark, d, "events"), f"{root}/in", 12, "event_id")
    name = F.when(F.col("event_type") == "purchase", "ObjectRemoved:Delete").when(F.col("event_type").isin("click", "view"), "ObjectCreated:Put").otherwise("Other")
    events = stream.select(F.lit("b").alias("bucket"), F.col("user_id").cast("string").alias("key"), name.alias("event_name"), F.col("ts").cast("timestamp").alias("ts"))
    ingest.run_batches(events, kept.kept_in(f"{root}/table"), f"{root}/checkpoint").awaitTermination()
    return kept.current(spark, f"{root}/table").select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "action")


def appended(rows, folder: str):
    """Run a stream's update rows to its end; gives them all, with the batch that told them."""
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    rows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(f"{folder}/out")


@query
def delivery_state(spark, d):
    """Events as deliveries of messages (users) to receivers (types): counts that keyed state keeps over many batches."""
    from ..streaming import timers

    folder = f"{shared_folder(spark)}/deliveries-{uuid.uuid4().hex}"
    stream = in_files(table(spark, d, "events"), f"{folder}/in", 6, "event_id")
    told = appended(timers.counted_deliveries(stream.select(F.col("user_id").cast("string").alias("message"), F.col("event_type").alias("receiver")), 9), folder)
    of_message = told.groupBy("message").agg(F.max("total").alias("total"), F.max(F.struct("total", "route"))["route"].alias("route"))
    return told.groupBy("message", "receiver").agg(F.max("times").alias("times")).join(of_message, "message")


@query
def silent_tasks(spark, d):
    """Users as tasks: those that the stream's time leaves behind by 12 hours are zombies, by timers of keyed state."""
    from ..streaming import timers

    folder = f"{shared_folder(spark)}/silent-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    progress = stream.select(F.col("user_id").cast("string").alias("task"), F.lit(0.0).alias("progress"), F.col("ts").cast("timestamp").alias("ts"))
    told = appended(timers.watched_tasks(progress, 12 * 3_600_000, 1 << 40), folder)
    return told.groupBy("task").agg(F.max_by(F.struct("deliveries", "status"), "batch").alias("last")).select("task", "last.*")
