"""The test tables as rasters, products, requests and task states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of four bands (the last is alpha), 16 pixels wide, 12 bits: image_id, y, x, band, dn."""
    lines = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("image_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"), "embedding")
    rows = lines.select("image_id", "y", F.posexplode("embedding").alias("i", "v"))
    dn = F.greatest(F.lit(0), F.least(F.lit(4095), F.floor((F.col("v").cast("double") + 1) * 2048))).cast("int")
    return rows.select("image_id", "y", F.expr("cast(i div 4 as int)").alias("x"), (F.col("i") % 4).alias("band"), dn.alias("dn"))


def orders_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one large image, 64 pixels wide, a band per line number; a cell's DN is its largest price."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 64).alias("x"), F.expr("l_orderkey div 64").alias("y"), (F.col("l_linenumber") - 1).alias("band"))
    return rows.agg(F.max(F.floor("l_extendedprice")).alias("dn")).select(F.lit("lineitem").alias("image_id"), "y", "x", "band", "dn")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four measures of line items as float bands: image_id, band, dn."""
    rows = table(spark, sf_dir, "lineitem").unpivot([], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "measure", "dn")
    return rows.select(F.lit("measures").alias("image_id"), F.col("measure").alias("band"), (F.col("dn") + 0.0).alias("dn"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes from orders: image_id, width, height."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("image_id"), (F.floor("o_totalprice") % 3000 + 1).cast("long").alias("width"), (F.col("o_custkey") % 2000 + 1).cast("long").alias("height"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("rect_id"), (F.col("o_custkey") * 7 % 4000).alias("x"), (F.col("o_orderkey") * 11 % 4000).alias("y"), (F.col("o_custkey") % 900 + 1).alias("w"), (F.col("o_orderkey") % 700 + 1).alias("h"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs in several shapes: as they are, as files with extensions, S3 objects, local paths and odd hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id") % 8
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    shaped = (
        F.when(k == 0, F.concat(F.lit("s3://"), bare, F.lit(".IMG"))).when(k == 1, F.concat(bare, F.lit(".VIC?v=1")))
        .when(k == 2, F.concat(F.lit("file://"), bare, F.lit(".png"))).when(k == 3, F.concat(F.lit("/"), bare, F.lit(".tif")))
        .when(k == 4, F.concat(F.lit("http://10.0."), (F.col("page_id") % 200).cast("string"), F.lit(".7/a.img")))
        .when(k == 5, F.concat(F.lit("https://b.s3.us-west-2.amazonaws.com/"), bare, F.lit(".img")))
        .when(k == 6, F.concat(bare, F.lit("/../x.jpg"))).otherwise(F.col("url"))
    )
    return p.select("page_id", shaped.alias("url"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for cached work: cache_hash (of the customer), request time and cost."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.sha1(F.concat(F.lit("file://"), F.col("o_custkey").cast("string"))).alias("cache_hash"), F.col("o_orderdate").alias("requested"), F.floor("o_totalprice").cast("long").alias("cost"), "o_custkey")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cached work in all states: cache_hash, finished, error, started, progressed, source_modified."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    ts = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    return c.select(
        F.sha1(F.concat(F.lit("file://"), k.cast("string"))).alias("cache_hash"),
        (k % 5 == 0).alias("finished"), (k % 7 == 0).alias("error"), F.when(k % 4 > 0, ts(k * 17 % 7000)).alias("started"),
        F.when(k % 3 > 0, ts(k * 31 % 7000)).alias("progressed"), F.when(k % 11 > 0, ts(k * 13 % 7000)).alias("source_modified"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label text of each event: system, property and task items of several types."""
    e = table(spark, sf_dir, "events")
    text = F.concat(
        F.lit("LBLSIZE=1024 FORMAT='HALF' NL="), (F.col("user_id") % 900 + 1).cast("string"), F.lit(" GAIN="), (F.col("event_id") % 50).cast("string"), F.lit(".5D1 PROPERTY='"),
        F.upper("event_type"), F.lit("' NAME='it''s "), F.col("event_type"), F.lit("' SIZES=(1,2,"), F.col("user_id").cast("string"), F.lit(") TASK='T"), (F.col("event_id") % 4).cast("string"), F.lit("' USER='u"), F.col("user_id").cast("string"), F.lit("'"),
    )
    return e.select(F.col("event_id").cast("string").alias("path"), text.alias("text"))
