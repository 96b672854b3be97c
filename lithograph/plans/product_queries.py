"""Named queries over products, their specs and the service around them, each with its SQL."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units, urls
from ..operators import catalog, pyramid, raster, rectangles, resample, spec, tiles
from ..sources import images as image_files
from . import queries as base
from . import tables
from .oracles import BOUNDS, IMAGES, LEVELS, REQUESTS, VECTORS
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def pick(column: str, values: list) -> F.Column:
    """One of ``values`` by a key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


OUT = "case when dn <= lo then 0 when dn >= hi then 255 else greatest(0, least(255, cast(trunc((dn - lo) * 255 / (hi - lo)) as integer))) end"


@query(f"""with recursive {BOUNDS},
big as (select c.image_id, y, x, band, {OUT} as v from color c join bounds b on c.image_id = b.image_id),
size as (select image_id, 16 as w, max(y) + 1 as h from big group by 1),
tops as (select *, length(ltrim(bin(greatest(w, h) - 1), '0')) as top from size),
pyr(image_id, step, y, x, band, v) as (select image_id, 0, y::bigint, x::bigint, band, v::bigint from big union all
  select p.image_id, step + 1, y // 2, x // 2, band, sum(v)::bigint // count(*) from pyr p join tops t on p.image_id = t.image_id where step < t.top group by all),
lev as (select t.image_id, cast(t.top - s as integer) as level, s as step, (w + (1::bigint << s::integer) - 1) // (1::bigint << s::integer) as w, (h + (1::bigint << s::integer) - 1) // (1::bigint << s::integer) as h from tops t, range(32) r(s) where s <= t.top),
tile as (select l.*, c, r, c * 16 - (c > 0)::integer as x0, r * 16 - (r > 0)::integer as y0 from lev l, range(2) a(c), range(64) b(r) where c * 16 < w and r * 16 < h),
sized as (select *, least(16 + case when c = 0 then 1 else 2 end, w - x0) as tw, least(16 + case when r = 0 then 1 else 2 end, h - y0) as th from tile)
select t.image_id, level, cast(c as integer) as col, cast(r as integer) as row, cast(tw as integer) as w, cast(th as integer) as h, band, cast(sum(v) as bigint) as s
from sized t join pyr p on p.image_id = t.image_id and p.step = t.step and p.x >= x0 and p.x < x0 + tw and p.y >= y0 and p.y < y0 + th group by all""")
def tile_pyramid(spark, d):
    """Pixels to encoded tiles of all levels with overlap; the tiles are decoded again and summed by band."""
    p = raster.stretch(base.color(spark, d), base.bounds(spark, d)).select("image_id", "y", "x", "band", "out")
    sizes = p.groupBy("image_id").agg(F.lit(16).alias("width"), (F.max("y") + 1).alias("height"))
    made = tiles.tile_pyramid(p, sizes, 3, base.shared_folder(spark), 16, 1)
    name = F.concat_ws("/", "image_id", "level", "col", "row", "w", "h")
    sums = image_files.pixels(image_files.blocks(made.select(name.alias("path"), F.col("data").alias("content")))).groupBy("path", "band").agg(F.sum("dn").cast("long").alias("s"))
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return sums.select(part(1).alias("image_id"), *[part(i).cast("int").alias(c) for i, c in enumerate(("level", "col", "row", "w", "h"), 2)], "band", "s")


V6 = ["::1", "::", "fe80::1", "fec0::9", "ff02::1", "fc00::5", "fd00:ec2::254", "2001::1", "64:ff9b:1::1", "::ffff:169.254.169.254", "::ffff:8.8.8.8", "::10.0.0.1", "64:ff9b::a9fe:a9fe", "64:ff9b::808:808", "2002:a9fe:a9fe::", "2002:808:808::1", "2606:4700::1111", "2001:db8::1", "1:2:3:4:5:6:7:8", "1::2::3", "12345::1", "::ffff:300.1.1.1", "fe80", ""]
V6_SAFE = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 1, 1, 1, None, None, None, None, None]


@query(f"""with given as (select o_orderkey, list_extract({V6!r}, cast(o_orderkey % {2 * len(V6)} as integer) + 1) as ip, list_extract({str(V6_SAFE).replace('None', 'null')}, cast(o_orderkey % {2 * len(V6)} as integer) + 1) as known,
  o_orderkey % {2 * len(V6)} >= {len(V6)} as own, o_orderkey * 37 % 65536 as g, o_custkey % 256 as a, o_orderkey % 256 as b from orders)
select o_orderkey, cast(case when not own then known when o_orderkey % 3 = 0 then not (a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 192 and b = 0 and 7 = 0) or (a = 198 and b in (18, 19)))
  when g between 64512 and 65023 or g between 65152 and 65279 or g >= 65280 then false
  when g = 8194 then not (a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 192 and b = 0) or (a = 198 and b in (18, 19))) when g = 0 then false else true end as integer) as safe from given""")
def ssrf_ipv6(spark, d):
    """Fixed addresses of every class, addresses by their first group, and mapped IPv4 ones."""
    n, k = len(V6), F.col("o_orderkey") % (2 * len(V6))
    first = F.lower(F.hex(F.col("o_orderkey") * 37 % 65536))
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", F.col("o_custkey") % 256, F.col("o_orderkey") % 256, F.lit(7), F.lit(9)))
    groups = F.concat(first, F.lit(":"), F.lower(F.hex((F.col("o_custkey") % 256) * 256 + F.col("o_orderkey") % 256)), F.lit(":100::1"))
    fixed = F.get(F.array(*map(F.lit, V6)), k.cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", F.when(k < n, fixed).when(F.col("o_orderkey") % 3 == 0, mapped).otherwise(groups).alias("ip"))
    return o.select("o_orderkey", urls.safe_ipv6(F.col("ip")).cast("int").alias("safe"))


@query("""with p as (select p_partkey, p_partkey * 7 % 8000 as n from part) select p_partkey, cast(case when n >= 3000 then n % 1000 else n end as integer) as sol, cast(n >= 3000 as integer) as doy, cast(case when n >= 3000 then n // 1000 - 3 + 2023 end as integer) as year from p""")
def sol_of_number(spark, d):
    s = catalog.sol_of_number(F.lpad((F.col("p_partkey") * 7 % 8000).cast("string"), 4, "0"))
    return table(spark, d, "part").select("p_partkey", s["sol"].alias("sol"), s["sol_doy"].cast("int").alias("doy"), s["year"].alias("year"))


@query("""with p as (select p_partkey, 'NLF_' || lpad((p_partkey % 1700)::varchar, 4, '0') || '_X' as filename from part)
select filename || '-' || p_partkey as path, p_brand as instrument, p_type as product_type, cast(p_partkey % 1700 as integer) as sol, 0 as doy, 'NULL' as sclk from p join part using (p_partkey)""")
def finder_metadata(spark, d):
    name = F.concat(F.lit("NLF_"), F.lpad((F.col("p_partkey") % 1700).cast("string"), 4, "0"), F.lit("_X"))
    products = table(spark, d, "part").select(
        F.concat(name, F.lit("-"), F.col("p_partkey")).alias("path"), name.alias("filename"), F.lit("Single Frame").alias("finder_type"),
        F.col("p_brand").alias("instrument"), F.col("p_type").alias("product_type"), F.lit(None).cast("string").alias("sclk"),
    )
    back = F.from_json("entry", "rdr string, metadata struct<instrument: string, product_type: string, sol: int, sol_doy: boolean, sclk: string>")
    entries = catalog.finder_metadata(products, "M20").select(back.alias("e"))
    return entries.select(F.col("e.rdr").alias("path"), "e.metadata.instrument", "e.metadata.product_type", "e.metadata.sol", F.col("e.metadata.sol_doy").cast("int").alias("doy"), "e.metadata.sclk")


@query("""with n as (select o_orderkey, o_orderkey % 1800 as t from orders) select o_orderkey, case when t % 3 = 0 then null when t % 3 = 1 then 'M20' when t % 2 = 0 then 'CADRE' end as mission from n""")
def mission_names(spark, d):
    name = F.when(F.col("t") % 3 == 0, "viking").when(F.col("t") % 3 == 1, F.when(F.col("t") % 2 == 0, "m2020").otherwise(" M20 ")).when(F.col("t") % 2 == 0, "Cadre").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1800).alias("t")).select("o_orderkey", catalog.mission_name(name).alias("mission"))


SPEC_CONFIG = spec.Config({"tile_size": "512", "stretch_low": "2"}, quicklook=(".*/quick/.*",), compressed=(".*/crisp/.*",), preapplied_gamma=("RA[SX]",), fifteen_bit=("X.*",))


def asked(spark, d):
    """Customers as products with asked values, some of them invalid."""
    k = F.col("c_custkey")
    url = F.concat(pick("c_custkey", ["a/", "a/quick/", "a/crisp/"]), k, pick("c_custkey", [".IMG", ".png", ".vic", ".jpg"]))
    args = F.map_filter(
        F.map_from_arrays(
            F.array(*map(F.lit, ("tile_size", "stretch_type", "stretch_low", "tile_format", "gamma_mode", "masked_alpha", "tile_overlap", "product_type", "rdr_type", "extrema_stretch"))),
            F.array(
                F.when(k % 5 == 0, (k % 300 - 100).cast("string")), F.when(k % 29 == 0, F.lit("Histogram_Percent")).when(k % 7 == 0, pick("c_custkey", ["none", "Relative", "extrema"])), F.when(k % 4 == 0, (k % 150 / 100).cast("string")),
                F.when(k % 11 == 0, F.lit("JPG")), F.when(k % 13 == 0, F.lit("convert")), F.when(k % 6 == 0, pick("c_custkey", ["auto", "0.5", "7"])), F.when(k % 17 == 0, F.lit("0")),
                F.when(k % 19 == 0, F.lit("ecm")), F.when(k % 23 == 0, pick("c_custkey", ["auto", "ZZZ"])), F.when(k % 31 == 0, pick("c_custkey", ["True", "1"])),
            ),
        ), lambda _, v: v.isNotNull(),
    )
    kind = pick("c_custkey", ["RAS", "ECM", "XYZ", "RAX"])
    return table(spark, d, "customer").select("c_custkey", url.alias("url"), kind.alias("product_type"), pick("c_custkey", ["N", "EDL", ""]).alias("instrument"), (k % 10 == 0).alias("overlayable"), kind.alias("rdr_type"), args.alias("args"))


ASKED = """c as (select c_custkey as k, ['a/', 'a/quick/', 'a/crisp/'][c_custkey % 3 + 1] || c_custkey || ['.IMG', '.png', '.vic', '.jpg'][c_custkey % 4 + 1] as url, ['RAS', 'ECM', 'XYZ', 'RAX'][c_custkey % 4 + 1] as kind, ['N', 'EDL', ''][c_custkey % 3 + 1] as instrument from customer)"""


@query(f"""with {ASKED} select k as c_custkey, cast(k % 4 in (0, 2) as integer) as is_pds, cast(k % 3 = 2 as integer) as is_compressed, cast(k % 3 = 1 as integer) as is_quicklook, cast(instrument like 'E%' as integer) as is_descent_camera,
cast(kind = 'ECM' as integer) as is_raw, cast(kind = 'XYZ' as integer) as is_fifteen_bit, cast(kind in ('RAS', 'RAX') as integer) as is_preapplied_gamma from c""")
def product_classes(spark, d):
    flags = ("is_pds", "is_compressed", "is_quicklook", "is_descent_camera", "is_raw", "is_fifteen_bit", "is_preapplied_gamma")
    return spec.product_classes(asked(spark, d), SPEC_CONFIG).select("c_custkey", *[F.col(c).cast("int").alias(c) for c in flags])


@query(f"""with {ASKED}, a as (select *, k % 4 in (0, 2) and k % 10 = 0 as laid, kind = 'ECM' or k % 19 = 0 or k % 3 = 1 or instrument like 'E%' as plain, (k % 19 = 0 and kind <> 'ECM') or (k % 23 = 0 and k % 2 = 1) as other, case when k % 5 = 0 then k % 300 - 100 end as size, case when k % 31 = 0 and k % 2 = 0 then 'extrema' when k % 29 = 0 then 'percent' when k % 7 = 0 then ['none', 'relative', 'extrema'][k % 3 + 1] end as kind_of,
  case when k % 4 = 0 then (k % 150) / 100e0 end as low, k % 11 = 0 as jpg, k % 3 = 2 as crisp, case when k % 6 = 0 and k % 3 = 1 then 0.5e0 end as mask from c),
b as (select *, coalesce(kind_of, case when plain then 'none' else 'percent' end) as stretch_type, case when size > 0 then size else 512 end as tile_size, case when laid or crisp then 0e0 else 1e0 end as mask_default from a),
s as (select *, case stretch_type when 'percent' then coalesce(low, 2e0) when 'relative' then coalesce(case when low <= 1 then low end, 1e0) when 'extrema' then low end as stretch_low,
  case stretch_type when 'percent' then 2e0 when 'relative' then 1e0 end as low_default, case when jpg then 1e0 else coalesce(mask, mask_default) end as masked_alpha from b)
select k as c_custkey, case when jpg then 'jpg' else 'png' end as tile_format, cast(tile_size as integer) as tile_size, case when k % 17 = 0 then 0 else 1 end as tile_overlap, stretch_type, stretch_low, masked_alpha,
cast(laid as integer) as overlayable, cast(not jpg and crisp as integer) as mask_black,
cast(not (other or jpg or tile_size <> 512 or k % 17 = 0 or (not laid and (stretch_type <> case when plain then 'none' else 'percent' end or stretch_low is distinct from low_default)) or (not jpg and mask is not null and mask <> mask_default)) as integer) as nominal from s""")
def spec_resolved(spark, d):
    """All fields of the specs of asked products; those that this query's SQL repeats are shown."""
    # the configured stretch_low of 2 is no share, so a relative stretch has the default
    out = spec.resolved(asked(spark, d), SPEC_CONFIG)
    shown = ["c_custkey", "tile_format", "tile_size", "tile_overlap", "stretch_type", "stretch_low", "masked_alpha"]
    return out.select(*shown, *[F.col(c).cast("int").alias(c) for c in ("overlayable", "mask_black", "nominal")])


@query("""with p as (select p_partkey, p_partkey % 4 as k, repeat('a', case when p_partkey % 4 = 0 then 54 when p_partkey % 4 = 1 then 51 when p_partkey % 4 = 2 then 40 else 53 end) as id from part)
select p_partkey, case k when 0 then id || '.IMG' when 1 then id || 'J01.IMG' when 3 then id || 'X.IMG' end as filename from p""")
def repaired_ids(spark, d):
    length = pick("p_partkey", [54, 51, 40, 53])
    name = F.concat(F.lit("crisp-x-"), F.repeat(F.lit("a"), length), F.lit(".IMG"))
    return table(spark, d, "part").select("p_partkey", spec.repaired_id(name, "M20", ["J01", "X"]).alias("filename"))


@query("""select o_orderkey, cast(o_orderkey % 4 in (0, 3) as integer) as valid from orders""")
def overlay_preferences(spark, d):
    return table(spark, d, "orders").select("o_orderkey", spec.valid_preference(pick("o_orderkey", ["contour:STEP=0.5", "contour:STEP=a b", "STEP=1", "x:y=z=w"])).cast("int").alias("valid"))


@query(f"""with {IMAGES}, h as (select *, width * 40 as w, height * 40 as h, 1 + (width % 3 = 0)::integer * 2 as bands, case when height % 2 = 0 then 1 else 2 end as bps, width * height as bytes, width % 2 = 0 as pds from img),
s as (select *, case when bands = 3 and bps = 1 then 4 else bands end * bps as bpp from h)
select image_id, cast(bpp as integer) as bpp, case when bytes > 3000000 then 'file_bytes' when w * h * bpp > 4000000000 then 'image_bytes' when not pds and w * h > 2147483647 then 'pixels' end as reason, cast(case when v <= 1 then v else 1::bigint << (length(ltrim(bin(v - 1), '0')) - 1)::integer end as bigint) as below from (select *, width as v from s)""")
def size_guards(spark, d):
    i = tables.images(spark, d).select(
        "image_id", (F.col("width") * 40).alias("w"), (F.col("height") * 40).alias("h"), (1 + (F.col("width") % 3 == 0).cast("int") * 2).alias("bands"),
        F.when(F.col("height") % 2 == 0, 1).otherwise(2).alias("bps"), (F.col("width") * F.col("height")).alias("bytes"), (F.col("width") % 2 == 0).alias("pds"), "width",
    )
    header = {"is_pds": F.col("pds"), "file_bytes": F.col("bytes"), "width": F.col("w"), "height": F.col("h"), "bands": F.col("bands"), "bytes_per_sample": F.col("bps")}
    return i.select("image_id", raster.bytes_per_pixel(F.col("bands"), F.col("bps")).alias("bpp"), raster.oversize_reason(header, -1, 3_000_000, 4_000_000_000).alias("reason"), catalog.power_below(F.col("width")).alias("below"))


@query(f"""with {VECTORS}, b as (select image_id, min(dn) / 4095e0 as a, max(dn) / 4095e0 as z from color group by 1)
select image_id, 4095 * case when a <= 0.04045e0 then a / 12.92e0 else pow((a + 0.055e0) / 1.055e0, 2.4e0) end as lo, 4095 * case when z <= 0.04045e0 then z / 12.92e0 else pow((z + 0.055e0) / 1.055e0, 2.4e0) end as hi from b""")
def linear_bounds(spark, d):
    ends = raster.global_extrema(raster.extrema(base.color(spark, d))).select("image_id", F.col("mn").alias("lo"), F.col("mx").alias("hi"))
    return raster.linear_bounds(ends, 0.0, 4095.0)


@query(f"""with {VECTORS}, p as (select image_id, y, x, band, dn // 16 as v from color), l as (select *, case when v / 255e0 <= 0.04045e0 then v / 255e0 / 12.92e0 else pow((v / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end as s from p),
c as (select image_id, y, x, band, case when image_id::integer % 2 = 0 then cast(trunc(greatest(0e0, least(1e0, s)) * 255) as integer) else v end as v from l)
select image_id, cast(sum(case when band = 0 then v end) as bigint) as r, cast(sum(case when band = 1 then v end) as bigint) as g, cast(sum(case when band = 2 then v end) as bigint) as b from c group by 1""")
def overlay_conversion(spark, d):
    p = raster.wide(base.color(spark, d), 3).select("image_id", F.transform("bands", lambda b: F.floor(b / 16)).alias("bands"))
    argb = raster.overlay_argb(F.col("bands"), F.lit(255), F.col("image_id").cast("int") % 2 == 0, F.lit(False))
    byte = lambda n: F.sum(F.shiftrightunsigned("argb", n).bitwiseAND(F.lit(255)))
    return p.select("image_id", argb.alias("argb")).groupBy("image_id").agg(byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b"))


@query(f"with {BOUNDS} select c.image_id, band, cast(sum({OUT}) as bigint) as s from color c join bounds b on c.image_id = b.image_id group by all")
def stretch_by_table(spark, d):
    p, b = base.color(spark, d), base.bounds(spark, d)
    return raster.stretch_by_table(p, raster.value_table(p, b)).groupBy("image_id", "band").agg(F.sum("out").alias("s"))


@query(f"with {VECTORS}, sz as (select image_id, max(y) + 1 as h from color group by 1) select c.image_id, cast(y * 10 // h as bigint) as y, cast(x * 5 // 16 as bigint) as x, band, cast(sum(dn) as bigint) // count(*) as dn from color c join sz on c.image_id = sz.image_id group by all")
def resized(spark, d):
    p = base.color(spark, d)
    sizes = p.groupBy("image_id").agg(F.lit(16).alias("width"), (F.max("y") + 1).alias("height"))
    return raster.resized(p.join(sizes, "image_id"), 5, 10)


@query("""select n_name as image_id, count(*) as n, cast(sum(128) as bigint) as s from nation, range(1000) a(x), range(100) b(y) where x <= n_nationkey and y < 3 group by 1""")
def constant_image(spark, d):
    sizes = table(spark, d, "nation").select(F.col("n_name").alias("image_id"), (F.col("n_nationkey") + 1).cast("long").alias("width"), F.lit(3).cast("long").alias("height"))
    return raster.constant(sizes).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dn").alias("s"))


@query("""with n as (select n_nationkey, n_nationkey - 12.5e0 as v from nation) select n_nationkey, abs(v) as absolute, v * 255 as scaled, cast(least(255, greatest(0, floor(v * 20 + 0.5))) as integer) as byte,
cast(least(n_nationkey % 6, 3) as integer) as colors from n""")
def sample_conversions(spark, d):
    v = F.col("n_nationkey") - 12.5
    bands = F.col("n_nationkey") % 6
    return table(spark, d, "nation").select(
        "n_nationkey", raster.absolute(v).alias("absolute"), raster.scaled_to_byte(v).alias("scaled"), raster.as_byte(v * 20).alias("byte"), raster.color_bands(bands, F.lit(3)).cast("int").alias("colors")
    )


@query(f"""with {REQUESTS} select o_orderkey, case when o_custkey % 4 > 0 then 'u' || o_custkey end as source_url from req""")
def tile_sources(spark, d):
    r = tables.requests(spark, d).select("o_orderkey", F.col("cache_hash").alias("hash"))
    c = table(spark, d, "customer").where("c_custkey % 4 > 0")  # what isn't cached has no metadata
    known = c.select(F.sha1(F.concat(F.lit("file://"), F.col("c_custkey").cast("string"))).alias("cache_hash"), F.concat(F.lit("u"), F.col("c_custkey")).alias("rdr_url"))
    return catalog.tile_sources(r, known).select("o_orderkey", "source_url")


@query("""select count(*) filter (where c_custkey * 31 % 7000 >= 2400) as live, count(*) filter (where c_custkey * 31 % 7000 < 2400) as zombie from customer""")
def task_liveness(spark, d):
    t = table(spark, d, "customer").select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 31 % 7000).alias("progressed"))
    return catalog.liveness(t, F.timestamp_seconds(F.lit(1_700_006_000)))


@query("""with e as (select event_id // 1000 as batch, event_type, event_id from events) select batch, count(*) as events, count(*) filter (where event_type = 'signup' or (event_type in ('click', 'view') and event_id % 5 = 0)) as processed, count(*) filter (where event_type in ('click', 'view') and event_id % 5 = 1) as cancelled,
count(*) filter (where event_type in ('click', 'view') and event_id % 5 = 2) as rejected, count(*) filter (where event_type in ('click', 'view') and event_id % 5 = 3) as forwarded, count(*) filter (where event_type in ('click', 'view') and event_id % 5 = 4) as retry from e group by 1""")
def batch_outcomes(spark, d):
    """Deliveries routed by what became of them, counted by batch."""
    from ..streaming import ingest

    e = table(spark, d, "events").withColumn("key", F.col("event_id").cast("string")).withColumn("bucket", F.lit("b"))
    decisions = e.select("bucket", "key", F.expr("event_id div 1000").alias("batch"), F.when(F.col("event_type").isin("click", "view"), "build").when(F.col("event_type") == "signup", "delete").otherwise("ignore").alias("action"))
    k = F.col("event_id") % 5
    sources = e.where(F.col("event_type").isin("click", "view")).select("bucket", "key", (k != 2).alias("supported"), (k == 3).alias("oversize"), F.when(k == 1, "cancelled").when(k == 4, "disk full").alias("error"))
    return catalog.outcomes(ingest.routed(decisions, sources))


@query("""select o_orderkey, [200, 400, 404, 403, 202, 503, 500][o_orderkey % 7 + 1] as status, 'queue-' || o_custkey as queue, 'ARN=plain' as odd from orders""")
def service_answers(spark, d):
    error = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, ("oversize", "not_found", "forbidden", "still_running", "overloaded", "other"))), (F.col("o_orderkey") % 7).cast("int"))
    arn = F.concat(F.lit("arn:aws:sqs:us-west-2:1:queue-"), F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", catalog.http_status(error).alias("status"), urls.queue_name(arn).alias("queue"), urls.queue_name(F.lit("plain")).alias("odd"))


@query("""with r as (select l_partkey % 50 as x, l_suppkey % 7 as y, l_linenumber as w, cast(l_orderkey % 10 as varchar) as image_id from lineitem), e as (select image_id, x, y, w, count(*) as n from r group by all)
select image_id, cast(sum(n) as bigint) as reads, count(*) as rectangles, min(n) as least, max(n) as most, min(x) as left, min(y) as top, max(x + w) as right, max(y + 5) as bottom from e group by 1""")
def read_stats(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).cast("string").alias("image_id"), (F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 7).alias("y"), F.col("l_linenumber").alias("w"), F.lit(5).alias("h"))
    return catalog.read_stats(r)


@query("""with e as (select user_id as owner, event_id as seq, cast(floor(value) as bigint) % 20 as page, row_number() over (partition by user_id order by event_id) as n from events) select owner, seq, n - lag(n) over (partition by owner, page order by n) - 1 as gap from e""")
def page_returns(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), (F.floor("value") % 20).alias("page"))
    return catalog.page_returns(e).select("owner", "seq", "gap")


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'b' || o_custkey when 1 then 'b.c' when 2 then 'p' else 'real' end as bucket, case o_orderkey % 4 when 0 then 'k/x+y' when 1 then 'k z' when 2 then 'k' else 'more/k' end as key, case o_orderkey % 4 when 1 then 'us-west-2' end as region, case o_orderkey % 4 when 1 then '7' end as version from orders""")
def store_urls(spark, d):
    """Buckets and keys of URLs in all forms; a bucket with a prefix is set right."""
    shapes = F.element_at(F.array(F.concat(F.lit("s3://b"), F.col("o_custkey"), F.lit("/k/x+y")), F.lit("https://b.c.s3.us-west-2.amazonaws.com/k%20z?versionId=7"), F.lit("http://s3.amazonaws.com/p/k"), F.lit("s3://real/more/k")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    p = urls.s3_parts(shapes)
    odd = F.col("o_orderkey") % 4 == 3
    bucket, key = urls.bucket_and_key(F.when(odd, "s3://real/more").otherwise(p["bucket"]), F.when(odd, "k").otherwise(p["key"]))
    return table(spark, d, "orders").select("o_orderkey", bucket.alias("bucket"), key.alias("key"), p["region"].alias("region"), p["version_id"].alias("version"))


@query(f"""with {REQUESTS} select o_orderkey, case o_orderkey % 4 when 0 then 'https://me:8443/app/' || cache_hash || '/https_proxy_image_files/' when 1 then 'https://tiles/x/' || cache_hash || '/y/' when 2 then 'https://data/bucket/loc/' || cache_hash || '/image_files/' else 'http://me:8443/app/' || cache_hash || '/http_proxy_image_files/' end as url,
case o_orderkey % 4 when 0 then 's3' when 1 then 'tile' when 2 then 'data' else 'http' end as mode from req""")
def proxy_urls(spark, d):
    r = tables.requests(spark, d)
    asked_mode = pick("o_orderkey", ["https", "TILE", "data", "http"])
    url = urls.tiles_url(F.lower(asked_mode), F.col("cache_hash"), F.lit("https://tiles/x/HASH/y/"), F.lit("https://data/"), F.lit("bucket/loc"), F.lit("https://me:8443/app"))
    mode = urls.proxy_mode(F.when(F.col("o_orderkey") % 4 == 0, "odd").otherwise(asked_mode), F.lit(""), F.lit(""), F.lit(True), F.lit(False))
    return r.select("o_orderkey", url.alias("url"), mode.alias("mode"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then '' else 'd' || o_custkey || '/' end as folder, 'p/' || o_custkey as path, 'tile_size=9 x=' || o_custkey as args, 'at p with ' || o_custkey as page from orders""")
def path_texts(spark, d):
    folder = pick("o_orderkey", ["", "a", "b"])
    given = F.when(folder == "", F.lit("///")).otherwise(F.concat(F.lit("d"), F.col("o_custkey"), F.when(folder == "a", "").otherwise("//")))
    path = F.concat(pick("o_orderkey", ["/root/", "/abs/root/", "/"]), F.lit("p/"), F.col("o_custkey"))
    args = urls.query_args(F.concat(F.lit("http://h/?tile_size=9&x=%2B"), F.col("o_custkey"), F.lit("#f")))
    shown = F.concat(F.lit("tile_size="), args["tile_size"], F.lit(" x="), F.regexp_replace(args["x"], "[+]", ""))
    page = urls.filled(F.lit("at {{PATH}} with {{PARAMS}}"), {"PATH": F.lit("p"), "PARAMS": F.col("o_custkey").cast("string")})
    return table(spark, d, "orders").select("o_orderkey", urls.with_separator(given).alias("folder"), urls.without_root(path, "/root", "/abs/root").alias("path"), shown.alias("args"), page.alias("page"))


@query("""with t as (select o_orderkey, o_orderkey * 997 % 9000000 as ms, cast(o_custkey as varchar) as n from orders) select o_orderkey, case when ms = 0 then '0s' when ms < 1000 then ms || 'ms' when ms < 60000 then (ms // 1000) || '.' || lpad((ms % 1000)::varchar, 3, '0') || 's'
when ms < 3600000 then (ms // 60000) || 'm' || (ms // 1000 % 60) || 's' else (ms // 3600000) || 'h' || (ms // 60000 % 60) || 'm' || (ms // 1000 % 60) || 's' end as time, case o_orderkey % 3 when 0 then 7 when 1 then cast(n as integer) else 7 end as number, ['percent', 'none', 'percent'][o_orderkey % 3 + 1] as kind, o_orderkey % 7 in (0, 1, 5) as flag from t""")
def typed_texts(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, "auto").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), F.col("o_custkey"))).otherwise("-5")
    number = units.parsed(text, "int", F.trim(text).try_cast("int") >= 0, F.lit(7))
    kind = units.one_of(pick("o_orderkey", ["", " None", "PERCENT"]), spec.STRETCHES, "percent")
    flag = units.parsed(pick("o_orderkey", ["true", " TRUE ", "1", "yes", "false", "auto", "t"]), "boolean", None, F.lit(True))
    return table(spark, d, "orders").select("o_orderkey", units.hms(F.col("o_orderkey") * 997 % 9_000_000).alias("time"), number.alias("number"), kind.alias("kind"), flag.alias("flag"))


@query("""select o_orderkey, 's3://b/' || o_custkey || ' x.IMG' as rdr_url, case when o_orderkey % 3 = 0 then 'jpg' end as tile_format, case when o_orderkey % 5 = 0 then 'extrema' when o_orderkey % 2 = 0 then 'percent' end as stretch_type,
case when o_orderkey % 4 = 0 then 'contour:STEP=0.5' || chr(10) || 'xyz:a=b' end as overlay_preferences, 2 + (o_orderkey % 3 = 0)::integer + (o_orderkey % 5 = 0 or o_orderkey % 2 = 0)::integer + (o_orderkey % 4 = 0)::integer as fields from orders""")
def query_args(spark, d):
    """Requests' query strings with the service's own names."""
    k = F.col("o_orderkey")
    part = lambda n, text: F.when(k % n == 0, F.lit(text)).otherwise("")
    text = F.concat(F.lit("image=s3%3A%2F%2Fb%2F"), F.col("o_custkey"), F.lit("+x.IMG&tileSize=128&tileSize=7&unknown=1"), part(3, "&format=jpg"), part(2, "&stretchType=histogram_percent"), part(5, "&extremaStretch=TRUE"), part(4, "&overlayPreference=contour%3ASTEP%3D0.5&overlayPreference=xyz:a=b"))
    args = table(spark, d, "orders").select("o_orderkey", spec.args_of_query(text).alias("args"))
    return args.select("o_orderkey", *[F.col("args")[n].alias(n) for n in ("rdr_url", "tile_format", "stretch_type", "overlay_preferences")], F.size("args").alias("fields"))


@query(f"""with {IMAGES}, h as (select image_id, width * 4000::bigint as w, height * 4000::bigint as h, 1 + (width % 3 = 0)::integer * 2 as bands, case when height % 2 = 0 then 1 else 2 end as bps, width % 2 = 0 as pds from img),
s as (select *, w * case when bands = 3 and bps = 1 then 4 else bands * bps end as line from h),
m as (select *, case when pds and w * h > 2147483647 then 2147483647 // w when not pds and line * h > 2147483647 then 2147483647 // line end as line_limit from s)
select image_id, line_limit, coalesce(line_limit, h) as lines, case when line_limit = 0 then 'width' when line * coalesce(line_limit, h) > 2000000000 then 'image_bytes' end as reason from m""")
def line_limits(spark, d):
    """Images so large that only some of their lines are worked on, if any."""
    i = tables.images(spark, d).select(
        "image_id", (F.col("width") * 4000).cast("long").alias("width"), (F.col("height") * 4000).cast("long").alias("height"), (1 + (F.col("width") % 3 == 0).cast("int") * 2).alias("bands"),
        F.when(F.col("height") % 2 == 0, 1).otherwise(2).alias("bytes_per_sample"), F.lit(0).alias("file_bytes"), (F.col("width") % 2 == 0).alias("is_pds"),
    )
    return raster.with_line_limit(i, most_image_bytes=2_000_000_000).select("image_id", "line_limit", "lines", "reason")


@query("""with q as (select o_orderkey as rect_id, o_custkey * 7 % 4000 as x, o_custkey % 900 + 1 as w from orders), m as (select *, (x + w // 2) // 512 as c from q),
k as (select *, x >= c * 512 - 64 and x + w <= c * 512 + 576 as held from m)
select rect_id, i as wx, greatest(x, i * 512 - 64) as px, least(x + w, i * 512 + 576) - greatest(x, i * 512 - 64) as pw from k, range(10) r(i) where case when held then i = c else i between x // 512 and (x + w - 1) // 512 end""")
def window_margin(spark, d):
    r = tables.rectangles(spark, d).withColumn("y", F.lit(0)).withColumn("h", F.lit(1))
    return pyramid.windows_of(r, 512, 64).select("rect_id", "wx", "px", "pw")


@query(f"""with {VECTORS} select image_id, cast(y // 32 as integer) as strip, cast(y % 32 // 8 * 8 as integer) as y, cast(x // 5 * 5 as integer) as x, band, count(*) as n, cast(sum(dn) as double) as s from color group by all""")
def windowed_read(spark, d):
    """Rasters made of strips of the table's images, written as files; their windows read back by ranges of bytes."""
    from ..sources import labelled, raster_source

    folder = f"{base.shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    made = labelled.encode(base.color(spark, d), 32).select(F.concat("path", F.lit(".img")).alias("path"), "content")
    raster_source.write_files(made, folder).write.parquet(f"{folder}-manifest")
    rows = raster_source.window_sums(raster_source.read_rasters(spark, folder, lines=8, samples=5))
    name = F.regexp_extract("path", "/([^/]+)/([0-9]+)[.]img$", 2).cast("int")
    return rows.select(F.regexp_extract("path", "/([^/]+)/[0-9]+[.]img$", 1).alias("image_id"), name.alias("strip"), "y", "x", "band", "n", "s")


@query(f"""with {VECTORS} select image_id, cast(y // 8 as integer) as strip, band, count(*) as n, cast(sum(dn) as double) as s from color group by all""")
def tiff_pieces(spark, d):
    """TIFF files made of strips of the table's images, in all packings; their strips and tiles decoded by ranges of bytes."""
    from ..sources import raster_source, tiff

    folder = f"{base.shared_folder(spark)}/tiffs-{uuid.uuid4().hex}"
    made = tiff.encode(base.color(spark, d), 8).select(F.concat("path", F.lit(".tif")).alias("path"), "content")
    raster_source.write_files(made, folder).write.parquet(f"{folder}-manifest")
    pieces = tiff.pieces_of(tiff.layouts(spark.read.parquet(f"{folder}-manifest")))
    sums = raster_source.window_sums(tiff.read_pieces(pieces))
    place = "/([^/]+)/([0-9]+)[.]tif$"
    keys = [F.regexp_extract("path", place, 1).alias("image_id"), F.regexp_extract("path", place, 2).cast("int").alias("strip"), "band"]
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@query(f"""with {VECTORS}, tile as (select image_id, cast(y // 8 as integer) as row, max(x) + 1 as w, max(y) % 8 + 1 as h from color group by all)
select image_id, row, n, name, case when n = 0 then cast(w as bigint) end as width, case when n = 0 then cast(h as bigint) end as height, case when n = 0 then 'RGB' end as color,
  case when n = 1 then 0.45e0 end as gamma, case when n < 2 then 1 end as whole from tile, (values (0, 'IHDR'), (1, 'gAMA'), (2, 'IDAT')) c(n, name)""")
def png_chunks(spark, d):
    """Chunks of PNG files made of strips of the table's images, up to their image data, with what they tell."""
    from ..sources import png_chunks as chunks
    from ..sources import raster_source, sinks

    folder = f"{base.shared_folder(spark)}/pngs-{uuid.uuid4().hex}"
    p = base.color(spark, d).select("image_id", F.lit(0).alias("level"), F.lit(0).alias("col"), F.expr("cast(y div 8 as int)").alias("row"), "y", "x", "band", F.expr("dn div 16").alias("out"))
    made = sinks.png_tiles(p, 3).select(F.concat_ws("/", "image_id", F.concat(F.col("row").cast("string"), F.lit(".png"))).alias("path"), F.col("data").alias("content"))
    raster_source.write_files(chunks.told_gamma(made, 0.45), folder).write.parquet(f"{folder}-manifest")
    rows = chunks.values(chunks.chunks_of(spark.read.parquet(f"{folder}-manifest")))
    place = "/([^/]+)/([0-9]+)[.]png$"
    return rows.select(F.regexp_extract("path", place, 1).alias("image_id"), F.regexp_extract("path", place, 2).cast("int").alias("row"), "n", "name", "width", "height", "color", "gamma", F.col("crc_ok").cast("int").alias("whole"))


AXIS = """select s.{size} as n_in, s.{out} as n_out, kind, i, j, case when kind = 'area' then least((i + 1) * s.{size}, (j + 1) * s.{out}) - greatest(i * s.{size}, j * s.{out})
  else 2 * greatest(s.{size}, s.{out}) - abs(2 * s.{out} * j + s.{out} - (2 * i + 1) * s.{size}) end as weight
  from (select distinct {size}, {out} from size) s, (values ('area'), ('linear')) k(kind), range(s.{out}) a(i), range(s.{size}) b(j)"""


@query(f"""with {VECTORS}, size as (select image_id, 16::bigint as width, max(y) + 1 as height, 5 + 3 * image_id::bigint as out_w, 9 + 20 * image_id::bigint as out_h from color group by 1),
kx as (select *, sum(weight) over (partition by n_in, n_out, kind, i)::bigint as norm from ({AXIS.format(size="width", out="out_w")}) where weight > 0),
ky as (select *, sum(weight) over (partition by n_in, n_out, kind, i)::bigint as norm from ({AXIS.format(size="height", out="out_h")}) where weight > 0),
line as (select c.image_id, kind, band, y, i as x, sum(dn * weight)::bigint * 65536 // any_value(norm) as v from color c join size s on c.image_id = s.image_id join kx on width = n_in and out_w = n_out and c.x = j group by all)
select l.image_id, ky.kind, band, ky.i as y, l.x, (2 * sum(v * weight)::bigint + 65536 * any_value(norm)) // (2 * 65536 * any_value(norm)) as dn
from line l join size s on l.image_id = s.image_id join ky on height = n_in and out_h = n_out and l.y = j and l.kind = ky.kind group by all""")
def resampled(spark, d):
    """The table's images at smaller and larger sizes, by areas and by triangles."""
    p = base.color(spark, d)
    number = F.col("image_id").cast("long")
    sizes = p.groupBy("image_id").agg(F.lit(16).alias("width"), (F.max("y") + 1).alias("height")).select("*", (5 + 3 * number).alias("out_w"), (9 + 20 * number).alias("out_h"))
    made = [resample.resized(p, sizes, kind).withColumn("kind", F.lit(kind)) for kind in ("area", "linear")]
    return made[0].unionByName(made[1])


@query(f"""with {VECTORS}, rect as (select o_orderkey as rect_id, cast(o_custkey % 10 as varchar) as image_id, o_custkey % 19 - 2 as x, o_orderkey % 61 - 5 as y, o_orderkey % 9 + 1 as w, o_custkey % 23 + 1 as h from orders)
select cast(rect_id as varchar) as rect_id, band, count(*) as n, cast(sum(dn) as bigint) as s from rect r join color c on r.image_id = c.image_id and c.x >= r.x and c.x < r.x + r.w and c.y >= r.y and c.y < r.y + r.h group by all""")
def rectangle_pixels(spark, d):
    """Pixels of a rectangle for each order, from blocks of the table's images; summed by band."""
    from ..sources import labelled, raster_source

    p = base.color(spark, d)
    image = F.substring_index("path", "/", 1).alias("path")
    blocks = image_files.blocks(labelled.encode(p, 1 << 20), 32).select(image, "band", (F.col("ty") * 32).alias("y"), (F.col("tx") * 32).alias("x"), "h", "w", "dtype", "data")
    sizes = p.groupBy(F.col("image_id").alias("path")).agg(F.lit(16).alias("width"), (F.max("y") + 1).alias("height"), F.lit(3).alias("bands"), F.lit(">i2").alias("dtype"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = table(spark, d, "orders").select(o.alias("rect_id"), (c % 10).cast("string").alias("path"), (c % 19 - 2).alias("x"), (o % 61 - 5).alias("y"), (o % 9 + 1).alias("w"), (c % 23 + 1).alias("h"))
    strips = rectangles.pixels_of(blocks, asked, sizes, 32, 16).withColumnRenamed("rect_id", "path").withColumn("x", F.lit(0))
    sums = raster_source.window_sums(strips.select("path", "band", "y", "x", "h", "w", "dtype", "data"))
    return sums.groupBy(F.col("path").alias("rect_id"), "band").agg(F.sum("n").alias("n"), F.sum("s").cast("long").alias("s"))


@query(f"""with {BOUNDS}, p as (select c.image_id, band, x // 8 as col, y // 8 as row, {OUT} as v from color c join bounds b on c.image_id = b.image_id)
select image_id, cast(col as integer) as col, cast(row as integer) as row, cast(count(*) // 3 as bigint) as pixels, cast(sum(v) as bigint) as s from p group by all""")
def committed_tiles(spark, d):
    """8-bit tiles of 8 pixels written as files by the sink; those that its manifest names are read back and decoded."""
    from ..sources import raster_source, sinks, tile_sink

    root = f"{base.shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    p = raster.stretch(base.color(spark, d), base.bounds(spark, d)).select("image_id", F.lit(0).alias("level"), F.expr("cast(x div 8 as int)").alias("col"), F.expr("cast(y div 8 as int)").alias("row"), "y", "x", "band", "out")
    tile_sink.write_tiles(sinks.png_tiles(p, 3), root)
    manifest = tile_sink.committed(spark, root)
    sums = image_files.pixels(image_files.blocks(raster_source.contents(manifest))).groupBy("path").agg(F.sum("dn").cast("long").alias("s"))
    return manifest.join(sums, "path").select("image_id", "col", "row", (F.col("w") * F.col("h")).cast("long").alias("pixels"), "s")


@query(f"with {BOUNDS} select c.image_id, band, cast(sum({OUT}) as bigint) as s, count(*) as n from color c join bounds b on c.image_id = b.image_id group by all")
def whole_images(spark, d):
    """One PNG for each of the table's images, made of strips of 8 lines that are packed and written apart, decoded again."""
    from ..sources import raster_source, whole_image

    folder = f"{base.shared_folder(spark)}/images-{uuid.uuid4().hex}"
    p = raster.stretch(base.color(spark, d), base.bounds(spark, d)).select("image_id", "y", "x", "band", "out")
    sizes = p.groupBy("image_id").agg(F.lit(16).alias("width"), (F.max("y") + 1).alias("height"))
    whole_image.strips(p, sizes, 3, 8).write.parquet(f"{folder}/strips")
    made = whole_image.write_images(whole_image.pieces(spark.read.parquet(f"{folder}/strips"), 3), f"{folder}/out")
    made.write.parquet(f"{folder}/manifest")
    files = raster_source.contents(spark.read.parquet(f"{folder}/manifest"))
    name = F.regexp_extract("path", "/([^/]+)[.]png$", 1)
    return image_files.pixels(image_files.blocks(files)).groupBy(name.alias("image_id"), "band").agg(F.sum("dn").cast("long").alias("s"), F.count(F.lit(1)).alias("n"))


#: Images whose tiles one task counts.
IMAGES_A_TASK = 50_000


def stored_levels(spark, d):
    """Tiles of generated images as they would be written, from their geometry; images are dealt, their many tiles needn't be."""
    i = tables.images(spark, d)
    n = max(image_files.dealt_over(spark), -(-i.count() // IMAGES_A_TASK))
    return pyramid.tile_rects(pyramid.levels(i.repartition(n, "image_id")))


@query(f"""with {LEVELS} select image_id, level, cols * rows as tiles from levels""")
def written_per_level(spark, d):
    from ..sources import sinks

    return sinks.written_per_level(stored_levels(spark, d))


@query("""with r as (select user_id, cast(floor(value) as bigint) % 50 as page from events), e as (select user_id, page, count(*) as n from r group by all) select user_id, max(n) as most, count(*) filter (where n = 1) as once, count(*) as pages from e group by 1""")
def transfer_stats(spark, d):
    return catalog.transfer_stats(table(spark, d, "events").select("user_id", (F.floor("value") % 50).alias("page")), "user_id")


@query("""select l_partkey as page, count(*) as transfers from lineitem group by 1""")
def page_transfers(spark, d):
    return catalog.transfers(table(spark, d, "lineitem").select(F.col("l_partkey").alias("page")))


@query("""select o_custkey || '/' || o_orderkey || '.png' as path from orders where o_custkey::varchar like '7%' and o_orderkey % 3 <> 0""")
def removable_files(spark, d):
    end = F.when(F.col("o_orderkey") % 3 == 0, ".pid").otherwise(".png")
    listing = table(spark, d, "orders").select(F.concat(F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"), end).alias("path"))
    return catalog.removable(listing, "7")


@query("""with f as (select page_id % 5 as place, page_id % 3 = 0 as kept, octet_length(encode(html)) as bytes from pages where html is not null)
select case when kept then 'kept' else 'deleted' end as outcome, false as is_folder, count(*) as n, sum(bytes)::bigint as bytes, count(*) filter (where kept) as left_over from f group by kept
union all select case when k then 'kept' else 'deleted' end, true, count(*), null, case when k then count(*) else 0 end from (select bool_or(kept) as k from f group by place union all select bool_or(kept) from f) group by k""")
def deleted_trees(spark, d):
    """Pages written as files of five folders, deleted but for those with one ending, with folders that are left empty."""
    from ..sources import deletes, raster_source

    shared = base.shared_folder(spark)
    root = f"{shared}/trash-{uuid.uuid4().hex}"
    k = F.col("page_id")
    made = table(spark, d, "pages").where("html is not null").select(F.concat_ws("/", (k % 5).cast("string"), F.concat(k, F.when(k % 3 == 0, ".pid").otherwise(".png"))).alias("path"), F.encode("html", "UTF-8").alias("content"))
    raster_source.write_files(made, root).write.parquet(f"{root}-manifest")
    roots = spark.createDataFrame([(root,)], "path string")
    done = deletes.outcome_counts(deletes.delete_trees(roots, shared, F.col("path").endswith(".pid")))
    left = deletes.tree(roots, shared).select("is_folder").unionByName(roots.select(F.lit(True).alias("is_folder"))).groupBy("is_folder").agg(F.count(F.lit(1)).alias("left_over"))
    kept = F.when(F.col("outcome") == "kept", F.coalesce("left_over", F.lit(0))).otherwise(0).cast("long")
    return done.join(left, "is_folder", "left").select("outcome", "is_folder", "n", "bytes", kept.alias("left_over"))


@query("""select 'p' as path from (select 1 from customer where c_custkey > 0 limit 1)""")
def any_below(spark, d):
    listing = table(spark, d, "customer").select(F.concat(F.lit("p/"), F.col("c_custkey")).alias("path"))
    return catalog.any_below(listing, "p/").select(F.substring("path", 1, 1).alias("path"))


@query("""select c_custkey, 'u' || c_custkey as url, case when c_custkey % 2 = 0 then (c_custkey % 500)::varchar end as tile_size, case when c_custkey % 3 = 0 then 'true' end as mask_black, case when c_custkey % 5 = 0 then 'a:b=1' || chr(10) || 'c:d=2' end as wishes from customer""")
def body_args(spark, d):
    k = F.col("c_custkey")
    body = F.concat(
        F.lit('{"rdr_url": "u'), k, F.lit('"'), F.when(k % 2 == 0, F.concat(F.lit(', "tile_size": '), k % 500)).otherwise(', "tile_size": null'),
        F.when(k % 3 == 0, ', "mask_black": true').otherwise(""), F.when(k % 5 == 0, ', "overlay_preferences": ["a:b=1", "c:d=2"]').otherwise(""), F.lit("}"),
    )
    a = spec.args_of_body(body)
    return table(spark, d, "customer").select("c_custkey", a["rdr_url"].alias("url"), a["tile_size"].alias("tile_size"), a["mask_black"].alias("mask_black"), a["overlay_preferences"].alias("wishes"))


@query("""select o_orderkey::varchar as image_id, case o_orderkey % 3 when 0 then 'histogram_percent' when 1 then 'relative' else 'none' end as stretch, case when o_orderkey % 3 = 0 then 0.5 end as low_percent, case when o_orderkey % 3 = 1 then 0.5 end as low_relative,
cast(o_custkey as bigint) as width, strftime(o_orderdate, '%Y-%m-%dT%H:%MZ') as at from orders""")
def product_metadata(spark, d):
    from ..sources import sinks

    p = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("image_id"), F.lit(254).alias("tile_size"), pick("o_orderkey", ["percent", "relative", "none"]).alias("stretch_type"), F.lit(0.5).alias("asked_low"), F.lit(0.5).alias("asked_high"),
        F.col("o_custkey").alias("width"), F.col("o_orderdate").alias("processing_timestamp"), F.lit(None).cast("double").alias("original_gamma"),
    )
    m = F.from_json("metadata", "stretch_type string, stretch_low_percent double, stretch_low_relative double, width long, processing_timestamp string")
    out = sinks.product_metadata(p, ["tile_size"]).select("image_id", m.alias("m"))
    return out.select("image_id", F.col("m.stretch_type").alias("stretch"), F.col("m.stretch_low_percent").alias("low_percent"), F.col("m.stretch_low_relative").alias("low_relative"), "m.width", F.col("m.processing_timestamp").alias("at"))
