"""Rasters as tables: pixels(image_id, y, x, band, dn), their statistics, contrast stretches and masks.

Every operator takes and keeps ``image_id``, so one job serves any number of images; statistics aggregate map-side
first, and per-image parameters (a few rows per image) are joined to pixels by image, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA_BAND = 3


def drop_alpha(pixels: DataFrame, color_bands: int = 3) -> DataFrame:
    """The first ``color_bands`` bands."""
    return pixels.where(F.col("band") < color_bands)


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


def limit_height(pixels: DataFrame, height: int) -> DataFrame:
    return pixels.where(F.col("y") < height)


def extrema(pixels: DataFrame) -> DataFrame:
    """image_id, band, mn, mx; NaN never wins, and a band of NaN alone has nulls."""
    known = F.when(~F.isnan(F.col("dn").cast("double")), F.col("dn"))
    return pixels.groupBy("image_id", "band").agg(F.min(known).alias("mn"), F.max(known).alias("mx"))


def repaired_extrema(bounds: DataFrame) -> DataFrame:
    """Unusable bounds: both give 0, 0; one gives the other -/+ 100; crossed ones give max - 100, max."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    mn = F.when(bad("mn") & bad("mx"), 0.0).when(bad("mn"), F.col("mx") - 100).otherwise(F.col("mn"))
    mx = F.when(bad("mn") & bad("mx"), 0.0).when(bad("mx"), F.col("mn") + 100).otherwise(F.col("mx"))
    fixed = bounds.select("image_id", "band", mn.cast("double").alias("mn"), mx.cast("double").alias("mx"))
    return fixed.withColumn("mn", F.when(F.col("mn") > F.col("mx"), F.col("mx") - 100).otherwise(F.col("mn")))


def global_extrema(bounds: DataFrame) -> DataFrame:
    return bounds.groupBy("image_id").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def histogram(pixels: DataFrame, bits: int, max_bins: int = 4096) -> DataFrame:
    """image_id, band, bin, cnt over [0, 2^bits) in min(max_bins, 2^bits) bins; values outside aren't counted."""
    bins = min(max_bins, 1 << bits)
    inside = pixels.where((F.col("dn") >= 0) & (F.col("dn") < (1 << bits)))
    return inside.groupBy("image_id", "band", F.floor(F.col("dn") * bins / (1 << bits)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def float_histogram(pixels: DataFrame, bins: int = 4096, quantum: float = 1e-6) -> DataFrame:
    """As ``histogram`` over [least, greatest + quantum) of all bands of an image; adds lo and width."""
    ends = global_extrema(extrema(pixels)).select("image_id", F.col("mn").alias("lo"), ((F.col("mx") + quantum - F.col("mn")) / bins).alias("width"))
    placed = pixels.where(~F.isnan("dn")).join(ends, "image_id")
    return placed.groupBy("image_id", "band", "lo", "width", F.least(F.lit(bins - 1), F.floor((F.col("dn") - F.col("lo")) / F.col("width")).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def zero_filled(hist: DataFrame, bins: int) -> DataFrame:
    """All bins of each image and band, with 0 where nothing was counted."""
    every = hist.select("image_id", "band").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(hist, ["image_id", "band", "bin"], "left").select("image_id", "band", "bin", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def extrema_from_histogram(hist: DataFrame, lo: float, width: float) -> DataFrame:
    """Low edges of the first and the last bin that isn't empty; 0, 0 without any."""
    edge = F.when(F.col("cnt") > 0, F.lit(lo) + F.col("bin") * width)
    return hist.groupBy("image_id", "band").agg(F.coalesce(F.min(edge), F.lit(0.0)).alias("mn"), F.coalesce(F.max(edge), F.lit(0.0)).alias("mx"))


def halvings(low: float, high: float) -> list[tuple[int, float, float]]:
    """The outlier fractions that a percent stretch tries in turn: halved, to 0 from 0.0005 on, until both are 0."""
    tried = [(0, low, high)]
    while tried[-1][1:] != (0.0, 0.0):
        k, low, high = tried[-1]
        tried.append((k + 1, low / 2 if low > 0.0005 else 0.0, high / 2 if high > 0.0005 else 0.0))
    return tried


def percent_bounds(hist: DataFrame, bins: int, lo: float, hi: float, low_percent: float = 0.5, high_percent: float = 0.5, quantum: float = 1.0) -> DataFrame:
    """image_id, k (halvings needed), lo, hi of the percent stretch.

    Bin 0 counts neither as pixels nor as outliers, and the pixel total is band 0's. The lower bound is the first bin at
    which any band has its quota of outliers below; the upper bound is its mirror image. Equal bounds are widened by a
    quantum; bounds that still don't ascend are tried again with halved fractions.
    """
    width = (hi - lo) / bins
    up, down = (Window.partitionBy("image_id", "band").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("bin"), F.desc("bin")))
    summed = hist.where("bin > 0").select("image_id", "band", "bin", F.sum("cnt").over(up).alias("below"), F.sum("cnt").over(down).alias("above"))
    totals = hist.groupBy("image_id", "band").agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("bin") == 0, F.col("cnt")).otherwise(0)).alias("zeros"))
    first = totals.where("band = 0").select("image_id", F.col("n").alias("pixels"))
    tries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, a, b in halvings(low_percent / 100, high_percent / 100)])
    quotas = totals.join(first, "image_id").select("image_id", "band", (F.col("pixels") - F.col("zeros")).alias("lit"), F.explode(tries).alias("t"))
    quotas = quotas.select("image_id", "band", "t.*", F.floor(F.col("low") * F.col("lit")).alias("low_quota"), F.floor(F.col("high") * F.col("lit")).alias("high_quota"))
    reached = quotas.join(summed, ["image_id", "band"], "left").groupBy("image_id", "band", "k", "low", "high", "low_quota", "high_quota").agg(
        F.min(F.when(F.col("below") >= F.col("low_quota"), F.col("bin"))).alias("i_low"), F.max(F.when(F.col("above") >= F.col("high_quota"), F.col("bin"))).alias("i_high")
    )
    i_low = F.when(F.col("low_quota") <= 0, 1).otherwise(F.coalesce("i_low", F.lit(bins - 1)))
    i_high = F.when(F.col("high_quota") <= 0, bins - 1).otherwise(F.coalesce("i_high", F.lit(1)))
    ends = reached.groupBy("image_id", "k", "low", "high").agg(
        F.when(F.max("low_quota") > 0, lo + F.min(i_low) * width).otherwise(lo).alias("a"),
        F.when(F.max("high_quota") > 0, lo + (F.max(i_high) + 1) * width - quantum).otherwise(hi - quantum).alias("b"),
    )
    last = (F.col("low") == 0) & (F.col("high") == 0)
    ends = ends.withColumn("a", F.when(last, lo).otherwise(F.col("a"))).withColumn("b", F.when(last, hi - quantum).otherwise(F.col("b")))
    same = ~last & (F.col("a") == F.col("b"))
    ends = ends.select(
        "image_id", "k", "low", "high",
        F.when(same & (F.col("a") >= quantum), F.greatest(F.lit(0.0), F.col("a") - quantum)).otherwise(F.col("a")).alias("lo"),
        F.when(same & (F.col("a") < quantum), F.col("b") + quantum).otherwise(F.col("b")).alias("hi"),
    )
    usable = ends.where((F.col("hi") > F.col("lo")) | ((F.col("low") == 0) & (F.col("high") == 0)))
    return usable.groupBy("image_id").agg(F.min(F.struct("k", "lo", "hi")).alias("best")).select("image_id", "best.k", F.col("best.lo").cast("double").alias("lo"), F.col("best.hi").cast("double").alias("hi"))


def relative_bounds(bounds: DataFrame, low: float, high: float, band_max: float) -> DataFrame:
    """image_id, lo = low * least DN, hi = high * greatest DN + (1 - high) * the band's greatest value."""
    return global_extrema(bounds).select("image_id", (F.col("mn") * low).cast("double").alias("lo"), (F.col("mx") * high + (1 - high) * band_max).cast("double").alias("hi"))


def literal_bounds(images: DataFrame, low: float | None, high: float | None, band_min: float, band_max: float) -> DataFrame:
    """image_id, lo, hi as given; unknown (None) ones are the ends of the band's range."""
    return images.select("image_id", F.lit(band_min if low is None else low).cast("double").alias("lo"), F.lit(band_max if high is None else high).cast("double").alias("hi"))


def stretched(v: Column, lo: Column, hi: Column, quantum: float = 1.0) -> Column:
    """Linear stretch to 0-255, truncated; equal bounds are widened by a quantum."""
    top = F.when(lo == hi, hi + quantum).otherwise(hi)
    scaled = (v - lo) * 255 / (top - lo)
    return F.when(v <= lo, 0).when(v >= top, 255).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), scaled.cast("int")))).cast("int")


def stretch(pixels: DataFrame, bounds: DataFrame, quantum: float = 1.0) -> DataFrame:
    """Pixels with ``out``, by their image's lo and hi."""
    return pixels.join(bounds.select("image_id", "lo", "hi"), "image_id").withColumn("out", stretched(F.col("dn"), F.col("lo"), F.col("hi"), quantum)).drop("lo", "hi")


def linear_to_srgb(v: Column) -> Column:
    """0-255 to 0-255, truncated."""
    l = v / 255.0
    s = F.when(l < 0.0031308, l * 12.92).otherwise(F.pow(l, F.lit(1 / 2.4)) * 1.055 - 0.055)
    return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) * 255).cast("int")


def srgb_to_linear(v: Column, gamma: float | None = None) -> Column:
    """0-255 to 0-255, truncated; a general ``gamma`` g maps s to s^(1/g)."""
    s = v / 255.0
    l = F.pow(s, F.lit(1 / gamma)) if gamma else F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))
    return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), l)) * 255).cast("int")


def gamma_flags(specs: DataFrame) -> DataFrame:
    """Conversions of a spec (gamma, gamma_mode, stretchable_pds, tile_format): srgb_to_linear, linear_to_srgb,
    output_linear, and what gamma tiles tell in their header (PNG alone can tell linear) and have in their data.

    Only stretchable labelled products have a gamma_class: linear without gamma or with 1, srgb within 0.01 of 0.45, else
    general; a class of general is converted with its own gamma.
    """
    known = F.col("gamma").isNotNull() & ~F.isnan("gamma")
    kind = (
        F.when(~F.col("stretchable_pds"), "none").when(~known | (F.col("gamma") == 1), "linear")
        .when(F.abs(F.col("gamma") - 0.45) < 0.01, "srgb").otherwise("general")
    )
    mode, linear = F.lower("gamma_mode"), F.col("gamma_class") == "linear"
    curved = F.col("gamma_class").isin("srgb", "general")
    flagged = specs.withColumn("gamma_class", kind).select(
        "*",
        ((mode == "srgbtolinear") | (mode == "convert") & curved).alias("srgb_to_linear"),
        ((mode == "lineartosrgb") | (mode == "convert") & (curved | linear)).alias("linear_to_srgb"),
        ((mode == "srgbtolinear") | (mode == "passthrough") & linear).alias("output_linear"),
    )
    header = F.col("output_linear") & (F.lower("tile_format") == "png")
    data = F.col("output_linear") | linear & ~F.col("linear_to_srgb")
    name = lambda c: F.when(c, "linear").otherwise("srgb")
    return flagged.select("*", name(header).alias("tile_header_gamma"), name(data).alias("tile_data_gamma"))


def linear_bounds(bounds: DataFrame, band_min: float, band_max: float, gamma: float | None = None) -> DataFrame:
    """Stretch bounds (image_id, lo, hi) of an sRGB image moved to linear space and kept within the band's range."""
    span = band_max - band_min

    def moved(c: str) -> Column:
        s = (F.col(c) - band_min) / span
        unit = F.pow(s, F.lit(1 / gamma)) if gamma else F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))
        return F.greatest(F.lit(band_min), F.least(F.lit(band_max), band_min + span * F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit))))

    return bounds.select("image_id", *[(moved(c) if span > 0 else F.col(c)).alias(c) for c in ("lo", "hi")])


def converted(v: Column, to_linear: Column, to_srgb: Column, gamma: float | None = None) -> Column:
    """An 8-bit value through the conversions that flags ask for: to linear first, then to sRGB."""
    linear = F.when(to_linear, srgb_to_linear(v, gamma)).otherwise(v.cast("int"))
    return F.when(to_srgb, linear_to_srgb(linear)).otherwise(linear)


def overlay_argb(bands: Column, alpha: Column, to_linear: Column, to_srgb: Column) -> Column:
    """A pixel that isn't stretched (an overlay's 8-bit bands, one or three) as a packed ARGB int, with its conversions."""
    at = lambda i: converted(F.get(bands, F.when(F.size(bands) >= 3, i).otherwise(0)), to_linear, to_srgb)
    return packed_argb(alpha, at(0), at(1), at(2))


def value_table(pixels: DataFrame, bounds: DataFrame, quantum: float = 1.0) -> DataFrame:
    """image_id, dn, out: the stretch of every value that occurs, computed once each."""
    return stretch(pixels.select("image_id", "dn").distinct(), bounds, quantum)


def stretch_by_table(pixels: DataFrame, values: DataFrame) -> DataFrame:
    """As ``stretch``, by look-up in a ``value_table``: pays where values are few and the mapping is dear."""
    return pixels.join(values, ["image_id", "dn"])


def color_bands(bands: Column, color_components: Column) -> Column:
    """How many bands are color: up to three all are, beyond, as many as the color model has components."""
    return F.when(bands > 3, F.coalesce(color_components, bands)).otherwise(bands)


def has_known_colors(stretchable: Column, colors: Column) -> Column:
    """Whether tiles can be made: what is stretched must have one or three colors."""
    return ~stretchable | colors.isin(1, 3)


def oversize_reason(header: dict[str, Column], limit_height: int, most_file_bytes: int, most_image_bytes: int) -> Column:
    """Why an image is too large, or null. ``header``: is_pds, file_bytes, width, height, bands, bytes_per_sample.

    Limits of 0 or less don't hold. With a positive ``limit_height`` only that many lines count; 0 lets none fit.
    """
    lines = F.least(header["height"], F.lit(limit_height)) if limit_height > 0 else header["height"]
    pixels = header["width"].cast("long") * lines
    size = pixels * bytes_per_pixel(header["bands"], header["bytes_per_sample"])
    return (
        F.when(F.lit(most_file_bytes > 0) & (header["file_bytes"] > most_file_bytes), "file_bytes").when(F.lit(limit_height == 0), "width")
        .when(F.lit(most_image_bytes > 0) & (size > most_image_bytes), "image_bytes").when(~header["is_pds"] & (pixels > (1 << 31) - 1), "pixels")
    )


#: Most pixels of a labelled raster, and most bytes of another image, that are worked on: what a signed 32-bit number counts.
MOST_COUNTED = (1 << 31) - 1


def line_limit(header: dict[str, Column], limit_pds: bool = True, limit_others: bool = True) -> Column:
    """How many lines of an image are worked on, where that isn't all of them: as many as keep the pixels of labelled
    rasters, and the bytes of other images, within MOST_COUNTED. Null: all. 0: not even one, the image is too wide.

    ``header``: as for ``oversize_reason``, which ``with_line_limit`` then holds for the lines that are left.
    """
    width, line = header["width"].cast("long"), header["width"].cast("long") * bytes_per_pixel(header["bands"], header["bytes_per_sample"])
    pds = F.lit(limit_pds) & header["is_pds"] & (width * header["height"] > MOST_COUNTED)
    other = F.lit(limit_others) & ~header["is_pds"] & (line * header["height"] > MOST_COUNTED)
    return F.when(pds, F.floor(MOST_COUNTED / width)).when(other, F.floor(MOST_COUNTED / line)).cast("long")


def with_line_limit(images: DataFrame, most_file_bytes: int = -1, most_image_bytes: int = -1, limit_pds: bool = True, limit_others: bool = True) -> DataFrame:
    """Images (is_pds, file_bytes, width, height, bands, bytes_per_sample) with line_limit, lines (that are worked on) and
    reason: why an image is too large even so, or null."""
    names = ("is_pds", "file_bytes", "width", "height", "bands", "bytes_per_sample")
    out = images.withColumn("line_limit", line_limit({n: F.col(n) for n in names}, limit_pds, limit_others))
    out = out.withColumn("lines", F.coalesce("line_limit", "height").cast("long"))
    header = {n: F.col(n) for n in names} | {"height": F.col("lines")}
    return out.withColumn("reason", F.when(F.col("line_limit") == 0, "width").otherwise(oversize_reason(header, -1, most_file_bytes, most_image_bytes)))


def within_line_limits(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels of the lines that ``with_line_limit`` leaves to their images (image_id, lines)."""
    return pixels.join(images.select("image_id", F.col("lines").alias("_lines")), "image_id").where(F.col("y") < F.col("_lines")).drop("_lines")


def bytes_per_pixel(bands: Column, bytes_per_sample: Column) -> Column:
    """Three 8-bit bands are held in four bytes, others as they are."""
    return F.when((bands == 3) & (bytes_per_sample == 1), 4).otherwise(bands) * bytes_per_sample


def estimates_extrema(policy: Column, stretchable: Column, is_float: Column, slow_reads: Column, always: bool = True) -> Column:
    """Whether extrema may come from the histogram: whole-number images that are stretched, unless the policy is never."""
    return (F.lower(policy) != "never") & stretchable & ~is_float & (slow_reads | F.lit(always))


def absolute(v: Column) -> Column:
    return F.abs(v)


def scaled_to_byte(v: Column) -> Column:
    """Unit values (0 to 1) to 0-255."""
    return v * 255


def as_byte(v: Column) -> Column:
    """Rounded half up, then kept within 0-255; NaN is 0."""
    return F.when(F.isnan(v.cast("double")), 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(v + 0.5).cast("double")))).cast("int")


def constant(images: DataFrame, value: int = 128, bands: int = 1) -> DataFrame:
    """Pixels of one value over whole images (image_id, width, height): what overlays are drawn upon."""
    lines = images.select("image_id", "width", F.explode(F.expr("sequence(0L, height - 1)")).alias("y"))
    cells = lines.select("image_id", "y", F.explode(F.expr("sequence(0L, width - 1)")).alias("x"))
    return cells.select("image_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), F.lit(value).alias("dn"))


def resized(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels (image_id, width, height, y, x, band, dn) made smaller to width x height by whole-number means of what falls
    into each new cell. Means are summed map-side, so only new cells are shuffled."""
    cell = lambda at, size, to: F.expr(f"cast({at} * {to} div {size} as long)").alias(at)
    return pixels.groupBy("image_id", cell("y", "height", height), cell("x", "width", width), "band").agg(F.expr("sum(cast(dn as long)) div count(1)").alias("dn"))


def wide(pixels: DataFrame, bands: int) -> DataFrame:
    """One row per pixel: image_id, y, x, bands (array)."""
    cells = pixels.where(F.col("band") < bands).groupBy("image_id", "y", "x").agg(F.sort_array(F.collect_list(F.struct("band", "dn"))).alias("cells"))
    return cells.select("image_id", "y", "x", F.transform("cells", lambda c: c["dn"]).alias("bands"))


def mono_to_rgb(v: Column) -> Column:
    return F.array_repeat(v, 3)


def alpha_of(a: Column, low: float, span: float) -> Column:
    return (F.lit(255) * (a - low) / span).cast("int")


def packed_argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    """One int of four bytes; each value is truncated and keeps its low 8 bits."""
    byte = lambda c: c.cast("int").bitwiseAND(F.lit(255))
    return F.shiftleft(byte(a), 24).bitwiseOR(F.shiftleft(byte(r), 16)).bitwiseOR(F.shiftleft(byte(g), 8)).bitwiseOR(byte(b))


def masked(bands: Column, mask_values: list[list[float]], mask_black: bool) -> Column:
    """Whether every band of a pixel has some mask value of that band; black joins the values if asked for."""
    values = F.array(*[F.array(*[F.lit(float(v[i])) for v in mask_values], *([F.lit(0.0)] if mask_black else [])) for i in range(len(mask_values[0]) if mask_values else 3)])
    return F.forall(F.zip_with(bands, values, lambda b, of: F.array_contains(of, b.cast("double"))), lambda x: x)


def masked_alpha(alpha: Column, is_masked: Column, masked_to: float, unmasked_to: float) -> Column:
    return (alpha / 255.0 * F.when(is_masked, masked_to).otherwise(unmasked_to) * 255).cast("int")


def threshold_replaced(v: Column, low: float, high: float, to: float) -> Column:
    return F.when(v.between(low, high), F.lit(to)).otherwise(v)


def combined(bands: Column) -> Column:
    """Sum of the bands, at most 255."""
    return F.least(F.aggregate(bands, F.lit(0), lambda s, b: s + b.cast("int")), F.lit(255))


def invalid_values(headers: DataFrame, mask_black: bool) -> DataFrame:
    """image_id, invalid: the different invalid and missing constants, with black if asked for."""
    both = F.concat(F.coalesce("invalid", F.array().cast("array<double>")), F.coalesce("missing", F.array().cast("array<double>")), F.array(F.lit(0.0)) if mask_black else F.array().cast("array<double>"))
    return headers.select("image_id", F.array_sort(F.array_distinct(both)).alias("invalid"))
