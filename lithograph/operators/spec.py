"""How a product is to be processed: asked values, configured ones and defaults, resolved column by column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units, urls

#: Defaults of a spec's fields.
TILE_FORMAT, TILE_SIZE, TILE_OVERLAP, THUMB_HEIGHT = "png", 254, 1, 160
STRETCHES = ("none", "percent", "extrema", "relative")
GAMMA_MODES = ("none", "passthrough", "convert", "lineartosrgb", "srgbtolinear")
PERCENT_STRETCH, RELATIVE_STRETCH, OVERLAY_ALPHA = (0.5, 0.5), (1.0, 1.0), 220 / 255
#: Lengths of a mission's product IDs.
ID_LENGTHS = {"MSL": 36, "M20": 54, "CADRE": 41}
#: TYPE:NAME=VALUE of an overlay preference: up to 100, 100 and 1000 characters, the last without white space.
PREFERENCE = r"^[^:]{1,100}:[^=]{1,100}=[^ \t\n\x0B\f\r]{1,1000}$"


@dataclass(frozen=True)
class Config:
    """Configured values (as text, like asked ones) and patterns of product classes, each matched with a whole URL or type."""

    values: dict[str, str] = field(default_factory=dict)
    compressed: tuple[str, ...] = ()
    unlinearized: tuple[str, ...] = ()
    quicklook: tuple[str, ...] = ()
    upload: tuple[str, ...] = ()
    fifteen_bit: tuple[str, ...] = ()
    preapplied_gamma: tuple[str, ...] = ()
    preapplied_gamma_instruments: tuple[str, ...] = ()
    #: Image types of product types that aren't their own, and image types that overlays are made of (None: each product says).
    rdr_types: dict[str, str] = field(default_factory=dict)
    overlayable_types: tuple[str, ...] | None = None


def product_classes(products: DataFrame, config: Config) -> DataFrame:
    """Products (url, product_type, instrument) with their classes as flags."""
    url, kind, instrument = F.col("url"), F.col("product_type"), F.coalesce("instrument", F.lit(""))
    match = lambda c, patterns: F.coalesce(urls.any_match(c, list(patterns)), F.lit(False))
    return products.select(
        "*",
        urls.has_ext(url, urls.PDS_EXTS).alias("is_pds"),
        match(url, config.compressed).alias("is_compressed"),
        match(url, config.unlinearized).alias("is_unlinearized"),
        match(url, config.quicklook).alias("is_quicklook"),
        match(url, config.upload).alias("is_upload"),
        instrument.startswith("E").alias("is_descent_camera"),
        F.upper(kind).isin("ECM", "ECV").alias("is_raw"),
        match(kind, config.fifteen_bit).alias("is_fifteen_bit"),
        (match(kind, config.preapplied_gamma) | match(instrument, config.preapplied_gamma_instruments)).alias("is_preapplied_gamma"),
    )


def repaired_id(filename: Column, mission: str, suffixes: list[str]) -> Column:
    """The full name of a product behind the last dash of a compressed one's: too short an ID is filled up by the first of
    ``suffixes`` that makes it as long as the mission's IDs are; null if none does."""
    length = ID_LENGTHS[mission]
    found = F.regexp_extract(filename, r"^.+-([^-]*)([.][^.-]*)$", 1)
    ext = F.regexp_extract(filename, r"([.][^.-]*)$", 1)
    whole = F.when(F.length(found) == length, found)
    for suffix in suffixes:
        whole = F.coalesce(whole, F.when(F.length(found) + len(suffix) == length, F.concat(found, F.lit(suffix))))
    return F.when(filename.rlike(r"^.+-[^-]*[.][^.-]*$"), F.concat(whole, ext))


def valid_preference(text: Column) -> Column:
    return text.rlike(PREFERENCE)


def asked_types(products: DataFrame, config: Config) -> DataFrame:
    """Products (product_type and rdr_type as their files tell, overlayable, args) with the types that were asked for in
    their place, and other_types: whether those aren't the ones that nobody asked for, case aside.

    An asked product type brings its own image type. Whether an overlay can be made hangs on the image type in the end.
    """
    given = lambda name: F.nullif(F.nullif(F.trim(F.col("args")[name]), F.lit("")), F.lit("auto"))
    kind = F.coalesce(F.when(F.lower(given("product_type")) != "auto", given("product_type")), F.col("product_type"))
    known = F.lit(None).cast("string")
    for name, image_type in config.rdr_types.items():
        known = F.when(F.col("_kind") == name, image_type).otherwise(known)
    told = products.withColumn("_kind", kind)
    told = told.withColumn("_usual", F.when(F.lower("_kind") == F.lower("product_type"), F.coalesce("rdr_type", known, "_kind")).otherwise(F.coalesce(known, F.col("_kind"))))
    told = told.withColumn("_rdr", F.coalesce(F.when(F.lower(given("rdr_type")) != "auto", given("rdr_type")), F.col("_usual")))
    other = (F.lower("_kind") != F.lower("product_type")) | (F.lower("_rdr") != F.lower("_usual"))
    laid = F.col("overlayable") if config.overlayable_types is None else F.coalesce(F.col("_rdr").isin(*config.overlayable_types), F.lit(False))
    replaced = {"product_type": F.col("_kind"), "rdr_type": F.col("_rdr"), "overlayable": laid, "other_types": F.coalesce(other, F.lit(False))}
    return told.withColumns(replaced).drop("_kind", "_usual", "_rdr")


def with_plain_names(args: Column) -> Column:
    """``args`` with the older ways to ask for a stretch in the words of today: histogram_percent is percent, and
    extrema_stretch asks for extrema."""
    kind = F.when(units.parsed(args["extrema_stretch"], "boolean"), "extrema").when(F.lower(args["stretch_type"]) == "histogram_percent", "percent").otherwise(args["stretch_type"])
    rest = F.map_filter(args, lambda name, _: ~name.isin("stretch_type", "extrema_stretch"))
    return F.when(kind.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit("stretch_type"), kind)))


#: Class flags of ``product_classes``.
CLASSES = ("is_pds", "is_compressed", "is_unlinearized", "is_quicklook", "is_upload", "is_descent_camera", "is_raw", "is_fifteen_bit", "is_preapplied_gamma")


def resolved(products: DataFrame, config: Config) -> DataFrame:
    """Products (url, product_type, rdr_type, instrument, overlayable; args: what was asked, a map of texts) with the
    types asked for, the ``product_classes`` of those, all fields of their spec, and ``nominal``: whether all of them are
    what nobody asked for.

    A field is what was asked if that is valid, else what is configured if that is valid, else its default. Text that is
    no value of a field's type raises, as do preferences of the wrong form and unknown tile formats.
    """
    products = products.withColumn("args", with_plain_names(F.coalesce("args", F.create_map().cast("map<string,string>"))))
    products = product_classes(asked_types(products.drop(*CLASSES), config), config)
    values = dict(config.values)
    if values.get("stretch_type", "").lower() == "histogram_percent":
        values["stretch_type"] = "percent"
    if values.pop("extrema_stretch", "").strip().lower() == "true":
        values["stretch_type"] = "extrema"
    plain = urls.has_ext(F.col("url"), urls.PLAIN_EXTS)
    overlay = ~plain & F.col("overlayable")
    out = products.withColumn("overlayable", overlay).withColumn("stretchable", ~overlay)
    arg, set_to = (lambda name: F.get(F.array(F.col("args")[name]), F.lit(0))), (lambda name: F.lit(values.get(name)))
    changed: list[Column] = [F.col("other_types")]

    def add(name: str, default: Column, kind: str, valid=None, counts: Column | None = None) -> None:
        nonlocal out
        check = lambda text: None if valid is None else valid(F.lower(F.trim(text)).try_cast(kind))
        configured = units.parsed(set_to(name), kind, check(set_to(name)), default)
        out = out.withColumn(f"_{name}", configured).withColumn(name, units.parsed(arg(name), kind, check(arg(name)), F.col(f"_{name}")))
        differs = ~F.col(name).eqNullSafe(F.col(f"_{name}"))
        changed.append(differs if counts is None else counts & differs)

    def choose(name: str, default: Column, names: tuple[str, ...], counts: Column | None = None, configurable: bool = True) -> None:
        nonlocal out
        configured = F.coalesce(units.one_of(set_to(name), names), default) if configurable else default
        out = out.withColumn(f"_{name}", configured).withColumn(name, F.coalesce(units.one_of(arg(name), names), F.col(f"_{name}")))
        differs = F.col(name) != F.col(f"_{name}")
        changed.append(differs if counts is None else counts & differs)

    stretched, laid = F.col("stretchable"), F.col("overlayable")
    choose("tile_format", F.lit(TILE_FORMAT), ("png", "jpg", "jpeg", "tif", "tiff"))
    add("tile_overlap", F.lit(TILE_OVERLAP), "int", lambda v: v >= 0)
    add("tile_size", F.lit(TILE_SIZE), "int", lambda v: v > 0)
    add("thumb_height", F.lit(THUMB_HEIGHT), "int", lambda v: v > 0)
    plain_look = F.col("is_quicklook") | F.col("is_upload") | F.col("is_descent_camera") | F.col("is_raw")
    configured = F.coalesce(units.one_of(set_to("stretch_type"), STRETCHES), F.lit("percent"))
    choose("stretch_type", F.when(plain_look, "none").otherwise(configured), STRETCHES, stretched, configurable=False)
    for side, i in (("stretch_low", 0), ("stretch_high", 1)):
        percent, relative = F.col("stretch_type") == "percent", F.col("stretch_type") == "relative"
        within = lambda v: F.when(percent, v.between(0, 100)).when(relative, v.between(0, 1)).otherwise(~F.isnan(v))  # noqa: E731, B023
        add(side, F.when(percent, PERCENT_STRETCH[i]).when(relative, RELATIVE_STRETCH[i]), "double", within, stretched)
        unused = F.col("stretch_type") == "none"
        literal = unused | (F.col("stretch_type") == "extrema")  # their configured value isn't looked at
        out = out.withColumn(f"_{side}", F.when(~literal, F.col(f"_{side}"))).withColumn(side, F.when(unused, None).when(literal, units.parsed(arg(side), "double")).otherwise(F.col(side)))
    png = F.col("tile_format") == "png"
    alpha = lambda v: v.between(0, 1)
    add("mask_black", F.col("is_compressed"), "boolean")
    add("overlay_alpha", F.lit(OVERLAY_ALPHA), "double", alpha, laid)
    add("unmasked_alpha", F.when(laid, F.col("overlay_alpha")).otherwise(1.0), "double", alpha)
    add("masked_alpha", F.when(laid | F.col("is_compressed"), 0.0).otherwise(1.0), "double", alpha)
    # formats without an alpha channel are opaque
    for name, value in (("mask_black", F.lit(False)), ("overlay_alpha", F.lit(OVERLAY_ALPHA)), ("unmasked_alpha", F.lit(1.0)), ("masked_alpha", F.lit(1.0))):
        out = out.withColumn(name, F.when(png, F.col(name)).otherwise(value)).withColumn(f"_{name}", F.when(png, F.col(f"_{name}")).otherwise(value))
    choose("gamma_mode", F.lit("convert"), GAMMA_MODES)
    wishes = F.when(laid & arg("overlay_preferences").isNotNull(), F.filter(F.split(arg("overlay_preferences"), "\n"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    fine = F.forall(wishes, valid_preference)
    out = out.withColumn("overlay_preferences", F.when(fine, wishes).otherwise(F.raise_error(F.lit("an overlay preference isn't TYPE:NAME=VALUE")).cast("array<string>")))
    changed.append(F.size("overlay_preferences") > 0)
    for name in ("force", "skip_cached", "do_monolithic", "no_dzi", "force_custom"):
        out = out.withColumn(name, units.parsed(arg(name), "boolean", None, F.lit(False)))
    wait = F.lower(F.trim(arg("max_wait_sec"))).try_cast("int")
    out = out.withColumn("max_wait_sec", units.parsed(arg("max_wait_sec"), "int", wait >= 0, F.lit(-1)))
    custom = F.col("force_custom")
    for differs in changed:
        custom = custom | differs
    own = [c for c in out.columns if c.startswith("_")]
    return out.withColumn("nominal", ~custom).drop(*own)


#: Types of what a request's body may hold besides texts.
NUMBERS = ("tile_size", "tile_overlap", "thumb_height", "max_wait_sec", "overlay_alpha", "unmasked_alpha", "masked_alpha")
FLAGS = ("mask_black", "force", "do_monolithic", "no_dzi", "force_custom")
TEXTS = ("rdr_url", "rdr_type", "product_type", "tile_format", "gamma_mode", "stretch_type")
EITHER = ("stretch_low", "stretch_high")


def args_of_body(body: Column) -> Column:
    """A request's JSON body as ``args``: known fields as texts, nulls left out. A body without rdr_url, or a field of
    another type than its own, raises; overlay_preferences is a list of texts and comes as lines."""
    value = lambda name: F.get_json_object(body, f"$.{name}")
    quoted = lambda name: body.rlike(rf'"{name}"\s*:\s*"')

    def checked(name: str, fits: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{name} has the wrong type: "), value(name))).cast("string")
        return F.when(value(name).isNull(), None).when(fits, value(name)).otherwise(wrong)

    fields = {n: checked(n, quoted(n)) for n in TEXTS} | {n: checked(n, ~quoted(n) & value(n).try_cast("double").isNotNull()) for n in NUMBERS}
    fields |= {n: checked(n, ~quoted(n) & value(n).isin("true", "false")) for n in FLAGS}
    fields |= {n: checked(n, quoted(n) | value(n).try_cast("double").isNotNull()) for n in EITHER}
    wishes = F.from_json(value("overlay_preferences"), "array<string>")
    fields["overlay_preferences"] = F.when(value("overlay_preferences").isNotNull(), F.array_join(wishes, "\n"))
    missing = F.raise_error(F.lit("a body must have rdr_url")).cast("string")
    fields["rdr_url"] = F.when(body.rlike(r'"rdr_url"\s*:'), fields["rdr_url"]).otherwise(missing)
    pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[c.cast("string") for c in fields.values()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


#: Names of a request's query arguments and of the fields that they are.
QUERY_NAMES = {
    "image": "rdr_url", "rdr": "rdr_type", "format": "tile_format", "stretchType": "stretch_type", "extremaStretch": "extrema_stretch", "stretchLow": "stretch_low", "stretchHigh": "stretch_high",
    "tileSize": "tile_size", "tileOverlap": "tile_overlap", "thumbHeight": "thumb_height", "maskBlack": "mask_black", "overlayAlpha": "overlay_alpha", "unmaskedAlpha": "unmasked_alpha",
    "maskedAlpha": "masked_alpha", "gammaMode": "gamma_mode", "force": "force", "maxWaitSec": "max_wait_sec", "doMonolithic": "do_monolithic", "noDZI": "no_dzi", "forceCustom": "force_custom",
}


def args_of_query(query: Column) -> Column:
    """A request's query string (name=value&...) as ``args``: the service's own names, percent-encoded; of a name that
    comes again the first value counts, overlayPreference may come many times and comes as lines; others are left out. A
    request without an image raises."""
    decoded = lambda text: F.url_decode(text)
    pairs = F.transform(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != ""), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("name"), F.when(p.contains("="), decoded(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("value")))

    def told(pairs: Column) -> Column:
        first = lambda name: F.get(F.filter(pairs, lambda p: p["name"] == name), F.lit(0))["value"]
        fields = {own: first(name) for name, own in QUERY_NAMES.items()}
        fields["rdr_url"] = F.coalesce(fields["rdr_url"], F.raise_error(F.lit("missing image parameter")).cast("string"))
        wishes = F.filter(pairs, lambda p: p["name"] == "overlayPreference")
        fields["overlay_preferences"] = F.when(F.size(wishes) > 0, F.array_join(F.transform(wishes, lambda p: p["value"]), "\n"))
        args = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[c.cast("string") for c in fields.values()]))
        return F.map_filter(args, lambda _, v: v.isNotNull())

    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  (names a value, so that it is made once)
    return once(once(pairs, told), with_plain_names)


def configured(settings: dict[str, str], prefix: str = "TILES_") -> Config:
    """The configuration that settings tell (environment variables or a session's, upper-case, with ``prefix``): patterns
    are parted by commas, other fields are values."""
    told = {k[len(prefix) :].lower(): v for k, v in settings.items() if k.startswith(prefix)}
    lists = {n: tuple(p.strip() for p in told.pop(n).split(",") if p.strip()) for n in Config.__dataclass_fields__ if n not in ("values", "rdr_types") and n in told}
    if "rdr_types" in told:  # TYPE=IMAGE_TYPE, parted by commas
        lists["rdr_types"] = dict(x.strip().split("=", 1) for x in told.pop("rdr_types").split(",") if "=" in x)
    return Config(values=told, **lists)
