"""Products and their derived ones, and the state of cached work, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sol_of(product: Column, mosaic: Column) -> Column:
    """struct(sol, sol_doy, year) from a product ID: four characters from place 5 (8 for mosaics).

    A letter first or last marks a day of year and tells the year, counted from 2017 for A.
    """
    part = F.when(mosaic, F.substring(product, 8, 4)).otherwise(F.substring(product, 5, 4))
    letter = F.upper(F.regexp_extract(part, "^([A-Za-z])[0-9]{3}$|^[0-9]{3}([A-Za-z])$", 1))
    letter = F.when(letter != "", letter).otherwise(F.upper(F.regexp_extract(part, "^([A-Za-z])[0-9]{3}$|^[0-9]{3}([A-Za-z])$", 2)))
    doy = letter != ""
    sol = F.regexp_extract(part, "([0-9]{3,4})", 1).try_cast("int")
    return F.struct(F.when(doy | part.rlike("^[0-9]{4}$"), sol).alias("sol"), doy.alias("sol_doy"), F.when(doy, F.ascii(letter) - 65 + 2017).alias("year"))


def sol_of_number(number: Column) -> Column:
    """struct(sol, sol_doy, year) of a four-digit number, as in the other mission's names: from 3000 on, the first digit
    tells the year, counted from 2023 for 3, and the rest is a day of year."""
    n = number.try_cast("int")
    doy = n >= 3000
    return F.struct(F.when(doy, n % 1000).otherwise(n).alias("sol"), doy.alias("sol_doy"), F.when(doy, F.floor(n / 1000).cast("int") - 3 + 2023).alias("year"))


MISSIONS = {"M2020": "M20"}


def mission_name(name: Column) -> Column:
    """A mission's name, upper-case, by its one known alias; null for missions that aren't supported."""
    upper = F.upper(F.trim(name))
    for alias, known in MISSIONS.items():
        upper = F.when(upper == alias, known).otherwise(upper)
    return F.when(upper.isin("M20", "CADRE", "MSL"), upper)


#: What a catalog entry tells of a product, besides its sol.
FINDER_FIELDS = (
    "finder_type instrument_id instrument instrument_category product_type group_id overlay_id is_source_product overlayable eye_type size_type projection "
    "geometry stage version sclk image_type description supplemental_description"
).split()


def finder_metadata(products: DataFrame, mission: str, what: str = "rdr") -> DataFrame:
    """path and entry: the JSON of a product's catalog entry, from its path, filename and FINDER_FIELDS (as far as there).

    Sols stand in the product's name by its mission's rule: at place 5 (8 for mosaics), or as the column
    ``cycle_or_ydoy`` of the mission that numbers wake cycles; other missions have sol -1.
    """
    if mission == "M20":
        sol = sol_of(F.col("filename"), F.col("finder_type") == "Mosaic")
    elif mission == "CADRE":
        sol = sol_of_number(F.col("cycle_or_ydoy"))
    else:
        sol = F.struct(F.lit(-1).alias("sol"), F.lit(False).alias("sol_doy"), F.lit(None).cast("int").alias("year"))
    fields = [F.coalesce(F.col("sclk"), F.lit("NULL")).alias("sclk") if f == "sclk" else F.col(f) for f in FINDER_FIELDS if f in products.columns]
    more = [F.col("cycle_or_ydoy").try_cast("int").alias("wake_cycle_or_ydoy")] if mission == "CADRE" else []
    made = products.withColumn("_sol", sol)
    metadata = F.struct(*fields, *more, F.col("_sol.sol").alias("sol"), F.col("_sol.sol_doy").alias("sol_doy"), F.col("_sol.year").alias("year"))
    return made.select("path", F.to_json(F.struct(F.col("path").alias(what), metadata.alias("metadata"))).alias("entry"))


def products_of_sol(products: DataFrame, sol: int) -> DataFrame:
    """Products of one sol; sols below 0 aren't asked for."""
    if sol < 0:
        raise ValueError(f"sol {sol} is below 0")
    return products.where(F.col("sol") == sol)


def sol_range(paths: DataFrame, pattern: str = r"^[0-9]{5}$") -> DataFrame:
    """least and greatest number of the directories named by ``pattern``."""
    named = paths.where(F.col("dir").rlike(pattern))
    return named.agg(F.min(F.col("dir").cast("int")).alias("min_sol"), F.max(F.col("dir").cast("int")).alias("max_sol"))


def derived_products(source: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Sources with the sorted list of their derived products; an empty list without any."""
    listed = derived.groupBy(key).agg(F.sort_array(F.collect_list("product")).alias("products"))
    return source.join(listed, key, "left").withColumn("products", F.coalesce("products", F.array().cast("array<long>")))


def typed_products(products: DataFrame, types: DataFrame) -> DataFrame:
    """Products with image_type and overlayable of their type; unknown types are their own image type.

    ``types`` is a small table with a row per product type; Spark broadcasts it if it is small.
    """
    return products.join(types, "product_type", "left").select(products["*"], F.coalesce("image_type", "product_type").alias("image_type"), F.coalesce("overlayable", F.lit(False)).alias("overlayable"))


def uncached(requests: DataFrame, cache: DataFrame, key: str = "cache_hash") -> DataFrame:
    """Requests, one per key, whose work isn't done."""
    return requests.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def existing(requests: DataFrame, sources: DataFrame, key: str = "url") -> DataFrame:
    """Requests whose source exists and isn't empty."""
    return requests.join(sources.where("length > 0").select(key), key, "left_semi")


def latest_events(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key, by one map-side aggregate."""
    rest = [c for c in events.columns if c != key and c not in order]
    best = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e"))
    return best.select(key, *[F.col(f"e.{c}").alias(c) for c in (*order, *rest)])


def cache_state(requests: DataFrame, tasks: DataFrame, now: Column, zombie_seconds: int = 3600) -> DataFrame:
    """cache_hash, state and is_cached of each request's work.

    ``tasks``: cache_hash, finished (its metadata are there), error, started, progressed (last sign of life, or null),
    source_modified and, to tell changed sources, started_etag and source_etag. Finished work is complete whatever else is
    there; then errors count, then work that wasn't started. Work under way is a zombie after ``zombie_seconds`` (0: never)
    without a sign, stale if its source is gone or newer or has another etag, else running, which counts as cached.
    """
    joined = requests.join(tasks, "cache_hash", "left")
    silent = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("progressed", "started"))
    zombie = (silent > zombie_seconds) if zombie_seconds > 0 else F.lit(False)
    changed = F.col("source_modified").isNull() | (F.col("started") < F.col("source_modified"))
    if {"started_etag", "source_etag"} <= set(tasks.columns):
        changed = changed | ~F.col("started_etag").eqNullSafe(F.col("source_etag"))
    state = (
        F.when(F.coalesce("finished", F.lit(False)), "complete").when(F.coalesce("error", F.lit(False)), "errored").when(F.col("started").isNull(), "missing")
        .when(zombie, "zombie").when(changed, "stale").otherwise("running")
    )
    return joined.select("cache_hash", state.alias("state")).withColumn("is_cached", F.col("state").isin("complete", "running"))


def liveness(tasks: DataFrame, now: Column, zombie_seconds: int = 3600) -> DataFrame:
    """live and zombie: how many unfinished tasks (progressed) gave a sign within ``zombie_seconds``, and how many didn't."""
    silent = F.unix_timestamp(now) - F.unix_timestamp("progressed") > zombie_seconds
    return tasks.agg(F.count_if(~silent).alias("live"), F.count_if(silent).alias("zombie"))


def tile_sources(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """Tile requests (hash) with the source_url that their product's metadata (cache_hash, rdr_url) tell; null if unknown.

    Custom specs are looked up below their source's hash.
    """
    known = metadata.select(F.col("cache_hash").alias("_hash"), F.col("rdr_url").alias("source_url"))
    return requests.join(known, requests["hash"] == known["_hash"], "left").drop("_hash")


def outcomes(deliveries: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch of deliveries (action, outcome): events, and how many were processed, cancelled, rejected and forwarded."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return deliveries.groupBy(batch).agg(F.count(F.lit(1)).alias("events"), *map(count, ("processed", "cancelled", "rejected", "forwarded", "retry")))


def http_status(error: Column) -> Column:
    """Status of a request by the kind of what went wrong; null is none."""
    return (
        F.when(error.isNull(), 200).when(error.isin("bad_argument", "unsupported", "oversize", "unsafe_url"), 400).when(error.isin("not_found", "no_such_key"), 404)
        .when(error == "forbidden", 403).when(error.isin("still_running", "cancelled"), 202).when(error == "overloaded", 503).otherwise(500)
    )


def most_tasks(setting: str, memory: int, disk: int, page_bytes: int, memory_pages: int, disk_pages: int, overhead: int = 100 << 20, default: int = 32) -> int:
    """How many tasks may run at once: 'auto', a number (negative: no limit), or a percentage of what memory and disk hold."""
    text = setting.strip().lower()
    if text in ("", "auto"):
        return default
    if not text.endswith("%"):
        return int(text)
    share, most = float(text[:-1]) / 100, default
    if page_bytes > 0:
        if memory > 0 and memory_pages > 0:
            most = max(1, int(share * memory / (page_bytes * memory_pages + overhead)))
        if disk > 0 and disk_pages > 0:
            most = max(1, min(most, int(share * disk / (page_bytes * disk_pages))))
    return most


def read_stats(reads: DataFrame) -> DataFrame:
    """Per image of its reads (image_id, x, y, w, h): how many, how often each rectangle was read (least, most), and the
    extent of all."""
    each = reads.groupBy("image_id", "x", "y", "w", "h").agg(F.count(F.lit(1)).alias("n"))
    ends = [F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom")]
    return each.groupBy("image_id").agg(F.sum("n").alias("reads"), F.count(F.lit(1)).alias("rectangles"), F.min("n").alias("least"), F.max("n").alias("most"), *ends)


def transfers(reads: DataFrame, page: str = "page") -> DataFrame:
    """How often each page was moved, most often first."""
    return reads.groupBy(page).agg(F.count(F.lit(1)).alias("transfers")).orderBy(F.desc("transfers"), page)


def transfer_stats(reads: DataFrame, owner: str, page: str = "page") -> DataFrame:
    """Per owner: the most transfers of a page, pages moved once, pages."""
    each = reads.groupBy(owner, page).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(owner).agg(F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("once"), F.count(F.lit(1)).alias("pages"))


def any_below(listing: DataFrame, prefix: str) -> DataFrame:
    """One row if some path of a listing begins with ``prefix``, else none."""
    return listing.where(F.col("path").startswith(prefix)).select("path").limit(1)


def removable(listing: DataFrame, folder: str, kept: tuple[str, ...] = (".pid",)) -> DataFrame:
    """What of a listing lies below ``folder`` and doesn't end with one of ``kept``, in the order of paths."""
    ends = F.lit(False)
    for end in kept:
        ends = ends | F.col("path").endswith(end)
    return listing.where(F.col("path").startswith(folder) & ~ends).orderBy("path")


def power_below(v: Column) -> Column:
    """The largest power of two below v; v itself up to 1."""
    return F.when(v <= 1, v.cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2), F.length(F.bin(v.cast("long") - 1)) - 1).cast("long"))


def admitted(requests: DataFrame, budget: int, queue: list[str], order: list[str]) -> DataFrame:
    """Requests with ``admitted``: whether the costs up to and with theirs, in their queue's order, fit the budget."""
    w = Window.partitionBy(*queue).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("used", F.sum("cost").over(w)).withColumn("admitted", F.col("used") <= budget)


def retry_gate(deliveries: DataFrame, key: list[str], order: list[str], most: int = 3) -> DataFrame:
    """Deliveries with their number and route: process, or fail_queue from ``most`` on."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return deliveries.withColumn("receive_count", number).withColumn("route", F.when(F.col("receive_count") >= most, "fail_queue").otherwise("process"))


def delete_batches(keys: DataFrame, group: str, key: str, size: int = 1000, digits: int = 2) -> DataFrame:
    """Keys with their batch (part, number) within a group; no batch has more than ``size``.

    Keys are first parted by ``digits`` hex digits of their hash, so a group is numbered in 16^digits tasks.
    """
    parted = keys.withColumn("part", F.substring(F.sha1(F.col(key).cast("string")), 1, digits))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(key)) - 1
    return parted.withColumn("number", F.floor(place / size).cast("int"))


def progress(tasks: DataFrame) -> DataFrame:
    """Percent done of tasks: histogram_steps, histogram_expected, extrema_steps, extrema_expected, tiles_done,
    tiles_expected, done.

    The histogram and the extrema weigh 10 each where they are expected, tiles the rest; until the first tile is there,
    the step under way decides alone.
    """
    none = F.col("tiles_done") == 0
    base, early = F.lit(0.0), F.lit(None).cast("double")
    for name in ("histogram", "extrema"):
        steps, expected = F.col(f"{name}_steps"), F.col(f"{name}_expected")
        under_way = early.isNull() & (expected > 0) & none & (steps < expected)
        early = F.when(under_way, base + 10.0 * steps / expected).otherwise(early)
        base = base + F.when(expected > 0, 10.0).otherwise(0.0)
    tiles = base + (100 - base) * F.least(F.lit(1.0), F.col("tiles_done") / F.col("tiles_expected"))
    percent = F.when(F.col("done"), 100.0).when(early.isNotNull(), early).when(none | (F.col("tiles_expected") < 1), base).otherwise(tiles)
    return tasks.withColumn("percent", percent)


def page_returns(accesses: DataFrame, owner: str = "owner", order: str = "seq") -> DataFrame:
    """Accesses (owner, seq, page) with ``gap``: how many accesses of the same owner lie between this and the page's last
    one (null for the first). A cache of as many pages as the gap is long surely still holds the page."""
    numbered = accesses.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy(order)))
    before = F.lag("_n").over(Window.partitionBy(owner, "page").orderBy("_n"))
    return numbered.withColumn("gap", F.col("_n") - before - 1).drop("_n")
