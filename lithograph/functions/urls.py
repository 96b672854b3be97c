"""URLs and paths as column expressions: parts, extensions, policy, canonical names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by kind, host names that are never fetched.
PLAIN_EXTS = ("png", "jpg", "jpeg", "tif", "tiff")
PDS_EXTS = ("img", "vic")
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "instance-data")
#: Top domains that by their standard name no public host.
NOWHERE = ("localhost", "invalid", "test", "local")


def path_part(url: Column) -> Column:
    """What stands before any query or fragment."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def last_segment(url: Column) -> Column:
    return F.regexp_extract(path_part(url), r"([^/\\]*)$", 1)


def filename(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def ext(url: Column) -> Column:
    """Lower-case extension of the last path segment, or ''."""
    return F.lower(F.regexp_extract(last_segment(url), r"[.]([^.]+)$", 1))


def has_ext(url: Column, exts: tuple[str, ...]) -> Column:
    return ext(url).isin(*exts)


def set_ext(url: Column, new: str) -> Column:
    """Replace or append the extension of the last path segment; query and fragment stay."""
    path = path_part(url)
    return F.concat(F.regexp_replace(path, r"[.][^./\\]*$", ""), F.lit("." + new), F.substr(url, F.length(path) + 1))


def strip_file_scheme(path: Column) -> Column:
    return F.regexp_replace(path, r"^(?i)file://", "")


def any_match(s: Column, patterns: list[str]) -> Column:
    """Whether some pattern matches all of ``s``."""
    return s.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$") if patterns else F.lit(False)


def host(url: Column) -> Column:
    """Lower-case host of an http or https URL, without user, port and trailing dots; null for others."""
    authority = F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.when(authority != "", F.rtrim(F.lower(bare), F.lit(".")))


def is_http(url: Column) -> Column:
    return url.rlike(r"^(?i:https?)://")


def is_s3(url: Column) -> Column:
    """s3 scheme, or an http host with an s3 label ahead of amazonaws.com."""
    return url.rlike(r"^(?i:s3)://") | F.coalesce(host(url).rlike(r"(^|[.])s3([.-][a-z0-9-]+)*[.]amazonaws[.]com([.]cn)?$"), F.lit(False))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is named for it, and so planned and made once however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def safe_ipv4(address: Column) -> Column:
    """Whether a dotted address is public; null if it isn't one."""

    def judged(parts: Column) -> Column:
        a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
        private = (
            a.isin(0, 10, 127) | (a >= 224) | (a == 100) & b.between(64, 127) | (a == 169) & (b == 254) | (a == 172) & b.between(16, 31)
            | (a == 192) & (b == 0) & (c == 0) | (a == 192) & (b == 168) | (a == 198) & b.isin(18, 19)
        )
        return F.when(F.forall(parts, lambda x: x <= 255), ~private)

    parts = F.transform(F.split(address, "[.]"), lambda x: x.cast("int"))
    return F.when(address.rlike(r"^([0-9]{1,3}[.]){3}[0-9]{1,3}$"), once(parts, judged))


def ipv6_groups(address: Column) -> Column:
    """The eight numbers of an IPv6 address (a dotted end counts as two); null if it isn't one."""

    def without_dots(text: Column) -> Column:
        dotted = F.regexp_extract(text, r":([0-9]{1,3}(?:[.][0-9]{1,3}){3})$", 1)
        byte = lambda parts, i: F.get(parts, F.lit(i))
        pair = lambda parts, i: F.lower(F.hex(byte(parts, i) * 256 + byte(parts, i + 1)))
        end = once(F.transform(F.split(dotted, "[.]"), lambda x: x.try_cast("int")), lambda parts: F.when(F.forall(parts, lambda x: x <= 255), F.concat(pair(parts, 0), F.lit(":"), pair(parts, 2))))
        return F.when(dotted == "", text).otherwise(F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), end))

    def filled(halves: Column) -> Column:
        given = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

        def joined(sides: Column) -> Column:
            missing = 8 - F.size(sides["l"]) - F.size(sides["r"])
            return F.when(F.size(halves) == 1, sides["l"]).when((F.size(halves) == 2) & (missing > 0), F.concat(sides["l"], F.array_repeat(F.lit("0"), missing), sides["r"]))

        return once(F.struct(given(F.get(halves, F.lit(0))).alias("l"), given(F.get(halves, F.lit(1))).alias("r")), joined)

    def numbers(whole: Column) -> Column:
        valid = (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(F.coalesce(valid, F.lit(False)), F.transform(whole, lambda g: F.conv(g, 16, 10).cast("int")))

    return once(once(F.split(once(F.lower(address), without_dots), "::", -1), filled), numbers)


def safe_ipv6(address: Column) -> Column:
    """Whether an IPv6 address (without brackets) is public; null if it isn't one.

    Addresses that hold an IPv4 one (mapped, compatible, the public NAT64 prefix, 6to4) are as safe as that; tunnels that
    hide it and local NAT64 prefixes aren't.
    """

    def judged(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        zeros = lambda low, high: F.forall(F.slice(g, low + 1, high - low), lambda x: x == 0)
        four = lambda i: safe_ipv4(F.concat_ws(".", *[x.cast("string") for k in (i, i + 1) for x in (F.shiftright(at(k), 8), at(k).bitwiseAND(F.lit(255)))]))
        within = lambda bits, value: at(0).bitwiseAND(F.lit(bits)) == value
        return (
            F.when(zeros(0, 7) & at(7).isin(0, 1), False)  # unspecified and loopback
            .when(within(0xFFC0, 0xFE80) | within(0xFFC0, 0xFEC0) | within(0xFF00, 0xFF00) | within(0xFE00, 0xFC00), False)  # link, site, many, unique local
            .when((at(0) == 0x2001) & (at(1) == 0), False).when((at(0) == 0x64) & (at(1) == 0xFF9B) & (at(2) == 1), False)
            .when(zeros(0, 5) & at(5).isin(0, 0xFFFF), four(6)).when((at(0) == 0x64) & (at(1) == 0xFF9B) & zeros(2, 6), four(6))
            .when(at(0) == 0x2002, four(1)).otherwise(True)
        )

    return once(ipv6_groups(address), lambda groups: F.when(groups.isNotNull(), judged(groups)))


def safe_name(name: Column) -> Column:
    """Whether a host name isn't one that is never fetched; numbers that aren't dotted addresses and odd characters aren't safe.

    Names aren't resolved here: whoever fetches must check the addresses too.
    """
    top = F.substring_index(name, ".", -1)
    shaped = name.rlike(r"^[a-z0-9]([a-z0-9_-]*[a-z0-9])?([.][a-z0-9]([a-z0-9_-]*[a-z0-9])?)*$")
    return shaped & ~(name.isin(*BLOCKED_HOSTS) | top.isin(*NOWHERE) | name.rlike(r"^(0x[0-9a-f]+|[0-9]+)([.](0x[0-9a-f]+|[0-9]+))*$"))


def safe_host(name: Column) -> Column:
    """Whether a host (an address or a name, IPv6 in brackets) may be fetched from."""

    def judged(name: Column) -> Column:
        inner = F.regexp_extract(name, r"^\[(.*)\]$", 1)
        return F.coalesce(F.when(name.startswith("["), F.coalesce(safe_ipv6(inner), F.lit(False))).otherwise(F.coalesce(safe_ipv4(name), safe_name(name))), F.lit(False))

    return once(name, judged)


def policy(
    url: Column, whitelist: list[str], ignored_subdirs: list[str], exceptions: list[str], unlinearized: list[str] | None = None, ignored_exts: tuple[str, ...] = ()
) -> Column:
    """First reason to reject a source URL, or 'ok'; rules in order, the first that applies decides.

    ``exceptions``: patterns of products taken whatever their class and extension. ``unlinearized``: patterns of a product
    class that isn't tiled.
    """
    local = ~is_http(url) & ~is_s3(url)
    subdirs = F.lit(False)
    for d in ignored_subdirs:
        subdirs = subdirs | url.contains(f"/{d}/")
    plain_http = is_http(url) & ~is_s3(url)
    return (
        F.when(url.contains("../"), "dotdot")
        .when(plain_http & ~safe_host(host(url)), "unsafe_host")
        .when(plain_http & F.lit(not whitelist), "not_whitelisted")
        .when(F.lit(bool(whitelist)) & ~any_match(url, whitelist), "not_whitelisted")
        .when(local & (strip_file_scheme(url).startswith("/") | url.contains("\0")), "absolute_path")
        .when(subdirs, "ignored_subdir")
        .when(any_match(url, exceptions), "ok")
        .when(any_match(url, unlinearized or []), "product_class")
        .when(has_ext(url, ignored_exts) if ignored_exts else F.lit(False), "ignored_ext")
        .when(~has_ext(url, PLAIN_EXTS + PDS_EXTS), "unsupported_ext")
        .otherwise("ok")
    )


def s3_url(url: Column) -> Column:
    """s3://bucket/key of an S3 http URL (bucket in the host or first in the path); other URLs stay."""
    bucket_in_host = F.regexp_extract(url, r"^(?i:https?)://([^/]+?)[.]s3[.-][^/]*amazonaws[.]com", 1)
    path = F.regexp_extract(path_part(url), r"^(?i:https?)://[^/]+/(.*)$", 1)
    full = F.when(bucket_in_host != "", F.concat(F.lit("s3://"), bucket_in_host, F.lit("/"), path)).otherwise(F.concat(F.lit("s3://"), path))
    return F.when(is_s3(url) & is_http(url), full).otherwise(url)


def cache_hash(url: Column) -> Column:
    """SHA-1 of the canonical URL: one extension for both PDS ones, S3 URLs as s3://, local paths as file://."""
    one = s3_url(F.when(has_ext(url, PDS_EXTS), set_ext(url, "IMG")).otherwise(url))
    return F.sha1(F.when(is_s3(one) | is_http(one) | one.rlike("^(?i)file://"), one).otherwise(F.concat(F.lit("file://"), one)))


def custom_hash(url: Column, spec_json: Column, nominal: Column) -> Column:
    """A nominal spec has its source's hash; another one has a place of its own below it."""
    return F.when(nominal, cache_hash(url)).otherwise(F.concat(cache_hash(url), F.lit("/cfg/"), F.sha1(spec_json)))


def tile_request(path: Column) -> dict[str, Column]:
    """Parts of /HASH/[PROXY_proxy_]image_files/LEVEL/COL_ROW.ext."""
    pattern = r"^/([0-9a-f]{40}(?:/cfg/[0-9a-f]{40})?)/(?:([a-z0-9]+)_proxy_)?image_files/([0-9]+)/([0-9]+)_([0-9]+)[.]([a-z]+)$"
    return {name: F.nullif(F.regexp_extract(path, pattern, i), F.lit("")) for i, name in enumerate(("hash", "proxy", "level", "col", "row", "ext"), 1)}


def mime_type(fmt: Column) -> Column:
    f = F.lower(fmt)
    return F.when(f.isin("jpg", "jpeg"), "image/jpeg").when(f.isin("tif", "tiff"), "image/tiff").when(f == "png", "image/png")


def s3_key_decoded(key: Column) -> Column:
    """Keys of notifications: + is a space, the rest is percent-encoded."""
    return F.url_decode(key)


def with_separator(path: Column, separator: str = "/") -> Column:
    """A folder's path with one separator at its end; null and '' stay ''."""
    bare = F.rtrim(F.coalesce(path, F.lit("")), F.lit(separator))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit(separator)))


def bucket_and_key(bucket: Column, key: Column) -> tuple[Column, Column]:
    """A bucket without scheme and without what follows its first slash, which goes ahead of the key."""
    bare = F.regexp_replace(bucket, "^[^/:]*://", "")
    rest = F.regexp_extract(bare, "^[^/]*/(.*)$", 1)
    return F.substring_index(bare, "/", 1), F.when(bare.contains("/"), F.concat(rest, F.lit("/"), key)).otherwise(key)


def s3_parts(url: Column) -> dict[str, Column]:
    """bucket, key, region, version_id and path_style of an S3 URL (s3:// or an http form); null where it tells none."""
    scheme = url.rlike("^(?i)s3://")
    label = r"^(?i:https?)://(?:([^/]+?)[.])?s3(?:[.-]([a-z0-9-]+))?[.]amazonaws[.]com(?:[.]cn)?(?:/([^?#]*))?"
    named, region, path = (F.regexp_extract(url, label, i) for i in (1, 2, 3))
    path_style = ~scheme & (named == "")
    bucket = F.when(scheme, F.regexp_extract(url, "^(?i:s3)://([^/?#]*)", 1)).when(path_style, F.regexp_extract(path, "^([^/]*)", 1)).otherwise(named)
    key = F.when(scheme, F.regexp_extract(url, "^(?i:s3)://[^/?#]*/([^?#]*)", 1)).when(path_style, F.regexp_extract(path, "^[^/]*/(.*)$", 1)).otherwise(path)
    version = F.regexp_extract(url, "[?&]versionId=([^&#]*)", 1)
    empty = lambda c: F.nullif(c, F.lit(""))
    return {"bucket": empty(bucket), "key": empty(F.url_decode(F.replace(key, F.lit("+"), F.lit("%2B")))), "region": F.when(~scheme, empty(region)), "version_id": empty(version), "path_style": path_style}


def queue_name(arn: Column) -> Column:
    """What stands behind the last : or / of an ARN; the ARN itself, marked, if nothing does."""
    name = F.regexp_extract(F.coalesce(arn, F.lit("")), "[:/]([^:/]+)$", 1)
    return F.when(name != "", name).otherwise(F.concat(F.lit("ARN="), F.coalesce(arn, F.lit("null"))))


def without_root(path: Column, root: str, absolute_root: str) -> Column:
    """A product's path below its catalog's root, which may be written in two ways."""
    for start in (root, absolute_root):
        path = F.when(path.startswith(start), F.substring(path, len(start) + 1, 1 << 30)).otherwise(path)
    return F.when(path.startswith("/"), F.substring(path, 2, 1 << 30)).otherwise(path)


def query_args(url: Column) -> Column:
    """The query of a URL as a map, percent-decoded; an empty map without one."""
    query = F.regexp_extract(url, r"[?]([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decoded = lambda c: F.url_decode(c)
    entry = lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.when(p.contains("="), F.substr(p, F.instr(p, F.lit("=")) + 1)).otherwise(F.lit(""))).alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


PROXIES = ("https", "http", "data", "s3", "tile")


def proxy_mode(asked: Column, tile_url: Column, data_url: Column, redirects: Column, multihop: Column) -> Column:
    """How a client reaches tiles: as asked if that is a known mode; else by the tile service, the data service or the
    store, as far as they are there, else by this service."""
    known = F.when(F.lower(asked).isin(*PROXIES), F.lower(asked))
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.coalesce(known, F.when(there(tile_url), "tile").when(redirects, F.when(there(data_url) & multihop, "data").otherwise("s3")).otherwise("https"))


def tiles_url(proxy: Column, hash_code: Column, tile_url: Column, data_url: Column, store: Column, service: Column, overrides: dict[str, str] | None = None) -> Column:
    """Where a descriptor tells that its tiles are. ``service``: URL of this service; ``store``: bucket and folder of the
    cache; ``overrides``: protocol, host, port (a number, or '' for none), path and suffix in place of the service's."""
    o = overrides or {}
    part = lambda name, pattern, i: F.lit(o[name]) if name in o else F.regexp_extract(service, pattern, i)
    whole = r"^[^:]+://([^/:]*)(:[0-9]+)?(/[^?#]*)?"
    protocol = F.lit(o["protocol"]) if "protocol" in o else F.when(proxy.startswith("http"), proxy).otherwise("https")
    port = F.lit(f":{o['port']}" if o.get("port") else "") if "port" in o else F.regexp_extract(service, whole, 2)
    suffix = F.lit(o["suffix"]) if "suffix" in o else F.concat(F.lit("/"), proxy, F.lit("_proxy_image_files"))
    own = F.concat(protocol, F.lit("://"), part("host", whole, 1), port, part("path", whole, 3), F.lit("/"), hash_code, suffix, F.lit("/"))
    return F.when(proxy == "tile", F.replace(tile_url, F.lit("/HASH/"), F.concat(F.lit("/"), hash_code, F.lit("/")))).when(proxy == "data", F.concat(data_url, store, F.lit("/"), hash_code, F.lit("/image_files/"))).otherwise(own)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A text with each {{NAME}} replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template
