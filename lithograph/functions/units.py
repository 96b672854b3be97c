"""Sizes, durations and other small texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bytes(s: Column) -> Column:
    """'16m', '2g', '512' as bytes; 'auto' and '' are null; anything else raises."""
    t = F.lower(F.trim(s))
    number, unit = F.regexp_extract(t, r"^([0-9]+)[kmg]?b?$", 1), F.regexp_extract(t, r"^[0-9]+([kmg]?)b?$", 1)
    scale = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when((t == "") | (t == "auto"), None).when(number == "", F.raise_error(F.concat(F.lit("not a size: "), s)).cast("long")).otherwise(number.cast("long") * scale.cast("long"))


def parse_seconds(s: Column) -> Column:
    """'30s', '5m', '1h', '7' as seconds; 'auto' and '' are null; anything else raises."""
    t = F.lower(F.trim(s))
    number, unit = F.regexp_extract(t, r"^([0-9]+)[smh]?$", 1), F.regexp_extract(t, r"^[0-9]+([smh]?)$", 1)
    scale = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)
    return F.when((t == "") | (t == "auto"), None).when(number == "", F.raise_error(F.concat(F.lit("not a duration: "), s)).cast("long")).otherwise(number.cast("long") * scale.cast("long"))


def kmg(n: Column) -> Column:
    """Bytes with the largest unit that fits and one decimal (half up); below 1024 the number alone."""
    shown = lambda unit, size: F.concat(F.format_string("%.1f", n / size), F.lit(unit))
    return F.when(n < 1 << 10, n.cast("string")).when(n < 1 << 20, shown("k", 1 << 10)).when(n < 1 << 30, shown("M", 1 << 20)).otherwise(shown("G", 1 << 30))


def hms(ms: Column) -> Column:
    """Milliseconds as 12ms, 3.250s, 4m5s or 2h0m7s; 0 is 0s."""
    s = F.floor(ms / 1000).cast("long")
    part = lambda c: c.cast("string")
    return (
        F.when(ms == 0, "0s").when(ms < 1000, F.concat(part(ms.cast("long")), F.lit("ms"))).when(ms < 60_000, F.concat(F.format_string("%.3f", ms / 1000), F.lit("s")))
        .when(ms < 3_600_000, F.concat(part(F.floor(s / 60)), F.lit("m"), part(s % 60), F.lit("s")))
        .otherwise(F.concat(part(F.floor(s / 3600)), F.lit("h"), part(F.floor(s / 60) % 60), F.lit("m"), part(s % 60), F.lit("s")))
    )


def parsed(s: Column, kind: str, valid: Column | None = None, default: Column | None = None) -> Column:
    """Text as int, bigint, float, double or boolean: '', 'auto' and what ``valid`` rejects give the default; text that is
    no such value raises. Of booleans, only 'true' is true, and all other text is false."""
    t = F.lower(F.trim(s))
    value = t == "true" if kind == "boolean" else t.try_cast(kind)
    unknown = F.raise_error(F.concat(F.lit(f"not a {kind}: "), s)).cast(kind)
    given = F.when(s.isNull() | (t == "") | (t == "auto"), F.lit(None).cast(kind)).when(value.isNull(), unknown).otherwise(value)
    if valid is not None:
        given = F.when(valid, given)
    return given if default is None else F.coalesce(given, default.cast(kind))


def one_of(s: Column, names: tuple[str, ...], default: str | None = None) -> Column:
    """Text as one of ``names``, case aside: '' and 'auto' give the default; other text raises."""
    t = F.lower(F.trim(s))
    unknown = F.raise_error(F.concat(F.lit(f"not one of {', '.join(names)}: "), s)).cast("string")
    return F.when(s.isNull() | (t == "") | (t == "auto"), F.lit(default)).when(t.isin(*names), t).otherwise(unknown)


def iso_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'")


def trimmed(s: Column, depth: int = 4) -> Column:
    """Without white space, quotes and braces around, nested up to ``depth``."""
    for _ in range(depth):
        s = F.regexp_replace(s, r"^[\s\"'(){}\[\]]+|[\s\"'(){}\[\]]+$", "")
    return s


def defaulted(value: Column, valid: Column, default: Column) -> Column:
    """The value where it is valid, else the default."""
    return F.coalesce(F.when(valid, value), default)


def label_gamma(s: Column) -> Column:
    """A label's gamma: 'srgb' is 0.45, a number is its inverse, anything else unknown."""
    return F.when(F.lower(F.trim(s)) == "srgb", 0.45).otherwise(1 / F.nullif(s.try_cast("double"), F.lit(0.0)))


def significant_bits(mask: Column) -> Column:
    """Bits of a sample mask like 2#0000111111111111#."""
    return F.nullif(F.length(F.regexp_extract(mask, r"^2#0*(1+)#$", 1)), F.lit(0))
