"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000


def floor_to(ms: Column, unit: int) -> Column:
    """The start of the unit that holds ``ms``; floors negative times too."""
    return (F.floor(ms / F.lit(float(unit))) * unit).cast("long")


def ceil_hour(ms: Column) -> Column:
    """The hour at or after ``ms``; milliseconds within a second are dropped first."""
    return (F.ceil(F.floor(ms / F.lit(1000.0)) / F.lit(3600.0)) * HOUR).cast("long")


def round2(x: Column) -> Column:
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def round4(x: Column) -> Column:
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


def float_text(x: Column) -> Column:
    """A double of up to 4 decimals as plain digits where a cast would give an exponent."""
    return F.when((F.abs(x) < 0.001) & (x != 0), F.format_string("%.4f", x)).when(F.abs(x) >= 1e7, F.format_string("%.1f", x)).otherwise(x.cast("string"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def salted_hash(value: Column, purpose: str, salt_hex: str) -> Column:
    """SHA-256 of salt, purpose, a zero byte and the value."""
    return F.sha2(F.concat(F.unhex(F.lit(salt_hex)), F.encode(F.lit(purpose), "UTF-8"), F.unhex(F.lit("00")), F.encode(value, "UTF-8")), 256)


def domain_hash(url: Column, salt_hex: str) -> Column:
    """The salted hash of a url's authority; empty where there is none."""
    host = url_authority(url)
    return F.when(host != "", salted_hash(host, "url", salt_hex)).otherwise(F.lit(""))


def same_digest(a: Column, b: Column) -> Column:
    """Whether two hex digests agree, in either case of letters."""
    return F.lower(a) == F.lower(b)


def url_authority(url: Column) -> Column:
    """User, host and port of a url as written; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit(""))


def trackable_url(url: Column) -> Column:
    """Not empty and no page of the browser itself."""
    inner = [~url.startswith(p) for p in ("about:", "chrome:", "edge:", "data:")]
    return F.coalesce((url != "") & inner[0] & inner[1] & inner[2] & inner[3], F.lit(False))


def extension(name: Column) -> Column:
    """Lower-case suffix without the dot; none for names that only begin with one."""
    return F.lower(F.regexp_extract(name, r"[^/\\.][^/\\]*\.([^./\\]+)$", 1))


def seconds_of(text: Column, default: float) -> Column:
    """Seconds of texts such as ``7.0s`` or ``128 or 1.5s``."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*s\s*$", 1), F.lit("")).cast("double"), F.lit(default))


def age_text(age_ms: Column) -> Column:
    """``5s ago``, ``3m ago``, ``2h ago`` or ``4d ago``."""
    s = F.floor(age_ms / F.lit(1000.0)).cast("long")
    steps = ((60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"))
    out = F.concat(F.expr("0") + F.floor(s / 86400).cast("long"), F.lit("d ago"))
    for below, unit, mark in reversed(steps):
        out = F.when(s < below, F.concat(F.floor(s / unit).cast("long").cast("string"), F.lit(f"{mark} ago"))).otherwise(out)
    return out


def iso_utc(ms: Column) -> Column:
    """ISO 8601 text of a time in UTC, whatever the session's zone; microseconds only where there are any."""
    second = F.floor(ms / F.lit(1000.0)).cast("long")
    left, part = F.pmod(second, F.lit(86400)), F.pmod(ms, F.lit(1000))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(second / F.lit(86400.0)).cast("int")).cast("string")
    fraction = F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 3, "0"), F.lit("000"))).otherwise("")
    return F.concat(day, F.lit("T"), two(left / 3600), F.lit(":"), two(left % 3600 / 60), F.lit(":"), two(left % 60), fraction, F.lit("+00:00"))


def hour_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd-HH")


def valid_ulid(text: Column) -> Column:
    return text.rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")
