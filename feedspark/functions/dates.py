"""Dates: normalization, formats, the two effective times, durations and calendar floors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedspark.functions.binding import let

# Units of a duration in milliseconds.
UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}
DURATION = r"^(\d+)\s*([mhd])$"

_WEEKDAY = r"(?i)^(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?\.?\s+"
_MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_ISO = (
    r"^\d{4}(-\d{2}(-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?"
    r"(\s?[Zz]|\s?[+-]\d{2}:?\d{2})?)?)?)?$"
)
# Zone names of RFC 822.
_ZONES = {
    "GMT": "+0000",
    "UTC": "+0000",
    "UT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}
_CLOCK = r"( \d{1,2}:\d{1,2}(:\d{1,2})?)?( [+-]\d{4})?$"
_SHAPES = [
    (r"^\d{1,2} [A-Za-z]{3} \d{4}" + _CLOCK, "d MMM yyyy[ H:m[:s]][ XX]"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}" + _CLOCK, "MMM d yyyy[ H:m[:s]][ XX]"),
    (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}" + _CLOCK, "yyyy/M/d[ H:m[:s]][ XX]"),
    (r"^\d{1,2}/\d{1,2}/\d{4}" + _CLOCK, "M/d/yyyy[ H:m[:s]][ XX]"),
]


def epoch() -> Column:
    return F.timestamp_seconds(F.lit(0))


def millis(ts: Column) -> Column:
    """Milliseconds are the precision of every stored time."""
    return F.date_trunc("millisecond", ts)


def _zone_offset(plain: Column) -> Column:
    """Replace a trailing zone name by its offset."""
    zones = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
    offset = F.try_element_at(zones, F.upper(F.regexp_extract(plain, r" ([A-Za-z]{1,3})$", 1)))
    return F.coalesce(F.concat(F.regexp_replace(plain, r" [A-Za-z]{1,3}$", " "), offset), plain)


def _plain(s: Column) -> Column:
    """Written dates without commas, weekday, long month names and zone remarks."""
    plain = F.trim(F.regexp_replace(s, r"[,\s]+", " "))
    plain = F.regexp_replace(plain, _WEEKDAY, "")
    plain = F.regexp_replace(plain, _MONTH, "$1")
    plain = F.regexp_replace(plain, r" (GMT|UTC)([+-])", " $2")
    plain = F.regexp_replace(plain, r" \([^)]*\)$", "")
    return _zone_offset(F.regexp_replace(plain, r"([+-]\d{2}):(\d{2})$", "$1$2"))


def _written(plain: Column) -> Column:
    """Each row is parsed with the one pattern its shape asks for."""
    parsed = F.lit(None).cast("timestamp")
    for shape, pattern in reversed(_SHAPES):
        parsed = F.when(plain.rlike(shape), F.try_to_timestamp(plain, F.lit(pattern))).otherwise(
            parsed
        )
    return parsed


def norm_date(text: Column) -> Column:
    """Read ISO 8601, RFC 822 and common written dates; anything else is absent."""

    def read(s: Column) -> Column:
        iso = F.try_to_timestamp(F.regexp_replace(F.upper(s), r"\s([+-]|Z)", "$1"))
        return F.when(s.rlike(_ISO), iso).otherwise(let(_plain(s), _written))

    return millis(let(F.trim(F.regexp_replace(text, r"\s+", " ")), read))


def merge_time(published: Column, updated: Column) -> Column:
    """Effective time of a merge: updated, else published, else the epoch."""
    return F.coalesce(updated, published, epoch())


def refine_time(published: Column, updated: Column) -> Column:
    """Effective time of windows and sorts: published, else updated, else absent."""
    return F.coalesce(published, updated)


def day_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))


def rfc822(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def rfc3339(ts: Column, fallback: Column | None = None) -> Column:
    value = ts if fallback is None else F.coalesce(ts, fallback)
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_start(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def week_start(ts: Column) -> Column:
    """Monday midnight."""
    return F.date_trunc("WEEK", ts)


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration column such as ``24h``; absent when malformed."""
    amount = F.regexp_extract(F.trim(text), DURATION, 1).try_cast("bigint")
    unit = F.regexp_extract(F.trim(text), DURATION, 2)
    factor = F.lit(None).cast("bigint")
    for name, value in UNIT_MS.items():
        factor = F.when(unit == name, F.lit(value).cast("bigint")).otherwise(factor)
    return F.try_multiply(amount, factor)


def parse_duration(text: str) -> int | None:
    """The same for an argument."""
    match = re.match(DURATION, text.strip())
    return int(match.group(1)) * UNIT_MS[match.group(2)] if match else None
