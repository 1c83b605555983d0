"""Timestamps and durations as text: driver-side parsing and column forms, always in nanoseconds since 1970 UTC."""

from __future__ import annotations

import calendar
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.errors import QueryError

_ISO = re.compile(r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?")
_DURATION = re.compile(r"(\d+)(n|us|ms|s|min|m|h|d)?")
# Nanoseconds of a unit; a bare number counts nanoseconds.
UNITS = {"n": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "min": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}
_MAX = (1 << 63) - 1


def parse_timestamp(text: str | int) -> int:
    """Basic ISO format (20060102T150405.999999999) or an integer of nanoseconds."""
    s = str(text).strip()
    if len(s) < 15 or "T" not in s:
        if not s.isdigit():
            raise QueryError(f"can't parse timestamp {s!r}")
        ns = int(s)
    else:
        m = _ISO.fullmatch(s)
        if not m:
            raise QueryError(f"can't parse timestamp {s!r}")
        y, mo, d, h, mi, sec = map(int, m.groups()[:6])
        seconds = calendar.timegm((y, mo, d, h, mi, sec)) if 1 <= mo <= 12 and y > 0 else -1
        if seconds < 0 or time.gmtime(seconds)[:6] != (y, mo, d, h, mi, sec):
            raise QueryError(f"no such time: {s!r}")
        ns = seconds * 1_000_000_000 + int((m[7] or "0").ljust(9, "0"))
    if ns > _MAX:
        raise QueryError(f"timestamp {s!r} is out of range")
    return ns


def format_timestamp(ns: int) -> str:
    """Basic ISO format with nine digits of fraction."""
    return time.strftime("%Y%m%dT%H%M%S", time.gmtime(ns // 1_000_000_000)) + f".{ns % 1_000_000_000:09d}"


def parse_duration(text: str | int) -> int:
    """A number with an optional unit (n, us, ms, s, m or min, h, d)."""
    m = _DURATION.fullmatch(str(text).strip())
    if not m:
        raise QueryError(f"can't parse duration {text!r}")
    return int(m[1]) * UNITS[m[2] or "n"]


def iso_column(ts_ns: Column) -> Column:
    """``format_timestamp`` of a column; needs a session in UTC."""
    part = F.pmod(ts_ns, F.lit(1_000_000_000))
    whole = F.timestamp_seconds(F.call_function("div", ts_ns - part, F.lit(1_000_000_000)))
    return F.concat(F.date_format(whole, "yyyyMMdd'T'HHmmss"), F.lit("."), F.lpad(part.cast("string"), 9, "0"))


def parse_column(text: Column) -> Column:
    """``parse_timestamp`` of a column; null where the text is no timestamp."""
    iso = F.regexp_extract(text, r"^(\d{8}T\d{6})(?:[.,]\d{1,9})?$", 1)
    fraction = F.rpad(F.regexp_extract(text, r"[.,](\d{1,9})$", 1), 9, "0").cast("bigint")
    seconds = F.unix_timestamp(F.try_to_timestamp(iso, F.lit("yyyyMMdd'T'HHmmss")))
    return F.when(text.rlike(r"^\d{1,18}$"), text.try_cast("bigint")).when(iso != "", seconds * 1_000_000_000 + fraction)
