"""Durations and times in nanoseconds."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
DAY = 24 * NANOS["h"]
#: Durations that may be the unit of start and end times.
UNITS = {NANOS["s"], NANOS["ms"], NANOS["us"], 1, NANOS["m"], NANOS["h"], DAY, 365 * DAY}

_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def duration(text: str) -> int:
    """Nanoseconds of a duration such as ``1h30m`` or ``-1.5s``; ``0`` needs no unit."""
    if not isinstance(text, str):
        raise ValueError(f"invalid duration {text!r}")
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text[1:] if text[:1] == "+" else text)
    if rest == "0":
        return 0
    if not rest or _PART.sub("", rest):
        raise ValueError(f"invalid duration {text!r}")
    return sign * sum(int(Decimal(n) * NANOS[unit]) for n, unit in _PART.findall(rest))


def unit(text: str) -> int:
    """Nanoseconds of a time unit, given as a duration such as ``1ms``."""
    n = duration(text)
    if n not in UNITS:
        raise ValueError(f"invalid time unit {text!r}")
    return n


def rfc3339(text: Column) -> Column:
    """A text that has the form of an RFC 3339 time; empty if it has another."""
    return F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$", 0)


def rfc3339_nanos(found: Column) -> Column:
    """Nanoseconds since the epoch of what ``rfc3339`` returns; null if it is no time, or beyond what 64 bits hold (years 1677 to 2262)."""
    rest = F.substring(found, 20, 2**31 - 1)
    point = reduce(lambda s, mark: F.substring_index(s, mark, 1), "Z+-", rest)  # and digits, or empty
    seconds = F.unix_seconds(F.concat(F.substring(found, 1, 19), F.substr(rest, F.length(point) + 1)).try_cast("timestamp"))
    fraction = F.rpad(F.substring(point, 2, 9), 9, "0").cast("long")
    return F.try_add(F.try_multiply(seconds, F.lit(NANOS["s"])), fraction)


def micros_of(nanos: int) -> int:
    """The first whole microsecond at or after a time in nanoseconds."""
    return -(-nanos // 1000)
