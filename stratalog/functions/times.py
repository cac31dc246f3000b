"""Times as UTC nanoseconds: parsing, formatting, and days."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.model import DAY_NS

RFC3339 = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})$"
_RFC3339 = re.compile(RFC3339)
_INTEGER = re.compile(r"[+-]?[0-9]+")
#: Integers from here on are nanoseconds, below it seconds.
NANOSECONDS_FROM = 10**12


def _in_range(ns: int) -> int:
    if not -(2**63) <= ns < 2**63:
        raise ValueError("the time doesn't fit in nanoseconds of 64 bits")
    return ns


def parse_time(text: str) -> int | None:
    """RFC 3339 with an offset, or an integer of seconds or nanoseconds; None if blank."""
    text = text.strip()
    if not text:
        return None
    if m := _RFC3339.match(text):
        year, month, day, hour, minute, second = map(int, m.groups()[:6])
        datetime(year, month, day, hour, minute, second)
        offset = 0
        if m[8] != "Z":
            hours, minutes = int(m[8][1:3]), int(m[8][4:6])
            if hours > 24 or minutes > 59:
                raise ValueError(f"no time: {text!r}")
            offset = (hours * 60 + minutes) * (-60 if m[8][0] == "-" else 60)
        seconds = calendar.timegm((year, month, day, hour, minute, second)) - offset
        return _in_range(seconds * 10**9 + int(((m[7] or "") + "0" * 9)[:9]))
    if _INTEGER.fullmatch(text):
        n = int(text)
        return _in_range(n * 10**9 if n < NANOSECONDS_FROM else n)
    raise ValueError(f"no time: {text!r}")


def parse_time_column(text: Column) -> Column:
    """As ``parse_time``, but null for what it rejects."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, RFC3339, i)
    whole = F.try_to_timestamp(F.concat(F.substring(t, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    offset = F.when(part(8) == "Z", 0).otherwise((F.substring(part(8), 2, 2).cast("int") * 60 + F.substring(part(8), 5, 2).cast("int")) * F.when(F.startswith(part(8), F.lit("-")), -60).otherwise(60))
    seconds = F.unix_seconds(whole) - offset
    fraction = F.rpad(F.substring(part(7), 1, 9), 9, "0").cast("long")
    stamp = F.try_add(F.try_multiply(seconds, F.lit(10**9)), fraction)
    n = t.try_cast("long")
    return F.when(F.rlike(t, F.lit(RFC3339)), stamp).when(F.rlike(t, F.lit(r"^[+-]?[0-9]+$")), F.when(n < NANOSECONDS_FROM, F.try_multiply(n, F.lit(10**9))).otherwise(n))


def format_ns(ns: int) -> str:
    seconds, fraction = divmod(ns, 10**9)
    text = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    return text + (f".{fraction:09d}".rstrip("0") if fraction else "") + "Z"


def _div(n: Column, by: int) -> Column:
    """The floor of a whole division, without going through doubles."""
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by))


def timestamp_column(ns: Column) -> Column:
    return F.timestamp_micros(_div(ns, 1000))


def format_ns_column(ns: Column) -> Column:
    """RFC 3339 in UTC with nanoseconds, without trailing zeros. The session's time zone must be UTC."""
    fraction = F.regexp_replace(F.concat(F.lit("."), F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0")), r"\.?0+$", "")
    return F.concat(F.date_format(F.timestamp_seconds(_div(ns, 10**9)), "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def day_of(ns: int) -> str:
    return datetime.fromtimestamp(ns // 10**9, timezone.utc).strftime("%Y%m%d")


def day_column(ns: Column) -> Column:
    return F.date_format(F.timestamp_micros(_div(ns, 1000)), "yyyyMMdd")


def day_bounds(day: str) -> tuple[int, int]:
    """First and last nanosecond of a day."""
    if not re.fullmatch(r"\d{8}", day):
        raise ValueError(f"no day: {day!r}")
    first = calendar.timegm(datetime.strptime(day, "%Y%m%d").timetuple()) * 10**9
    return first, first + DAY_NS - 1


def day_overlaps(day: str, start: int | None, end: int | None) -> bool:
    first, last = day_bounds(day)
    return (start is None or last >= start) and (end is None or first <= end)
