"""Durations: parsing of human text on the driver, rendering as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of units, in milliseconds.
UNIT_MS = {
    "nsec": 1e-6, "ns": 1e-6, "nanos": 1e-6,
    "usec": 1e-3, "us": 1e-3, "µs": 1e-3, "micros": 1e-3,
    "msec": 1, "ms": 1, "millis": 1,
    "seconds": 1000, "second": 1000, "secs": 1000, "sec": 1000, "s": 1000,
    "minutes": 60_000, "minute": 60_000, "mins": 60_000, "min": 60_000, "m": 60_000,
    "hours": 3_600_000, "hour": 3_600_000, "hrs": 3_600_000, "hr": 3_600_000, "h": 3_600_000,
    "days": 86_400_000, "day": 86_400_000, "d": 86_400_000,
    "weeks": 604_800_000, "week": 604_800_000, "wks": 604_800_000, "wk": 604_800_000, "w": 604_800_000,
    "months": 2_630_016_000, "month": 2_630_016_000, "M": 2_630_016_000,
    "years": 31_557_600_000, "year": 31_557_600_000, "yrs": 31_557_600_000, "yr": 31_557_600_000, "y": 31_557_600_000,
}
_PART = re.compile(r"(\d+)\s*([a-zA-Zµ]+)\s*")


def parse_duration_ms(text: str) -> int:
    """'1h', '5m3s' or '2 days 4h' to milliseconds; ValueError otherwise."""
    at, total = 0, 0.0
    text = text.strip()
    while at < len(text):
        found = _PART.match(text, at)
        if not found or found[2] not in UNIT_MS:
            raise ValueError(f"not a duration: {text!r}")
        total += int(found[1]) * UNIT_MS[found[2]]
        at = found.end()
    if not text:
        raise ValueError("value was empty")
    return int(total)


def option_ms(text: str) -> int:
    """An option's duration: bare digits are milliseconds."""
    return int(text) if text.isdigit() else parse_duration_ms(text)


def _int(c: Column) -> Column:
    return c.cast("long").cast("string")


def format_duration(ms: Column) -> Column:
    """Days and hours, hours to seconds, minutes and seconds, or seconds: '1d 0h 0m', '1h 1m 1s', '1m 0.00s', '0.500s'."""
    s = F.floor(ms / 1000)
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    centi = F.floor((ms % 60000) / 10)
    rest = F.concat(_int(F.floor(centi / 100)), F.lit("."), F.lpad(_int(centi % 100), 2, "0"))
    milli = F.concat(_int(s), F.lit("."), F.lpad(_int(ms % 1000), 3, "0"))
    return (
        F.when(d > 0, F.concat(_int(d), F.lit("d "), _int(h), F.lit("h "), _int(m), F.lit("m")))
        .when(h > 0, F.concat(_int(h), F.lit("h "), _int(m), F.lit("m "), _int(s % 60), F.lit("s")))
        .when(m > 0, F.concat(_int(m), F.lit("m "), rest, F.lit("s")))
        .otherwise(F.concat(milli, F.lit("s")))
    )


def battery_time(seconds: Column) -> Column:
    """'2h 5m 3s', below an hour '5m 3s', below a minute '0m 3s'."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    tail = F.concat(_int(m), F.lit("m "), _int(s), F.lit("s"))
    return F.when(h > 0, F.concat(_int(h), F.lit("h "), tail)).otherwise(tail)


def battery_time_long(seconds: Column) -> Column:
    """'1 hour, 5 minutes, 3 seconds'; hours only if there are any."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    named = lambda n, unit: F.concat(_int(n), F.lit(" " + unit), F.when(n == 1, "").otherwise("s"))
    tail = F.concat(named(m, "minute"), F.lit(", "), named(s, "second"))
    return F.when(h > 0, F.concat(named(h, "hour"), F.lit(", "), tail)).otherwise(tail)


def running_seconds(system_uptime: Column, start_ticks: Column, ticks_a_second: int = 100) -> Column:
    """How long a process has run: the system's uptime less its start, 0 at least."""
    return F.greatest(system_uptime - F.floor(start_ticks / ticks_a_second), F.lit(0)).cast("long")


def iso_to_ms(text: Column) -> Column:
    """Strict 'YYYY-MM-DDTHH:MM:SS[.fff]Z' to milliseconds since 1970; null for any other form, an offset, a time before
    1970 or a field out of range. Digits beyond milliseconds are cut. A day that its month lacks is null."""
    form = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?Z$"
    day = F.datediff(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("long")
    number = lambda a, n: F.substring(text, a, n).try_cast("long")
    seconds = number(12, 2) * 3600 + number(15, 2) * 60 + number(18, 2)
    milli = F.coalesce(F.rpad(F.regexp_extract(text, r"\.(\d{1,3})", 1), 3, "0").try_cast("long"), F.lit(0))
    value = day * 86_400_000 + seconds * 1000 + milli
    return F.when(text.rlike(form) & (day >= 0), value)


def bucket_start(ms: Column, width_ms: int) -> Column:
    return ms - F.pmod(ms, F.lit(width_ms))
