"""Time expressions shared by the operators. Times are ``TIMESTAMP_NTZ``."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

UNITS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofyear": F.dayofyear,
    "hour": F.hour,
}

_MICROS = {
    "day": MICROS_PER_DAY,
    "hour": 3_600_000_000,
    "minute": 60_000_000,
    "second": 1_000_000,
    "millisecond": 1_000,
    "microsecond": 1,
    "week": 7 * MICROS_PER_DAY,
}
_ALIASES = {"d": "day", "h": "hour", "hr": "hour", "min": "minute", "m": "minute", "s": "second",
            "sec": "second", "ms": "millisecond", "us": "microsecond", "w": "week"}


def micros(t: Column) -> Column:
    """Microseconds since 1970-01-01 as bigint."""
    return F.unix_micros(t.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("bigint")).cast("timestamp_ntz")


def time_unit(t: Column, unit: str) -> Column:
    """Calendar unit of ``t`` as int: year, month, day, dayofyear or hour."""
    try:
        return UNITS[unit](t).cast("int")
    except KeyError:
        raise ValueError(f"unknown time unit {unit!r}; use one of {', '.join(UNITS)}") from None


def duration_micros(quantity: float = 1, unit: str = "day") -> int:
    """Length of ``quantity`` x ``unit``; the quantity may be a fraction."""
    name = unit.strip().lower()
    name = _ALIASES.get(name, name[:-1] if name.endswith("s") and len(name) > 1 else name)
    if name not in _MICROS:
        raise ValueError(f"unknown unit of time {unit!r}")
    us = round(quantity * _MICROS[name])
    if us <= 0:
        raise ValueError("a duration must be positive")
    return us


_PARTIAL = re.compile(
    r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2})(?::(\d{2})(?::(\d{2})(?:\.(\d{1,6})\d*)?)?)?)?)?)?$"
)


def time_bounds(value: str | date | datetime) -> tuple[datetime, datetime]:
    """First instant of ``value`` and first instant after it.

    A string names the whole unit it is written to: ``"2008-01-11"`` is that
    day, ``"2008"`` that year. A datetime is a single instant.
    """
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = (value - value.utcoffset()).replace(tzinfo=None)
        return value, value + timedelta(microseconds=1)
    if isinstance(value, date):
        return time_bounds(value.isoformat())
    match = _PARTIAL.match(value.strip().removesuffix("Z"))
    if not match:
        raise ValueError(f"cannot read {value!r} as a time")
    y, mo, d, h, mi, s, frac = match.groups()
    start = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0),
                     int((frac or "0").ljust(6, "0")))
    if mo is None:
        return start, start.replace(year=start.year + 1)
    if d is None:
        return start, (start.replace(day=1) + timedelta(days=32)).replace(day=1)
    for part, step in ((h, timedelta(days=1)), (mi, timedelta(hours=1)), (s, timedelta(minutes=1)),
                       (frac, timedelta(seconds=1))):
        if part is None:
            return start, start + step
    return start, start + timedelta(microseconds=1)


def ntz(value: datetime) -> Column:
    """A ``TIMESTAMP_NTZ`` literal, so that comparisons reach the scan."""
    return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")


def from_days_since_2000(days: Column) -> Column:
    """The time that many days after 2000-01-01, to the microsecond."""
    return from_micros(F.round(days * F.lit(float(MICROS_PER_DAY))).cast("bigint") + F.lit(946_684_800_000_000))


def days_since_2000(t: Column) -> Column:
    """Days since 2000-01-01 with fractions."""
    # Fixed value: 2000-01-01 in microseconds since 1970-01-01.
    return (micros(t) - F.lit(946_684_800_000_000)) / F.lit(float(MICROS_PER_DAY))
