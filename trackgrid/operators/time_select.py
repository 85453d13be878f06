"""Selection in time. Conditions are literals, so they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeexpr as T
from ..sizing import row_hash


def select_time_range(df: DataFrame, time: str = "time", start=None, end=None) -> DataFrame:
    """Rows with ``start <= time <= end``; either end may be open.

    A string covers the whole unit it names, so an end of ``"2008-01-11"``
    keeps that entire day.
    """
    t = F.col(time)
    if start is not None:
        df = df.where(t >= T.ntz(T.time_bounds(start)[0]))
    if end is not None:
        df = df.where(t < T.ntz(T.time_bounds(end)[1]))
    return df


def range_years(start=None, end=None) -> tuple[int | None, int | None]:
    """First and last year that a range of time can hold."""
    first = None if start is None else T.time_bounds(start)[0].year
    last = None if end is None else (T.time_bounds(end)[1] - timedelta(microseconds=1)).year
    return first, last


def selected(values: Iterable[int] | None, bounds: Sequence[int] | None) -> list[int] | None:
    """Union of a list and an inclusive range; None if neither is given."""
    if not values and not bounds:
        return None
    chosen = set(values or ())
    if bounds:
        chosen.update(range(bounds[0], bounds[1] + 1))
    return sorted(chosen)


def in_runs(v: Column, chosen: Sequence[int]) -> Column:
    """Membership as a few comparisons: runs of integers become ranges."""
    runs: list[list[int]] = []
    for n in chosen:
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    cond = F.lit(False)
    singles = [a for a, b in runs if a == b]
    if singles:
        cond = v.isin(singles)
    for a, b in runs:
        if a < b:
            cond = cond | v.between(a, b)
    return cond


def select_time_cond(
    df: DataFrame,
    time: str = "time",
    years=None,
    months=None,
    daysofyear=None,
    hours=None,
    year_range=None,
    month_range=None,
    dayofyear_range=None,
    hour_range=None,
) -> DataFrame:
    """Rows of certain years, months, days of year and hours.

    A list and a range for one unit are united; units are combined by AND.
    Without any criterion all rows are kept.
    """
    t = F.col(time)
    wanted = {
        "year": selected(years, year_range),
        "month": selected(months, month_range),
        "dayofyear": selected(daysofyear, dayofyear_range),
        "hour": selected(hours, hour_range),
    }
    chosen_years = wanted["year"]
    if chosen_years is not None:
        if not chosen_years:
            return df.where(F.lit(False))
        # year(t) does not reach the scan, a range of t does.
        df = df.where(
            (t >= T.ntz(datetime(chosen_years[0], 1, 1))) & (t < T.ntz(datetime(chosen_years[-1] + 1, 1, 1)))
        )
    for unit, chosen in wanted.items():
        if chosen is not None:
            df = df.where(in_runs(T.time_unit(t, unit), chosen))
    return df


def select_time_slice(df: DataFrame, at, time: str = "time") -> DataFrame:
    """Rows of exactly one time."""
    return df.where(F.col(time) == T.ntz(T.time_bounds(at)[0]))


def time_encoding_days(df: DataFrame, time: str = "time", name: str = "time") -> DataFrame:
    """Replace (or add) time as days since 2000-01-01."""
    return df.withColumn(name, T.days_since_2000(F.col(time)))


def sort_by_time(df: DataFrame, time: str = "time", partitions: int | None = None) -> DataFrame:
    """Global order by time: contiguous ranges, each sorted within its task.

    Rows of one time may be most of the table. A hash of the row and the
    number of the task that read it come after the time, so such a time is
    cut into several ranges, copies of a row included.
    """
    keys = [F.col(time), row_hash(df)]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(time)
