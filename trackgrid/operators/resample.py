"""Change of time resolution: means to a coarser one, interpolation to a finer."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.timeexpr import MICROS_PER_DAY, duration_micros, from_micros, micros
from .axes import RegularAxis
from .profile import time_resolution

# Axis positions per window partition: bounds how much of one cell's series a
# task sorts.
_CHUNK = 4096


def _span(grid) -> tuple[Column, Column, Column]:
    """Midnight of the first day, where all bins count from; first and last time.

    Literals if the time axis is declared, else one scalar subquery.
    """
    axis = grid.axes.get(grid.time)
    if isinstance(axis, RegularAxis):
        ends = sorted((axis.first, axis.first + axis.step * (axis.size - 1)))
        return F.lit(int(ends[0] // MICROS_PER_DAY * MICROS_PER_DAY)), F.lit(int(ends[0])), F.lit(int(ends[1]))
    ends = grid.df.agg(F.struct(F.min(grid.time).alias("a"), F.max(grid.time).alias("b")).alias("ends")).scalar()
    first, last = micros(ends["a"]), micros(ends["b"])
    day = F.lit(MICROS_PER_DAY)
    return (F.floor(first / day) * day).cast("bigint"), first, last


def _bin(t: Column, origin: Column, freq: int) -> Column:
    return origin + F.floor((t - origin) / F.lit(freq)).cast("bigint") * F.lit(freq)


def mean_bins(grid, freq: int, fill: bool = True):
    """Mean per cell and bin of ``freq`` microseconds, labelled by its start.

    With ``fill`` every cell has a row for every bin from the first to the
    last; bins without data are NULL. The empty rows are put under the data
    before the one aggregation, which costs no join.
    """
    origin, first, last = _span(grid)
    cells = [grid.lat, grid.lon]
    rows = grid.df.select(
        _bin(micros(F.col(grid.time)), origin, freq).alias("__bin"), *cells, *grid.variables
    )
    if fill:
        types = {f.name: f.dataType for f in grid.df.schema.fields}
        labels = F.sequence(_bin(first, origin, freq), _bin(last, origin, freq), F.lit(freq))
        empty = (
            grid.df.select(*cells).distinct()
            .select(F.explode(labels).alias("__bin"), *cells,
                    *[F.lit(None).cast(types[v]).alias(v) for v in grid.variables])
        )
        rows = rows.unionByName(empty)
    means = rows.groupBy("__bin", *cells).agg(*[F.avg(v).alias(v) for v in grid.variables])
    out = means.withColumn(grid.time, from_micros(F.col("__bin")))
    return grid.with_df(out.select(*grid.dims, *grid.variables), lost=[grid.time])


def interpolate_time(grid, freq: int):
    """Linear interpolation per cell to times ``freq`` microseconds apart.

    Neighbours in time are neighbours on the time axis: where a cell lacks the
    next time, nothing is interpolated across the gap. A target that falls on
    a source time takes its value; targets outside the data are missing.

    A cell's series is handled in chunks of 4096 axis positions, each with
    the first row of the next chunk, so a long series is split over tasks.
    """
    axis = grid.axis(grid.time)
    origin = _span(grid)[0]
    df = grid.df.withColumn("__t", micros(F.col(grid.time)))
    if isinstance(axis, RegularAxis):
        i = axis.index(F.col("__t"))
        df = df.withColumn("__i", F.when(F.lit(axis.step < 0), F.lit(axis.size - 1) - i).otherwise(i)).withColumn(
            "__next", F.when(F.col("__i") < axis.size - 1, F.col("__t") + F.lit(int(abs(axis.step))))
        )
    else:
        table = axis.table()
        after = table.select((F.col("idx") - 1).alias("__j"), F.col("value").alias("__next"))
        steps = table.join(after, F.col("idx") == F.col("__j"), "left").select(
            F.col("value").alias("__v"), F.col("idx").alias("__i"), "__next"
        )
        side = F.broadcast(steps) if axis.size <= 1_000_000 else steps
        df = df.join(side, F.col("__t") == F.col("__v")).drop("__v")
    own = F.floor(F.col("__i") / _CHUNK).cast("int")
    opens = (F.col("__i") % _CHUNK == 0) & (F.col("__i") > 0)
    df = df.withColumn("__own", own).withColumn(
        "__chunk", F.explode(F.when(opens, F.array(own, own - 1)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(grid.lat, grid.lon, "__chunk").orderBy("__t")
    df = df.withColumn("__lt", F.lead("__t").over(w))
    for v in grid.variables:
        df = df.withColumn(f"__n_{v}", F.lead(v).over(w))
    df = df.where(F.col("__own") == F.col("__chunk"))
    f = F.lit(freq)
    t, nxt = F.col("__t"), F.col("__next")
    first_k = F.ceil((t - origin) / f).cast("bigint")
    last_k = F.floor((F.coalesce(nxt - 1, t) - origin) / f).cast("bigint")
    targets = F.when(first_k <= last_k, F.sequence(origin + first_k * f, origin + last_k * f, f))
    out = df.withColumn("__target", F.explode(targets))
    part = (F.col("__target") - t) / (nxt - t)
    joined = F.col("__lt") == nxt
    values = [
        F.when(F.col("__target") == t, F.col(v).cast("double"))
        .when(joined, F.col(v) + (F.col(f"__n_{v}") - F.col(v)) * part)
        .alias(v)
        for v in grid.variables
    ]
    out = out.select(from_micros(F.col("__target")).alias(grid.time), grid.lat, grid.lon, *values)
    return grid.with_df(out, lost=[grid.time])


def source_resolution(grid) -> int | None:
    """Mean gap of the time axis in microseconds: one small action."""
    axis = grid.axes.get(grid.time) or grid._measured.get(grid.time)
    if isinstance(axis, RegularAxis):
        return int(abs(axis.step)) if axis.size > 1 else None
    return time_resolution(grid.df, grid.time).first()[0]


def resample_time(grid, quantity: float = 1, unit: str = "day", interp_irreg: bool = False,
                  fill: bool = True, max_growth: int = 10_000):
    """Bring a grid to a new time resolution.

    Finer than the source: interpolation. Coarser: means. Equal: unchanged.
    With ``interp_irreg`` a coarser resolution that is not a multiple of the
    source is reached by interpolating to their greatest common divisor first;
    ``max_growth`` refuses divisors that would multiply the rows beyond it.
    """
    freq = duration_micros(quantity, unit)
    source = source_resolution(grid)
    if source is None or freq == source:
        return grid
    if freq < source:
        return interpolate_time(grid, freq)
    if interp_irreg and freq % source:
        step = math.gcd(freq, source)
        if source // step > max_growth:
            raise ValueError(
                f"interpolating to {step} us multiplies the rows by {source // step}; allowed are {max_growth}"
            )
        grid = interpolate_time(grid, step)
    return mean_bins(grid, freq, fill)
