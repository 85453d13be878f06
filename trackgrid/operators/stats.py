"""Summary statistics of a grid variable by calendar units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeexpr import time_unit
from ..sizing import plan_bytes
from .quantiles import exact_quantiles

PROBS = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
COLUMNS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
# Up to this estimated input, one buffer per group can hold its values.
IN_ONE_BUFFER = 32 * 1024 * 1024
# Accuracy of approximate quantiles: rank error of 1 / 10000.
_ACCURACY = 10_000


def describe(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    quantiles: str = "exact",
    input_bytes: int | None = None,
) -> DataFrame:
    """``count, mean, std, min, p25, p50, p75, max`` of a column per key.

    ``std`` is that of a population; NULL values do not count. Quantiles are
    ``exact`` (interpolated), ``approx`` or ``none``. Exact ones come from
    ``percentile`` while the input is small, and from
    :func:`~trackgrid.operators.quantiles.exact_quantiles` otherwise; the
    results are the same.
    """
    if quantiles not in ("exact", "approx", "none"):
        raise ValueError("quantiles is 'exact', 'approx' or 'none'")
    keys = list(keys)
    v = F.col(value)
    aggs: dict[str, Column] = {
        "count": F.count(v), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v),
    }
    if quantiles == "none":
        return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    narrow = df.select(*keys, value)
    size = plan_bytes(narrow) if input_bytes is None else input_bytes
    if quantiles == "exact" and size > IN_ONE_BUFFER:
        rest = narrow.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
        found = exact_quantiles(narrow, value, keys, PROBS)
        if not keys:
            row = found.select(F.struct(*PROBS).alias("q")).scalar()
            full = rest.withColumn("__q", row).select("*", *[F.col("__q")[n].alias(n) for n in PROBS])
        else:
            renamed = found.withColumnsRenamed({k: f"__q_{k}" for k in keys})
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"__q_{k}"))
            full = rest.join(renamed, on, "left")
        return full.select(*keys, *COLUMNS)
    probs = F.array(*[F.lit(p) for p in PROBS.values()])
    made = F.percentile(v, probs) if quantiles == "exact" else F.percentile_approx(v, list(PROBS.values()), _ACCURACY)
    grouped = narrow.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()], made.alias("__q"))
    return grouped.select(
        *keys, *[F.col("__q")[list(PROBS).index(c)].alias(c) if c in PROBS else F.col(c) for c in COLUMNS]
    )


def with_units(df: DataFrame, time: str, units: Sequence[str]) -> DataFrame:
    """Add calendar units of ``time`` as columns of their own names."""
    return df.withColumns({u: time_unit(F.col(time), u) for u in units}) if units else df


def groupby_multi_time(grid, var: str, by: Sequence[str] = (), quantiles: str = "exact") -> DataFrame:
    """Statistics of ``var`` by calendar units, pooled over all cells.

    Units: year, month, day, dayofyear, hour, in any order. Without units the
    result is one row.
    """
    units = list(by or ())
    rows = with_units(grid.df.select(grid.time, var), grid.time, units)
    return describe(rows, var, units, quantiles, plan_bytes(grid.df.select(grid.time, var)))


def sort_stats(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics ordered by their group keys."""
    return stats.orderBy(*keys)


def spatial_mean_series(grid, var: str) -> DataFrame:
    """Mean over all cells, per time."""
    return grid.df.groupBy(grid.time).agg(F.avg(var).alias(var))


def present(df: DataFrame, var: str) -> Column:
    """The variable with NaN read as missing."""
    v = F.col(var)
    return F.nanvl(v, F.lit(None).cast(df.schema[var].dataType)) if df.schema[var].dataType.typeName() in ("double", "float") else v


def count_exceeding(df: DataFrame, var: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """How many values lie above a threshold, out of how many, per group. NaN is no value."""
    v = present(df, var)
    return df.groupBy(*by).agg(F.count_if(v > threshold).alias("n_exceeding"), F.count(v).alias("n_values"))


def first_day_exceeded(df: DataFrame, var: str, threshold: float, time: str = "time", by: Sequence[str] = ()) -> DataFrame:
    """First day of each year on which the threshold is passed, per group.

    Groups that never pass it are kept, with NULL. NaN does not pass it.
    """
    rows = df.withColumn("year", time_unit(F.col(time), "year"))
    first = F.min(F.when(present(df, var) > threshold, F.col(time)))
    return rows.groupBy(*by, "year").agg(first.cast("date").alias("first_day"))

