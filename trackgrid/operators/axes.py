"""Axes of a grid: the values of one dimension and their positions.

A grid in long form does not show a cell that is absent, so operators that
count positions (thin, coarsen, re-grid) count along an axis, never along the
rows at hand. Evenly spaced axes are three numbers and need no join. Others
are a table of ``value`` and 0-based ``idx``. Times are held as microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeexpr import from_micros, micros
from ..session import checkpointed

# How far a value may lie from its even place, as a share of the step.
TOLERANCE = 1e-6
# Shares an axis is cut into to number its values in parallel.
_RANK_BUCKETS = 1024


@dataclass(frozen=True)
class RegularAxis:
    """``size`` values ``first, first + step, ...``; a negative step descends."""

    first: float
    step: float
    size: int

    def index(self, v: Column) -> Column:
        return F.rint((v - F.lit(self.first)) / F.lit(self.step)).cast("int")

    def value(self, idx: Column) -> Column:
        return F.lit(self.first) + idx * F.lit(self.step)

    def table(self, spark: SparkSession) -> DataFrame:
        ids = spark.range(self.size)
        return ids.select(self.value(F.col("id")).alias("value"), F.col("id").cast("int").alias("idx"))

    def slice(self, lo: int, hi: int) -> "RegularAxis":
        return replace(self, first=self.first + lo * self.step, size=hi - lo + 1)

    def stride(self, n: int) -> "RegularAxis":
        return replace(self, step=self.step * n, size=-(-self.size // n))


@dataclass(frozen=True)
class TableAxis:
    """Values of any spacing, in a written table of ``value`` and ``idx``."""

    df: DataFrame
    size: int

    def table(self, spark: SparkSession | None = None) -> DataFrame:
        return self.df

    def slice(self, lo: int, hi: int) -> "TableAxis":
        kept = self.df.where(F.col("idx").between(lo, hi))
        return TableAxis(kept.withColumn("idx", F.col("idx") - lo), hi - lo + 1)

    def stride(self, n: int) -> "TableAxis":
        kept = self.df.where(F.col("idx") % n == 0)
        return TableAxis(kept.withColumn("idx", (F.col("idx") / n).cast("int")), -(-self.size // n))


Axis = RegularAxis | TableAxis


def coord(df: DataFrame, dim: str) -> Column:
    """The dimension as a number: microseconds if it is a time."""
    if df.schema[dim].dataType.typeName().startswith("timestamp"):
        return micros(F.col(dim))
    return F.col(dim)


def uncoord(df: DataFrame, dim: str, v: Column) -> Column:
    """Back from a number to the type the dimension has in ``df``."""
    if df.schema[dim].dataType.typeName().startswith("timestamp"):
        return from_micros(F.floor(v))
    return v.cast(df.schema[dim].dataType)


def measure_axis(df: DataFrame, dim: str, descending: bool = False) -> Axis:
    """The axis of a dimension from its distinct values.

    One job reads the one column and writes the distinct values to the shared
    folder; what follows works on that small table.
    """
    v = coord(df, dim)
    values = checkpointed(df.select(v.alias("value")).where(F.col("value").isNotNull()).distinct())
    row = values.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    n, lo, hi = row["n"], row["lo"], row["hi"]
    if n == 0:
        raise ValueError(f"the dimension {dim} has no values")
    whole = isinstance(lo, int)
    if n == 1:
        return RegularAxis(lo, 1 if whole else 1.0, 1)
    step = (hi - lo) / (n - 1)
    if whole and step == int(step):
        step = int(step)
    # n distinct values between lo and hi lie evenly if each is at a place.
    place = F.rint((F.col("value") - F.lit(lo)) / F.lit(step))
    off = F.abs(F.col("value") - (F.lit(lo) + place * F.lit(step)))
    worst = values.agg(F.max(off).alias("off"), F.count_distinct(place).alias("places")).first()
    if worst["off"] <= TOLERANCE * abs(step) and worst["places"] == n:
        return RegularAxis(hi, -step, n) if descending else RegularAxis(lo, step, n)
    return TableAxis(checkpointed(_ranked(values, lo, hi, descending)), n)


def _ranked(values: DataFrame, lo: float, hi: float, descending: bool) -> DataFrame:
    """Number distinct values from 0 without sorting them in one task.

    Values are cut into 1024 ranges; ranges are offset by the counts before
    them, and values are numbered within their range.
    """
    width = (hi - lo) / _RANK_BUCKETS
    bucket = F.floor((F.col("value") - F.lit(lo)) / F.lit(width)).cast("int")
    if descending:
        bucket = -bucket
    cut = values.withColumn("b", bucket)
    order = F.col("value").desc() if descending else F.col("value").asc()
    # At most 1025 rows, whatever the length of the axis.
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("b").alias("ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = F.row_number().over(Window.partitionBy("b").orderBy(order)) - 1
    ranked = cut.withColumn("r", within).join(F.broadcast(offsets), F.col("b") == F.col("ob"))
    return ranked.select("value", (F.col("offset") + F.col("r")).cast("int").alias("idx"))


def with_index(df: DataFrame, dim: str, axis: Axis, name: str) -> DataFrame:
    """Add the position along ``axis`` as ``name``; off the axis, by more than ``TOLERANCE`` of a step, it is null."""
    v = coord(df, dim)
    if isinstance(axis, RegularAxis):
        i = axis.index(v)
        on = F.abs(v - axis.value(i)) <= TOLERANCE * abs(axis.step)
        return df.withColumn(name, F.when((i >= 0) & (i < axis.size) & on, i))
    table = axis.table().select(F.col("value").alias("__v"), F.col("idx").alias(name))
    keyed = df.withColumn("__c", v)
    side = F.broadcast(table) if axis.size <= 1_000_000 else table
    return keyed.join(side, F.col("__c") == F.col("__v"), "left").drop("__c", "__v")


def axis_product(spark: SparkSession, template: DataFrame, dims: Sequence[str], axes: Sequence[Axis]) -> DataFrame:
    """Every combination of axis values, produced where the rows are needed.

    The longest axis becomes the rows; the others are exploded within a row,
    so nothing is shuffled and no two tables are multiplied.
    """
    order = sorted(range(len(dims)), key=lambda k: -axes[k].size)
    first = order[0]
    out = axes[first].table(spark).select(F.col("value").alias(dims[first]))
    for k in order[1:]:
        axis = axes[k]
        if isinstance(axis, RegularAxis):
            steps = F.transform(F.sequence(F.lit(0), F.lit(axis.size - 1)), axis.value)
        else:
            steps = axis.df.agg(F.sort_array(F.collect_list("value"))).scalar()
        out = out.withColumn(dims[k], F.explode(steps))
    return out.select(*[uncoord(template, d, F.col(d)).alias(d) for d in dims])
