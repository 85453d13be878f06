"""Bring a grid to other latitudes and longitudes.

Either axis is handled for itself: a small table says from which source
positions a target value is made, and with what weight. The grid meets the two
tables in broadcast joins; only the weighted sum shuffles, and nearest
neighbours do not even need that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .axes import Axis, RegularAxis, uncoord, with_index

METHODS = ("nearest", "linear")


def _neighbours(spark: SparkSession, source: Axis, target: Axis) -> DataFrame:
    """``value, i0, v0, i1, v1``: source places at or around each target value."""
    want = target.table(spark).select("value")
    if isinstance(source, RegularAxis):
        at = (F.col("value") - F.lit(source.first)) / F.lit(source.step)
        # A value within rounding of a place is at that place.
        near = F.rint(at)
        at = F.when(F.abs(at - near) < 1e-9, near).otherwise(at)
        return want.withColumn("at", at).select(
            "value",
            F.floor("at").cast("int").alias("i0"), source.value(F.floor("at")).alias("v0"),
            F.ceil("at").cast("int").alias("i1"), source.value(F.ceil("at")).alias("v1"),
        ).withColumn("n", F.lit(source.size))
    # Axis values only: a table of two axes, not of the grid.
    both = source.table(spark).select("value", "idx").unionByName(
        want.select("value", F.lit(None).cast("int").alias("idx"))
    )
    place = F.when(F.col("idx").isNotNull(), F.struct("idx", "value"))
    down = Window.orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy("value").rangeBetween(0, Window.unboundedFollowing)
    near = both.withColumns({
        "p": F.last(place, ignorenulls=True).over(down), "q": F.first(place, ignorenulls=True).over(up),
    })
    return near.where(F.col("idx").isNull()).select(
        "value", F.col("p.idx").alias("i0"), F.col("p.value").alias("v0"),
        F.col("q.idx").alias("i1"), F.col("q.value").alias("v1"), F.lit(source.size).alias("n"),
    )


def _weights(spark: SparkSession, source: Axis, target: Axis, method: str, prefix: str) -> DataFrame:
    """``idx, value, w`` per target value: one place if nearest, else up to two."""
    near = _neighbours(spark, source, target)
    in0 = F.col("i0").isNotNull() & F.col("i0").between(0, F.col("n") - 1)
    in1 = F.col("i1").isNotNull() & F.col("i1").between(0, F.col("n") - 1)
    span = F.col("v1") - F.col("v0")
    part = F.when(F.col("i0") == F.col("i1"), F.lit(0.0)).otherwise((F.col("value") - F.col("v0")) / span)
    if method == "nearest":
        # Halfway takes the lower position. Targets off the axis have no source.
        pick = F.when(in0 & in1, F.when(part <= 0.5, F.col("i0")).otherwise(F.col("i1")))
        out = near.select(pick.alias("i"), "value", F.lit(1.0).alias("w")).where(F.col("i").isNotNull())
    else:
        entries = F.when(
            in0 & in1,
            F.filter(
                F.array(F.struct(F.col("i0").alias("i"), "value", (1 - part).alias("w")),
                        F.struct(F.col("i1").alias("i"), "value", part.alias("w"))),
                lambda e: e["w"] > 0,
            ),
        )
        out = near.select(F.inline(entries))
    return out.toDF(f"{prefix}i", f"{prefix}value", f"{prefix}w")


def regrid_to(grid, target, method: str = "nearest"):
    """The grid on the latitudes and longitudes of ``target``.

    ``target`` is a grid, or a pair of axes (latitude, longitude). ``linear``
    weighs the four neighbours; if one that counts is missing, so is the
    result. Targets outside the source are missing.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    lat_axis, lon_axis = target if isinstance(target, tuple) else (target.axis(target.lat), target.axis(target.lon))
    spark = grid.df.sparkSession
    a = _weights(spark, grid.axis(grid.lat), lat_axis, method, "__a")
    b = _weights(spark, grid.axis(grid.lon), lon_axis, method, "__b")
    df = with_index(grid.df, grid.lat, grid.axis(grid.lat), "__i")
    df = with_index(df, grid.lon, grid.axis(grid.lon), "__j")
    # An axis is far below a million values; beyond that Spark decides.
    bounded = max(lat_axis.size, lon_axis.size) <= 1_000_000
    side = F.broadcast if bounded else (lambda d: d)
    hit = df.join(side(a), F.col("__i") == F.col("__ai")).join(side(b), F.col("__j") == F.col("__bi"))
    lat = uncoord(grid.df, grid.lat, F.col("__avalue")).alias(grid.lat)
    lon = uncoord(grid.df, grid.lon, F.col("__bvalue")).alias(grid.lon)
    if method == "nearest":
        out = hit.select(grid.time, lat, lon, *grid.variables)
    else:
        w = F.col("__aw") * F.col("__bw")
        # The weights that count add up to 1; less means a neighbour is missing.
        sums = [F.when(F.sum(F.when(F.col(v).isNotNull(), w)) > 1 - 1e-9, F.sum(F.col(v) * w)).alias(v)
                for v in grid.variables]
        out = hit.groupBy(F.col(grid.time), lat, lon).agg(*sums)
    axes = {grid.lat: lat_axis, grid.lon: lon_axis}
    return grid.with_df(out.select(*grid.dims, *grid.variables), lost=[grid.lat, grid.lon]).with_axes(axes)


def interpolate_space(grid, lat_step: float, lon_step: float, method: str = "linear"):
    """Interpolate to evenly spaced coordinates over the extent of the grid."""
    lat, lon = grid.axis(grid.lat), grid.axis(grid.lon)
    return regrid_to(grid, (_even(lat, lat_step, grid.df), _even(lon, lon_step, grid.df)), method)


def _even(axis: Axis, step: float, df: DataFrame) -> RegularAxis:
    if step <= 0:
        raise ValueError("a step must be positive")
    if isinstance(axis, RegularAxis):
        first, last = axis.first, axis.first + axis.step * (axis.size - 1)
    else:
        ends = axis.df.agg(F.min_by("value", "idx"), F.max_by("value", "idx")).first()
        first, last = ends[0], ends[1]
    count = int(abs(last - first) / step + 1e-9) + 1
    return RegularAxis(first, step if last >= first else -step, count)
