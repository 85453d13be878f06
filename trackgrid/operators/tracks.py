"""Operators on track tables: one row per fix, ``location_long/lat`` in degrees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import checkpointed
from ..sizing import BROADCAST_ROWS, sized_join

KEY = "deployment_id"


def merge_tracks_ref(tracks: DataFrame, ref: DataFrame, small: bool | None = None) -> DataFrame:
    """Left join of tracks with reference data on ``deployment_id``.

    Columns both tables have are taken from the tracks. Null keys match null
    keys. A reference too large to broadcast is joined by a shuffle that
    spreads hot animals.
    """
    if KEY not in tracks.columns or KEY not in ref.columns:
        raise KeyError(f"both track and reference data need the column {KEY}")
    extra = [c for c in ref.columns if c not in tracks.columns]
    return sized_join(tracks, ref.select(KEY, *extra), [KEY], "left", null_safe=True, small=small)


def combine_studies(studies: Sequence[DataFrame]) -> DataFrame:
    """Stack track tables; columns a study lacks are null."""
    studies = list(studies)
    if not studies:
        raise ValueError("combine_studies needs at least one study")
    for s in studies:
        if not isinstance(s, DataFrame):
            raise TypeError(f"a study is a DataFrame or a path, not {type(s).__name__}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), studies)


def clip_tracks_timerange(tracks: DataFrame, other: DataFrame, time: str = "timestamp") -> DataFrame:
    """Fixes within the first and last time of another table, ends included.

    The two ends are scalar subqueries: one aggregate over ``other``, whose
    result filters the scan of ``tracks``.
    """
    first = other.agg(F.min(time).alias("t")).scalar()
    last = other.agg(F.max(time).alias("t")).scalar()
    return tracks.where((F.col(time) >= first) & (F.col(time) <= last))


def dissolve_points(
    tracks: DataFrame,
    by: Sequence[str] = (KEY,),
    x: str = "location_long",
    y: str = "location_lat",
    part_size: int = 100_000,
) -> DataFrame:
    """Union of the points of each key as multipoints.

    A union holds every position once. It is stored in rows of at most about
    ``part_size`` points, numbered by ``part``, so that an animal with most of
    the fixes neither meets in one task nor outgrows an array. A position
    always falls in the same part, so copies are removed before the shuffle.
    """
    by = list(by)
    located = tracks.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    parts = F.ceil(F.count(F.lit(1)) / F.lit(part_size)).cast("int").alias("__parts")
    counts = located.groupBy(*by).agg(parts)
    if by:
        # One row per key, written once and counted. Catalyst's estimate would
        # be that of all fixes.
        written = checkpointed(counts)
        few = written.count() <= BROADCAST_ROWS
        sized = sized_join(located, written, by, "inner", null_safe=True, small=few)
    else:
        sized = located.withColumn("__parts", counts.scalar())
    numbered = sized.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("__parts")).cast("int"))
    grouped = numbered.groupBy(*by, "part").agg(
        F.sort_array(F.collect_set(G.point(F.col("x"), F.col("y")))).alias("__points")
    )
    dots = F.transform("__points", lambda p: F.array(p))
    return G.with_box(grouped.select(*by, "part", G.geometry("MultiPoint", dots).alias("geom")))


def track_density(
    tracks: DataFrame,
    resolution: float,
    origin: tuple[float, float] = (0.0, 0.0),
    x: str = "location_long",
    y: str = "location_lat",
) -> DataFrame:
    """Fixes per square cell: the data of a density raster."""
    res = F.lit(float(resolution))
    cx = F.floor((F.col(x) - F.lit(float(origin[0]))) / res)
    cy = F.floor((F.col(y) - F.lit(float(origin[1]))) / res)
    located = tracks.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return located.groupBy(cx.alias("cell_x"), cy.alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))
