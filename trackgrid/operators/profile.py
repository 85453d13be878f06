"""Metadata of tables and grids: one small aggregate each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timeexpr as T
from .features import get_crs
from .stats import present

# The spellings a role is recognised by, in order of preference.
TIME_NAMES = ("time", "timestamp", "Time")
LAT_NAMES = ("lat", "latitude", "Latitude")
LON_NAMES = ("lon", "long", "longitude", "Longitude")


def detect_varnames(columns: Iterable[str]) -> tuple[dict, list[str], list[str]]:
    """Columns playing the roles of time, latitude and longitude.

    Returns the roles, all names, and the names without a role. Of several
    spellings the first in the list of spellings is taken.
    """
    names = list(columns)
    roles = {"timevar": TIME_NAMES, "latvar": LAT_NAMES, "lonvar": LON_NAMES}
    matched = {role: next((s for s in spellings if s in names), None) for role, spellings in roles.items()}
    return matched, names, [n for n in names if n not in matched.values()]


def profile_features(features: DataFrame) -> DataFrame:
    """Extent, number of records, kinds of geometry and system, in one pass.

    The box columns are enough for the extent: coordinates are not read.
    """
    return features.agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        F.count(F.lit(1)).alias("records"),
        F.array_join(F.sort_array(F.collect_set("geom.kind")), ",").alias("kinds"),
        F.first(F.lit(get_crs(features))).alias("crs"),
    )


def feature_schema(features: DataFrame) -> dict[str, str]:
    """Attribute names and types; no job is run."""
    shape = {"geom", "xmin", "ymin", "xmax", "ymax"}
    return {f.name: f.dataType.simpleString() for f in features.schema.fields if f.name not in shape}


def time_resolution(df: DataFrame, time: str = "time") -> DataFrame:
    """Mean gap between consecutive distinct times, in microseconds.

    The gaps telescope, so no ordering is needed. One distinct time gives NULL.
    """
    times = df.select(T.micros(F.col(time)).alias("t")).where(F.col("t").isNotNull()).distinct()
    gaps = F.count(F.lit(1)) - 1
    span = F.max("t") - F.min("t")
    return times.agg(F.when(gaps > 0, F.floor(span / gaps)).cast("bigint").alias("resolution_us"))


def time_unit_domain(df: DataFrame, time: str = "time", units: Iterable[str] = ("year", "month", "dayofyear", "hour")) -> DataFrame:
    """Per calendar unit: how many values occur, the least and the greatest.

    Columns ``unit, n_values, min_value, max_value, values``; ``offered`` tells
    whether there is a choice. The values of a unit are few by the calendar.
    """
    units = list(units)
    # Distinct hours are bounded by the calendar; distinct times are not.
    times = df.select(F.date_trunc("hour", F.col(time)).alias("t")).distinct()
    entries = F.array(*[
        F.struct(F.lit(u).alias("unit"), T.time_unit(F.col("t"), u).alias("v")) for u in units
    ])
    values = times.select(F.inline(entries)).where(F.col("v").isNotNull()).distinct()
    return values.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        (F.count(F.lit(1)) > 1).alias("offered"),
        F.sort_array(F.collect_set("v")).alias("values"),
    )


def value_range(df: DataFrame, var: str) -> DataFrame:
    """Least and greatest value of a variable. NaN is no value."""
    v = present(df, var)
    return df.agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"))
