"""Writing features, grids and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.timeexpr import days_since_2000
from ..operators.axes import RegularAxis
from ..sizing import row_hash
from .readers import AXES_SUFFIX, YEAR, _stored_axes


def geojson_coordinates(geom: Column) -> Column:
    """JSON text of the coordinates, nested as the kind asks; ``[]`` of an empty geometry.

    Rings of a MultiPolygon that turn as its first ring does are outer rings; those that turn the other
    way are holes of the outer ring before them.
    """
    pairs_of = lambda part: F.transform(part, lambda p: F.array(p["x"], p["y"]))
    pairs = F.transform(geom.getField("parts"), pairs_of)
    kind = geom.getField("kind")
    return (
        F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, F.lit("[]"))
        .when(kind == "Point", F.to_json(pairs[0][0]))
        .when(kind == "MultiPoint", F.to_json(F.transform(pairs, lambda p: p[0])))
        .when(kind == "LineString", F.to_json(pairs[0]))
        .when(kind == "MultiPolygon", F.to_json(F.transform(ring_groups(geom.getField("parts")), lambda rings: F.transform(rings, pairs_of))))
        .otherwise(F.to_json(pairs))
    )


def ring_groups(rings: Column) -> Column:
    """Rings as an array of polygons: each an outer ring and the holes behind it."""
    with_turns = F.transform(rings, lambda r: F.struct(r.alias("r"), F.signum(G.twice_area(r)).alias("t")))

    def grouped(z: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda k: (k == 0) | (z[k]["t"] * z[0]["t"] >= 0))
        stop = lambda i: F.coalesce(F.get(starts, i + 1), F.size(z))
        return F.transform(starts, lambda k, i: F.transform(F.slice(z, k + 1, stop(i) - k), lambda x: x["r"]))

    # As the variable of a lambda, areas are worked out once.
    return F.transform(F.array(with_turns), grouped)[0]


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as the column ``value``. Without a geometry it is written as null."""
    attrs = [c for c in features.columns if c not in ("geom", *G.BOX)]
    properties = F.to_json(F.struct(*attrs), {"ignoreNullFields": "false"}) if attrs else F.lit("{}")
    geom = F.col("geom")
    shape = F.concat(F.lit('{"type":"'), geom.getField("kind"), F.lit('","coordinates":'), geojson_coordinates(geom), F.lit("}"))
    shape = F.coalesce(shape, F.lit("null"))
    return features.select(
        F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("value")
    )


def write_features(features: DataFrame, path: str, format: str = "parquet", cluster: bool = False, mode: str = "error") -> None:
    """Write features as Parquet or as GeoJSON, a feature per line.

    With ``cluster`` rows are ordered by place first, so that later reads with
    a box skip most of the Parquet row groups.
    """
    if format == "parquet":
        if cluster:
            # After the place come hash and task, which split a crowded place.
            place = [F.floor("ymin"), F.floor("xmin"), F.col("ymin"), F.col("xmin")]
            features = features.repartitionByRange(*place, row_hash(features.drop("geom")))
            features = features.sortWithinPartitions(*place)
        features.write.mode(mode).parquet(path)
    elif format == "geojsonl":
        geojson_lines(features).write.mode(mode).text(path)
    else:
        raise ValueError(f"cannot write features as {format}")


def write_grid(grid, path: str, cluster: bool = True, encode_days: bool = False, mode: str = "error") -> None:
    """Write a grid as Parquet by year, with its declared axes beside it.

    With ``cluster`` the rows are ordered by time and place, so that a task
    writes few files and a time range reads few of them. ``encode_days``
    stores time as days since 2000-01-01.
    """
    stored = _stored_axes(grid.df.sparkSession, f"{path.rstrip('/')}{AXES_SUFFIX}") if mode == "append" else None
    df = grid.df.withColumn(YEAR, F.year(grid.time).cast("int"))
    if cluster:
        df = df.repartitionByRange(*grid.dims).sortWithinPartitions(*grid.dims)
    if encode_days:
        df = df.withColumn(grid.time, days_since_2000(F.col(grid.time)))
    df.write.mode(mode).partitionBy(YEAR).parquet(path)
    known = [(d, isinstance(a.first, int), float(a.first), float(a.step), a.size)
             for d, a in grid.axes.items() if isinstance(a, RegularAxis)
             # Rows that are added may lie off an axis, unless it is that of the rows before.
             if stored is None or stored.get(d) == a]
    # Written even if there are none: axes of earlier data must not outlive it.
    schema = "dim string, whole boolean, first double, step double, size int"
    df.sparkSession.createDataFrame(known, schema).write.mode("overwrite").json(f"{path.rstrip('/')}{AXES_SUFFIX}")


def write_stats(stats: DataFrame, path: str, keys: Sequence[str] = (), mode: str = "error") -> None:
    """Write statistics as CSV with a header, ordered by their keys."""
    ordered = stats.orderBy(*keys) if keys else stats
    ordered.write.mode(mode).option("header", True).csv(path)


def write_tracks(tracks: DataFrame, path: str, mode: str = "error") -> None:
    """Write fixes as CSV with a header; times keep their microseconds."""
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    tracks.write.mode(mode).option("header", True).option("timestampNTZFormat", stamp).csv(path)
