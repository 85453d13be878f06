"""Operators on feature tables: attributes, ``geom`` and its box columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.projection import normalise, reproject


def make_features(df: DataFrame, geom: Column, box: Sequence[Column] | None = None) -> DataFrame:
    """A feature table from any table and a geometry expression.

    ``box`` gives the sides of the box where they are known without looking at
    the coordinates.
    """
    if box is None:
        return G.with_box(df.withColumn("geom", geom))
    return df.withColumns({"geom": geom, **dict(zip(G.BOX, box))})


def box_features(df: DataFrame, xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> DataFrame:
    """Polygons from four box columns."""
    sides = {name: F.col(c).cast("double") for name, c in zip(G.BOX, (xmin, ymin, xmax, ymax))}
    return df.withColumns({**sides, "geom": G.box_polygon(*sides.values())})


def set_crs(features: DataFrame, crs) -> DataFrame:
    """Note the coordinate system on the ``geom`` column; Parquet keeps it."""
    return features.withMetadata("geom", {"crs": normalise(crs)})


def get_crs(features: DataFrame) -> str:
    """The system noted on ``geom``, or WGS 84. No job is run."""
    return normalise(features.schema["geom"].metadata.get("crs"))


def reproject_features(features: DataFrame, source, target) -> DataFrame:
    """All coordinates in another system, boxes recomputed."""

    def move(p: Column) -> Column:
        x, y = reproject(p["x"], p["y"], source, target)
        return G.point(x, y)

    parts = F.transform(F.col("geom.parts"), lambda part: F.transform(part, move))
    moved = G.with_box(features.withColumn("geom", G.geometry(F.col("geom.kind"), parts)))
    return set_crs(moved, target)


def explode_rings(features: DataFrame, *keep: str) -> DataFrame:
    """One row per vertex: ``part, vertex, x, y``."""
    parts = features.select(*keep, F.posexplode("geom.parts").alias("part", "__p"))
    verts = parts.select(*keep, "part", F.posexplode("__p").alias("vertex", "__v"))
    return verts.select(*keep, "part", "vertex", F.col("__v.x").alias("x"), F.col("__v.y").alias("y"))


def signed_areas(geom: str = "geom") -> Column:
    """Signed area of each ring; counter-clockwise is positive."""
    edges = G.edges_of_part("ring")
    term = "(e.x1 - ring[0].x) * (e.y2 - ring[0].y) - (e.x2 - ring[0].x) * (e.y1 - ring[0].y)"
    return F.expr(f"transform({geom}.parts, ring -> aggregate({edges}, 0D, (s, e) -> s + {term}) / 2)")


def length() -> Column:
    """Length of all edges of ``geom`` in the units of the coordinates."""
    return F.expr(f"aggregate({G.EDGES}, 0D, (s, e) -> s + hypot(e.x2 - e.x1, e.y2 - e.y1))")
