"""Subset of a feature layer: by a box, by tracks, or by other features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.projection import WGS84, normalise, reproject
from ..operators.boundary import (
    buffer_convex,
    buffer_distance,
    envelope,
    expand_box,
    feature_envelope,
    hull_ring,
    ring_extent,
    ring_feature,
)
from ..operators.clip import KINDS, clip_to_box, clip_to_polygons
from ..operators.features import get_crs, reproject_features, set_crs
from ..operators.overlay import buffer_polygons
from ..operators.spatial import filter_bbox, filter_polygon
from ..sources.readers import read_features, read_tracks
from ..sources.writers import write_features

BOUNDARY_TYPES = ("rectangular", "convex_hull", "mask")


@dataclass(frozen=True)
class SubsetResult:
    """The subset, its boundary, and the table the boundary came from."""

    subset: DataFrame
    boundary: DataFrame
    track_points: DataFrame | None = None
    bounding_geom: DataFrame | None = None
    # Distance the mask was widened by; the boundary is the widened one.
    within: float = 0.0


# Points put on each edge of a box before it is moved to another system.
EDGE_POINTS = 256


def ring_in(spark: SparkSession, bbox: Sequence[float], source, target) -> list[tuple[float, float]]:
    """The outline of a box in another system. Its edges bend, so points are put along them."""
    corners = G.bbox_ring(bbox)
    dense = [
        (x0 + (x1 - x0) * k / EDGE_POINTS, y0 + (y1 - y0) * k / EDGE_POINTS)
        for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]]) for k in range(EDGE_POINTS)
    ]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(dense)], "k int, x double, y double")
    x, y = reproject(F.col("x"), F.col("y"), source, target)
    moved = [(r["x"], r["y"]) for r in points.select("k", x.alias("x"), y.alias("y")).orderBy("k").collect()]
    return [*moved, moved[0]]


def in_degree_box(layer: DataFrame, ring: list[tuple[float, float]], bbox: Sequence[float], crs, id_col: str | None) -> DataFrame:
    """Features of a projected layer that meet a box in degrees.

    Points are moved to degrees and compared with the box itself, other features with its outline.
    """
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    # The outline's chords lie inside the bend by less than this.
    pad = max(max(xs) - min(xs), max(ys) - min(ys)) / EDGE_POINTS
    near = filter_bbox(layer, (min(xs) - pad, min(ys) - pad, max(xs) + pad, max(ys) + pad), exact=False)
    dots = F.col("geom.kind").isin("Point", "MultiPoint")
    x0, y0, x1, y1 = map(float, bbox)

    def inside(part: Column) -> Column:
        x, y = reproject(part[0]["x"], part[0]["y"], crs, WGS84)
        return x.between(x0, x1) & y.between(y0, y1)

    points = near.where(dots & F.exists("geom.parts", inside))
    return points.unionByName(filter_polygon(near.where(~dots), ring_feature(layer.sparkSession, ring), id_col))


def box_in(spark: SparkSession, bbox: Sequence[float], source, target) -> tuple[float, float, float, float]:
    """Extent, in another system, of a box."""
    if normalise(source) == normalise(target):
        return tuple(map(float, bbox))
    xs, ys = zip(*ring_in(spark, bbox, source, target))
    return min(xs), min(ys), max(xs), max(ys)


def subset_features(
    spark: SparkSession,
    features,
    bbox: Sequence[float] | None = None,
    track_points=None,
    bounding_geom=None,
    boundary_type: str = "rectangular",
    buffer: float = 0,
    clip: bool = False,
    outfile: str | None = None,
    crs=None,
    bounding_crs=None,
    id_col: str | None = None,
    kinds: Sequence[str] = KINDS,
) -> SubsetResult:
    """Features that intersect an area of interest, optionally cut at its edge.

    The area is exactly one of: a box in degrees; the surroundings of track
    points; the surroundings of other features, or with ``mask`` those
    features themselves. ``buffer`` widens it by that share of its larger
    side, with round corners. Tables may be given as paths. Coordinate systems
    are those noted on the tables unless given here. ``id_col`` names a unique
    column; without one rows are numbered.
    """
    areas = {"bbox": bbox, "track_points": track_points, "bounding_geom": bounding_geom}
    given = [name for name, value in areas.items() if value is not None]
    if len(given) != 1:
        raise TypeError(f"an area is one of {', '.join(areas)}; given: {', '.join(given) or 'none'}")
    if boundary_type not in BOUNDARY_TYPES:
        raise ValueError(f"boundary_type is one of {', '.join(BOUNDARY_TYPES)}")
    if boundary_type == "mask" and bounding_geom is None:
        raise TypeError("boundary_type 'mask' needs bounding_geom")

    layer = read_features(spark, features)
    tracks = None if track_points is None else read_tracks(spark, track_points)
    shapes = None if bounding_geom is None else read_features(spark, bounding_geom)
    crs = crs or get_crs(layer)
    bounding_crs = bounding_crs or (get_crs(shapes) if shapes is not None else WGS84)
    within = 0.0
    if bbox is not None:
        if normalise(crs) == WGS84:
            box = tuple(map(float, bbox))
            boundary = ring_feature(spark, G.bbox_ring(bbox))
            subset = filter_bbox(layer, box)
            if clip:
                subset = clip_to_box(subset, box)
        else:
            ring = ring_in(spark, bbox, WGS84, crs)
            boundary = ring_feature(spark, ring)
            subset = in_degree_box(layer, ring, bbox, crs, id_col)
            if clip:
                subset = clip_to_polygons(subset, boundary, id_col, kinds)
    elif boundary_type == "mask":
        boundary = shapes if normalise(bounding_crs) == normalise(crs) else reproject_features(shapes, bounding_crs, crs)
        within = buffer_distance(feature_envelope(boundary).first(), buffer) if buffer else 0.0
        subset = filter_polygon(layer, boundary, id_col, within)
        if within:
            boundary = buffer_polygons(boundary, within)
        if clip:
            subset = clip_to_polygons(subset, boundary, id_col, kinds)
    else:
        ring = _ring(tracks, shapes, boundary_type, crs, bounding_crs)
        d = buffer_distance(ring_extent(ring), buffer)
        boundary = ring_feature(spark, buffer_convex(ring, d, "round"))
        if boundary_type == "rectangular":
            box = expand_box(ring_extent(ring), d)
            subset = filter_bbox(layer, box)
        else:
            subset = filter_polygon(layer, boundary, id_col)
        if clip:
            if boundary_type == "rectangular" and not d:
                subset = clip_to_box(subset, box)
            else:
                subset = clip_to_polygons(subset, boundary, id_col, kinds)
    if outfile is not None:
        write_features(subset, outfile, "geojsonl" if outfile.endswith((".geojsonl", ".geojson")) else "parquet")
    return SubsetResult(subset, set_crs(boundary, crs), tracks, shapes, within)


def _ring(tracks, shapes, boundary_type, crs, bounding_crs) -> list[tuple[float, float]]:
    """Box or hull around tracks or features, in the system of the layer."""
    if tracks is not None:
        x, y = reproject(F.col("location_long"), F.col("location_lat"), WGS84, crs)
        pts = tracks.select(x.alias("x"), y.alias("y"))
    else:
        if normalise(bounding_crs) != normalise(crs):
            shapes = reproject_features(shapes, bounding_crs, crs)
        if boundary_type == "rectangular":
            return _box_ring(feature_envelope(shapes))
        pts = shapes.select(F.expr(f"explode({G.POINTS})").alias("p")).select("p.x", "p.y")
    if boundary_type == "rectangular":
        return _box_ring(envelope(pts, "x", "y"))
    return hull_ring(pts, "x", "y")


def _box_ring(box: DataFrame) -> list[tuple[float, float]]:
    row = box.first()
    if row["xmin"] is None:
        raise ValueError("there is nothing to draw a boundary around")
    return G.bbox_ring((row["xmin"], row["ymin"], row["xmax"], row["ymax"]))
