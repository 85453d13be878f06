"""Geometry as plain columns.

``geom`` is ``struct<kind:string, parts:array<array<struct<x:double,y:double>>>>``.
A part is a ring of a polygon (closed: the last point repeats the first), a
line, or the single point of a point. Holes need no mark for tests, which count
edge crossings over all rings (even-odd rule). What this library makes has outer
rings counter-clockwise and their holes, clockwise, behind them. Each feature row also stores its box in ``xmin, ymin, xmax, ymax``, which is what
scans are pruned by.

Functions on columns take and return Columns. The tests at the end of the
module take and return SQL text: they nest deeply, and text keeps them legible
and quick to build. In them ``e``, ``a`` and ``b`` name edges, structs of
``x1, y1, x2, y2``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_TYPE = "struct<x:double,y:double>"
PARTS_TYPE = f"array<array<{POINT_TYPE}>>"
GEOM_TYPE = f"struct<kind:string,parts:{PARTS_TYPE}>"
EDGE_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"
BOX = ("xmin", "ymin", "xmax", "ymax")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str | Column, parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), parts.alias("parts")).cast(GEOM_TYPE)


def geometry_kind(geom: str | Column = "geom") -> Column:
    """Point, LineString, Polygon or the Multi form of one of them."""
    return (F.col(geom) if isinstance(geom, str) else geom).getField("kind")


def bbox_ring(bbox: Sequence[float]) -> list[tuple[float, float]]:
    """Corners of ``(long_min, lat_min, long_max, lat_max)``.

    Order: lower left, upper left, upper right, lower right.
    """
    x0, y0, x1, y1 = map(float, bbox)
    return [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]


def ring_of(points: Sequence[tuple[float, float]]) -> Column:
    """A literal ring, closed if it is not."""
    pts = [tuple(map(float, p)) for p in points]
    if pts[0] != pts[-1]:
        pts.append(pts[0])
    return F.expr("array(" + ", ".join(f"named_struct('x', {x!r}D, 'y', {y!r}D)" for x, y in pts) + ")")


def bbox_to_polygon(bbox: Sequence[float]) -> Column:
    """The box as a ``Polygon`` literal."""
    return geometry("Polygon", F.array(ring_of(bbox_ring(bbox))))


def box_polygon(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """One polygon per row from four box columns."""
    ring = F.array(point(xmin, ymin), point(xmin, ymax), point(xmax, ymax), point(xmax, ymin), point(xmin, ymin))
    return geometry("Polygon", F.array(ring))


def line(*points: Column) -> Column:
    return geometry("LineString", F.array(F.array(*points)))


def closed(ring: Column) -> Column:
    """``ring`` with its first point repeated at the end if need be."""
    return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def twice_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring; counter-clockwise is positive."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    cross = lambda k: (ring[k - 1]["x"] - x0) * (ring[k]["y"] - y0) - (ring[k]["x"] - x0) * (ring[k - 1]["y"] - y0)
    steps = F.when(F.size(ring) > 1, F.transform(F.sequence(F.lit(1), F.size(ring) - 1), cross))
    return F.coalesce(F.aggregate(steps, F.lit(0.0), lambda s, c: s + c), F.lit(0.0))


def with_box(df: DataFrame) -> DataFrame:
    """Add the box columns of ``geom``."""
    xs, ys = "transform(flatten(geom.parts), p -> p.x)", "transform(flatten(geom.parts), p -> p.y)"
    return df.withColumns({
        "xmin": F.expr(f"array_min({xs})"), "ymin": F.expr(f"array_min({ys})"),
        "xmax": F.expr(f"array_max({xs})"), "ymax": F.expr(f"array_max({ys})"),
    })


# SQL text -------------------------------------------------------------------

PUNTAL = "endswith(geom.kind, 'Point')"
LINEAL = "endswith(geom.kind, 'LineString')"
POLYGONAL = "endswith(geom.kind, 'Polygon')"
POINTS = "flatten(geom.parts)"


def num(v) -> str:
    """A number as a DOUBLE literal; text is taken as an expression."""
    return v if isinstance(v, str) else f"{float(v)!r}D"


def edges_of_part(part: str) -> str:
    """Directed edges between consecutive points."""
    return (
        f"if(size({part}) < 2, cast(array() as array<{EDGE_TYPE}>), transform(sequence(1, size({part}) - 1), "
        f"k -> named_struct('x1', {part}[k-1].x, 'y1', {part}[k-1].y, 'x2', {part}[k].x, 'y2', {part}[k].y)))"
    )


# All edges of all parts in one array, and the same with points as edges of
# length zero.
EDGES = f"flatten(transform(geom.parts, part -> {edges_of_part('part')}))"
EDGES_OR_POINTS = (
    f"if({PUNTAL}, transform({POINTS}, p -> named_struct('x1', p.x, 'y1', p.y, 'x2', p.x, 'y2', p.y)), {EDGES})"
)


def crosses_ray(e: str, x: str, y: str) -> str:
    """Whether an edge meets the ray going right from (x, y).

    Half open in y, so an edge shared by two polygons counts for one of them.
    """
    at = f"({e}.x2 - {e}.x1) * ({y} - {e}.y1) / ({e}.y2 - {e}.y1) + {e}.x1"
    return f"(({e}.y1 > {y}) != ({e}.y2 > {y}) and {x} < {at})"


def point_in(edges: str, x: str, y: str) -> str:
    """Even-odd test of (x, y) against an array of edges."""
    return f"(aggregate({edges}, 0, (n, ray) -> if({crosses_ray('ray', x, y)}, n + 1, n)) % 2 = 1)"


def box_overlaps(xmin: str, ymin: str, xmax: str, ymax: str, bbox: Sequence) -> str:
    """Box columns against a box: plain comparisons, so they reach the scan."""
    x0, y0, x1, y1 = map(num, bbox)
    return f"({xmin} <= {x1} and {xmax} >= {x0} and {ymin} <= {y1} and {ymax} >= {y0})"


def edge_box_overlaps(e: str, bbox: Sequence) -> str:
    return box_overlaps(f"least({e}.x1, {e}.x2)", f"least({e}.y1, {e}.y2)",
                        f"greatest({e}.x1, {e}.x2)", f"greatest({e}.y1, {e}.y2)", bbox)


def side(e: str, x: str, y: str) -> str:
    """Positive where (x, y) is left of an edge, negative where it is right."""
    return f"(({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({e}.y2 - {e}.y1) * ({x} - {e}.x1))"


def segment_meets_box(e: str, bbox: Sequence) -> str:
    """Closed segment against closed box by separating axes.

    They are apart exactly if their boxes are, or if all four corners lie
    strictly on one side of the segment's line.
    """
    x0, y0, x1, y1 = map(num, bbox)
    corners = ", ".join(side(e, x, y) for x in (x0, x1) for y in (y0, y1))
    return f"({edge_box_overlaps(e, bbox)} and least({corners}) <= 0 and greatest({corners}) >= 0)"


def geometry_meets_box(bbox: Sequence) -> str:
    """Exact test of ``geom`` against a closed box, by kind."""
    x0, y0, x1, y1 = map(num, bbox)
    dots = f"exists({POINTS}, p -> p.x between {x0} and {x1} and p.y between {y0} and {y1})"
    lines = f"exists({EDGES}, e -> {segment_meets_box('e', bbox)})"
    return (f"(case when {PUNTAL} then {dots} when {POLYGONAL} then {lines} or {point_in(EDGES, x0, y0)} "
            f"else {lines} end)")


def segments_meet(a: str, b: str) -> str:
    """Whether two closed segments share a point.

    Signs are multiplied, as a product of two small numbers may round to zero.
    """
    box = (f"least({b}.x1, {b}.x2)", f"least({b}.y1, {b}.y2)", f"greatest({b}.x1, {b}.x2)", f"greatest({b}.y1, {b}.y2)")
    s = [f"signum({side(*args)})" for args in (
        (b, f"{a}.x1", f"{a}.y1"), (b, f"{a}.x2", f"{a}.y2"), (a, f"{b}.x1", f"{b}.y1"), (a, f"{b}.x2", f"{b}.y2"))]
    return f"({edge_box_overlaps(a, box)} and {s[0]} * {s[1]} <= 0 and {s[2]} * {s[3]} <= 0)"


def distance2(x: str, y: str, e: str) -> str:
    """Squared distance from (x, y) to a segment."""
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    t = (f"coalesce(least(greatest((({x} - {e}.x1) * {dx} + ({y} - {e}.y1) * {dy}) "
         f"/ nullif({dx} * {dx} + {dy} * {dy}, 0D), 0D), 1D), 0D)")
    return f"(pow({x} - ({e}.x1 + {t} * {dx}), 2) + pow({y} - ({e}.y1 + {t} * {dy}), 2))"


def segments_within(a: str, b: str, d: float) -> str:
    """Whether two segments come within ``d`` of each other."""
    if d == 0:
        return segments_meet(a, b)
    d2, w = num(float(d) ** 2), num(float(d))
    wide = (f"least({b}.x1, {b}.x2) - {w}", f"least({b}.y1, {b}.y2) - {w}",
            f"greatest({b}.x1, {b}.x2) + {w}", f"greatest({b}.y1, {b}.y2) + {w}")
    ends = [(f"{p}.x{i}", f"{p}.y{i}", q) for p, q in ((a, b), (b, a)) for i in (1, 2)]
    near = " or ".join(f"{distance2(*end)} <= {d2}" for end in ends)
    return f"({edge_box_overlaps(a, wide)} and ({segments_meet(a, b)} or {near}))"
