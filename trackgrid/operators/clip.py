"""Cutting features at a boundary.

A box is handled within the row. Other boundaries are cut into cells first, so
that a feature only meets the part of the boundary near it. Parts of length or
area zero, where a feature merely touches the boundary, are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay as O
from ..sizing import sized_join, spread
from .features import get_crs, set_crs
from .overlay import clip_polygons, region
from .spatial import PolygonCells, cells_of_edges, polygon_cells

_NO_PARTS = G.PARTS_TYPE
KINDS = ("Point", "LineString", "Polygon")


def clip_range(e: str, bbox: Sequence) -> str:
    """``struct(t0, t1)``: the share of a segment within a box (Liang-Barsky)."""
    x0, y0, x1, y1 = map(G.num, bbox)
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    sides = ((f"(-{dx})", f"({e}.x1 - {x0})"), (dx, f"({x1} - {e}.x1)"),
             (f"(-{dy})", f"({e}.y1 - {y0})"), (dy, f"({y1} - {e}.y1)"))
    enter = ", ".join(f"if({p} < 0, {q} / {p}, 0D)" for p, q in sides)
    leave = ", ".join(f"if({p} > 0, {q} / {p}, 1D)" for p, q in sides)
    outside = " or ".join(f"({p} = 0 and {q} < 0)" for p, q in sides)
    return f"named_struct('t0', greatest(0D, {enter}), 't1', if({outside}, -1D, least(1D, {leave})))"


def along(e: str, t: str) -> str:
    """Point at share ``t``; the ends are returned as they are."""
    x, y = (f"case when {t} <= 0 then {e}.{c}1 when {t} >= 1 then {e}.{c}2 else {e}.{c}1 + {t} * ({e}.{c}2 - {e}.{c}1) end"
            for c in "xy")
    return f"named_struct('x', {x}, 'y', {y})"


def join_pieces(df: DataFrame, pieces: str, out: str) -> DataFrame:
    """Add lines made from an array column of ``struct(part, a, b)``.

    Pieces of one part that meet become one line. Intermediate arrays are
    columns, so that each is computed once per row.
    """
    p = pieces
    apart = f"i = 0 or {p}[i].part != {p}[greatest(i - 1, 0)].part or {p}[i].a != {p}[greatest(i - 1, 0)].b"
    df = df.withColumn("__starts", F.expr(f"filter(sequence(0, size({p}) - 1), i -> {apart})"))
    df = df.withColumn(
        "__runs", F.expr(f"transform(__starts, (s, i) -> named_struct('s', s, 'n', coalesce(get(__starts, i + 1), size({p})) - s))")
    )
    lines = f"transform(__runs, r -> concat(array({p}[r.s].a), transform(slice({p}, r.s + 1, r.n), q -> q.b)))"
    made = F.expr(f"if(size({p}) > 0, {lines}, cast(array() as {_NO_PARTS}))")
    return df.withColumn(out, made).drop("__starts", "__runs")


def _line_geometry(parts: Column) -> Column:
    return G.geometry(F.when(F.size(parts) == 1, F.lit("LineString")).otherwise(F.lit("MultiLineString")), parts)


def _point_geometry(parts: Column) -> Column:
    return G.geometry(F.when(F.size(parts) == 1, F.lit("Point")).otherwise(F.lit("MultiPoint")), parts)


# Boxes ----------------------------------------------------------------------


def clip_to_box(features: DataFrame, bbox: Sequence[float]) -> DataFrame:
    """Features cut at a box, by kind, without a shuffle."""
    x0, y0, x1, y1 = map(G.num, bbox)
    near = features.where(G.box_overlaps(*G.BOX, bbox))
    inside = f"(xmin >= {x0} and xmax <= {x1} and ymin >= {y0} and ymax <= {y1})"
    names = features.columns

    # Lines: the kept share of each segment, then pieces that meet are joined.
    # Emptiness is tested on what was kept, where it is made.
    segs = (
        f"flatten(transform(geom.parts, (part, i) -> transform({G.edges_of_part('part')}, "
        f"e -> named_struct('part', i, 'e', e, 'r', {clip_range('e', bbox)}))))"
    )
    kept = (
        f"if({G.LINEAL} and not {inside}, filter({segs}, s -> s.r.t0 < s.r.t1), null)"
    )
    whole = near.where(f"{inside} or not {G.POLYGONAL}").withColumn("__kept", F.expr(kept))
    whole = whole.withColumn("__dots", F.expr(
        f"if({G.PUNTAL} and not {inside}, filter(geom.parts, p -> p[0].x between {x0} and {x1} "
        f"and p[0].y between {y0} and {y1}), null)"))
    whole = whole.where(f"{inside} or size(__kept) > 0 or size(__dots) > 0")
    whole = whole.withColumn("__pieces", F.expr(
        f"transform(__kept, s -> named_struct('part', s.part, 'a', {along('s.e', 's.r.t0')}, 'b', {along('s.e', 's.r.t1')}))"))
    whole = join_pieces(whole, "__pieces", "__lines")
    shaped = (
        F.when(F.expr(inside), F.col("geom"))
        .when(F.expr(G.PUNTAL), _point_geometry(F.col("__dots")))
        .otherwise(_line_geometry(F.col("__lines")))
    )
    whole = G.with_box(whole.withColumn("geom", shaped)).select(*names)

    # Polygons: Python is only reached by those that cross the edge of the box.
    crossing = near.where(f"not {inside} and {G.POLYGONAL}")
    cut = _cut_at_box(crossing, tuple(map(float, bbox)))
    return set_crs(whole.unionByName(G.with_box(cut).select(*names)), get_crs(features))


def _cut_at_box(polygons: DataFrame, bbox: Sequence[float]) -> DataFrame:
    """Polygons within a box, each by itself; those without a common area are left out."""
    names = [c for c in polygons.columns if c not in ("geom", *G.BOX)]
    df = polygons.select(*names, F.expr("transform(geom.parts, ring -> flatten(transform(ring, p -> array(p.x, p.y))))").alias("__rings"))
    n = len(names)
    box = np.array([(bbox[0], bbox[1]), (bbox[2], bbox[1]), (bbox[2], bbox[3]), (bbox[0], bbox[3])], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, outer = [], []
            for flat in batch.column(n).to_pylist():
                rings = [np.array(r, float).reshape(-1, 2) for r in flat]
                unit = 2.0 ** (math.ceil(math.log2(max(1e-300, *(np.abs(r).max() for r in [*rings, box] if len(r))))) - 50)
                made = O.overlay_rings([[r / unit for r in rings], [box / unit]], O.intersection)
                outer.append(sum(O.area(r) > 0 for r in made))
                parts.append([(r * unit).tolist() for r in made])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(parts, pa.list_(pa.list_(pa.list_(pa.float64())))), pa.array(outer, pa.int64())], names=[*names, "__parts", "__outer"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields]
    made = df.mapInArrow(run, ", ".join([*fields, "__parts array<array<array<double>>>, __outer long"]))
    parts = F.expr("transform(__parts, ring -> transform(ring, p -> named_struct('x', p[0], 'y', p[1])))")
    kind = F.when(F.col("__outer") == 1, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    return made.where("__outer > 0").withColumn("geom", G.geometry(kind, parts)).drop("__parts", "__outer")


# Any boundary ---------------------------------------------------------------


def clip_to_polygons(features: DataFrame, mask: DataFrame, id_col: str | None = None,
                     kinds: Sequence[str] = KINDS) -> DataFrame:
    """Features cut at the union of the polygons of ``mask``, which may overlap and have holes.

    ``kinds`` names the kinds of geometry the table holds; each is read once, and another kind is an
    error. Rows are numbered where they are read, so equal ids do no harm (``id_col`` is not needed any
    more). A feature without a geometry, or of which nothing lies within, has no row. Polygons come out
    with their holes behind their outer rings.
    """
    other = [k for k in kinds if k not in KINDS]
    if other:
        raise ValueError(f"cannot cut features of the kind {', '.join(other)}")
    expected = F.col("geom.kind").isin(*[k for kind in kinds for k in (kind, f"Multi{kind}")])
    seen = F.when(F.col("geom.kind").isNull() | expected, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("cannot cut a feature of the kind "), F.col("geom.kind"), F.lit(f" with kinds = {list(kinds)}"))).cast("boolean"))
    keyed = spread(features.where(seen).withColumn("__row", F.monotonically_increasing_id()))
    makers = {"Point": _clip_points, "LineString": _clip_lines, "Polygon": _clip_polygons}
    outs = []
    for kind in kinds:
        only = keyed.where(F.col("geom.kind").isin(kind, f"Multi{kind}"))
        outs.append(makers[kind](only, mask, "__row"))
    out = outs[0]
    for one in outs[1:]:
        out = out.unionByName(one)
    return set_crs(G.with_box(out).select(*features.columns), get_crs(features))


def _regroup(pieces: DataFrame, features: DataFrame, key: str, collected: Column) -> DataFrame:
    """One row per feature: its attributes and everything collected for it."""
    carried = [c for c in features.columns if c not in (key, "geom", *G.BOX)]
    attrs = [F.first(c).alias(c) for c in carried]
    return pieces.groupBy(key).agg(collected.alias("__all"), *attrs)


def _clip_points(features: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    cells = polygon_cells(mask)
    dots = features.withColumn("__p", F.expr(f"explode({G.POINTS})"))
    dots = dots.withColumns({"cx": F.expr(cells.cell("__p.x")), "cy": F.expr(cells.cell("__p.y"))})
    inside = F.expr(f"edges is null or {G.point_in('edges', '__p.x', '__p.y')}")
    right = cells.df.select("cx", "cy", "edges")
    hits = sized_join(dots, right, ["cx", "cy"], "left_semi", small=cells.small, where=inside)
    whole = _regroup(hits, features, key, F.sort_array(F.collect_list("__p")))
    return whole.withColumn("geom", _point_geometry(F.expr("transform(__all, p -> array(p))"))).drop("__all")


def _with_breaks(cells: PolygonCells) -> DataFrame:
    """The cells with ``breaks``: places where the number of edges right of the cell, seen from within it, turns odd or even.

    A ray to the right meets those edges wherever it starts in the cell, so that of each only the heights
    of its ends matter, and ends at which two such edges go on cancel out.
    """
    h, slack = G.num(cells.size), G.num(1e-9 * cells.size)
    beyond = f"filter(edges, e -> least(e.x1, e.x2) - {slack} > (cx + 1) * {h})"
    # An end below the cell is below every ray, one above it is as if at its top.
    ends = f"flatten(transform({beyond}, e -> array(least(e.y1, (cy + 2) * {h}), least(e.y2, (cy + 2) * {h}))))"
    found = cells.df.withColumn("__ends", F.expr(f"sort_array(filter({ends}, y -> y >= (cy - 1) * {h}))"))
    unpaired = "(i + 1 - array_position(__ends, y)) % 2 = 0 and (i + 1 = size(__ends) or __ends[i + 1] != y)"
    return found.withColumn("breaks", F.expr(f"filter(__ends, (y, i) -> {unpaired})")).drop("__ends")


def _clip_lines(features: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Segment by segment and cell by cell; kept shares are united afterwards."""
    cells = polygon_cells(mask)
    h = G.num(cells.size)
    if cells.bounds is None:
        return features.limit(0)
    carried = [c for c in features.columns if c not in ("geom", *G.BOX)]
    parts = features.select(*carried, F.expr("posexplode(geom.parts)").alias("__part", "__points"))
    segs = parts.select(*carried, "__part", F.expr(f"posexplode({G.edges_of_part('__points')})").alias("__seg", "e"))
    near = segs.where(G.edge_box_overlaps("e", cells.bounds))

    # A segment comes once per cell that it crosses.
    crossed = cells_of_edges(near.select(F.struct("*").alias("__s"), "e.*"), cells).select("__s.*", "cx", "cy")
    box = (f"(cx * {h})", f"(cy * {h})", f"((cx + 1) * {h})", f"((cy + 1) * {h})")
    crossed = crossed.withColumn("r", F.expr(clip_range("e", box))).where("r.t0 < r.t1")
    right = _with_breaks(cells).select("cx", "cy", F.expr("edges is null").alias("whole"), "touching", "breaks")
    met = sized_join(crossed, right, ["cx", "cy"], "inner", small=cells.small)

    # Where the segment crosses the boundary within the cell; between two
    # crossings it is inside or outside as its middle is.
    e_box = ("least(e.x1, e.x2)", "least(e.y1, e.y2)", "greatest(e.x1, e.x2)", "greatest(e.y1, e.y2)")
    solved = (
        f"transform(filter(touching, m -> {G.edge_box_overlaps('m', e_box)}), m -> named_struct("
        "'d', (e.x2 - e.x1) * (m.y2 - m.y1) - (e.y2 - e.y1) * (m.x2 - m.x1), "
        "'t', (m.x1 - e.x1) * (m.y2 - m.y1) - (m.y1 - e.y1) * (m.x2 - m.x1), "
        "'u', (m.x1 - e.x1) * (e.y2 - e.y1) - (m.y1 - e.y1) * (e.x2 - e.x1)))"
    )
    shares = f"transform(filter({solved}, c -> c.d != 0 and c.u / c.d between 0 and 1), c -> c.t / c.d)"
    inner = f"filter({shares}, t -> t > r.t0 and t < r.t1)"
    met = met.withColumn("cuts", F.expr(f"array_sort(array_distinct(concat(array(r.t0, r.t1), {inner})))"))
    middle = ("e.x1 + (s.t0 + s.t1) / 2 * (e.x2 - e.x1)", "e.y1 + (s.t0 + s.t1) / 2 * (e.y2 - e.y1)")
    inside = f"(whole or ({G.point_in('touching', f'({middle[0]})', f'({middle[1]})')}) != (size(filter(breaks, b -> b > {middle[1]})) % 2 = 1))"
    pieces = "transform(sequence(1, size(cuts) - 1), i -> named_struct('t0', cuts[i-1], 't1', cuts[i]))"
    # The outer form keeps the optimizer from testing emptiness beforehand,
    # which would work everything out twice.
    kept = met.withColumn("s", F.expr(f"explode_outer(filter({pieces}, s -> {inside}))")).where("s is not null")
    kept = kept.select(*carried, "__part", "__seg", "e", "s.t0", "s.t1")

    # Shares of a segment that touch or overlap become one before they turn
    # into points, so the cells leave no trace. All that follows is clustered
    # by feature: one shuffle.
    kept = kept.repartition(F.col(key))
    order = Window.partitionBy(key, "__part", "__seg").orderBy("t0", "t1")
    so_far = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("__opens", (so_far.isNull() | (so_far < F.col("t0"))).cast("int"))
    kept = kept.withColumn("__run", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = kept.groupBy(key, "__part", "__seg", "__run").agg(
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("e").alias("e"),
        *[F.first(c).alias(c) for c in carried if c != key],
    )
    piece = (f"named_struct('part', __part, 'seg', __seg, 't0', t0, 'a', {along('e', 't0')}, 'b', {along('e', 't1')})")
    whole = _regroup(runs, features, key, F.sort_array(F.collect_list(F.expr(piece))))
    lines = join_pieces(whole, "__all", "__lines")
    return lines.withColumn("geom", _line_geometry(F.col("__lines"))).drop("__all", "__lines")


# Polygons -------------------------------------------------------------------


def _clip_polygons(features: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    return clip_polygons(features, region(mask), key)
