"""Spatial filters and the point-in-polygon join.

Spark plans a spatial predicate as a nested loop. Here polygons are cut into
coarse square cells first, and points find them by an equi-join on the cell.
A cell keeps only the edges its points can need, and a cell no edge touches
keeps none: it is wholly inside. The work per point thus depends on the local
detail of a boundary, not on the number of its vertices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sizing import BROADCAST_BYTES, BROADCAST_ROWS, sized_join, spread_small

# Most cells one axis of the whole polygon layer is cut into.
MAX_CELLS_PER_AXIS = 1024
# Most cells across a polygon of average size; simple polygons get fewer.
MAX_CELLS_PER_POLYGON = 32
# Bytes a cell and an edge take in memory, generously.
_CELL_BYTES, _EDGE_BYTES = 128, 48


@dataclass(frozen=True)
class PolygonCells:
    """Polygons cut into cells.

    ``df`` has ``cx, cy, <keep...>, edges, touching, starts``; ``edges`` is null in a
    cell that lies inside. ``small`` says whether ``df`` was measured to fit a
    broadcast.
    """

    df: DataFrame
    size: float
    pad: float
    small: bool
    keep: tuple[str, ...]
    # Extent of all polygons, widened by ``pad``; None if there are none.
    bounds: tuple[float, float, float, float] | None

    def cell(self, v: str) -> str:
        """SQL text of the cell number of a coordinate."""
        return f"cast(floor({v} / {G.num(self.size)}) as bigint)"


def _survey(polygons: DataFrame):
    """One aggregate over the boxes and edge counts of a polygon layer.

    With ``w`` and ``h`` the sides of a box and ``c`` the cell size, a polygon
    covers at most (w/c + 2)(h/c + 2) cells and stores its edges at most twice
    in each. The sums here bound both for any cell size.
    """
    w, h, n = "(xmax - xmin)", "(ymax - ymin)", "cast(size(flatten(geom.parts)) as double)"
    sums = {"n": "1D", "wh": f"{w} * {h}", "w": f"{w} + {h}", "e": n, "ewh": f"{n} * {w} * {h}", "ew": f"{n} * ({w} + {h})"}
    return polygons.agg(
        F.avg(F.expr(f"greatest({w}, {h})")).alias("extent"),
        *[F.sum(F.expr(v)).alias(k) for k, v in sums.items()],
        F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"), F.max("ymax").alias("y1"),
    ).first()


def _cell_size(survey) -> float:
    """Small cells for detailed polygons, large ones for simple polygons."""
    across = min(max(2.0, (survey["e"] / survey["n"]) ** 0.5), MAX_CELLS_PER_POLYGON)
    total = max(survey["x1"] - survey["x0"], survey["y1"] - survey["y0"])
    return max(survey["extent"] / across, total / MAX_CELLS_PER_AXIS, 1e-9)


def _surely_fits(survey, size: float, pad: float) -> bool:
    """Whether the bound alone proves that the cells fit a broadcast."""
    more = 2 + 2 * pad / size

    def covered(wh, w, n):
        return wh / size**2 + w * more / size + n * more**2

    cells = covered(survey["wh"], survey["w"], survey["n"])
    edges = 2 * covered(survey["ewh"], survey["ew"], survey["e"])
    return cells <= BROADCAST_ROWS and cells * _CELL_BYTES + edges * _EDGE_BYTES <= BROADCAST_BYTES


def polygon_cells(
    polygons: DataFrame,
    keep: Sequence[str] = (),
    cell_size: float | None = None,
    pad: float = 0.0,
    small: bool | None = None,
    within: Sequence[float] | None = None,
) -> PolygonCells:
    """Cut a feature table of polygons into cells, without a shuffle.

    ``keep`` names attribute columns to carry. With ``pad`` a cell also lists
    edges that come within that distance of it. ``within`` is a box outside of
    which no cells are wanted.
    """
    survey = _survey(polygons)
    if not survey["n"]:
        return PolygonCells(_no_cells(polygons, keep), 1.0, float(pad), True, tuple(keep), None)
    if cell_size is None:
        cell_size = _cell_size(survey)
    h = G.num(cell_size)
    # Slack for the rounding of v / h: more edges than needed do no harm.
    slack = G.num(float(pad) + 1e-9 * cell_size)
    rows = polygons.select(*keep, *G.BOX, F.expr(G.EDGES).alias("all_edges"),
                           F.expr("transform(geom.parts, p -> p[0])").alias("starts"))

    def spread(df: DataFrame, name: str, lo: str, hi: str) -> DataFrame:
        if within is not None:
            least, most = (within[0], within[2]) if name == "cx" else (within[1], within[3])
            lo, hi = f"greatest({lo}, {G.num(float(least))})", f"least({hi}, {G.num(float(most))})"
            df = df.where(f"{lo} <= {hi}")
        span = f"explode(sequence(floor(({lo} - {slack}) / {h}), floor(({hi} + {slack}) / {h})))"
        return df.withColumn(name, F.expr(span))

    # First rows of cells, then the cells of a row: each step narrows the
    # edges, so that the work is edges x rows and not edges x cells.
    strips = spread(rows, "cy", "ymin", "ymax").withColumn("strip", F.expr(
        f"filter(all_edges, e -> greatest(e.y1, e.y2) + {slack} >= cy * {h} and least(e.y1, e.y2) - {slack} <= (cy + 1) * {h})"))
    cells = spread(strips, "cx", "xmin", "xmax").withColumn("edges", F.expr(
        f"filter(strip, e -> greatest(e.x1, e.x2) + {slack} >= cx * {h})"))
    cells = cells.withColumn("touching", F.expr(f"filter(edges, e -> least(e.x1, e.x2) - {slack} <= (cx + 1) * {h})"))
    centre_in = G.point_in("edges", f"((cx + 0.5D) * {h})", f"((cy + 0.5D) * {h})")
    cells = cells.where(F.expr(f"size(touching) > 0 or {centre_in}")).select(
        "cx", "cy", *keep,
        F.expr("if(size(touching) > 0, edges, null)").alias("edges"),
        "touching",
        F.expr(f"filter(starts, p -> floor(p.x / {h}) = cx and floor(p.y / {h}) = cy)").alias("starts"),
    )
    if small is None:
        small = _surely_fits(survey, cell_size, pad) or _cells_fit(cells)
    bounds = (survey["x0"] - pad, survey["y0"] - pad, survey["x1"] + pad, survey["y1"] + pad)
    return PolygonCells(cells, float(cell_size), float(pad), small, tuple(keep), bounds)


def _no_cells(polygons: DataFrame, keep: Sequence[str]) -> DataFrame:
    edges = f"cast(null as array<{G.EDGE_TYPE}>)"
    return polygons.limit(0).select(
        F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cy"), *keep,
        F.expr(edges).alias("edges"), F.expr(edges).alias("touching"),
        F.expr(f"cast(null as array<{G.POINT_TYPE}>)").alias("starts"),
    )


def _cells_fit(cells: DataFrame) -> bool:
    """Measure the cells: exact count of rows and of stored edges."""
    row = cells.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.size("edges"), F.lit(0)) + F.size("touching")).alias("e"),
    ).first()
    bytes_needed = row["n"] * _CELL_BYTES + (row["e"] or 0) * _EDGE_BYTES
    return row["n"] <= BROADCAST_ROWS and bytes_needed <= BROADCAST_BYTES


def _inside(edges: str, x: str, y: str) -> str:
    return f"({edges} is null or {G.point_in(edges, x, y)})"


def _located(points: DataFrame, cells: PolygonCells, x: str, y: str) -> DataFrame:
    return points.withColumns({"cx": F.expr(cells.cell(f"`{x}`")), "cy": F.expr(cells.cell(f"`{y}`"))})


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame | PolygonCells,
    x: str,
    y: str,
    keep: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Join points with the polygons that hold them.

    ``how`` is ``inner`` (a row per point and polygon, with the columns
    ``keep`` of the polygon), ``left_semi`` or ``left_anti``. Points keep
    their columns. A point without coordinates is in no polygon.
    """
    cells = polygons if isinstance(polygons, PolygonCells) else polygon_cells(polygons, keep)
    right = cells.df.select("cx", "cy", *cells.keep, "edges")
    clash = [c for c in points.columns if c in right.columns]
    if clash:
        raise ValueError(f"points and polygons share column names: {', '.join(clash)}")
    where = F.expr(_inside("edges", f"`{x}`", f"`{y}`"))
    left = _located(spread_small(points), cells, x, y)
    joined = sized_join(left, right, ["cx", "cy"], how, small=cells.small, where=where)
    return joined.drop("cx", "cy", "edges")


def points_in_last_polygon(
    points: DataFrame, cells: PolygonCells, x: str, y: str, order: str
) -> DataFrame:
    """Like the inner join, but of several polygons the highest ``order`` wins.

    With cells that fit a broadcast, the polygons of a cell become one array,
    highest order first, and each point looks up its cell once, without a
    shuffle of the points. Otherwise points are numbered, joined by shuffle,
    and the highest of each point's polygons is taken by an aggregate.
    """
    if not cells.small:
        numbered = points.withColumn("__point", F.monotonically_increasing_id())
        hits = points_in_polygons(numbered, cells, x, y)
        top = hits.groupBy("__point").agg(F.max_by(F.struct(*points.columns, *cells.keep), F.col(order)).alias("__top"))
        return top.select("__top.*")
    entry = F.struct(F.col(order).alias("o"), *[F.col(k).alias(k) for k in cells.keep if k != order], "edges")
    grouped = cells.df.groupBy("cx", "cy").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("candidates")
    )
    joined = sized_join(_located(points, cells, x, y), grouped, ["cx", "cy"], "inner", small=True)
    inside = _inside("c.edges", f"`{x}`", f"`{y}`")
    # Exploding one element, in the outer form, works the test out only once.
    first = F.expr(f"explode_outer(slice(filter(candidates, c -> {inside}), 1, 1))")
    found = joined.withColumn("hit", first).where("hit is not null")
    out = [F.col("hit.o" if k == order else f"hit.{k}").alias(k) for k in cells.keep]
    return found.select(*points.columns, *out)


def filter_bbox(features: DataFrame, bbox: Sequence[float], exact: bool = True) -> DataFrame:
    """Features that intersect a box ``(long_min, lat_min, long_max, lat_max)``.

    The stored boxes are compared first, in a form the scan can use. Only
    features that straddle the edge of the box need the exact test.
    """
    near = features.where(G.box_overlaps(*G.BOX, bbox))
    if not exact:
        return near
    x0, y0, x1, y1 = map(G.num, bbox)
    within = f"(xmin >= {x0} and xmax <= {x1} and ymin >= {y0} and ymax <= {y1})"
    return near.where(f"{within} or {G.geometry_meets_box(bbox)}")


def cells_of_edges(edges: DataFrame, cells: PolygonCells) -> DataFrame:
    """``edges`` (with ``x1, y1, x2, y2``) once per cell that each crosses, as ``cx, cy``: column by column, the rows it covers there.

    Cells outside the bounds of the polygons are left out.
    """
    x0, y0, x1, y1 = map(G.num, cells.bounds)
    h, slack = G.num(cells.size), G.num(1e-9 * cells.size)

    def span(lo: str, hi: str, least: str, most: str) -> Column:
        first, last = cells.cell(f"greatest({lo}, {least})"), cells.cell(f"least({hi}, {most})")
        return F.expr(f"explode(if({first} <= {last}, sequence({first}, {last}), array()))")

    columns = edges.withColumn("cx", span(f"least(x1, x2) - {slack}", f"greatest(x1, x2) + {slack}", x0, x1))
    # Where the edge enters and leaves the column.
    at = lambda x: f"if(x1 = x2, {{}}, y1 + ({x} - x1) * ((y2 - y1) / (x2 - x1)))"
    left = at(f"greatest(least(x1, x2), cx * {h} - {slack})").format("y1")
    right = at(f"least(greatest(x1, x2), (cx + 1) * {h} + {slack})").format("y2")
    columns = columns.withColumns({"__ya": F.expr(left), "__yb": F.expr(right)})
    return columns.withColumn("cy", span(f"least(__ya, __yb) - {slack}", f"greatest(__ya, __yb) + {slack}", y0, y1)).drop("__ya", "__yb")


def filter_polygon(
    features: DataFrame,
    mask: DataFrame,
    id_col: str | None = None,
    within: float = 0.0,
    cell_size: float | None = None,
) -> DataFrame:
    """Features that intersect any polygon of ``mask`` or come within a distance.

    An edge of a feature is compared with the mask in the cells that it crosses
    and no others. Three cases make an intersection: edges meet, a part of the
    feature starts inside the mask, or a ring of the mask starts inside the
    feature. All depend on the geometry alone, so features are told apart by a
    128-bit hash of it: rows with equal ids, or equal rows, do no harm, and
    ``id_col`` is not needed any more. A feature without a geometry meets
    nothing.
    """
    d = float(within)
    cells = polygon_cells(mask, cell_size=cell_size, pad=d)
    if cells.bounds is None:
        return features.limit(0)
    keys = ["__g1", "__g2"]
    near = spread_small(features).where(G.box_overlaps(*G.BOX, cells.bounds))
    near = near.withColumns({"__g1": F.xxhash64("geom"), "__g2": F.xxhash64(F.lit(1), "geom")})

    edges = cells_of_edges(near.select(*keys, F.expr(f"inline({G.EDGES_OR_POINTS})")), cells)
    edges = edges.select(*keys, "cx", "cy", F.struct("x1", "y1", "x2", "y2").alias("e"))
    # One row per edge of the mask, so that the comparison is compiled code. A cell without edges lies inside.
    borders = cells.df.select("cx", "cy", F.explode_outer("touching").alias("m"))
    meet = F.expr(f"m is null or {G.segments_within('e', 'm', d)}")
    hits = sized_join(edges, borders, ["cx", "cy"], "left_semi", small=cells.small, where=meet).select(*keys)

    starts = near.select(*keys, F.expr("inline(transform(geom.parts, q -> q[0]))"))
    starts = starts.withColumns({"cx": F.expr(cells.cell("x")), "cy": F.expr(cells.cell("y"))})
    rims = cells.df.where("edges is not null").select("cx", "cy", "edges")
    inside = F.expr(G.point_in("edges", "x", "y"))
    hits = hits.unionByName(sized_join(starts, rims, ["cx", "cy"], "left_semi", small=cells.small, where=inside).select(*keys))

    # Starts of the mask's rings within polygons: crossings of a ray, among the edges that share its row of cells.
    rings = cells.df.select("cy", F.expr("inline(starts)")).withColumnsRenamed({"x": "qx", "y": "qy"}).distinct()
    shapes = near.where(G.POLYGONAL).withColumn("__row", F.monotonically_increasing_id())
    sides = shapes.select("__row", *keys, "xmin", "xmax", F.expr(f"inline({G.EDGES})")).where("y1 != y2")
    least, most = G.num(cells.bounds[1]), G.num(cells.bounds[3])
    low, high = cells.cell(f"greatest(least(y1, y2), {least})"), cells.cell(f"least(greatest(y1, y2), {most})")
    sides = sides.withColumn("cy", F.expr(f"explode(if({low} <= {high}, sequence({low}, {high}), array()))"))
    crossed = F.expr(
        "qx between xmin and xmax and ((y1 > qy) != (y2 > qy)) and qx < (x2 - x1) * (qy - y1) / (y2 - y1) + x1"
    )
    held = sized_join(sides, rings, ["cy"], "inner", small=cells.small, where=crossed)
    held = held.groupBy("__row", *keys, "qx", "qy").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    hits = hits.unionByName(held.select(*keys)).distinct()
    return near.join(hits, keys, "left_semi").select(*features.columns)
