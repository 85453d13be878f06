"""Grids and polygons: spatial selection and zonal statistics.

Whether a cell lies in a polygon does not depend on time. So, as long as the
distinct cells are few enough to broadcast, they are tested once and the grid
is joined with the outcome, without a shuffle. Where there are more cells, the
polygons are broadcast instead and every row is tested where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.projection import normalise
from ..session import checkpointed
from ..sizing import BROADCAST_ROWS, plan_bytes, sized_join
from .axes import RegularAxis
from .features import get_crs, reproject_features
from .spatial import PolygonCells, filter_polygon, points_in_last_polygon, points_in_polygons, polygon_cells
from .stats import describe, with_units


def _cells(grid) -> tuple[DataFrame, bool]:
    """Distinct (lat, lon) and whether they fit a broadcast.

    Declared axes prove the bound without a job; otherwise the cells are
    written once, which counts them and saves reading the grid again.
    """
    cells = grid.df.select(grid.lat, grid.lon).distinct()
    if grid.lat in grid.axes and grid.lon in grid.axes:
        return cells, grid.axes[grid.lat].size * grid.axes[grid.lon].size <= BROADCAST_ROWS
    written = checkpointed(cells)
    return written, written.count() <= BROADCAST_ROWS


def _in_system(polygons: DataFrame, source, target) -> DataFrame:
    """Polygons in the system of the grid; ``source`` overrides what they note."""
    source = source or get_crs(polygons)
    return polygons if normalise(source) == normalise(target) else reproject_features(polygons, source, target)


def _half_step(grid, dim: str) -> float:
    axis = grid.axis(dim)
    if not isinstance(axis, RegularAxis):
        raise ValueError(f"all_touched needs evenly spaced cells, which {dim} has not")
    return abs(axis.step) / 2


def _cells_inside(grid, cells: DataFrame, polygons: DataFrame, all_touched: bool) -> DataFrame:
    if not all_touched:
        return points_in_polygons(cells, polygons, grid.lon, grid.lat, how="left_semi")
    dy, dx = _half_step(grid, grid.lat), _half_step(grid, grid.lon)
    lat, lon = F.col(grid.lat), F.col(grid.lon)
    boxes = cells.withColumns({"xmin": lon - dx, "ymin": lat - dy, "xmax": lon + dx, "ymax": lat + dy})
    boxes = boxes.withColumn("geom", G.box_polygon(*[F.col(c) for c in G.BOX])).withColumn(
        "cell", F.struct(lat.alias("a"), lon.alias("b"))
    )
    return filter_polygon(boxes, polygons, "cell").select(grid.lat, grid.lon)


def select_spatial(grid, polygons: DataFrame, invert: bool = False, crs=None, polygons_crs=None,
                   mode: str = "filter", all_touched: bool = False, strategy: str = "auto"):
    """Cells whose centre lies in a polygon, or with ``invert`` in none.

    ``mode="filter"`` drops the other rows. ``mode="null"`` keeps the shape of
    a raster: rows are cut to the window of the kept cells and the rest of
    the window is NULL. ``all_touched`` keeps cells whose box meets a polygon.
    Polygons in another coordinate system are brought to the grid's.
    ``strategy`` is ``cells``, ``rows`` or ``auto``; results are the same.
    """
    if mode not in ("filter", "null"):
        raise ValueError("mode is 'filter' or 'null'")
    if strategy not in ("auto", "cells", "rows"):
        raise ValueError("strategy is 'auto', 'cells' or 'rows'")
    polygons = _in_system(polygons, polygons_crs, crs or grid.crs)
    by_row_ok = mode == "filter" and not all_touched
    if strategy == "rows" and not by_row_ok:
        raise ValueError("strategy 'rows' filters by cell centres only")
    how = "left_anti" if invert else "left_semi"
    if strategy == "rows":
        return grid.cropped_to(points_in_polygons(grid.df, polygons, grid.lon, grid.lat, how=how))
    cells, few = _cells(grid)
    if strategy == "auto" and not few and by_row_ok:
        return grid.cropped_to(points_in_polygons(grid.df, polygons, grid.lon, grid.lat, how=how))
    inside = _cells_inside(grid, cells, polygons, all_touched)
    keys = [grid.lat, grid.lon]
    if mode == "filter":
        return grid.cropped_to(sized_join(grid.df, inside, keys, how, small=few))
    kept = inside if not invert else sized_join(cells, inside, keys, "left_anti", small=few)
    window = kept.agg(
        F.struct(F.min(grid.lat).alias("a0"), F.max(grid.lat).alias("a1"),
                 F.min(grid.lon).alias("b0"), F.max(grid.lon).alias("b1")).alias("w")
    ).scalar()
    framed = grid.df.withColumn("__w", window).where(
        F.col(grid.lat).between(F.col("__w.a0"), F.col("__w.a1"))
        & F.col(grid.lon).between(F.col("__w.b0"), F.col("__w.b1"))
    ).drop("__w")
    marked = sized_join(framed, kept.withColumn("__in", F.lit(True)), keys, "left", small=few)
    values = [F.when(F.col("__in"), F.col(v)).alias(v) for v in grid.variables]
    return grid.cropped_to(marked.select(*grid.dims, *values))


def cell_polygons(grid, polygons: DataFrame, id_col: str, order_col: str | None = None) -> DataFrame:
    """``lat, lon, <id>`` for each cell in a polygon; the highest order wins."""
    cells, _ = _cells(grid)
    return _burn(cells, polygon_cells(polygons, keep=_kept(id_col, order_col)), grid, id_col, order_col)


def _kept(id_col: str, order_col: str | None) -> tuple[str, ...]:
    return tuple(dict.fromkeys([id_col, order_col or id_col]))


def _burn(cells: DataFrame, cut: PolygonCells, grid, id_col: str, order_col: str | None) -> DataFrame:
    hits = points_in_polygons(cells, cut, grid.lon, grid.lat)
    best = F.max_by(F.col(id_col), F.struct(F.col(order_col or id_col), F.col(id_col)))
    return hits.groupBy(grid.lat, grid.lon).agg(best.alias(id_col))


def groupby_poly_time(grid, polygons: DataFrame, id_col: str, var: str, by: Sequence[str] = (),
                      order_col: str | None = None, quantiles: str = "exact", strategy: str = "auto",
                      polygons_crs=None) -> DataFrame:
    """Zonal statistics: those of ``var`` per polygon and calendar units.

    A cell belongs to one polygon: where polygons overlap, to the one with the
    highest ``order_col`` (by default the highest id). Cells in no polygon are
    left out. There is one aggregation for all polygons; it has few groups, so
    sums are combined before the shuffle and a polygon with most of the cells
    costs no more than others.
    """
    units = list(by or ())
    polygons = _in_system(polygons, polygons_crs, grid.crs)
    rows = grid.df.select(*grid.dims, var)
    bound = plan_bytes(rows)
    cut = polygon_cells(polygons, keep=_kept(id_col, order_col))
    if strategy == "rows":
        tagged = points_in_last_polygon(rows, cut, grid.lon, grid.lat, order_col or id_col)
    else:
        cells, few = _cells(grid)
        if few or strategy == "cells" or not cut.small:
            burnt = _burn(cells, cut, grid, id_col, order_col)
            tagged = sized_join(rows, burnt, [grid.lat, grid.lon], "inner", small=few)
        else:
            tagged = points_in_last_polygon(rows, cut, grid.lon, grid.lat, order_col or id_col)
    return describe(with_units(tagged, grid.time, units), var, [id_col, *units], quantiles, bound)

