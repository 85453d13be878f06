"""Exploration of a grid: select, re-shape, summarise, store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..grid import GridFrame
from ..operators.grid_spatial import groupby_poly_time
from ..operators.stats import groupby_multi_time, sort_stats
from ..sources.writers import write_grid, write_stats


@dataclass(frozen=True)
class Exploration:
    grid: GridFrame
    stats: DataFrame | None = None


def explore_grid(
    grid: GridFrame,
    variables: Sequence[str] = (),
    start=None,
    end=None,
    conditions: Mapping | None = None,
    polygons: DataFrame | None = None,
    invert: bool = False,
    resample: tuple | None = None,
    interp_irreg: bool = False,
    coarsen: Mapping[str, int] | int | None = None,
    thin: Mapping[str, int] | int | None = None,
    stats_of: str | None = None,
    by: Sequence[str] = (),
    zones: DataFrame | None = None,
    zone_id: str | None = None,
    quantiles: str = "exact",
    grid_out: str | None = None,
    stats_out: str | None = None,
) -> Exploration:
    """One pass from a stored grid to a smaller grid and its statistics.

    Steps run in the order of the parameters: time range, time conditions,
    area, resolution in time, blocks, thinning, statistics. Every step is
    optional and lazy; Spark reads the grid once per output.
    """
    if zones is not None and zone_id is None:
        raise ValueError("zones need zone_id, the column that names them")
    if variables:
        grid = grid.select_variables(*variables)
    if start is not None or end is not None:
        grid = grid.select_time_range(start, end)
    if conditions:
        grid = grid.select_time_cond(**conditions)
    if polygons is not None:
        grid = grid.select_spatial(polygons, invert=invert)
    if resample is not None:
        grid = grid.resample_time(*resample, interp_irreg=interp_irreg)
    if coarsen is not None:
        grid = grid.coarsen(coarsen)
    if thin is not None:
        grid = grid.thin(thin)
    stats = None
    if stats_of is not None:
        keys = list(by)
        if zones is not None:
            keys.insert(0, zone_id)
            stats = groupby_poly_time(grid, zones, zone_id, stats_of, by, quantiles=quantiles)
        else:
            stats = groupby_multi_time(grid, stats_of, by, quantiles=quantiles)
        if keys:
            stats = sort_stats(stats, keys)
    if grid_out is not None:
        write_grid(grid, grid_out)
    if stats_out is not None and stats is not None:
        write_stats(stats, stats_out)
    return Exploration(grid, stats)
