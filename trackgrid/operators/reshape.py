"""Thin, coarsen and re-index: operators that count along axes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sizing import is_small
from .axes import RegularAxis, uncoord, with_index

_FUNCS = {"mean": F.avg, "min": F.min, "max": F.max}


def _per_dim(grid, spec: int | Mapping[str, int], what: str) -> dict[str, int]:
    per = dict(spec) if isinstance(spec, Mapping) else dict.fromkeys(grid.dims, spec)
    unknown = [d for d in per if d not in grid.dims]
    if unknown:
        raise ValueError(f"the grid has no dimension {', '.join(unknown)}")
    if any(int(n) != n or n < 1 for n in per.values()):
        raise ValueError(f"{what} must be whole numbers of at least 1")
    return {d: int(n) for d, n in per.items() if n > 1}


def thin(grid, n: int | Mapping[str, int]):
    """Keep every n-th position of each dimension, from the first.

    An int is for all dimensions, a dict for the named ones.
    """
    df = grid.df
    axes = {}
    for dim, step in _per_dim(grid, n, "thinning steps").items():
        axis = grid.axis(dim)
        df = with_index(df, dim, axis, "__i").where(F.col("__i") % step == 0).drop("__i")
        axes[dim] = axis.stride(step)
    return grid.with_df(df).with_axes(axes)


def coarsen(grid, windows: int | Mapping[str, int], boundary: str = "trim", side: str = "left",
            coord_func: str | Mapping[str, str] = "mean"):
    """Mean over blocks of cells.

    What does not fill a block is dropped (``trim``), kept as a short block
    (``pad``) or an error (``exact``). ``side="right"`` lets blocks end at the
    end of the axis instead of starting at its start. A block's coordinates
    come from the axis by ``coord_func`` (mean, min or max, or one per
    dimension), so they do not depend on which cells hold data. Every block is
    one group: sums are combined before the single shuffle.
    """
    if boundary not in ("trim", "exact", "pad"):
        raise ValueError("boundary is 'trim', 'exact' or 'pad'")
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    windows = _per_dim(grid, windows, "windows")
    funcs = dict(coord_func) if isinstance(coord_func, Mapping) else dict.fromkeys(windows, coord_func)
    df = grid.df
    blocks = {}
    for k, (dim, w) in enumerate(windows.items()):
        axis = grid.axis(dim)
        n, over = axis.size, axis.size % w
        if over and boundary == "exact":
            raise ValueError(f"{n} values of {dim} are not a multiple of the window {w}")
        shift = 0
        if over and side == "right":
            shift = -over if boundary == "trim" else w - over
        count = n // w if boundary == "trim" else -(-n // w)
        df = with_index(df, dim, axis, f"__i{k}")
        block = F.floor((F.col(f"__i{k}") + shift) / w).cast("int")
        df = df.withColumn(f"__b{k}", block).where(F.col(f"__b{k}").between(0, count - 1)).drop(f"__i{k}")
        blocks[dim] = (f"__b{k}", axis, w, shift, funcs.get(dim, "mean"))
    keys = [F.col(blocks[d][0]) if d in blocks else F.col(d) for d in grid.dims]
    grouped = df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in grid.variables])
    for dim, (name, axis, w, shift, func) in blocks.items():
        grouped = _block_coordinate(grouped, grid.df, dim, name, axis, w, shift, func)
    return grid.with_df(grouped.select(*grid.dims, *grid.variables), lost=list(windows))


def _block_coordinate(grouped: DataFrame, template: DataFrame, dim, name, axis, w, shift, func) -> DataFrame:
    if func not in _FUNCS:
        raise ValueError(f"coord_func is one of {', '.join(_FUNCS)}")
    if isinstance(axis, RegularAxis):
        lo = F.greatest(F.col(name) * w - shift, F.lit(0))
        hi = F.least(F.col(name) * w - shift + (w - 1), F.lit(axis.size - 1))
        a, b = axis.value(lo), axis.value(hi)
        value: Column = {"mean": (a + b) / 2, "min": F.least(a, b), "max": F.greatest(a, b)}[func]
        return grouped.withColumn(dim, uncoord(template, dim, value)).drop(name)
    block = F.floor((F.col("idx") + shift) / w).cast("int").alias("__b")
    values = axis.table().groupBy(block).agg(_FUNCS[func]("value").alias("__v"))
    side = F.broadcast(values) if axis.size <= 1_000_000 else values
    joined = grouped.join(side, F.col(name) == F.col("__b"))
    return joined.withColumn(dim, uncoord(template, dim, F.col("__v"))).drop(name, "__b", "__v")


def reindex_like(grid, other):
    """Put a grid on the places of another; places without data are NULL.

    The places are the product of the axes of ``other`` if all are declared,
    else the rows it has. Coordinates of declared axes are compared by their
    positions, since those of an axis and those of the data may differ in the
    last digits; data off the axes, by more than a millionth of a step, have
    no place and are left out. A place is unique, so the join has no hot key.
    """
    if grid.dims != other.dims:
        raise ValueError("the grids name their dimensions differently")
    declared = all(d in other.axes for d in other.dims)
    places = other.product() if declared else other.df.select(*other.dims)
    # A side that is small by estimate is counted before it is broadcast.
    data = F.broadcast(grid.df) if is_small(grid.df) else grid.df
    keys = list(grid.dims)
    if declared:
        keys = [f"__at{k}" for k in range(len(grid.dims))]
        for key, dim in zip(keys, grid.dims):
            places = with_index(places, dim, other.axes[dim], key)
            data = with_index(data, dim, other.axes[dim], key)
        data = data.select(*keys, *grid.variables)
        if is_small(grid.df):
            data = F.broadcast(data)
    joined = places.join(data, keys, "left")
    return other.with_df(joined.select(*grid.dims, *grid.variables))


def concat_time(grids):
    """Stack grids along time."""
    grids = list(grids)
    if not grids:
        raise ValueError("concat_time needs at least one grid")
    first = grids[0]
    df = first.df
    for g in grids[1:]:
        if g.dims != first.dims:
            raise ValueError("the grids name their dimensions differently")
        df = df.unionByName(g.df, allowMissingColumns=True)
    same = {d: a for d, a in first.axes.items() if d != first.time and all(g.axes.get(d) == a for g in grids)}
    return first.with_df(df, lost=first.dims).with_axes(same)
