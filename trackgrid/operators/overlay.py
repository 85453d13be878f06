"""Union, buffer and intersection of polygons, cell by cell.

Polygons are cut into the cells of a grid, and each cell works out the pieces of
the result's boundary within it (``functions.overlay``). Where only the pieces
are needed, as for cutting features at a mask, no outline is ever put together.
For outlines, pieces are chained into paths within a cell, and paths within
blocks of cells that grow, so that a step holds only what crosses its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay as O
from ..session import checkpointed
from ..sizing import is_small, sized_join, spread_small, task_count
from .boundary import QUAD_SEGMENTS
from .features import get_crs, set_crs, signed_areas
from .spatial import _cell_size, _survey, polygon_cells

#: A block has this many times the cells of the one before it, along each axis.
BLOCK_BITS = 5
_PATHS = pa.list_(pa.list_(pa.float64()))


@dataclass(frozen=True)
class Lattice:
    """Cells of a size and coordinates of a unit, both powers of two."""

    size: float
    unit: float
    #: Extent of the polygons it was made for, None if there are none.
    bounds: tuple[float, float, float, float] | None

    @classmethod
    def of(cls, polygons: DataFrame, size: float | None = None) -> "Lattice":
        s = _survey(polygons.where("xmin is not null"))
        if not s["n"]:
            return cls(1.0, 2.0**-40, None)
        bounds = (s["x0"], s["y0"], s["x1"], s["y1"])
        wanted = 2.0 ** math.ceil(math.log2(_cell_size(s)))
        size = size or wanted
        # Coordinates take 50 of the 53 bits of a double.
        return cls(size, 2.0 ** (math.ceil(math.log2(max(size, *map(abs, bounds)))) - 50), bounds)

    def rounded(self, features: DataFrame) -> DataFrame:
        """Features with coordinates in whole units, and their boxes."""
        u = G.num(self.unit)
        moved = f"transform(geom.parts, part -> transform(part, p -> named_struct('x', rint(p.x / {u}) * {u}, 'y', rint(p.y / {u}) * {u})))"
        return G.with_box(features.withColumn("geom", G.geometry(F.col("geom.kind"), F.expr(moved))))

    def cells(self, polygons: DataFrame, keep: Sequence[str] = (), within=None) -> DataFrame:
        """``keep, cx, cy, corner, edges``: whether each polygon holds at the corner of a cell, and its edges there, in units."""
        found = polygon_cells(polygons, keep, cell_size=self.size, small=False, within=within).df
        h, u = G.num(self.size), G.num(self.unit)
        corner = f"edges is null or {G.point_in('edges', f'(cx * {h})', f'(cy * {h})')}"
        flat = f"flatten(transform(touching, e -> array(e.x1 / {u}, e.y1 / {u}, e.x2 / {u}, e.y2 / {u})))"
        return found.select(*keep, "cx", "cy", F.expr(corner).alias("corner"), F.expr(flat).alias("edges"), "starts")

    @property
    def units(self) -> float:
        """The size of a cell in units."""
        return self.size / self.unit

    def box(self, cx: int, cy: int) -> tuple[float, float, float, float]:
        w = self.units
        return cx * w, cy * w, (cx + 1) * w, (cy + 1) * w


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists of doubles."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _edges(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges of four doubles each in a column of lists, and the row of each."""
    offsets = column.offsets.to_numpy()
    edges = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    return edges, np.repeat(np.arange(len(column)), np.diff(offsets) // 4)


def _points(flat: Sequence[float]) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, 2)


def _flat(paths: list[np.ndarray]) -> list[list[float]]:
    return [p.reshape(-1).tolist() for p in paths]


def _schema(df: DataFrame, columns: Sequence[str], more: str) -> str:
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields]
    return ", ".join([*own, more])


def _union_cells(polygons: DataFrame, lattice: Lattice, by: Sequence[str]) -> DataFrame:
    """``by, cx, cy, corner, paths``: of each cell, whether the union holds at its corner, and the union's boundary in it."""
    cells = lattice.cells(lattice.rounded(polygons), by)
    each = F.collect_list(F.struct("corner", "edges"))
    grouped = cells.groupBy(*by, "cx", "cy").agg(each.alias("own"))
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corners, out = [], []
            owns = batch.column(n + 2)
            starts = owns.offsets.to_numpy() - owns.offsets[0].as_py()
            fields = owns.flatten()
            corner = fields.field(0).to_numpy(zero_copy_only=False).astype(bool)
            edges = _arrays(fields.field(1))
            for cx, cy, a, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), starts, starts[1:]):
                held = corner[a:b]
                corners.append(bool(held.any()))
                if any(h and not len(e) for h, e in zip(held, edges[a:b])):  # one polygon fills the cell
                    out.append([])
                    continue
                every = np.concatenate(edges[a:b]).reshape(-1, 4)
                owner = np.repeat(np.arange(b - a), [len(e) // 4 for e in edges[a:b]])
                pieces = O.boundary(every, owner, held, lattice.box(cx, cy), O.union)
                rings, opened = O.chain(list(pieces.reshape(-1, 2, 2)))
                out.append(_flat([np.vstack([r, r[:1]]) for r in rings] + opened))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(corners, pa.bool_()), pa.array(out, _PATHS)], names=[*batch.schema.names[: n + 2], "corner", "paths"])

    return grouped.mapInArrow(run, _schema(grouped, [*by, "cx", "cy"], "corner boolean, paths array<array<double>>"))


def _joined(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paths of one set of ``keys`` chained: ``keys, path``."""
    grouped = paths.groupBy(*keys).agg(F.collect_list("path").alias("paths"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, some in enumerate(batch.column(n).to_pylist()):
                rings, opened = O.chain([_points(p) for p in some])
                made = _flat([np.vstack([r, r[:1]]) for r in rings] + opened)
                at += [k] * len(made)
                out += made
            taken = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:n], "path"])

    return grouped.mapInArrow(run, _schema(grouped, keys, "path array<double>"))


def _shapes(rings: DataFrame, by: Sequence[str], unit: float, more: Sequence[Column] = ()) -> DataFrame:
    """One geometry per key from arrays of rings and open paths, which are closed: ``by, geom, more``; none without area."""
    grouped = rings.groupBy(*by).agg(F.collect_list("path").alias("paths"), *more)
    names = [c for c in grouped.columns if c != "paths"]
    grouped = grouped.select(*names, "paths")
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, outer = [], []
            for some in batch.column(n).to_pylist():
                paths = [_points(p) for p in some]
                rings, opened = O.chain(paths)
                made = O.nested([*rings, *opened])
                outer.append(sum(O.area(r) > 0 for r in made))
                parts.append([(r * unit).tolist() for r in made])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(parts, pa.list_(pa.list_(pa.list_(pa.float64())))), pa.array(outer, pa.int64())], names=[*names, "__parts", "__outer"])

    made = grouped.mapInArrow(run, _schema(grouped, names, "__parts array<array<array<double>>>, __outer long"))
    parts = F.expr("transform(__parts, ring -> transform(ring, p -> named_struct('x', p[0], 'y', p[1])))")
    kind = F.when(F.col("__outer") == 1, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    return made.where("__outer > 0").select(*names, G.geometry(kind, parts).alias("geom"))


def _outlined(shapes: DataFrame, unit: float) -> DataFrame:
    """Rows whose last column has all pieces of an outline, with the ``geom`` they make instead; none without area."""
    names = shapes.columns[:-1]
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, ring, of, outer = O.outlines(*_edges(batch.column(n)))
            rings = np.r_[0, np.cumsum(np.bincount(ring, minlength=len(of)))]
            parts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(batch)))]
            dots = pa.StructArray.from_arrays([pa.array(points[:, k] * unit) for k in (0, 1)], names=["x", "y"])
            for stops in (rings, parts):
                dots = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), dots)
            found = pa.array(np.bincount(of[outer], minlength=len(batch)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], dots, found], names=[*names, "__parts", "__outer"])

    made = shapes.mapInArrow(run, _schema(shapes, names, "__parts array<array<struct<x: double, y: double>>>, __outer long"))
    kind = F.when(F.col("__outer") == 1, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    return made.where("__outer > 0").select(*names, G.geometry(kind, F.col("__parts")).alias("geom"))


def dissolve_polygons(polygons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The union of polygons, over all or per key, as a feature table of one row each.

    Polygons may overlap, touch, lie in one another and have holes; other kinds and rows without a
    geometry are left out. Outer rings are counter-clockwise, largest first, each followed by its holes,
    which are clockwise. Coordinates are kept to the last bits of a double, points on straight lines are
    dropped. A key without any area has no row. Pieces of outlines are chained in blocks of cells; only
    the finished outline of a key is in one row.
    """
    by = list(by)
    crs = get_crs(polygons)
    found = polygons.where(F.expr(G.POLYGONAL) & F.col("xmin").isNotNull()).select(*by, "geom", *G.BOX)
    lattice = Lattice.of(found)
    none = found.limit(0).select(*by, "geom", *G.BOX)
    if lattice.bounds is None:
        return set_crs(none, crs)
    cells = _union_cells(spread_small(found), lattice, by)
    x0, y0, x1, y1 = lattice.bounds
    cx0, cy0 = math.floor(x0 / lattice.size) - 1, math.floor(y0 / lattice.size) - 1
    across = max(x1 - x0, y1 - y0) / lattice.size + 3
    paths = cells.select(*by, (F.col("cx") - cx0).alias("bx"), (F.col("cy") - cy0).alias("by_"), F.explode("paths").alias("path"))
    closed = F.expr("path[0] = path[size(path) - 2] and path[1] = path[size(path) - 1]")
    done = None
    # One written step per 32-fold growth of the blocks: two for a grid of 1,024 by 1,024 cells.
    for _ in range(max(0, math.ceil(math.log2(across) / BLOCK_BITS) - 1)):
        blocks = paths.withColumns({c: F.shiftright(c, BLOCK_BITS) for c in ("bx", "by_")})
        step = checkpointed(_joined(blocks, [*by, "bx", "by_"]))
        rings = step.where(closed).select(*by, "path")
        done = rings if done is None else done.unionByName(rings)
        paths = step.where(~closed)
    rest = paths.select(*by, "path")
    rings = rest if done is None else done.unionByName(rest)
    return set_crs(G.with_box(_shapes(rings, by, lattice.unit)).select(*by, "geom", *G.BOX), crs)


def _grown(rings: list[np.ndarray], d: float) -> list[np.ndarray]:
    """What a buffer adds on the right of closed rings: a strip per edge, a wedge per corner that turns left."""
    out = []
    for ring in rings:
        step = np.diff(ring, axis=0)
        keep = (step != 0).any(1)
        a, b, step = ring[:-1][keep], ring[1:][keep], step[keep]
        normal = np.c_[step[:, 1], -step[:, 0]] / np.hypot(*step.T)[:, None] * d
        out += [np.array([p, p + n, q + n, q, p]) for p, q, n in zip(a, b, normal)]
        before = np.roll(normal, 1, 0)
        turn = np.arctan2(before[:, 0] * normal[:, 1] - before[:, 1] * normal[:, 0], (before * normal).sum(1))
        for p, n, t in zip(a, before, turn):
            if t <= 0:
                continue
            steps = max(1, int(t / (math.pi / 2 / QUAD_SEGMENTS) + 0.5))
            angle = math.atan2(n[1], n[0]) + t * np.arange(steps + 1) / steps
            out.append(np.vstack([p, p + d * np.c_[np.cos(angle), np.sin(angle)], p]))
    return out


def buffer_polygons(polygons: DataFrame, d: float) -> DataFrame:
    """The union of polygons, grown by ``d`` with round corners of 16 steps per quarter: one row.

    The union's outline is known first, so that only its edges grow, holes included; strips along edges and
    wedges at corners are united with it.
    """
    whole = dissolve_polygons(polygons)
    if d < 0:
        raise ValueError("polygons cannot be shrunk")
    if d == 0:
        return whole
    whole = checkpointed(whole.select("geom", *G.BOX))
    rings = whole.select(F.explode("geom.parts").alias("ring")).select(F.expr("flatten(transform(ring, p -> array(p.x, p.y)))").alias("ring"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _flat(_grown([_points(r) for r in _arrays(batch.column(0))], d))
            for start in range(0, len(made), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(made[start : start + 1000], pa.list_(pa.float64()))], names=["ring"])

    strips = rings.mapInArrow(run, "ring array<double>")
    ring = F.expr("transform(sequence(0, size(ring) div 2 - 1), k -> named_struct('x', ring[2 * k], 'y', ring[2 * k + 1]))")
    strips = G.with_box(strips.select(G.geometry("Polygon", F.array(ring)).alias("geom")))
    # Written once: the size of cells is found from the strips before they are cut.
    every = whole.unionByName(checkpointed(strips))
    return set_crs(dissolve_polygons(every), get_crs(polygons))


@dataclass(frozen=True)
class Region:
    """The union of a mask's polygons by cells: ``cx, cy, held, border`` (edges of its boundary, in units)."""

    df: DataFrame
    lattice: Lattice
    small: bool


def region(mask: DataFrame) -> Region:
    """The union of the polygons of ``mask`` in cells, written once; polygons may overlap."""
    found = mask.where(F.expr(G.POLYGONAL) & F.col("xmin").isNotNull()).select("geom", *G.BOX)
    lattice = Lattice.of(found)
    if lattice.bounds is None:
        empty = mask.sparkSession.createDataFrame([], "cx bigint, cy bigint, held boolean, border array<double>")
        return Region(empty, lattice, True)
    edges = "flatten(transform(paths, p -> flatten(transform(sequence(0, size(p) div 2 - 2), k -> slice(p, 2 * k + 1, 4)))))"
    cells = _union_cells(spread_small(found), lattice, []).select("cx", "cy", F.col("corner").alias("held"), F.expr(edges).alias("border"))
    cells = checkpointed(cells.where("held or size(border) > 0"))
    stored = cells.agg(F.coalesce(F.sum(F.size("border")), F.lit(0))).first()[0]
    return Region(cells, lattice, stored <= 2_000_000 and is_small(cells))


def clip_polygons(features: DataFrame, mask: Region, key: str) -> DataFrame:
    """Polygons of ``features`` within a region: attributes, ``key`` and the new ``geom``.

    Each feature meets the region cell by cell; the pieces of its cut outline are chained per feature. A feature
    that lies in the region as a whole keeps its geometry as it is.
    """
    lattice = mask.lattice
    if lattice.bounds is None:
        return features.limit(0).drop(*G.BOX)
    near = features.where(F.expr(G.POLYGONAL)).where(G.box_overlaps(*G.BOX, lattice.bounds))
    carried = [c for c in features.columns if c not in (key, "geom", *G.BOX)]
    whole = near.withColumn("__geom", F.col("geom"))
    cells = lattice.cells(lattice.rounded(whole), [key, *carried, "__geom"], within=lattice.bounds)
    # The geometry goes along in the one cell that holds its first point.
    first = F.expr("exists(starts, p -> p.x = rint(__geom.parts[0][0].x / {u}) * {u} and p.y = rint(__geom.parts[0][0].y / {u}) * {u})".format(u=G.num(lattice.unit)))
    cells = cells.withColumn("__geom", F.when(first, F.col("__geom"))).drop("starts")
    met = sized_join(cells, mask.df, ["cx", "cy"], "inner", small=mask.small).where("size(edges) > 0 or size(border) > 0")
    met = met.select(key, *carried, "__geom", "cx", "cy", "corner", "held", "edges", "border")
    n = 2 + len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cx, cy, corner, held = (batch.column(n + k).to_numpy(zero_copy_only=False) for k in range(4))
            (own, a), (border, b) = (_edges(batch.column(n + k)) for k in (4, 5))
            cell = np.concatenate([a, b])
            order = np.argsort(cell, kind="stable")
            owner = np.repeat([0, 1], [len(own), len(border)])
            w = lattice.units
            boxes = np.c_[cx * w, cy * w, (cx + 1) * w, (cy + 1) * w]
            corners = np.c_[corner.astype(bool), held.astype(bool)]
            pieces, at = O.boundaries(np.concatenate([own, border])[order], owner[order], cell[order], corners, boxes, O.intersection)
            pieces = pieces[np.argsort(at, kind="stable")]
            stops = 4 * np.r_[0, np.cumsum(np.bincount(at, minlength=len(batch)))]
            flat = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(pieces.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], flat], names=[*batch.schema.names[:n], "pieces"])

    cut = met.mapInArrow(run, _schema(met, [key, *carried, "__geom"], "pieces array<double>"))
    # Cells where nothing is left still bring attributes and the geometry; rows without any outline fall out in the end.
    # The parts are numbered, so that small rows of much work are not merged into few tasks.
    cut = cut.repartition(task_count(near), key)
    attributes = [F.first(c).alias(c) for c in carried]
    whole = cut.groupBy(key).agg(F.flatten(F.collect_list("pieces")).alias("pieces"), F.first("__geom", ignorenulls=True).alias("__geom"), *attributes)
    made = _outlined(whole.select(key, "__geom", *carried, "pieces").where("size(pieces) > 0"), lattice.unit)
    same = F.col("__geom").isNotNull()
    for size in (_outline, _ring_areas):
        same &= F.abs(size("__geom") - size("geom")) <= 1e-12 * size("geom")
    return made.withColumn("geom", F.when(same, F.col("__geom")).otherwise(F.col("geom"))).drop("__geom")


def _outline(geom: str) -> Column:
    edges = G.EDGES.replace("geom.parts", f"{geom}.parts")
    return F.expr(f"aggregate({edges}, 0D, (s, e) -> s + hypot(e.x2 - e.x1, e.y2 - e.y1))")


def _ring_areas(geom: str) -> Column:
    return F.aggregate(signed_areas(geom), F.lit(0.0), lambda total, a: total + F.abs(a))


def polygon_area(geom: str = "geom") -> Column:
    """Area of polygons whose holes turn the other way than their outer rings."""
    term = "(e.x1 - {g}.parts[0][0].x) * (e.y2 - {g}.parts[0][0].y) - (e.x2 - {g}.parts[0][0].x) * (e.y1 - {g}.parts[0][0].y)".format(g=geom)
    edges = G.EDGES.replace("geom.parts", f"{geom}.parts")
    return F.expr(f"abs(aggregate({edges}, 0D, (s, e) -> s + {term}) / 2)")
