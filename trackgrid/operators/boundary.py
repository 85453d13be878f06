"""Boundaries: envelope, convex hull, buffers, and the extent of tracks.

A boundary is a feature table of one or a few polygons. Its ring is small
whatever the input was (a hull of tracks has a few dozen vertices), so ring
arithmetic is done on the driver; finding the ring is a Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sizing import plan_bytes

# Points a task holds before it reduces them to hulls, and vertices it keeps
# before it hands them on.
_HELD, _KEPT = 500_000, 250_000
# Hulls of one key that the last step should see at most, about.
_LAST_HULLS = 1000
# Bytes a task reads, by Spark's default.
_TASK_BYTES = 128 * 1024 * 1024
# Arc steps per quarter circle of a round buffer.
QUAD_SEGMENTS = 16


def ring_feature(spark: SparkSession, ring: Sequence[tuple[float, float]]) -> DataFrame:
    """A one-row feature table holding one polygon."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return spark.range(1).select(
        G.geometry("Polygon", F.array(G.ring_of(ring))).alias("geom"),
        *[F.lit(float(v)).alias(n) for n, v in zip(G.BOX, (min(xs), min(ys), max(xs), max(ys)))],
    )


def envelope(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Box of the points, over all or per key. Partial aggregates only."""
    return df.groupBy(*by).agg(
        F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")
    )


def feature_envelope(features: DataFrame) -> DataFrame:
    return features.agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
    )


def hull(xy: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise, by monotone chain."""
    rows = sorted(set(map(tuple, _extreme_candidates(xy).tolist())))
    if len(rows) < 3:
        return np.array(rows, float).reshape(-1, 2)

    def chain(rows):
        out: list = []
        for px, py in rows:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0:
                    break
                out.pop()
            out.append((px, py))
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def _extreme_candidates(pts: np.ndarray) -> np.ndarray:
    """Drop points strictly inside the polygon of extremes in 16 directions."""
    if len(pts) < 64:
        return pts
    angle = np.arange(16) * (np.pi / 8)
    far = np.argmax(pts @ np.vstack([np.cos(angle), np.sin(angle)]), axis=0)
    corners = pts[far[np.r_[True, far[1:] != far[:-1]]]]
    if len(corners) > 1 and (corners[0] == corners[-1]).all():
        corners = corners[:-1]
    if len(corners) < 3:
        return pts
    nxt = np.roll(corners, -1, axis=0)
    inside = np.ones(len(pts), bool)
    span = np.ptp(pts, axis=0).max() ** 2
    for a, b in zip(corners, nxt):
        cross = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
        inside &= cross > 1e-9 * span
    return pts[~inside]


def _reduce(pdf: pd.DataFrame, by: list[str], number: bool = False) -> pd.DataFrame:
    """Hull vertices per key of a table of ``by, x, y``."""
    xy = pdf[["x", "y"]].to_numpy(float)
    if by:
        group = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(pdf) else np.array([], int)
        hulls = [hull(xy[rows]) for rows in np.split(order, starts[1:])]
        keys = pdf[by].iloc[order[starts].repeat([len(h) for h in hulls])].reset_index(drop=True)
    else:
        hulls, keys = [hull(xy)], pd.DataFrame()
    out = keys.copy()
    if number:
        out["vertex"] = np.concatenate([np.arange(len(h), dtype="int32") for h in hulls])
    verts = np.vstack(hulls)
    out["x"], out["y"] = verts[:, 0], verts[:, 1]
    return out


def convex_hull(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Hull vertices, over all points or per key.

    Columns: the keys, ``vertex`` (0-based, counter-clockwise), ``x``, ``y``.
    Every task reduces its points to hulls, so only vertices are shuffled. If
    the input is read by many tasks, their hulls are merged in slices before
    the last step merges the slices of a key; no step holds all points of a
    key. Valid because hull(A ∪ B) = hull(hull(A) ∪ hull(B)).
    """
    by = list(by)
    keyed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}," for f in keyed.schema.fields if f.name in by)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) > _HELD:
                held = [_reduce(pd.concat(held), by)]
                if len(held[0]) > _KEPT:
                    yield held.pop()
        if held:
            yield _reduce(pd.concat(held), by)

    def by_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come ordered by key: all but the last key of a batch are whole.
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            group = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            open_run = group == group[-1]
            rest = pdf[open_run]
            if len(rest) > _HELD:
                rest = _reduce(rest, by)
            if not open_run.all():
                yield _reduce(pdf[~open_run], by, number=True)
        if rest is not None:
            yield _reduce(rest, by, number=True)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = _reduce(pdf if held is None else pd.concat([held, pdf]), by)
        if held is not None and len(held):
            yield _reduce(held, by, number=True)

    hulls = keyed.mapInPandas(local, f"{keys} x double, y double")
    slices = int(plan_bytes(keyed) / _TASK_BYTES / _LAST_HULLS)
    if slices > 1:
        sliced = hulls.repartition(*by, F.pmod(F.xxhash64("x", "y"), F.lit(slices)))
        hulls = sliced.mapInPandas(local, f"{keys} x double, y double")
    out = f"{keys} vertex int, x double, y double"
    if by:
        return hulls.repartition(*by).sortWithinPartitions(*by).mapInPandas(by_runs, out)
    return hulls.repartition(1).mapInPandas(whole, out)


def hull_features(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """One hull per key, as a feature table: a polygon, or a line or point if the fixes have no area."""
    verts = convex_hull(df, x, y, by)
    rings = verts.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("vertex", "x", "y"))).alias("v")
    )
    ring = F.transform("v", lambda p: G.point(p["x"], p["y"]))
    n = F.size("v")
    kind = F.when(n == 1, "Point").when(n == 2, "LineString").otherwise("Polygon")
    shaped = rings.select(*by, G.geometry(kind, F.array(F.when(n > 2, G.closed(ring)).otherwise(ring))).alias("geom"))
    return G.with_box(shaped)


def ring_extent(ring: Sequence[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return min(xs), min(ys), max(xs), max(ys)


def buffer_distance(extent: Sequence[float], buffer: float) -> float:
    """A buffer is relative: that share of the larger side of the extent."""
    x0, y0, x1, y1 = extent
    return buffer * max(abs(x1 - x0), abs(y1 - y0))


def expand_box(bbox: Sequence[float], d: float) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = bbox
    return x0 - d, y0 - d, x1 + d, y1 + d


def _ccw(ring):
    pts = [tuple(map(float, p)) for p in ring]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))
    return pts if area >= 0 else pts[::-1]


def buffer_convex(ring: Sequence[tuple[float, float]], d: float, join: str = "mitre") -> list[tuple[float, float]]:
    """Grow a convex ring by ``d`` with mitred or round corners.

    A mitre is cut off beyond five times the distance, which only happens at
    corners sharper than about 23 degrees. A ring without area, a point or a
    line, is grown with round ends.
    """
    if join not in ("mitre", "round"):
        raise ValueError("join is 'mitre' or 'round'")
    pts = _ccw(ring)
    pts = [p for p, before in zip(pts, pts[-1:] + pts[:-1]) if p != before] or pts[:1]
    if d == 0 or not pts:
        return pts
    if len(pts) == 1:
        (x, y), turns = pts[0], 4 * QUAD_SEGMENTS
        return [(x + d * math.cos(2 * math.pi * k / turns), y + d * math.sin(2 * math.pi * k / turns)) for k in range(turns)]
    if len(pts) == 2:
        join = "round"
    n = len(pts)
    normals = []
    for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
        length = math.hypot(bx - ax, by - ay)
        normals.append(((by - ay) / length, (ax - bx) / length))
    out = []
    for i, (px, py) in enumerate(pts):
        (n0x, n0y), (n1x, n1y) = normals[i - 1], normals[i]
        turn = math.pi if n == 2 else math.atan2(n0x * n1y - n0y * n1x, n0x * n1x + n0y * n1y)
        if join == "round":
            start = math.atan2(n0y, n0x)
            steps = max(1, int(turn / (math.pi / 2 / QUAD_SEGMENTS) + 0.5))
            out += [(px + d * math.cos(start + turn * k / steps), py + d * math.sin(start + turn * k / steps))
                    for k in range(steps + 1)]
            continue
        reach = 1 / math.cos(turn / 2)
        bx, by = n0x + n1x, n0y + n1y
        length = math.hypot(bx, by)
        bx, by = bx / length, by / length
        if reach <= 5.0:
            out.append((px + bx * d * reach, py + by * d * reach))
        else:
            cut = (5.0 - math.cos(turn / 2)) / math.sin(turn / 2)
            mx, my = px + bx * d * 5.0, py + by * d * 5.0
            out += [(mx + by * d * cut, my - bx * d * cut), (mx - by * d * cut, my + bx * d * cut)]
    return out


def hull_ring(df: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    """The hull of all points as a list: a few dozen vertices on the driver."""
    ring = [(r["x"], r["y"]) for r in convex_hull(df, x, y).orderBy("vertex").collect()]
    if not ring:
        raise ValueError("there is nothing to draw a boundary around")
    return ring


def tracks_extent(
    tracks: DataFrame,
    boundary_shape: str = "rectangular",
    buffer: float = 0,
    x: str = "location_long",
    y: str = "location_lat",
) -> DataFrame:
    """Boundary around all track points, grown by ``buffer`` with mitred corners.

    The result is a one-row feature table; without a buffer it is the plain
    boundary. The rectangular form stays lazy: it is one aggregate.
    """
    if boundary_shape == "rectangular":
        box = envelope(tracks, x, y)
        d = F.lit(float(buffer)) * F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
        grown = box.select(
            (F.col("xmin") - d).alias("xmin"), (F.col("ymin") - d).alias("ymin"),
            (F.col("xmax") + d).alias("xmax"), (F.col("ymax") + d).alias("ymax"),
        )
        return grown.select(G.box_polygon(*[F.col(c) for c in G.BOX]).alias("geom"), *G.BOX)
    if boundary_shape == "convex_hull":
        ring = hull_ring(tracks, x, y)
        grown = buffer_convex(ring, buffer_distance(ring_extent(ring), buffer))
        return ring_feature(tracks.sparkSession, grown)
    raise ValueError("boundary_shape is 'rectangular' or 'convex_hull'")
