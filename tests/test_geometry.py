import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import trackgrid as tg
from conftest import rows
from trackgrid.functions import geometry as G
from trackgrid.operators import boundary as B
from trackgrid.operators.features import explode_rings, length
from trackgrid.operators.spatial import polygon_cells, points_in_last_polygon

RNG = np.random.default_rng(11)


def star(cx, cy, n, r0, r1):
    a = np.sort(RNG.uniform(0, 2 * np.pi, n))
    r = RNG.uniform(r0, r1, n)
    pts = np.c_[cx + r * np.cos(a), cy + r * np.sin(a)].tolist()
    return pts + pts[:1]


# Non-convex polygons, one with a hole, one of two rings, all apart.
POLYGONS = {
    1: ("Polygon", [star(0, 0, 40, 1, 4), star(0, 0, 9, 0.2, 0.8)]),
    2: ("Polygon", [star(12, 1, 200, 2, 4)]),
    3: ("MultiPolygon", [star(-10, -10, 12, 1, 3), star(-10, 0, 12, 1, 3)]),
}


def table(spark, shapes, name="id"):
    data = [(k, kind, [[(float(x), float(y)) for x, y in p] for p in parts]) for k, (kind, parts) in shapes.items()]
    df = spark.createDataFrame(data, f"{name} long, kind string, parts {G.PARTS_TYPE}")
    return tg.make_features(df, G.geometry(F.col("kind"), F.col("parts"))).drop("kind", "parts")


def inside(parts, x, y):
    odd = False
    for ring in parts:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def meet(a, b):
    def side(p, q, r):
        return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    return side(*a, b[0]) * side(*a, b[1]) <= 0 and side(*b, a[0]) * side(*b, a[1]) <= 0


def segments(parts):
    return [(p, q) for ring in parts for p, q in zip(ring, ring[1:])]


@pytest.fixture(scope="module")
def mask(spark):
    return table(spark, POLYGONS, "zone").cache()


@pytest.fixture(scope="module")
def dots(spark):
    xy = RNG.uniform(-16, 18, (4000, 2))
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double").cache()


@pytest.fixture(scope="module")
def held(dots):
    return {(r["pid"], k) for r in dots.collect() for k, (_, parts) in POLYGONS.items() if inside(parts, r["x"], r["y"])}


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("cell", [None, 0.3, 50.0])
def test_points_in_polygons(dots, mask, held, small, cell):
    cells = polygon_cells(mask, ["zone"], cell_size=cell, small=small)
    got = tg.points_in_polygons(dots, cells, "x", "y", ["zone"])
    assert {(r["pid"], r["zone"]) for r in got.collect()} == held
    some = {p for p, _ in held}
    semi = tg.points_in_polygons(dots, cells, "x", "y", how="left_semi")
    anti = tg.points_in_polygons(dots, cells, "x", "y", how="left_anti")
    assert {r["pid"] for r in semi.collect()} == some
    assert semi.count() + anti.count() == dots.count()


def test_cells_are_measured(mask):
    assert polygon_cells(mask).small
    from trackgrid.operators import spatial

    survey = spatial._survey(mask)
    assert not spatial._surely_fits(survey, 1e-4, 0.0)
    cells = polygon_cells(mask, cell_size=0.3)
    real = cells.df.agg(F.count(F.lit(1)), F.sum(F.size("touching"))).first()
    assert spatial._surely_fits(survey, 0.3, 0.0) and real[0] > 100


def test_last_polygon_wins(spark, dots):
    boxes = spark.createDataFrame([(1, 0., 0., 6., 6.), (2, 3., 3., 9., 9.)], "z int, xmin double, ymin double, xmax double, ymax double")
    cut = polygon_cells(tg.box_features(boxes), ["z"])
    got = {r["pid"]: r["z"] for r in points_in_last_polygon(dots, cut, "x", "y", "z").collect()}
    for r in dots.collect():
        want = 2 if 3 < r["x"] < 9 and 3 < r["y"] < 9 else 1 if 0 < r["x"] < 6 and 0 < r["y"] < 6 else None
        assert got.get(r["pid"]) == want


@pytest.fixture(scope="module")
def layer():
    shapes = {}
    for i in range(250):
        x, y = RNG.uniform(-16, 18, 2)
        steps = RNG.normal(0, 1.2, (RNG.integers(1, 6), 2))
        pts = [(x, y)] + [tuple(v) for v in np.array([x, y]) + np.cumsum(steps, axis=0)]
        if i % 3 == 0:
            shapes[i] = ("LineString", [pts])
        elif i % 3 == 1:
            ring = star(x, y, 8, 0.3, 6 if i % 30 == 1 else 1.5)
            shapes[i] = ("Polygon", [ring])
        else:
            shapes[i] = ("Point", [[(x, y)]])
    return shapes


def meets_mask(kind, parts):
    for _, rings in POLYGONS.values():
        if any(inside(rings, *p[0]) for p in parts):
            return True
        if kind != "Point" and any(meet(a, b) for a in segments(parts) for b in segments(rings)):
            return True
        if kind == "Polygon" and any(inside(parts, *ring[0]) for ring in rings):
            return True
    return False


def distance(kind, parts):
    def to_segment(p, s):
        (ax, ay), (bx, by) = s
        l2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(max(((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / l2, 0), 1) if l2 else 0
        return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))

    best = math.inf
    for _, rings in POLYGONS.values():
        for s in segments(rings):
            for own in segments(parts) or [(parts[0][0], parts[0][0])]:
                best = min(best, *(to_segment(p, s) for p in own), *(to_segment(p, own) for p in s))
    return best


@pytest.mark.parametrize("id_col", ["id", None])
def test_filter_polygon(spark, mask, layer, id_col):
    want = {i for i, (kind, parts) in layer.items() if meets_mask(kind, parts)}
    got = tg.filter_polygon(table(spark, layer), mask, id_col)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_filter_polygon_within_distance(spark, mask, layer):
    want = {i for i, (kind, parts) in layer.items() if meets_mask(kind, parts) or distance(kind, parts) <= 0.7}
    got = tg.filter_polygon(table(spark, layer), mask, "id", within=0.7)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_filter_bbox(spark, layer):
    box = (-3.0, -2.0, 4.0, 5.0)
    ring = [(-3, -2), (-3, 5), (4, 5), (4, -2), (-3, -2)]
    want = set()
    for i, (kind, parts) in layer.items():
        hit = any(-3 <= x <= 4 and -2 <= y <= 5 for part in parts for x, y in part)
        hit = hit or any(meet(a, b) for a in segments(parts) for b in segments([ring]) if kind != "Point")
        if hit or (kind == "Polygon" and inside(parts, -3, -2)):
            want.add(i)
    assert {r["id"] for r in tg.filter_bbox(table(spark, layer), box).collect()} == want


def test_clip_lines_to_polygons(spark, mask, layer):
    lines = {i: s for i, s in layer.items() if s[0] == "LineString"}
    got = {r["id"]: r for r in tg.clip_to_polygons(table(spark, lines), mask, "id", ["LineString"]).withColumn("len", length()).collect()}
    for i, (_, parts) in lines.items():
        total = 0.0
        for (x1, y1), (x2, y2) in segments(parts):
            t = (np.arange(100) + 0.5) / 100
            n = sum(any(inside(r, x1 + s * (x2 - x1), y1 + s * (y2 - y1)) for _, r in POLYGONS.values()) for s in t)
            total += math.hypot(x2 - x1, y2 - y1) * n / 100
        assert (got[i]["len"] if i in got else 0.0) == pytest.approx(total, abs=0.15)


def test_clipped_line_keeps_its_vertices(spark):
    """Inside one polygon nothing is added: cells leave no trace."""
    line = {1: ("LineString", [[(0.5, 0.5), (6.5, 3.5), (7.5, 12.0), (30.0, 12.0)]])}
    wide = spark.createDataFrame([(1, 0., 0., 20., 20.)], "z int, xmin double, ymin double, xmax double, ymax double")
    for cut in (tg.clip_to_polygons(table(spark, line), tg.box_features(wide), "id", ["LineString"]),
                tg.clip_to_box(table(spark, line), (0, 0, 20, 20))):
        r = cut.first()
        assert r["geom"]["kind"] == "LineString"
        assert [(p["x"], p["y"]) for p in r["geom"]["parts"][0]] == [(0.5, 0.5), (6.5, 3.5), (7.5, 12.0), (20.0, 12.0)]
        assert r["xmax"] == 20.0


def test_clip_polygons(spark, mask, layer):
    shapes = {i: s for i, s in layer.items() if s[0] == "Polygon"}
    got = {r["id"]: r["a"] for r in tg.clip_to_polygons(table(spark, shapes), mask, "id", ["Polygon"]).select("id", tg.polygon_area().alias("a")).collect()}
    grid = [(x, y) for x in np.arange(0.5, 30) / 30 for y in np.arange(0.5, 30) / 30]
    for i, (_, parts) in list(shapes.items())[:30]:
        xs, ys = zip(*parts[0])
        w, h = max(xs) - min(xs), max(ys) - min(ys)
        n = sum(inside(parts, min(xs) + u * w, min(ys) + v * h)
                and any(inside(r, min(xs) + u * w, min(ys) + v * h) for _, r in POLYGONS.values()) for u, v in grid)
        assert got.get(i, 0.0) == pytest.approx(n / len(grid) * w * h, abs=0.04 * w * h + 0.01)


def test_clip_box_by_kind(spark, layer):
    box = (-3.0, -2.0, 4.0, 5.0)
    cut = tg.clip_to_box(table(spark, layer), box)
    for r in cut.collect():
        assert box[0] - 1e-9 <= r["xmin"] and r["xmax"] <= box[2] + 1e-9 and box[1] - 1e-9 <= r["ymin"] and r["ymax"] <= box[3] + 1e-9
    points = {i for i, (k, p) in layer.items() if k == "Point" and -3 <= p[0][0][0] <= 4 and -2 <= p[0][0][1] <= 5}
    assert {r["id"] for r in cut.where("geom.kind = 'Point'").collect()} == points


@pytest.mark.parametrize("by", [[], ["k"]])
def test_convex_hull(spark, by):
    xy = np.round(RNG.normal(size=(5000, 2)) * 30) / 10
    df = spark.createDataFrame([(int(i % 7), float(x), float(y)) for i, (x, y) in enumerate(xy)], "k long, lon double, lat double").repartition(6)
    got = tg.convex_hull(df, "lon", "lat", by).orderBy(*by, "vertex").collect()
    groups = {None: xy} if not by else {k: xy[np.arange(5000) % 7 == k] for k in range(7)}
    for k, pts in groups.items():
        ring = np.array([(r["x"], r["y"]) for r in got if not by or r["k"] == k])
        nxt = np.roll(ring, -1, axis=0)
        # Every point is left of every edge, and every vertex is a point.
        for a, b in zip(ring, nxt):
            assert ((b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0]) >= -1e-12).all()
        assert set(map(tuple, ring)) <= set(map(tuple, pts))


def test_hull_of_few_points(spark):
    df = spark.createDataFrame([(1., 1.), (1., 1.), (2., 2.), (3., 3.)], "x double, y double")
    assert rows(tg.convex_hull(df, "x", "y"), "x", "y") == [(1.0, 1.0), (3.0, 3.0)]
    assert rows(tg.convex_hull(df.limit(1), "x", "y"), "x", "y") == [(1.0, 1.0)]
    assert tg.convex_hull(df.limit(0), "x", "y").count() == 0


def test_large_partitions_flush(monkeypatch):
    monkeypatch.setattr(B, "_HELD", 100)
    import pandas as pd

    pdf = pd.DataFrame({"k": [1, 2] * 50, "x": RNG.normal(size=100), "y": RNG.normal(size=100)})
    once = B._reduce(pdf, ["k"])
    twice = B._reduce(pd.concat([B._reduce(pdf[:50], ["k"]), B._reduce(pdf[50:], ["k"])]), ["k"])
    assert set(map(tuple, once.to_numpy())) == set(map(tuple, twice.to_numpy()))


def test_buffers():
    square = [(0, 0), (0, 2), (2, 2), (2, 0)]
    grown = B.buffer_convex(square, 1.0)
    assert sorted((round(x, 9), round(y, 9)) for x, y in grown) == [(-1, -1), (-1, 3), (3, -1), (3, 3)]
    round_ = B.buffer_convex(square, 1.0, "round")
    assert len(round_) == 4 * 17
    for x, y in round_:
        dx, dy = max(0 - x, 0, x - 2), max(0 - y, 0, y - 2)
        assert math.hypot(dx, dy) == pytest.approx(1.0)
    sliver = B.buffer_convex([(0, 0), (10, 0.1), (10, -0.1)], 1.0)
    assert max(abs(x) for x, _ in sliver) < 16
    assert B.buffer_distance((0, 0, 4, 10), 0.2) == 2.0


def test_extent_without_buffer(spark, dots):
    for shape in ("rectangular", "convex_hull"):
        r = tg.tracks_extent(dots, shape, x="x", y="y").first()
        lo, hi = dots.agg(F.min("x"), F.max("y")).first()
        assert r["xmin"] == lo and r["ymax"] == hi
    with pytest.raises(ValueError):
        tg.tracks_extent(dots, "circle")


def test_dissolve_splits_and_dedupes(spark):
    df = spark.createDataFrame([(1, float(i % 50), float(i % 50)) for i in range(500)] + [(2, 0.0, 0.0)],
                               "deployment_id long, location_long double, location_lat double")
    multi = tg.dissolve_points(df, part_size=10)
    assert rows(explode_rings(multi, "deployment_id"), "deployment_id", "x") == sorted([(1, float(i)) for i in range(50)] + [(2, 0.0)])
    assert multi.where("deployment_id = 1").count() > 1
    whole = tg.dissolve_points(df, by=[], part_size=1000)
    assert whole.count() == 1 and len(whole.first()["geom"]["parts"]) == 50


def test_rings_without_area_are_grown_round():
    from trackgrid.operators.boundary import buffer_convex

    def extent(ring):
        xs, ys = zip(*ring)
        return pytest.approx((min(xs), min(ys), max(xs), max(ys)))

    assert (1.0, 0.0, 5.0, 4.0) == extent(buffer_convex([(3, 2)], 2.0))
    for ring in ([(0, 0), (0, 10)], [(0, 0), (0, 10), (0, 10), (0, 0)]):
        for join in ("mitre", "round"):
            assert (-1.0, -1.0, 1.0, 11.0) == extent(buffer_convex(ring, 1.0, join))


def test_boundaries_of_degenerate_tracks(spark):
    import trackgrid as tg

    line = spark.createDataFrame([(-120.0, 50.0 + k) for k in range(5)], "location_long double, location_lat double")
    hull = tg.tracks_extent(line, "convex_hull", 0.1).first()
    assert hull["xmin"] == pytest.approx(-120.4) and hull["ymax"] == pytest.approx(54.4)
    with pytest.raises(ValueError, match="nothing to draw"):
        tg.tracks_extent(line.limit(0), "convex_hull")
