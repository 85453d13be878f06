"""Union, buffer and intersection of polygons against points that are tested one by one."""

import math


import numpy as np
import pytest
from pyspark.sql import functions as F

import trackgrid as tg
from trackgrid.functions import overlay as O
from trackgrid.operators.features import length
from trackgrid.operators.overlay import Lattice

RNG = np.random.default_rng(3)


def star(cx, cy, r, n, hole):
    angle = np.sort(RNG.random(n)) * 2 * np.pi
    reach = r * (0.4 + 0.6 * RNG.random(n))
    ring = np.c_[cx + reach * np.cos(angle), cy + reach * np.sin(angle)]
    return [ring, (ring + [cx, cy] * np.array(2)) / 3] if hole else [ring]


def inside(rings, x, y):
    out = np.zeros(len(x), bool)
    for r in rings:
        for a, b in zip(r, np.roll(r, -1, 0)):
            with np.errstate(divide="ignore", invalid="ignore"):
                at = a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
            out ^= ((a[1] > y) != (b[1] > y)) & (x < at)
    return out


def polygons(n):
    return [star(*(RNG.random(2) * 8 + 1), RNG.random() * 2 + 0.3, int(RNG.integers(3, 25)), RNG.random() < 0.4) for _ in range(n)]


def boxes(n, at=15):
    return [[np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)] for x, y, w, h in RNG.integers(1, at, (n, 4))]


X, Y = RNG.random(6000) * 14, RNG.random(6000) * 14


@pytest.mark.parametrize("many", [10**6, 30])
@pytest.mark.parametrize("unit", [2.0**-20, 2.0**-44])
def test_kernel_holds_the_same_points(monkeypatch, many, unit):
    monkeypatch.setattr(O, "MANY", many)
    for trial in range(25):
        shapes = boxes(12, 10) if trial % 3 == 0 else polygons(2 if trial % 3 == 1 else 9)
        rounded = [[np.rint(r / unit) for r in p] for p in shapes]
        for holds, every in ((O.union, np.any), (O.intersection, np.all)):
            made = O.overlay_rings(rounded, holds)
            want = every([inside([r * unit for r in p], X, Y) for p in rounded], 0)
            off = inside([r[:-1] * unit for r in made], X, Y) != want
            assert all(min(distance(s, X[off][k : k + 1], Y[off][k : k + 1])[0] for s in shapes) < 9 * unit for k in range(off.sum()))
            signs = [O.area(r[:-1]) > 0 for r in made]
            assert not signs or signs[0]


def table(spark, shapes, **columns):
    rows = []
    for i, rings in enumerate(shapes):
        parts = None if rings is None else [[(float(x), float(y)) for x, y in np.vstack([r, r[:1]])] for r in rings]
        rows.append((i, i % 3, None if rings is None else ("Polygon", parts)))
    df = spark.createDataFrame(rows, "id long, k long, geom struct<kind: string, parts: array<array<struct<x: double, y: double>>>>")
    return tg.make_features(df, F.col("geom"))


def rings_of(row):
    return [np.array([(p["x"], p["y"]) for p in part])[:-1] for part in row["geom"]["parts"]]


def test_dissolve_holds_what_any_polygon_holds(spark):
    shapes = polygons(40) + boxes(10) + [None]
    layer = table(spark, shapes)
    whole = tg.dissolve_polygons(layer).collect()
    assert len(whole) == 1
    want = np.any([inside(s, X, Y) for s in shapes if s], 0)
    assert (inside(rings_of(whole[0]), X, Y) == want).all()
    parts = {r["k"]: r for r in tg.dissolve_polygons(layer, ["k"]).collect()}
    assert set(parts) == {0, 1, 2}
    for k, r in parts.items():
        assert (inside(rings_of(r), X, Y) == np.any([inside(s, X, Y) for i, s in enumerate(shapes) if s and i % 3 == k], 0)).all()


def test_dissolve_leaves_no_seams(spark):
    tiles = [[np.array([[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1]], float)] for x in range(40) for y in range(40) if (x, y) != (7, 7)]
    row = tg.dissolve_polygons(table(spark, tiles)).select("geom", tg.polygon_area().alias("a"), length().alias("l")).first()
    assert row["a"] == pytest.approx(1599) and row["l"] == pytest.approx(164)
    assert row["geom"]["kind"] == "Polygon" and [len(p) for p in row["geom"]["parts"]] == [5, 5]


def test_dissolve_of_nothing(spark):
    layer = table(spark, [None])
    assert tg.dissolve_polygons(layer).count() == 0 and tg.dissolve_polygons(layer.limit(0), ["k"]).count() == 0
    assert tg.clip_to_polygons(table(spark, boxes(3)), layer, kinds=["Polygon"]).count() == 0


def distance(rings, x, y):
    best = np.full(len(x), np.inf)
    for r in rings:
        for a, b in zip(r, np.roll(r, -1, 0)):
            d = b - a
            t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(d @ d, 1e-300), 0, 1)
            best = np.minimum(best, np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]))
    return best


@pytest.mark.parametrize("d", [0.05, 0.9])
def test_buffer_holds_what_is_near(spark, d):
    shapes = polygons(6)
    row = tg.buffer_polygons(table(spark, shapes), d).collect()
    assert len(row) == 1
    got = inside(rings_of(row[0]), X, Y)
    near = np.min([np.where(inside(s, X, Y), 0, distance(s, X, Y)) for s in shapes], 0)
    # Arcs are chords of 16 steps per quarter: they lie within the circle by this share.
    chord = d * (1 - math.cos(math.pi / 64)) + 1e-9
    assert not got[near > d + 1e-9].any() and got[near < d - chord].all()


def test_clip_keeps_holes_and_accepts_overlaps(spark):
    shapes, cutters = polygons(30), polygons(12) + boxes(4)
    got = {r["id"]: rings_of(r) for r in tg.clip_to_polygons(table(spark, shapes), table(spark, cutters), kinds=["Polygon"]).collect()}
    mask = np.any([inside(c, X, Y) for c in cutters], 0)
    for i, s in enumerate(shapes):
        assert (inside(got.get(i, []), X, Y) == (inside(s, X, Y) & mask)).all()


def test_clip_at_a_box_keeps_holes(spark):
    shapes = polygons(30)
    box = (2.0, 3.0, 7.5, 8.25)
    got = {r["id"]: rings_of(r) for r in tg.clip_to_box(table(spark, shapes), box).collect()}
    mask = (X >= box[0]) & (X <= box[2]) & (Y >= box[1]) & (Y <= box[3])
    for i, s in enumerate(shapes):
        assert (inside(got.get(i, []), X, Y) == (inside(s, X, Y) & mask)).all()


def test_what_lies_within_stays_as_it_is(spark):
    layer = table(spark, polygons(8))
    around = table(spark, [[np.array([[-50, -50], [50, -50], [50, 50], [-50, 50]], float)]])
    got = tg.clip_to_polygons(layer, around, kinds=["Polygon"])
    assert {r["id"]: r["geom"] for r in got.collect()} == {r["id"]: r["geom"] for r in layer.collect()}


def test_equal_ids_and_other_kinds(spark):
    layer = table(spark, polygons(4)).withColumn("id", F.lit(1))
    around = table(spark, [[np.array([[-50, -50], [50, -50], [50, 50], [-50, 50]], float)]])
    assert tg.clip_to_polygons(layer, around, "id").count() == 4
    with pytest.raises(Exception, match="cannot cut a feature of the kind Polygon"):
        tg.clip_to_polygons(layer, around, "id", ["LineString"]).count()
    with pytest.raises(ValueError):
        tg.clip_to_polygons(layer, around, "id", ["Circle"])


def test_mask_with_buffer_and_clip(spark):
    mask, layer = table(spark, polygons(5)), table(spark, polygons(20))
    out = tg.subset_features(spark, layer, bounding_geom=mask, boundary_type="mask", buffer=0.05, clip=True, kinds=["Polygon"])
    wide = out.boundary.collect()
    assert len(wide) == 1 and out.within > 0
    held = inside(rings_of(wide[0]), X, Y)
    got = {r["id"]: rings_of(r) for r in out.subset.collect()}
    for r in layer.collect():
        assert (inside(got.get(r["id"], []), X, Y) == (inside(rings_of(r), X, Y) & held)).all()


def test_lattice_rounds_to_its_unit(spark):
    layer = table(spark, polygons(3))
    lattice = Lattice.of(layer)
    moved = lattice.rounded(layer).collect()
    for a, b in zip(layer.orderBy("id").collect(), sorted(moved, key=lambda r: r["id"])):
        for p, q in zip(np.concatenate(rings_of(a)), np.concatenate(rings_of(b))):
            assert abs(p - q).max() <= lattice.unit / 2 and ((q / lattice.unit) % 1 == 0).all()
