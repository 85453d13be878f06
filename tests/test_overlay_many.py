"""Cells and shapes worked out together against the same ones by themselves, and tables whose few files hold many rows."""

import numpy as np
from test_overlay import boxes, inside, polygons, rings_of, table

import trackgrid as tg
from trackgrid import sizing
from trackgrid.functions import overlay as O
from trackgrid.sizing import spread, task_count

UNIT = 2.0**-44


def cells(n):
    """Edges, owners, cells, corners and boxes of two polygons each; every second box cuts them."""
    edges, owners, cell, cut = [], [], [], []
    for k in range(n):
        some = [boxes(1, 10)[0] if k % 3 else polygons(1)[0], boxes(1, 10)[0] if k % 5 else polygons(1)[0]]
        own = [O.edges_of([np.rint(np.asarray(r) / UNIT) for r in p]) for p in some]
        every = np.concatenate(own)
        lo, hi = every.reshape(-1, 2).min(0) - 2, every.reshape(-1, 2).max(0) + 2
        edges.append(every)
        owners.append(np.repeat([0, 1], [len(e) for e in own]))
        cell.append(np.full(len(every), k))
        cut.append([*lo, *(np.floor((lo + hi) / 2) if k % 2 else hi)])
    return edges, owners, cell, np.zeros((n, 2), bool), np.array(cut)


def turned(ring):
    """A closed ring from its smallest point on."""
    at = min(range(len(ring) - 1), key=lambda k: tuple(ring[k]))
    return tuple(map(tuple, np.roll(ring[:-1], -at, 0)))


def test_cells_and_shapes_together_are_those_by_themselves(monkeypatch):
    monkeypatch.setattr(O, "TOGETHER", 3000)
    edges, owners, cell, corners, cut = cells(150)
    for holds in (O.intersection, O.union):
        pieces, at = O.boundaries(*map(np.concatenate, (edges, owners, cell)), corners, cut, holds)
        one = [O.boundary(edges[k], owners[k], corners[k], cut[k], holds) for k in range(len(cut))]
        assert any(map(len, one))
        for k, want in enumerate(one):
            assert sorted(map(tuple, pieces[at == k])) == sorted(map(tuple, want))
        order = np.argsort(at, kind="stable")
        points, ring, shape, outer = O.outlines(pieces[order], at[order])
        for k, some in enumerate(one):
            want = O.nested([r for rings in O.chain(list(some.reshape(-1, 2, 2))) for r in rings])
            got = [points[ring == r] for r in np.flatnonzero(shape == k)]
            assert sorted(map(turned, got)) == sorted(map(turned, want))
            assert outer[shape == k].tolist() == [O.area(r) > 0 for r in want]


def test_nothing_together():
    none, no = np.empty((0, 4)), np.empty(0, np.int64)
    assert [len(x) for x in O.boundaries(none, no, no, np.empty((3, 2), bool), np.zeros((3, 4)), O.union)] == [0, 0]
    assert [len(x) for x in O.outlines(none, no)] == [0, 0, 0, 0]


def test_cut_at_rings_with_holes(spark):
    """A mask of several outer rings with a hole each, around and across the shapes."""
    shapes = boxes(60) + polygons(10)
    mask = [[np.array([[x, 0], [x + 4, 0], [x + 4, 14], [x, 14]], float), np.array([[x + 1, 1], [x + 1, 2], [x + 2, 2], [x + 2, 1]], float)] for x in (0, 5, 10)]
    got = {r["id"]: rings_of(r) for r in tg.clip_to_polygons(table(spark, shapes), table(spark, mask), kinds=["Polygon"]).collect()}
    r = np.random.default_rng(7)
    x, y = r.random(4000) * 14, r.random(4000) * 14
    held = np.any([inside(m, x, y) for m in mask], 0)
    for i, s in enumerate(shapes):
        assert (inside(got.get(i, []), x, y) == (inside(s, x, y) & held)).all()


def test_costly_rows_are_spread_whatever_the_files(spark, monkeypatch):
    few = spark.range(2000).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 1000)
    assert spread(few).rdd.getNumPartitions() == task_count(few) >= 4 * spark.sparkContext.defaultParallelism
