"""Lines cut at a mask of many corners, whose cells keep but the edges that touch them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_overlay import inside, star, table

import trackgrid as tg
from trackgrid.operators.clip import _with_breaks
from trackgrid.operators.features import length
from trackgrid.operators.spatial import polygon_cells


def mask(spark):
    return table(spark, [star(4, 4, 3.5, 300, True), star(9, 5, 3.0, 200, False)])


def test_cut_lines_have_the_length_inside(spark):
    r = np.random.default_rng(11)
    ends = r.random((40, 4)) * 13
    rows = [(i, 5.0, ("LineString", [[(float(a), float(b)), (float(c), float(d))]])) for i, (a, b, c, d) in enumerate(ends)]
    # A column of a name that edges use inside.
    lines = tg.make_features(spark.createDataFrame(rows, "id long, x1 double, geom struct<kind: string, parts: array<array<struct<x: double, y: double>>>>"), F.col("geom"))
    layer = mask(spark)
    got = {r["id"]: r for r in tg.clip_to_polygons(lines, layer, kinds=["LineString"]).select("id", "x1", length().alias("l")).collect()}
    assert {g["x1"] for g in got.values()} == {5.0}
    shapes = [[np.array([(p["x"], p["y"]) for p in part])[:-1] for part in row["geom"]["parts"]] for row in layer.collect()]
    t = (np.arange(20000) + 0.5) / 20000
    for i, (a, b, c, d) in enumerate(ends):
        share = np.any([inside(s, a + t * (c - a), b + t * (d - b)) for s in shapes], 0).mean()
        whole = np.hypot(c - a, d - b)
        assert (got[i]["l"] if i in got else 0) == pytest.approx(share * whole, abs=2e-3 * whole)


def test_cells_keep_few_heights(spark):
    """Edges right of a cell, up to all of its row, come down to the ends where their number changes."""
    found = _with_breaks(polygon_cells(mask(spark))).where("edges is not null")
    row = found.select(F.sum(F.size("edges")), F.sum(F.size("touching") + F.size("breaks"))).first()
    assert row[1] * 2 < row[0]
