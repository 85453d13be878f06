from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import trackgrid as tg
from conftest import rows
from trackgrid import GridFrame, RegularAxis
from trackgrid.operators import resample as R
from trackgrid.operators.axes import TableAxis, measure_axis
from trackgrid.operators.reshape import concat_time

START = datetime(2020, 1, 1)
LATS = [50.0, 49.0, 48.0, 47.0, 46.0]
LONS = [10.0, 10.5, 11.0, 11.5]


def make(spark, times=None, lats=LATS, lons=LONS, drop=lambda t, a, o: False, **kw):
    times = times or [START + timedelta(hours=6 * i) for i in range(12)]
    data = [(t, a, o, float(i * 100 + j * 10 + k)) for i, t in enumerate(times) for j, a in enumerate(lats)
            for k, o in enumerate(lons) if not drop(t, a, o)]
    return GridFrame.of(spark.createDataFrame(data, "time timestamp_ntz, lat double, lon double, v double"), **kw)


def values(grid):
    return {(r["time"], r["lat"], r["lon"]): r["v"] for r in grid.df.collect()}


def test_of_makes_nan_null_and_finds_roles(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0, 2.0, float("nan"), 3)], "timestamp string, Latitude double, long double, a double, b int")
    g = GridFrame.of(df)
    assert g.dims == ("timestamp", "Latitude", "long") and g.variables == ["a", "b"]
    assert g.df.first()["a"] is None and g.df.schema["timestamp"].dataType.typeName() == "timestamp_ntz"
    with pytest.raises(ValueError):
        GridFrame.of(df.drop("long"))
    with pytest.raises(ValueError):
        g.select_variables("c")


def test_axes_are_recognised(spark):
    g = make(spark)
    assert g.axis("lat") == RegularAxis(50.0, -1.0, 5)
    assert g.axis("lon") == RegularAxis(10.0, 0.5, 4)
    time = g.axis("time")
    assert (time.step, time.size) == (6 * 3_600_000_000, 12)
    with pytest.raises(ValueError):
        g.axis("height")


@pytest.mark.parametrize("descending", [False, True])
def test_irregular_axis_is_ranked(spark, descending):
    rng = np.random.default_rng(5)
    v = np.unique(np.r_[rng.normal(size=3000), rng.normal(size=500) * 1e-6])
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(np.r_[v, v])], "x double")
    axis = measure_axis(df, "x", descending)
    assert isinstance(axis, TableAxis) and axis.size == len(v)
    got = [r["value"] for r in axis.df.orderBy("idx").collect()]
    assert got == sorted(v.tolist(), reverse=descending)
    assert rows(axis.df, "idx") == [(i,) for i in range(len(v))]
    assert rows(axis.stride(7).df, "idx") == [(i,) for i in range(axis.stride(7).size)]


IRREGULAR = [0.0, 1.0, 3.0, 4.0, 9.0, 10.0, 20.0]


@pytest.mark.parametrize("lats", [LATS, IRREGULAR])
def test_thin_counts_from_the_north(spark, lats):
    g = make(spark, lats=lats).thin({"lat": 2, "time": 5})
    north = sorted(lats, reverse=True)[::2]
    assert {k[1] for k in values(g)} == set(north)
    assert len({k[0] for k in values(g)}) == 3
    # The thinned axis counts on.
    assert {k[1] for k in values(g.thin({"lat": 2}))} == set(north[::2])
    assert make(spark, lats=lats).thin(1).df.count() == 12 * len(lats) * 4
    with pytest.raises(ValueError):
        make(spark).thin({"height": 2})
    with pytest.raises(ValueError):
        make(spark).thin(0)


def brute_coarsen(grid_values, axes, windows, boundary, side):
    """Blocks by positions of dense axes; means over what is there."""
    out = {}
    spans = []
    for axis, w in zip(axes, windows):
        n = len(axis)
        over = n % w
        if boundary == "trim":
            keep = axis[: n - over] if side == "left" else axis[over:]
            spans.append([keep[i:i + w] for i in range(0, len(keep), w)])
        elif side == "left":
            spans.append([axis[i:i + w] for i in range(0, n, w)])
        else:
            first = over or w
            spans.append([axis[:first]] + [axis[i:i + w] for i in range(first, n, w)])
    for ts in spans[0]:
        for la in spans[1]:
            for lo in spans[2]:
                got = [grid_values[k] for k in ((t, a, o) for t in ts for a in la for o in lo) if k in grid_values]
                if got:
                    mid = ts[0] + sum(((t - ts[0]) for t in ts), timedelta()) / len(ts)
                    out[mid, round(float(np.mean(la)), 6), round(float(np.mean(lo)), 6)] = round(float(np.mean(got)), 6)
    return out


@pytest.mark.parametrize("boundary, side", [("trim", "left"), ("trim", "right"), ("pad", "left"), ("pad", "right")])
@pytest.mark.parametrize("lats", [LATS, IRREGULAR])
def test_coarsen(spark, boundary, side, lats):
    drop = lambda t, a, o: (t.hour == 6 and o == 10.5) or (a == lats[0] and t < START + timedelta(days=2))
    g = make(spark, lats=lats, drop=drop)
    got = g.coarsen({"time": 5, "lat": 2, "lon": 3}, boundary=boundary, side=side)
    want = brute_coarsen(values(g), [sorted({k[0] for k in values(g)}), sorted(lats, reverse=True), LONS], [5, 2, 3], boundary, side)
    assert {(k[0], round(k[1], 6), round(k[2], 6)): round(v, 6) for k, v in values(got).items()} == want


def test_coarsen_checks(spark):
    g = make(spark)
    with pytest.raises(ValueError, match="multiple"):
        g.coarsen({"lat": 2}, boundary="exact")
    assert g.coarsen({"lat": 5, "time": 4}, boundary="exact").df.count() == 3 * 4
    got = g.coarsen({"time": 12, "lat": 5}, coord_func={"time": "max", "lat": "min"})
    assert {k[:2] for k in values(got)} == {(START + timedelta(hours=66), 46.0)}
    for bad in ({"boundary": "wrap"}, {"side": "top"}, {"coord_func": "median"}):
        with pytest.raises(ValueError):
            g.coarsen({"lat": 2}, **bad).df


def test_downsample_fills_empty_bins(spark):
    times = [START + timedelta(hours=h) for h in (3, 9, 15, 80, 86)]
    g = make(spark, times=times, drop=lambda t, a, o: a == 46.0 and t.day > 1)
    got = values(g.resample_time(1, "day"))
    assert {k[0] for k in got} == {START + timedelta(days=d) for d in range(4)}
    assert len(got) == 4 * 5 * 4
    assert got[START, 50.0, 10.0] == 100.0 and got[START + timedelta(days=1), 50.0, 10.0] is None
    assert got[START + timedelta(days=3), 46.0, 10.0] is None
    bare = values(g.resample_time(1, "day", fill=False))
    assert bare == {k: v for k, v in got.items() if v is not None}


def test_bins_start_at_midnight(spark):
    times = [START + timedelta(hours=5 + h) for h in range(20)]
    got = values(make(spark, times=times, lats=[1.0], lons=[1.0]).resample_time(7, "hour"))
    assert sorted(k[0].hour for k in got) == [0, 7, 14, 21]


@pytest.mark.parametrize("chunk", [2, 3, 4096])
@pytest.mark.parametrize("hours", [(0, 6, 12, 18, 24, 30, 36), (0, 6, 14, 16, 30, 31, 36)])
def test_upsample_is_numpy_interp(spark, monkeypatch, chunk, hours):
    monkeypatch.setattr(R, "_CHUNK", chunk)
    times = [START + timedelta(hours=h) for h in hours]
    gap = times[3]
    g = make(spark, times=times, drop=lambda t, a, o: t == gap and a == 46.0)
    got = values(g.resample_time(2, "hour"))
    v = values(g)
    for a in LATS:
        for o in LONS:
            for h in range(0, 37, 2):
                t = START + timedelta(hours=h)
                lo = max(x for x in hours if x <= h)
                hi = min(x for x in hours if x >= h)
                ends = [v.get((START + timedelta(hours=x), a, o)) for x in (lo, hi)]
                want = None if None in ends else float(np.interp(h, (lo, hi), ends)) if lo != hi else ends[0]
                assert got.get((t, a, o)) == (pytest.approx(want) if want is not None else None), (t, a, o)


def test_resample_choices(spark):
    g = make(spark)
    assert g.resample_time(6, "hour") is g
    one = make(spark, times=[START])
    assert one.resample_time(1, "day") is one
    irregular = values(g.resample_time(9, "hour", interp_irreg=True, fill=False))
    fine = values(g.resample_time(3, "hour"))
    for (t, a, o), v in irregular.items():
        inside = [fine[t + timedelta(hours=h), a, o] for h in (0, 3, 6) if (t + timedelta(hours=h), a, o) in fine]
        assert v == pytest.approx(np.mean(inside))
    with pytest.raises(ValueError, match="multiplies"):
        g.resample_time(25.001, "hour", interp_irreg=True, max_growth=10)


def test_reindex_and_concat(spark):
    g = make(spark)
    part = g.select_time_range("2020-01-02", "2020-01-02")
    back = values(part.reindex_like(g))
    assert len(back) == 240 and sum(v is not None for v in back.values()) == 4 * 20
    axes = {"lat": RegularAxis(50.0, -1.0, 5), "lon": RegularAxis(10.0, 0.5, 4), "time": g.axis("time")}
    hole = make(spark, drop=lambda t, a, o: a == 48.0)
    full = values(hole.reindex_like(g.with_axes(axes)))
    assert full.keys() == values(g).keys() and full[START, 48.0, 10.0] is None and full[START, 47.0, 10.0] == 30.0
    both = concat_time([g.select_time_range(end="2020-01-01"), g.select_time_range(start="2020-01-02")])
    assert values(both) == values(g)


BOX = "zone int, xmin double, ymin double, xmax double, ymax double"


@pytest.fixture(scope="module")
def zones(spark):
    return tg.box_features(spark.createDataFrame([(1, 9.7, 47.6, 10.7, 49.4), (2, 10.9, 45.0, 12.0, 46.2)], BOX))


def test_spatial_selection_is_the_same_three_ways(spark, zones):
    g = make(spark)
    inside = lambda a, o: (47.6 < a < 49.4 and 9.7 < o < 10.7) or (a < 46.2 and 10.9 < o < 12)
    want = {k: v for k, v in values(g).items() if inside(k[1], k[2])}
    for strategy in ("auto", "cells", "rows"):
        assert values(g.select_spatial(zones, strategy=strategy)) == want
        assert values(g.select_spatial(zones, invert=True, strategy=strategy)).keys() == values(g).keys() - want.keys()
    null = values(g.select_spatial(zones, mode="null"))
    assert {k: v for k, v in null.items() if v is not None} == want
    assert {k[1] for k in null} == {49.0, 48.0, 47.0, 46.0} and {k[2] for k in null} == set(LONS)
    touched = values(g.select_spatial(zones, all_touched=True))
    boxes = [(9.7, 47.6, 10.7, 49.4), (10.9, 45.0, 12.0, 46.2)]
    meets = lambda a, o: any(o - 0.25 <= x1 and o + 0.25 >= x0 and a - 0.5 <= y1 and a + 0.5 >= y0 for x0, y0, x1, y1 in boxes)
    assert {k[1:] for k in touched} == {(a, o) for a in LATS for o in LONS if meets(a, o)}
    with pytest.raises(ValueError):
        g.select_spatial(zones, mode="null", strategy="rows")
    assert g.select_spatial(zones.where("zone > 5")).df.count() == 0


def test_cut_grid_keeps_its_axis(spark, zones):
    """An emptied row of cells still counts when the cut grid is thinned."""
    cut = make(spark).select_spatial(zones)
    assert cut.axis("lat") == RegularAxis(49.0, -1.0, 4)
    assert {k[1] for k in values(cut.thin({"lat": 3}))} == {49.0, 46.0}
    blocks = make(spark).select_spatial(zones).coarsen({"lat": 2})
    assert blocks.axis("lat") == RegularAxis(48.5, -2.0, 2) and blocks.axis("lon") == RegularAxis(10.0, 0.5, 4)
    uneven = make(spark, lats=[50.0, 49.0, 48.5, 47.0, 46.0]).select_spatial(zones)
    assert [r["value"] for r in uneven.axis("lat").df.orderBy("idx").collect()] == [49.0, 48.5, 47.0, 46.0]


def test_zonal_statistics(spark, zones):
    g = make(spark)
    v = values(g)
    want = [x for (t, a, o), x in v.items() if 47.6 < a < 49.4 and 9.7 < o < 10.7]
    for strategy in ("cells", "rows"):
        got = {r["zone"]: r for r in g.zonal_stats(zones, "zone", "v", strategy=strategy).collect()}
        assert got[1]["count"] == len(want) and got[1]["std"] == pytest.approx(np.std(want))
        assert got[1]["p25"] == pytest.approx(np.quantile(want, 0.25))
    by = g.zonal_stats(zones, "zone", "v", ["day", "hour"])
    assert by.columns[:3] == ["zone", "day", "hour"] and by.count() == 2 * 12
    shifted = tg.reproject_features(zones, 4326, 3857)
    same = g.zonal_stats(shifted, "zone", "v", polygons_crs=3857)
    assert rows(same, "zone", "count") == [(1, len(want)), (2, 24)]


def test_group_stats_units(spark):
    g = make(spark)
    assert g.group_stats("v").first()["count"] == 240
    assert g.group_stats("v", ["hour", "day"]).columns[:2] == ["hour", "day"]
    with pytest.raises(ValueError):
        g.group_stats("v", ["week"])


def test_thresholds(spark):
    g = make(spark)
    assert tg.count_exceeding(g.df, "v", 1000, ["lat"]).where("lat = 50").first()["n_exceeding"] == 7
    first = {r["lat"]: r["first_day"] for r in tg.first_day_exceeded(g.df, "v", 1140, by=["lat"]).collect()}
    assert first[50.0] is None and first[46.0].isoformat() == "2020-01-03"


@pytest.mark.parametrize("lats", [LATS, IRREGULAR])
@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_regrid(spark, lats, method):
    g = make(spark, lats=lats, times=[START], drop=lambda t, a, o: a == sorted(lats)[2] and o == 11.0)
    v = values(g)
    target = (RegularAxis(max(lats) + 0.3, -0.7, 12), RegularAxis(9.9, 0.3, 6))
    got = {(round(k[1], 9), round(k[2], 9)): x for k, x in values(g.regrid_to(target, method)).items() if x is not None}
    north = sorted(lats, reverse=True)
    for i in range(12):
        for j in range(6):
            a, o = target[0].first + i * target[0].step, 9.9 + 0.3 * j
            want = None
            if min(lats) <= a <= max(lats) and min(LONS) <= o <= max(LONS):
                a0, a1 = min(x for x in north if x >= a), max(x for x in north if x <= a)
                o0, o1 = max(x for x in LONS if x <= o + 1e-9), min(x for x in LONS if x >= o - 1e-9)
                fa = 0 if a0 == a1 else (a0 - a) / (a0 - a1)
                fo = 0 if o0 == o1 else (o - o0) / (o1 - o0)
                if method == "nearest":
                    # Irregular axes are ordered upwards there: a tie takes the lower value.
                    if abs(fa - 0.5) < 1e-9 or abs(fo - 0.5) < 1e-9:
                        continue
                    want = v.get((START, a0 if fa < 0.5 else a1, o0 if fo < 0.5 else o1))
                else:
                    parts = [((1 - fa) * (1 - fo), v.get((START, a0, o0))), (fa * (1 - fo), v.get((START, a1, o0))),
                             ((1 - fa) * fo, v.get((START, a0, o1))), (fa * fo, v.get((START, a1, o1)))]
                    parts = [(w, x) for w, x in parts if w > 1e-9]
                    want = None if any(x is None for _, x in parts) else sum(w * x for w, x in parts)
            assert got.get((round(a, 9), round(o, 9))) == (None if want is None else pytest.approx(want)), (a, o)


def test_interpolate_space(spark):
    got = values(tg.interpolate_space(make(spark, times=[START]), 0.5, 0.25))
    assert len(got) == 9 * 7 and got[START, 49.5, 10.25] == pytest.approx(5.5)
    with pytest.raises(ValueError):
        tg.interpolate_space(make(spark), 0, 1)


def test_explore_is_lazy_and_chained(spark, zones, tmp_path):
    out = tg.explore_grid(make(spark), variables=["v"], start="2020-01-01", end="2020-01-02", conditions={"hours": [0, 6, 12, 18]},
                          polygons=zones, resample=(1, "day"), stats_of="v", by=["day"], zones=zones, zone_id="zone",
                          grid_out=f"{tmp_path}/grid", stats_out=f"{tmp_path}/stats")
    assert [(r["zone"], r["day"]) for r in out.stats.collect()] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert spark.read.parquet(f"{tmp_path}/grid").count() == out.grid.df.count()
    with pytest.raises(ValueError):
        tg.explore_grid(make(spark), zones=zones)


def test_reindex_goes_by_position(spark):
    lats, lons = ([round(x + 0.1 * i, 1) for i in range(30)] for x in (47.0, 10.0))
    data = [(START, a, o, a + o) for a in lats for o in lons]
    g = GridFrame.of(spark.createDataFrame(data, "time timestamp_ntz, lat double, lon double, v double"))
    g = g.with_axes({d: g.axis(d) for d in g.dims})
    assert g.reindex_like(g).df.where("v is not null").count() == 900


def test_nan_passes_no_threshold(spark):
    df = spark.createDataFrame([(START, float("nan")), (START, 1.0), (START, None)], "time timestamp_ntz, v double")
    assert rows(tg.count_exceeding(df, "v", 5.0)) == [(0, 1)]
    assert rows(tg.first_day_exceeded(df, "v", 5.0), "first_day") == [(None,)]
    assert rows(tg.value_range(df, "v")) == [(1.0, 1.0)]
