import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import stand_ins as S
import trackgrid as tg
from conftest import rows
from trackgrid.functions import geometry as G
from trackgrid.functions.projection import ALBERS, normalise, reproject


def convert(spark, pts, a, b):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")
    x, y = reproject(F.col("x"), F.col("y"), a, b)
    return np.array([tuple(r) for r in df.select(x, y).collect()])


PTS = [(-123.0, 49.0), (-130.5, 60.25), (-111.0, 33.3), (-120.0, 1.0), (-121.5, -0.5)]
SYSTEMS = ["EPSG:3857", "MODIS", "EPSG:32610", "EPSG:32710", *ALBERS]


@pytest.mark.parametrize("crs", SYSTEMS)
def test_there_and_back(spark, crs):
    back = convert(spark, convert(spark, PTS, 4326, crs), crs, 4326)
    assert np.abs(back - PTS).max() < 1e-7


def test_known_places(spark):
    assert convert(spark, [(180, 0), (0, 0)], 4326, 3857) == pytest.approx(np.array([[20037508.342789244, 0], [0, 0]]), abs=1e-6)
    # On the central meridian of zone 10 the northing is the meridian arc, scaled.
    east, north = convert(spark, [(-123, 49)], 4326, 32610)[0]
    e2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
    phi = (np.arange(200_000) + 0.5) / 200_000 * math.radians(49)
    arc = (6378137.0 * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).mean() * math.radians(49)
    assert east == pytest.approx(500000, abs=1e-6) and north == pytest.approx(arc * 0.9996, abs=1e-3)
    assert convert(spark, [(-126, 45)], 4326, 3005)[0] == pytest.approx([1_000_000, 0], abs=1e-6)
    assert convert(spark, [(0, 0), (0, 90)], 4326, "MODIS")[1][1] == pytest.approx(math.pi / 2 * 6371007.181)


@pytest.mark.parametrize("crs", list(ALBERS))
def test_albers_keeps_area(spark, crs):
    """A small square far from the parallels has the area it has on the ellipsoid."""
    d, lon, lat = 1e-3, -110.0, 40.0
    p = convert(spark, [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d)], 4326, crs)
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p - p[0], np.roll(p - p[0], -1, axis=0)))) / 2
    e2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
    phi = math.radians(lat + d / 2)
    w = 1 - e2 * math.sin(phi) ** 2
    true = 6378137.0**2 * (1 - e2) / w**2 * math.cos(phi) * math.radians(d) ** 2
    assert area == pytest.approx(true, rel=1e-6)


def test_unknown_systems(spark):
    assert normalise("urn:ogc:def:crs:EPSG::4326") == normalise(4326) == normalise("OGC:CRS84") == normalise(None)
    with pytest.raises(ValueError):
        reproject(F.lit(1.0), F.lit(1.0), 4326, 27700)


def test_subset_options(spark, sf):
    roads, tracks = S.roads(spark, sf), S.view(spark, sf, "tracks")
    with pytest.raises(TypeError):
        tg.subset_features(spark, roads)
    with pytest.raises(TypeError):
        tg.subset_features(spark, roads, bbox=(0, 0, 1, 1), track_points=tracks)
    with pytest.raises(TypeError):
        tg.subset_features(spark, roads, track_points=tracks, boundary_type="mask")
    with pytest.raises(ValueError):
        tg.subset_features(spark, roads, track_points=tracks, boundary_type="circle")


def test_hull_subset_by_brute_force(spark, sf):
    """Roads against the widened hull of some tracks, edge by edge."""
    roads = S.roads(spark, sf)
    tracks = S.view(spark, sf, "tracks").where("location_long between -124 and -118 and location_lat + location_long < -70")
    out = tg.subset_features(spark, roads, track_points=tracks, boundary_type="convex_hull", buffer=0.05, id_col="road_id")
    ring = [(p["x"], p["y"]) for p in out.boundary.first()["geom"]["parts"][0]]
    pts = np.array([tuple(r) for r in tracks.select("location_long", "location_lat").collect()])
    hull_box = pts.min(axis=0), pts.max(axis=0)
    d = 0.05 * max(hull_box[1] - hull_box[0])
    xs, ys = zip(*ring)
    assert min(xs) == pytest.approx(hull_box[0][0] - d, abs=1e-3) and max(ys) <= hull_box[1][1] + d + 1e-9
    want = []
    for r in roads.collect():
        p, q = [(v["x"], v["y"]) for v in r["geom"]["parts"][0]]
        # A convex ring: the road meets it unless some share of it is outside every edge.
        t0, t1 = 0.0, 1.0
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            s0 = (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
            s1 = (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax)
            if s0 < 0 and s1 < 0:
                t0, t1 = 1.0, 0.0
            elif s0 < 0:
                t0 = max(t0, s0 / (s0 - s1))
            elif s1 < 0:
                t1 = min(t1, s0 / (s0 - s1))
        if t0 <= t1:
            want.append(r["road_id"])
    got = [r["road_id"] for r in out.subset.collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < roads.count()
    assert out.track_points is not None and out.bounding_geom is None


def test_subset_in_another_system_and_to_file(spark, sf, tmp_path):
    """A layer in metres, cut by a box in degrees and by features in degrees."""
    roads = S.roads(spark, sf)
    metric = tg.reproject_features(roads, 4326, 3857)
    box = (-123.0, 50.0, -117.0, 55.0)
    plain = tg.subset_features(spark, roads, bbox=box).subset
    moved = tg.subset_features(spark, metric, bbox=box, crs=3857, outfile=f"{tmp_path}/out.geojsonl").subset
    assert abs(plain.count() - moved.count()) <= 1
    assert tg.read_features(spark, f"{tmp_path}/out.geojsonl").count() == moved.count()
    zone = S.diamonds(spark, sf).where("zone_id = 12")
    a = tg.subset_features(spark, roads, bounding_geom=zone, boundary_type="mask", id_col="road_id", clip=True, kinds=["LineString"])
    b = tg.subset_features(spark, metric, bounding_geom=zone, boundary_type="mask", id_col="road_id", crs=3857)
    assert {r["road_id"] for r in a.subset.collect()} <= {r["road_id"] for r in b.subset.collect()}
    wide = tg.subset_features(spark, roads, bounding_geom=zone, boundary_type="mask", buffer=0.1, id_col="road_id")
    assert wide.within == pytest.approx(0.33) and wide.subset.count() > b.subset.count()


def test_rectangular_boundary_with_buffer_and_clip(spark, sf):
    zone = S.diamonds(spark, sf).where("zone_id = 12")
    out = tg.subset_features(spark, S.roads(spark, sf), bounding_geom=zone, buffer=0.1, clip=True, id_col="road_id", kinds=["LineString"])
    b = out.boundary.first()
    s = out.subset.agg(F.min("xmin"), F.max("ymax")).first()
    assert s[0] >= b["xmin"] - 1e-9 and s[1] <= b["ymax"] + 1e-9


def test_prepared_tracks(spark, sf):
    t = S.view(spark, sf, "tracks")
    half = t.where("timestamp < timestamp_ntz'2024-01-15'")
    out = tg.prepare_tracks(spark, [t], ref=S.view(spark, sf, "ref"), period_of=half, boundary_shape="convex_hull", buffer=0.1)
    assert out.tracks.count() == half.count() and "animal_taxon" in out.tracks.columns
    assert out.extent.count() == 1
    assert rows(tg.time_unit_domain(t, "timestamp", ["month", "year"]), "unit", "offered") == [("month", False), ("year", False)]


def test_box_in_degrees_on_a_projected_layer(spark):
    pts = [(1, -100.0, 55.0), (2, -96.0, 50.5), (3, -51.0, 59.0), (4, -49.0, 55.0), (5, -96.0, 49.9)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    x, y = tg.reproject(F.col("lon"), F.col("lat"), 4326, "ESRI:102001")
    point = G.geometry("Point", F.array(F.array(G.point(x, y))))
    layer = tg.set_crs(G.with_box(df.select("id", point.alias("geom"))), "ESRI:102001")
    out = tg.subset_features(spark, layer, bbox=(-140, 50, -50, 60), id_col="id")
    assert rows(out.subset, "id") == [(1,), (2,), (3,)]
    assert tg.get_crs(out.boundary) == "ESRI:102001"
    lines = G.geometry("LineString", F.array(F.array(G.point(x, y), G.point(x + 1000.0, y + 1000.0))))
    layer = tg.set_crs(G.with_box(df.select("id", lines.alias("geom"))), "ESRI:102001")
    assert rows(tg.subset_features(spark, layer, bbox=(-140, 50, -50, 60), id_col="id", clip=True).subset, "id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("key, view", [("c1_subset_all_tracks_hull", "tracks"), ("c1_subset_part_tracks_hull", "tracks_part")])
def test_registered_hulls_of_all_fixes_by_brute_force(spark, sf, key, view):
    """Every fix bounds the hull, and roads are compared with the hull by its distance alone."""
    import registered

    tracks = S.view(spark, sf, view)
    assert tracks.count() == S.table(spark, sf, "events").count()
    pts = sorted({tuple(r) for r in tracks.select("location_long", "location_lat").collect()})

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(half(pts) + half(pts[::-1]))
    d = 0.02 * max(np.ptp(np.array(pts), axis=0))
    nxt = np.roll(hull, -1, axis=0)

    def distance(p):
        e, v = nxt - hull, p - hull
        if (e[:, 0] * v[:, 1] - e[:, 1] * v[:, 0] >= 0).all():
            return 0.0
        t = np.clip((v * e).sum(1) / (e * e).sum(1), 0, 1)
        return float(np.hypot(*(v - t[:, None] * e).T).min())

    near, far = set(), set()
    for r in S.roads(spark, sf).collect():
        p, q = (np.array([v["x"], v["y"]]) for v in r["geom"]["parts"][0])
        low, high = 0.0, 1.0
        for _ in range(60):  # the distance from a convex set has one valley along a segment
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if distance(p + a * (q - p)) <= distance(p + b * (q - p)) else (a, high)
        least = min(distance(p + t * (q - p)) for t in (0.0, (low + high) / 2, 1.0))
        # Round corners are polygons of 16 steps per quarter, up to 0.13 % inside.
        if least <= 0.998 * d:
            near.add(r["road_id"])
        elif least > d + 1e-9:
            far.add(r["road_id"])
    got = {r["road_id"] for r in registered.QUERIES[key](spark, sf).collect()}
    assert near <= got and not got & far
    assert view == "tracks" or (near and far)
