import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import stand_ins as S
import trackgrid as tg
from conftest import rows
from trackgrid import GridFrame, RegularAxis
from trackgrid.operators.features import explode_rings
from trackgrid.streaming.tracks import append_parquet, stream_tracks

CSV = """event-id,visible,timestamp,location-long,location-lat,"tag-local-identifier",,visible
1,true,2009-05-01 10:00:00.000,-120.5,55.25,"B, 1",7,x
2,false,2009-05-01 11:30:00.500,,55.5,B2,8,y
"""


def test_tracks_from_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    df = tg.read_tracks(spark, f"{tmp_path}/t.csv")
    assert df.columns == ["event_id", "visible", "timestamp", "location_long", "location_lat", "tag_local_identifier",
                          "unnamed_6", "visible_1"]
    got = df.orderBy("event_id").collect()
    assert got[0]["timestamp"] == datetime(2009, 5, 1, 10) and got[1]["timestamp"] == datetime(2009, 5, 1, 11, 30, 0, 500000)
    assert got[0]["tag_local_identifier"] == "B, 1" and got[1]["location_long"] is None and got[0]["visible_1"] == "x"
    assert dict(df.dtypes)["event_id"] == "bigint" and dict(df.dtypes)["timestamp"] == "timestamp_ntz"


def test_tracks_need_coordinates(spark):
    with pytest.raises(KeyError):
        tg.read_tracks(spark, spark.range(1).toDF("deployment-id"))


def test_reference_and_merge(spark, tmp_path):
    (tmp_path / "ref.csv").write_text("Deployment ID,animal-sex,timestamp,x_ref\n5,f,2009,q\n,m,2010,r\n")
    ref, report = tg.read_ref(spark, f"{tmp_path}/ref.csv")
    assert ref.columns == ["deployment_id", "animal_sex", "timestamp", "x_ref"] and report["cleaned"] == 2
    tracks = spark.createDataFrame([(5, "a"), (6, "b"), (None, "c")], "deployment_id long, timestamp string")
    merged = tg.merge_tracks_ref(tracks, ref)
    # Track columns win; a name holding "_ref" stays; null keys meet.
    assert merged.columns == ["deployment_id", "timestamp", "animal_sex", "x_ref"]
    assert rows(merged, "timestamp", "animal_sex") == [("a", "f"), ("b", None), ("c", "m")]
    with pytest.raises(KeyError):
        tg.merge_tracks_ref(tracks.drop("deployment_id"), ref)


def test_studies(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    extra = spark.createDataFrame([(3, 1.0, 2.0, "gps")], "event_id long, location_long double, location_lat double, sensor string")
    both = tg.read_studies(spark, [f"{tmp_path}/t.csv", extra])
    assert both.count() == 3 and both.where("sensor is null").count() == 2
    for bad in ([5], []):
        with pytest.raises((TypeError, ValueError)):
            tg.read_studies(spark, bad)


def test_dissolved_read(spark, tmp_path):
    (tmp_path / "t.csv").write_text("deployment-id,location-long,location-lat\n1,1,2\n1,1,2\n1,3,4\n2,5,6\n")
    multi = tg.read_tracks(spark, f"{tmp_path}/t.csv", dissolve=True)
    assert rows(multi, "deployment_id", "xmin", "xmax") == [(1, 1.0, 3.0), (2, 5.0, 5.0)]


FEATURES = [
    ("Point", [1, 2]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", [[0, 0], [1, 1.5]]),
    ("MultiLineString", [[[0, 0], [1, 1]], [[5, 5], [6, 7]]]),
    ("Polygon", [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 0.5], [2, 0.5], [2, 1], [1, 0.5]]]),
    ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]),
]


def test_geojson_both_forms(spark, tmp_path):
    feats = [{"type": "Feature", "properties": {"id": i, "name": k}, "geometry": {"type": k, "coordinates": c}}
             for i, (k, c) in enumerate(FEATURES)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=1))
    (tmp_path / "b.geojsonl").write_text("\n".join(map(json.dumps, feats)))
    one = tg.read_features(spark, f"{tmp_path}/a.geojson")
    two = tg.read_features(spark, f"{tmp_path}/b.geojsonl")
    assert rows(one) == rows(two) and one.count() == 6
    got = {r["name"]: r for r in one.collect()}
    assert got["MultiPolygon"]["xmax"] == 6.0 and len(got["Polygon"]["geom"]["parts"]) == 2
    # Of the triangle only the corner (3.5, 3) of the box is inside; the point (3, 4) is above it.
    assert rows(tg.read_features(spark, f"{tmp_path}/a.geojson", bbox=(2.5, 3, 3.5, 3.9)), "name") == [("Polygon",)]
    # What is written reads back the same; a row that holds rings keeps them.
    tg.write_features(two, f"{tmp_path}/c.geojsonl", "geojsonl")
    again = tg.read_features(spark, f"{tmp_path}/c.geojsonl")
    assert rows(explode_rings(again, "name")) == rows(explode_rings(two, "name"))
    with pytest.raises(ValueError):
        tg.write_features(two, f"{tmp_path}/d", "shp")


def test_wkt(spark):
    texts = {
        "POINT (1 2)": ("Point", 1), "MULTIPOINT ((1 2), (3 4))": ("MultiPoint", 2), "MULTIPOINT (1 2, 3 4)": ("MultiPoint", 2),
        "LINESTRING(0 0,1 1.5, -2e1 3)": ("LineString", 1), "MULTILINESTRING ((0 0, 1 1), (5 5, 6 7))": ("MultiLineString", 2),
        "SRID=4326;POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))": ("Polygon", 2),
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))": ("MultiPolygon", 2),
    }
    df = tg.read_features(spark, spark.createDataFrame([(t,) for t in texts], "w string").withColumn("t", F.col("w")), wkt="w")
    for r in df.collect():
        kind, parts = texts[r["t"]]
        assert r["geom"]["kind"] == kind and len(r["geom"]["parts"]) == parts, r["t"]
    assert df.agg(F.min("xmin"), F.max("ymax")).first() == (-20.0, 7.0)


def test_mask_read_and_profile(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 1.0, 0.0, i + 0.5, 0.5) for i in range(10)], "id int, xmin double, ymin double, xmax double, ymax double")
    tg.write_features(tg.box_features(df), f"{tmp_path}/f", cluster=True)
    mask = tg.box_features(df.where("id = 3").selectExpr("id", "xmin + 0.2 as xmin", "ymin", "xmax + 1 as xmax", "ymax"))
    assert rows(tg.read_features(spark, f"{tmp_path}/f", mask=mask, id_col="id"), "id") == [(3,), (4,)]
    stored = tg.read_features(spark, f"{tmp_path}/f", bbox=(2.1, 0, 2.2, 1))
    assert "LessThanOrEqual(xmin" in stored._jdf.queryExecution().executedPlan().toString()
    p = tg.profile_features(stored).first()
    assert (p["records"], p["kinds"], p["xmin"], p["crs"]) == (1, "Polygon", 2.0, "EPSG:4326")
    tg.write_features(tg.reproject_features(stored, 4326, 3857), f"{tmp_path}/m")
    metric = tg.read_features(spark, f"{tmp_path}/m")
    assert tg.get_crs(metric) == "EPSG:3857" == tg.get_crs(tg.clip_to_box(metric, (0, 0, 1e6, 1e6)))
    assert tg.subset_features(spark, metric, bbox=(2.1, 0, 2.2, 1)).subset.count() == 1
    assert tg.feature_schema(stored) == {"id": "int"}


def grid(spark, **kw):
    df = spark.createDataFrame([(datetime(y, 1, 1 + d), 1.0 * a, 2.0, float(y + a)) for y in (2019, 2020) for d in range(3) for a in range(2)],
                               "time timestamp_ntz, lat double, lon double, v double")
    return GridFrame.of(df, **kw)


def test_grid_round_trip_with_axes(spark, tmp_path):
    axes = {"lat": RegularAxis(1.0, -1.0, 2), "time": RegularAxis(0, 86_400_000_000, 9)}
    tg.write_grid(grid(spark, axes=axes), f"{tmp_path}/g")
    back = tg.read_grid(spark, f"{tmp_path}/g")
    assert back.axes == axes and isinstance(back.axes["time"].first, int)
    assert rows(back.df) == rows(grid(spark).df)
    tg.write_grid(grid(spark), f"{tmp_path}/h", encode_days=True)
    first = spark.read.parquet(f"{tmp_path}/h").agg(F.min("time")).first()[0]
    assert first == (datetime(2019, 1, 1) - datetime(2000, 1, 1)).days


def test_rasters_without_date_fail(spark, tmp_path):
    cells = grid(spark).df.drop("time")
    cells.write.parquet(f"{tmp_path}/r/MOD_NDVI_doy2021017_aid1")
    cells.write.parquet(f"{tmp_path}/r/MOD_NDVI_doy2021033_aid1")
    got = tg.stack_rasters_by_date(spark, f"{tmp_path}/r")
    assert rows(got.df.select("time").distinct()) == [(datetime(2021, 1, 17),), (datetime(2021, 2, 2),)]
    other = tg.stack_rasters_by_date(spark, f"{tmp_path}/r", pattern=r"day(\d{8})", date_format="yyyyMMdd")
    with pytest.raises(Exception, match="no date"):
        other.df.collect()


def test_stats_csv(spark, tmp_path):
    tg.write_stats(grid(spark).group_stats("v", ["year"]), f"{tmp_path}/s", ["year"])
    text = spark.read.option("header", True).csv(f"{tmp_path}/s")
    assert text.columns[:3] == ["year", "count", "mean"] and text.count() == 2


def test_stream_through_stateless_operators(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = "deployment-id,timestamp,location-long,location-lat\n"
    (tmp_path / "in" / "a.csv").write_text(body + "1,2009-05-01 10:00:00,0.5,0.5\n2,2009-05-02 10:00:00,5.0,5.0\n")
    schema = "`deployment-id` long, timestamp string, `location-long` double, `location-lat` double"
    zones = tg.box_features(spark.createDataFrame([(7, 0., 0., 2., 2.)], "zone int, xmin double, ymin double, xmax double, ymax double"))
    ref = spark.createDataFrame([(1, "f")], "deployment_id long, sex string")
    # Progress outlives the session, so every run of this test has its own name.
    name = f"tracks-{uuid.uuid4().hex}"

    def run():
        s = stream_tracks(spark, f"{tmp_path}/in", schema)
        s = tg.select_time_range(s, "timestamp", "2009-05-01", "2009-05-03")
        s = tg.points_in_polygons(s, zones, "location_long", "location_lat", ["zone"])
        append_parquet(tg.merge_tracks_ref(s, ref, small=True), f"{tmp_path}/out", name).awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"), "deployment_id", "zone", "sex")

    assert run() == [(1, 7, "f")]
    (tmp_path / "in" / "b.csv").write_text(body + "3,2009-05-03 23:00:00,1.0,1.0\n")
    assert run() == [(1, 7, "f"), (3, 7, None)]


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event-id,location-long,location-lat\n1,-121.0,51.0\n")
    (tmp_path / "b.csv").write_text("event-id,location-lat,location-long,sensor\n2,52.0,-122.0,gps\n")
    got = tg.read_tracks(spark, str(tmp_path))
    assert rows(got, "event_id", "location_long", "location_lat", "sensor") == [(1, -121.0, 51.0, None), (2, -122.0, 52.0, "gps")]
    with pytest.raises(ValueError):
        tg.read_tracks(spark, str(tmp_path), schema="a int, b double, c double")


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('event-id,note,location-long,location-lat\n1,"two\nlines",-121.0,51.0\n')
    got = tg.read_tracks(spark, f"{tmp_path}/t.csv", multiline=True)
    assert rows(got, "event_id", "note", "location_lat") == [(1, "two\nlines", 51.0)]


def test_features_without_a_place_stay(spark, tmp_path):
    lines = [
        {"type": "Feature", "properties": {"id": 1}, "geometry": None},
        {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}},
    ]
    (tmp_path / "f.geojsonl").write_text("\n".join(map(json.dumps, lines)))
    got = tg.read_features(spark, f"{tmp_path}/f.geojsonl")
    assert rows(got, "id", "xmin") == [(1, None), (2, 1.0)]
    assert rows(tg.read_features(spark, f"{tmp_path}/f.geojsonl", bbox=(0, 0, 5, 5)), "id") == [(2,)]
    wkt = tg.read_features(spark, spark.createDataFrame([(1, "POINT EMPTY"), (2, "POINT (1 2)"), (3, None)], "id int, w string"), wkt="w")
    assert rows(wkt, "id", "xmin") == [(1, None), (2, 1.0), (3, None)]


def _grid(spark, lats, start=1, extra="v"):
    data = [(datetime(2020 + k, 1, start), float(a), 10.0, float(a)) for k in range(2) for a in lats]
    return GridFrame.of(spark.createDataFrame(data, f"time timestamp_ntz, latitude double, longitude double, {extra} double"))


def test_axes_do_not_outlive_their_data(spark, tmp_path):
    first = _grid(spark, range(4))
    tg.write_grid(first.with_axes({"latitude": first.axis("latitude")}), f"{tmp_path}/g")
    assert tg.read_grid(spark, f"{tmp_path}/g").axes
    tg.write_grid(_grid(spark, range(10)), f"{tmp_path}/g", mode="overwrite")
    again = tg.read_grid(spark, f"{tmp_path}/g")
    assert not again.axes and again.thin({"latitude": 2}).df.select("latitude").distinct().count() == 5
    kept = _grid(spark, range(4))
    kept = kept.with_axes({d: kept.axis(d) for d in ("latitude", "time")})
    tg.write_grid(kept, f"{tmp_path}/h")
    later = _grid(spark, range(4), start=9)
    tg.write_grid(later.with_axes({d: later.axis(d) for d in ("latitude", "time")}), f"{tmp_path}/h", mode="append")
    assert set(tg.read_grid(spark, f"{tmp_path}/h").axes) == {"latitude"}


def test_a_variable_named_year_and_encoded_days(spark, tmp_path):
    grid = _grid(spark, range(3), extra="year")
    tg.write_grid(grid, f"{tmp_path}/g", encode_days=True)
    got = tg.read_grid(spark, f"{tmp_path}/g")
    assert got.variables == ["year"] and rows(got.df, "time", "latitude", "year") == rows(grid.df, "time", "latitude", "year")


def test_years_prune_the_folders_of_a_stored_grid(spark, sf, tmp_path):
    grid = S.grid(spark, sf, "grid_ship", declare=True)
    path = f"{tmp_path}/grid.parquet"
    tg.write_grid(grid, path)
    back = tg.read_grid(spark, path)
    assert "__year" not in back.df.columns and back.variables == grid.variables

    def scanned(g):
        plan = g.df._jdf.queryExecution().toString()
        return plan.split("== Physical Plan ==")[1].split("PartitionFilters: ")[1].split("PushedFilters")[0]

    some = back.select_variables("ndvi").select_time_range("1997-03", "1998").select_time_cond(month_range=[2, 8])
    assert "__year" in scanned(some)
    assert rows(some.df) == rows(grid.select_variables("ndvi").select_time_range("1997-03", "1998").select_time_cond(month_range=[2, 8]).df)
    years = back.select_time_cond(years=[1995], year_range=[1998, 1999])
    assert "__year" in scanned(years)
    assert rows(years.df) == rows(grid.select_time_cond(years=[1995], year_range=[1998, 1999]).df)
    assert scanned(back).strip().startswith("[]")


def test_headers_are_read_without_a_job(spark, sf, tmp_path):
    import gzip

    from trackgrid.sources.readers import first_lines

    folder = tmp_path / "some folder"
    folder.mkdir()
    for k in range(3):
        (folder / f"plain {k}.csv").write_text(f"id,ä{k}\n" + "1,2\n" * 10)
    with gzip.open(folder / "z.csv.gz", "wt") as f:
        f.write("zipped,x\n1,2\n")
    (folder / "empty.csv").write_text("")
    files = sorted(spark.read.text(str(folder)).inputFiles())
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    assert sorted(first_lines(spark, files)) == ["", "id,ä0", "id,ä1", "id,ä2", "zipped,x"]
    assert len(tracker.getJobIdsForGroup()) == before


def test_missing_geometry_and_holes_survive_geojson(spark, tmp_path):
    wkt = ["POINT (1 2)", None, "POINT EMPTY", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"]
    two = "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1), (4 4, 4 5, 5 5, 5 4, 4 4)), ((20 20, 21 20, 21 21, 20 20)))"
    layer = spark.createDataFrame([(i, w) for i, w in enumerate([*wkt, two])], "id long, wkt string")
    layer = tg.make_features(layer, tg.geometry_from_wkt("wkt")).drop("wkt")
    path = f"{tmp_path}/mixed.geojsonl"
    tg.write_features(layer, path, "geojsonl")
    lines = {json.loads(r["value"])["properties"]["id"]: json.loads(r["value"])["geometry"] for r in spark.read.text(path).collect()}
    assert lines[1] is None and lines[2] == {"type": "Point", "coordinates": []}
    assert [len(p) for p in lines[4]["coordinates"]] == [3, 1] and len(lines[3]["coordinates"]) == 2
    back = tg.read_features(spark, path, properties="id bigint")
    assert back.count() == 5
    assert {r["id"]: r["a"] for r in back.where("id >= 3").select("id", tg.polygon_area().alias("a")).collect()} == {3: 15.0, 4: 79.5}
    kinds = {r["id"]: r["k"] for r in back.select("id", F.col("geom.kind").alias("k")).collect()}
    assert kinds == {0: "Point", 1: None, 2: "Point", 3: "Polygon", 4: "MultiPolygon"}
