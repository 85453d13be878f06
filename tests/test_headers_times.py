from datetime import datetime

import pytest

from conftest import rows
from trackgrid import clean_headers, detect_varnames
from trackgrid.functions import timeexpr as T
from trackgrid.functions.headers import clean_names, number_duplicates, snake_case
from trackgrid.operators.time_select import select_time_cond, select_time_range, selected


@pytest.mark.parametrize("raw, clean", [
    ("location-long", "location_long"), ("event.id", "event_id"), ("HTTPServer", "http_server"),
    ("argos:best-level", "argos_best_level"), ("abc1def", "abc_1def"), ("X2y3", "x_2y_3"), ("visibleName", "visible_name"),
    ("tag-local_identifier", "tag_local_identifier"), ("'quoted' name", "quoted_name"), ("%humidity", "%humidity"),
    ("", "header"), (None, "header"), ("Unnamed: 0", "unnamed_0"), ("already_snake", "already_snake"),
])
def test_snake_case(raw, clean):
    assert snake_case(raw) == clean


def test_duplicates_are_numbered_and_unique():
    assert number_duplicates(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]
    names = number_duplicates(["a", "a", "a_1", "a"])
    assert len(set(names)) == 4 and names[0] == "a"
    assert clean_names(["lat", "Lat", "LAT"]) == ["lat", "lat_1", "lat_2"]


def test_report(spark):
    df = spark.range(1).toDF("eventID").selectExpr("eventID", "1 as ok")
    cleaned, report = clean_headers(df, report=True)
    assert cleaned.columns == ["event_id", "ok"]
    assert report == {"cleaned": 1, "columns": 2, "percent": 50.0}


def test_detect_varnames_takes_the_first_spelling():
    found, names, others = detect_varnames(["latitude", "lat", "Time", "t2m", "longitude"])
    assert found == {"timevar": "Time", "latvar": "lat", "lonvar": "longitude"}
    assert others == ["latitude", "t2m"]
    assert detect_varnames(["x"])[0] == {"timevar": None, "latvar": None, "lonvar": None}


@pytest.mark.parametrize("text, start, end", [
    ("2008", datetime(2008, 1, 1), datetime(2009, 1, 1)),
    ("2008-12", datetime(2008, 12, 1), datetime(2009, 1, 1)),
    ("2008-02-29", datetime(2008, 2, 29), datetime(2008, 3, 1)),
    ("2008-03-01 13", datetime(2008, 3, 1, 13), datetime(2008, 3, 1, 14)),
    ("2008-03-01 13:00", datetime(2008, 3, 1, 13), datetime(2008, 3, 1, 13, 1)),
    ("2008-03-01T13:00:05", datetime(2008, 3, 1, 13, 0, 5), datetime(2008, 3, 1, 13, 0, 6)),
])
def test_partial_strings(text, start, end):
    assert T.time_bounds(text) == (start, end)


def test_bad_times_and_durations():
    with pytest.raises(ValueError):
        T.time_bounds("yesterday")
    with pytest.raises(ValueError):
        T.duration_micros(1, "month")
    with pytest.raises(ValueError):
        T.duration_micros(0, "day")
    assert T.duration_micros(1.5, "days") == 36 * 3_600_000_000 == T.duration_micros(36, "h")


@pytest.fixture(scope="module")
def hourly(spark):
    return spark.sql("""select cast(t as timestamp_ntz) as time from
      (select explode(sequence(timestamp'2007-12-30', timestamp'2009-01-02', interval 6 hour)) as t)""")


def test_time_range_ends_are_inclusive(hourly):
    got = rows(select_time_range(hourly, "time", "2008-01-10", "2008-01-11"))
    assert len(got) == 8 and got[-1][0] == datetime(2008, 1, 11, 18)
    assert select_time_range(hourly, "time", datetime(2008, 1, 1, 6), datetime(2008, 1, 1, 6)).count() == 1


def test_range_and_years_reach_the_scan(spark, hourly, tmp_path):
    hourly.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    for df in (select_time_range(stored, "time", "2008", "2008"), select_time_cond(stored, years=[2008])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in plan


def test_conditions(hourly):
    assert selected([3, 1], [5, 6]) == [1, 3, 5, 6] and selected(None, None) is None and selected([], None) is None
    got = select_time_cond(hourly, years=[2008], month_range=[2, 3], hours=[6, 12])
    assert got.count() == 60 * 2
    assert select_time_cond(hourly).count() == hourly.count()
    assert select_time_cond(hourly, daysofyear=[366]).count() == 4
