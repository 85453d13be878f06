"""Registered queries: one per operator, with SQL where SQL can express it.

Aggregated doubles are rounded on both sides, because the engines add in
different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import stand_ins as S
import trackgrid as tg
from stand_ins import with_views
from trackgrid.functions import geometry as G
from trackgrid.operators.boundary import buffer_convex, feature_envelope
from trackgrid.operators.features import explode_rings, length, signed_areas
from trackgrid.operators.overlay import polygon_area
from trackgrid.operators.reshape import concat_time
from trackgrid.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, views: str = ""):
    """Register a query and, if there is one, its SQL over the named views."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tg.configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(views, oracle) if views else oracle.strip()
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    # Adding 0.0 turns a negative zero into zero.
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def stats_out(df: DataFrame) -> DataFrame:
    out = rounded(df, "mean", "std", "min", "p25", "p50", "p75", "max")
    return out.withColumnsRenamed({"count": "n", "min": "mn", "max": "mx"})


def stats_sql(v: str) -> str:
    return f"""count({v}) as n, round(avg({v}),6)+0.0 as mean, round(stddev_pop({v}),6)+0.0 as std,
  round(min({v}),6)+0.0 as mn, round(quantile_cont({v},0.25),6)+0.0 as p25, round(quantile_cont({v},0.5),6)+0.0 as p50,
  round(quantile_cont({v},0.75),6)+0.0 as p75, round(max({v}),6)+0.0 as mx"""


TRACK_COLS = "event_id, timestamp, deployment_id, location_long, location_lat"
BOX = (-123.0, 50.0, -117.0, 55.0)

# SQL shared by the spatial oracles.
ZONE_HIT = """hit as (select c.latitude, c.longitude, e.zone_id from (select distinct latitude, longitude from {g}) c
  join zone_edges e on (e.y1 > c.latitude) <> (e.y2 > c.latitude)
   and c.longitude < (e.x2-e.x1)*(c.latitude-e.y1)/(e.y2-e.y1)+e.x1
  group by 1,2,3 having count(*)%2=1)"""


def side(px: str, py: str, a: str) -> str:
    return f"(({a}.x2-{a}.x1)*({py}-{a}.y1)-({a}.y2-{a}.y1)*({px}-{a}.x1))"


def segments_meet_sql(a: str, b: str) -> str:
    d = [side(f"{a}.x1", f"{a}.y1", b), side(f"{a}.x2", f"{a}.y2", b), side(f"{b}.x1", f"{b}.y1", a),
         side(f"{b}.x2", f"{b}.y2", a)]
    return f"""(least({a}.x1,{a}.x2) <= greatest({b}.x1,{b}.x2) and greatest({a}.x1,{a}.x2) >= least({b}.x1,{b}.x2)
   and least({a}.y1,{a}.y2) <= greatest({b}.y1,{b}.y2) and greatest({a}.y1,{a}.y2) >= least({b}.y1,{b}.y2)
   and sign({d[0]})*sign({d[1]}) <= 0 and sign({d[2]})*sign({d[3]}) <= 0)"""


def segment_box_sql(a: str, x0: str, y0: str, x1: str, y1: str) -> str:
    s = [side(x, y, a) for x in (x0, x1) for y in (y0, y1)]
    return f"""(least({a}.x1,{a}.x2) <= {x1} and greatest({a}.x1,{a}.x2) >= {x0}
   and least({a}.y1,{a}.y2) <= {y1} and greatest({a}.y1,{a}.y2) >= {y0}
   and least({', '.join(s)}) <= 0 and greatest({', '.join(s)}) >= 0)"""


def dist2_sql(px: str, py: str, e: str) -> str:
    t = f"least(greatest((({px}-{e}.x1)*({e}.x2-{e}.x1)+({py}-{e}.y1)*({e}.y2-{e}.y1))/(({e}.x2-{e}.x1)**2+({e}.y2-{e}.y1)**2),0e0),1e0)"
    return f"(({px}-({e}.x1+{t}*({e}.x2-{e}.x1)))**2+({py}-({e}.y1+{t}*({e}.y2-{e}.y1)))**2)"


STARTS_INSIDE = """starts as (select r.road_id, e.zone_id from roads r join zone_edges e
  on (e.y1 > r.y1) <> (e.y2 > r.y1) and r.x1 < (e.x2-e.x1)*(r.y1-e.y1)/(e.y2-e.y1)+e.x1
  group by 1,2 having count(*)%2=1)"""
LINE_BOX = "least(x1,x2) as xmin, least(y1,y2) as ymin, greatest(x1,x2) as xmax, greatest(y1,y2) as ymax"

# 2.1 Sources and sinks ------------------------------------------------------


@register("s1_read_tracks", f"select {TRACK_COLS} from tracks", "tracks")
def s1(spark, d):
    """Tracks written as CSV with raw headers and read back cleaned."""
    raw = S.view(spark, d, "tracks").toDF("event-id", "timestamp", "deployment ID", "location-long", "location-lat")
    path = scratch_path(spark, "tracks-csv")
    tg.write_tracks(raw, path)
    return tg.read_tracks(spark, path)


@register("s1_read_tracks_mixed", f"select {TRACK_COLS} from tracks", "tracks")
def s1m(spark, d):
    """Two files in one folder whose columns are in different orders."""
    raw = S.view(spark, d, "tracks").toDF("event-id", "timestamp", "deployment ID", "location-long", "location-lat")
    path = scratch_path(spark, "tracks-mixed")
    other = raw.where("`event-id` % 2 = 1").select("location-lat", "event-id", "location-long", "timestamp", "deployment ID")
    tg.write_tracks(raw.where("`event-id` % 2 = 0"), path)
    tg.write_tracks(other, path, mode="append")
    return tg.read_tracks(spark, path)


@register("s2_read_ref", "select deployment_id, animal_id, animal_taxon, animal_mass from ref_all", "ref_all")
def s2(spark, d):
    raw = S.view(spark, d, "ref_all").toDF("DeploymentID", "animal-id", "animal.taxon", "Animal Mass")
    path = scratch_path(spark, "ref-csv")
    raw.write.option("header", True).csv(path)
    return tg.read_ref(spark, path)[0]


@register("s3_read_features", f"select road_id, road_class, {LINE_BOX} from roads r where "
          + segment_box_sql("r", *[f"({v})" for v in map(str, BOX)]), "roads")
def s3(spark, d):
    """Roads written as GeoJSON lines and read back within a box."""
    path = scratch_path(spark, "roads") + ".geojsonl"
    tg.write_features(S.roads(spark, d), path, "geojsonl")
    return tg.read_features(spark, path, bbox=BOX, properties="road_id bigint, road_class string").drop("geom")


@register("s4_read_grid", "select time, latitude, longitude, t2m from grid_day", "grid_day")
def s4(spark, d):
    """A grid written with NaN for missing values is read with NULL."""
    path = scratch_path(spark, "grid")
    S.view(spark, d, "grid_day").withColumnRenamed("latitude", "lat").write.parquet(path)
    return tg.read_grid(spark, path).df.withColumnRenamed("lat", "latitude")


@register("s5_stack_rasters_by_date", "select time, latitude, longitude, t2m from grid_day", "grid_day")
def s5(spark, d):
    """Cell tables of one date each, the date being in the path."""
    path = scratch_path(spark, "rasters")
    g = S.view(spark, d, "grid_day")
    named = g.withColumn("raster", F.concat(F.lit("t2m_doy"), F.date_format("time", "yyyyDDD"))).drop("time")
    named.repartition("raster").write.partitionBy("raster").parquet(path)
    return tg.stack_rasters_by_date(spark, path).df


@register("s6_write_features", f"select road_id, road_class, {LINE_BOX} from roads r where "
          + segment_box_sql("r", *[f"({v})" for v in map(str, BOX)]), "roads")
def s6(spark, d):
    """Roads stored by place; the box reaches the Parquet scan."""
    path = scratch_path(spark, "roads-parquet")
    tg.write_features(S.roads(spark, d), path, cluster=True)
    return tg.read_features(spark, path, bbox=BOX).drop("geom")


@register("s6_write_features_null", f"""select road_id, road_class, case when road_id % 5 > 1 then xmin end as xmin,
  case when road_id % 5 > 1 then ymax end as ymax, case when road_id % 5 > 0 then 'LineString' end as kind
from (select road_id, road_class, {LINE_BOX} from roads)""", "roads")
def s6n(spark, d):
    """Roads of which some have no geometry and some an empty one, written as GeoJSON lines and read back: none is lost."""
    path = scratch_path(spark, "roads-null") + ".geojsonl"
    geom = F.expr("case road_id % 5 when 0 then null when 1 then named_struct('kind', 'LineString', 'parts', filter(geom.parts, p -> false)) else geom end")
    tg.write_features(tg.make_features(S.roads(spark, d).drop(*G.BOX), geom), path, "geojsonl")
    back = tg.read_features(spark, path, properties="road_id bigint, road_class string")
    return back.select("road_id", "road_class", "xmin", "ymax", F.col("geom.kind").alias("kind"))


@register("s7_write_grid", f"""select latitude, {stats_sql('ndvi')} from grid_ship
  where time >= timestamp '1998-03-01' and time < timestamp '1999-01-01' group by 1""", "grid_ship")
def s7(spark, d):
    """A grid stored by year and read back for a range of time."""
    path = scratch_path(spark, "grid-parquet")
    tg.write_grid(S.grid(spark, d, "grid_ship", declare=True), path)
    back = tg.read_grid(spark, path).select_time_range("1998-03", "1998")
    from trackgrid.operators.stats import describe

    return stats_out(describe(back.df, "ndvi", ["latitude"]))


@register("s8_write_stats", f"select cast(month(time) as bigint) as month, {stats_sql('t2m')} from grid_day group by 1",
          "grid_day")
def s8(spark, d):
    path = scratch_path(spark, "stats")
    stats = stats_out(tg.groupby_multi_time(S.grid(spark, d, "grid_day"), "t2m", ["month"]))
    tg.write_stats(stats, path, ["month"])
    schema = ", ".join(f"{f.name} {'bigint' if f.name == 'month' else f.dataType.simpleString()}" for f in stats.schema)
    return spark.read.schema(schema).option("header", True).csv(path)


# 2.2 Metadata ---------------------------------------------------------------


@register("m1_profile_features", """select min(least(x1,x2)) as xmin, min(least(y1,y2)) as ymin,
  max(greatest(x1,x2)) as xmax, max(greatest(y1,y2)) as ymax, count(*) as records, 'LineString' as kinds, 'EPSG:4326' as crs from roads""",
          "roads")
def m1(spark, d):
    return tg.profile_features(S.roads(spark, d))


@register("m2_detect_varnames", """select 'time' as timevar, 'latitude' as latvar, 'longitude' as lonvar,
  'ndvi,snow' as unmatched, count(time) as n_time, min(latitude) as min_lat, max(longitude) as max_lon from grid_ship""",
          "grid_ship")
def m2(spark, d):
    df = S.view(spark, d, "grid_ship")
    roles, _, others = tg.detect_varnames(df.columns)
    return df.agg(
        *[F.first(F.lit(roles[r])).alias(r) for r in roles],
        F.first(F.lit(",".join(sorted(others)))).alias("unmatched"),
        F.count(roles["timevar"]).alias("n_time"), F.min(roles["latvar"]).alias("min_lat"),
        F.max(roles["lonvar"]).alias("max_lon"),
    )


@register("m3_time_resolution", """select cast(floor((epoch_us(max(time))-epoch_us(min(time)))/(count(distinct time)-1))
  as bigint) as resolution_us from grid_ship""", "grid_ship")
def m3(spark, d):
    return tg.time_resolution(S.view(spark, d, "grid_ship"))


@register("m4_time_unit_domain", """with u as (
  select distinct 'year' as unit, cast(year(time) as int) as v from grid_ship
  union select distinct 'month', cast(month(time) as int) from grid_ship
  union select distinct 'dayofyear', cast(dayofyear(time) as int) from grid_ship
  union select distinct 'hour', cast(hour(time) as int) from grid_ship)
select unit, count(*) as n_values, min(v) as min_value, max(v) as max_value, count(*) > 1 as offered from u group by 1""",
          "grid_ship")
def m4(spark, d):
    return tg.time_unit_domain(S.view(spark, d, "grid_ship")).drop("values")


@register("m5_value_range", "select min(ndvi) as min_value, max(ndvi) as max_value from grid_ship", "grid_ship")
def m5(spark, d):
    return tg.value_range(S.view(spark, d, "grid_ship"), "ndvi")


# 2.3 Projection and filters -------------------------------------------------


@register("p1_clean_headers", """select c_custkey as cust_key, c_name as animal_name, c_nationkey as animal_name_1,
  c_acctbal as acc_2bal, c_mktsegment as mkt_segment from customer""")
def p1(spark, d):
    raw = S.table(spark, d, "customer").toDF("cust-key", "animalName", "animal:name", "'Acc2'bal", "MktSegment")
    return tg.clean_headers(raw)


@register("p2_select_variables", "select time, latitude, longitude, snow from grid_ship", "grid_ship")
def p2(spark, d):
    return S.grid(spark, d, "grid_ship").select_variables("snow").df


@register("f1_select_time_range", """select time, latitude, longitude, ndvi, snow from grid_ship
  where time >= timestamp '1997-02-10' and time < timestamp '1998-07-01'""", "grid_ship")
def f1(spark, d):
    return S.grid(spark, d, "grid_ship").select_time_range("1997-02-10", "1998-06").df


@register("f2_select_time_cond", """select time, latitude, longitude, ndvi, snow from grid_ship
  where (year(time) = 1995 or year(time) between 1998 and 1999) and (month(time) in (1, 7) or month(time) between 4 and 5)
   and dayofyear(time) between 20 and 200 and hour(time) in (0)""", "grid_ship")
def f2(spark, d):
    return S.grid(spark, d, "grid_ship").select_time_cond(
        years=[1995], year_range=[1998, 1999], months=[1, 7], month_range=[4, 5], dayofyear_range=[20, 200], hours=[0]
    ).df


@register("f3_time_encoding_days", """select event_id, deployment_id,
  (epoch_us(timestamp)-946684800000000)/86400000000e0 as time_days from tracks""", "tracks")
def f3(spark, d):
    df = tg.time_encoding_days(S.view(spark, d, "tracks"), "timestamp", "time_days")
    return df.select("event_id", "deployment_id", "time_days")


@register("f4_clip_tracks_timerange", f"""select {TRACK_COLS} from tracks_ship
  where timestamp between (select min(timestamp) from tracks_order) and (select max(timestamp) from tracks_order)""",
          "tracks_ship tracks_order")
def f4(spark, d):
    return tg.clip_tracks_timerange(S.view(spark, d, "tracks_ship"), S.view(spark, d, "tracks_order"))


@register("f5_filter_bbox", f"select road_id, road_class, {LINE_BOX} from roads r where "
          + segment_box_sql("r", *[f"({v})" for v in map(str, BOX)]), "roads")
def f5(spark, d):
    return tg.filter_bbox(S.roads(spark, d), BOX).drop("geom")


@register("f5_filter_bbox_polygons", "select parcel_id, brand from parcels where xmin <= -117e0 and xmax >= -123e0 "
          "and ymin <= 55e0 and ymax >= 50e0", "parcels")
def f5p(spark, d):
    return tg.filter_bbox(S.parcels(spark, d), BOX).select("parcel_id", "brand")


@register("f6_filter_polygon", f"""with {STARTS_INSIDE},
meets as (select distinct r.road_id from roads r join zone_edges e on {segments_meet_sql('r', 'e')})
select road_id, road_class from roads where road_id in (select road_id from meets)
  or road_id in (select road_id from starts)""", "roads zone_edges")
def f6(spark, d):
    return tg.filter_polygon(S.roads(spark, d), S.diamonds(spark, d), "road_id").select("road_id", "road_class")


@register("f6_filter_polygon_buffered", f"""with {STARTS_INSIDE},
meets as (select distinct r.road_id from roads r join zone_edges e
  on least(r.x1,r.x2) <= greatest(e.x1,e.x2)+0.25e0 and greatest(r.x1,r.x2) >= least(e.x1,e.x2)-0.25e0
  and least(r.y1,r.y2) <= greatest(e.y1,e.y2)+0.25e0 and greatest(r.y1,r.y2) >= least(e.y1,e.y2)-0.25e0
  where {segments_meet_sql('r', 'e')} or {dist2_sql('r.x1', 'r.y1', 'e')} <= 0.0625e0
  or {dist2_sql('r.x2', 'r.y2', 'e')} <= 0.0625e0
  or (case when r.x1=r.x2 and r.y1=r.y2 then false else {dist2_sql('e.x1', 'e.y1', 'r')} <= 0.0625e0
      or {dist2_sql('e.x2', 'e.y2', 'r')} <= 0.0625e0 end))
select road_id, road_class from roads where road_id in (select road_id from meets)
  or road_id in (select road_id from starts)""", "roads zone_edges")
def f6b(spark, d):
    return tg.filter_polygon(S.roads(spark, d), S.diamonds(spark, d), "road_id", within=0.25).select(
        "road_id", "road_class")


GRID_COLS = "g.time, g.latitude, g.longitude, g.ndvi, g.snow"


@register("f7_select_spatial", f"""with {ZONE_HIT.format(g='grid_ship')}
select {GRID_COLS} from grid_ship g where (latitude, longitude) in (select (latitude, longitude) from hit)""",
          "grid_ship zone_edges")
def f7(spark, d):
    return S.grid(spark, d, "grid_ship").select_spatial(S.diamonds(spark, d)).df


@register("f7_select_spatial_invert", f"""with {ZONE_HIT.format(g='grid_ship')}
select {GRID_COLS} from grid_ship g where (latitude, longitude) not in (select (latitude, longitude) from hit)""",
          "grid_ship zone_edges")
def f7i(spark, d):
    return S.grid(spark, d, "grid_ship", declare=True).select_spatial(S.diamonds(spark, d), invert=True).df


@register("f7_select_spatial_rows", f"""with {ZONE_HIT.format(g='grid_ship')}
select {GRID_COLS} from grid_ship g where (latitude, longitude) in (select (latitude, longitude) from hit)""",
          "grid_ship zone_edges")
def f7r(spark, d):
    """The form for grids with more cells than a broadcast holds."""
    return S.grid(spark, d, "grid_ship").select_spatial(S.diamonds(spark, d), strategy="rows").df


@register("f7_select_spatial_null", f"""with {ZONE_HIT.format(g='grid_day')}
select g.time, g.latitude, g.longitude,
  case when (g.latitude, g.longitude) in (select (latitude, longitude) from hit) then g.t2m end as t2m
from grid_day g where latitude between (select min(latitude) from hit) and (select max(latitude) from hit)
  and longitude between (select min(longitude) from hit) and (select max(longitude) from hit)""", "grid_day zone_edges")
def f7n(spark, d):
    return S.grid(spark, d, "grid_day").select_spatial(S.diamonds(spark, d), mode="null").df


@register("f7_select_spatial_touched", f"""with cells as (select distinct latitude, longitude,
  longitude-0.75e0 as x0, longitude+0.75e0 as x1, latitude-0.75e0 as y0, latitude+0.75e0 as y1 from grid_day),
{ZONE_HIT.format(g='grid_day')},
touched as (select distinct c.latitude, c.longitude from cells c join zone_edges e
  on {segment_box_sql('e', 'c.x0', 'c.y0', 'c.x1', 'c.y1')}
  union select latitude, longitude from hit)
select g.time, g.latitude, g.longitude, g.t2m from grid_day g
where (latitude, longitude) in (select (latitude, longitude) from touched)""", "grid_day zone_edges")
def f7t(spark, d):
    g = S.grid(spark, d, "grid_day", declare=True)
    return g.select_spatial(S.diamonds(spark, d), all_touched=True).df


@register("f8_select_time_slice", """select time, latitude, longitude, ndvi, snow from grid_ship
  where time = timestamp '1998-05-17'""", "grid_ship")
def f8(spark, d):
    return tg.select_time_slice(S.view(spark, d, "grid_ship"), "1998-05-17")


# 2.4 Joins ------------------------------------------------------------------

J1_SQL = """select t.event_id, t.timestamp, t.deployment_id, t.location_long, t.location_lat,
  r.animal_id, r.animal_taxon, r.animal_mass from tracks t left join ref r using (deployment_id)"""


@register("j1_merge_tracks_ref", J1_SQL, "tracks ref")
def j1(spark, d):
    ref = S.view(spark, d, "ref").withColumn("location_lat", F.lit(0.0))
    return tg.merge_tracks_ref(S.view(spark, d, "tracks"), ref)


@register("j1_merge_tracks_ref_shuffled", J1_SQL, "tracks ref")
def j1s(spark, d):
    """The form for a reference table too large to broadcast: hot animals are spread."""
    return tg.merge_tracks_ref(S.view(spark, d, "tracks"), S.view(spark, d, "ref"), small=False)


@register("j2_points_in_polygons", """select t.event_id, t.deployment_id, e.zone_id from tracks t join zone_edges e
  on (e.y1 > t.location_lat) <> (e.y2 > t.location_lat)
 and t.location_long < (e.x2-e.x1)*(t.location_lat-e.y1)/(e.y2-e.y1)+e.x1
  group by 1,2,3 having count(*)%2=1""", "tracks zone_edges")
def j2(spark, d):
    tracks = S.view(spark, d, "tracks")
    hits = tg.points_in_polygons(tracks, S.diamonds(spark, d), "location_long", "location_lat", keep=["zone_id"])
    return hits.select("event_id", "deployment_id", "zone_id")


@register("j2_points_outside_polygons", """with inside as (select t.event_id from tracks t join zone_edges e
  on (e.y1 > t.location_lat) <> (e.y2 > t.location_lat)
 and t.location_long < (e.x2-e.x1)*(t.location_lat-e.y1)/(e.y2-e.y1)+e.x1
  group by t.event_id, e.zone_id having count(*)%2=1)
select event_id, deployment_id from tracks where event_id not in (select event_id from inside)""", "tracks zone_edges")
def j2a(spark, d):
    tracks = S.view(spark, d, "tracks")
    return tg.points_in_polygons(tracks, S.diamonds(spark, d), "location_long", "location_lat", how="left_anti").select(
        "event_id", "deployment_id")


@register("j3_reindex_like", """select g.time, g.latitude, g.longitude,
  case when month(g.time) in (3, 4) then g.ndvi end as ndvi, case when month(g.time) in (3, 4) then g.snow end as snow
from grid_ship g""", "grid_ship")
def j3(spark, d):
    g = S.grid(spark, d, "grid_ship")
    return g.select_time_cond(months=[3, 4]).reindex_like(g).df


@register("j3_reindex_product", """with t as (select distinct time from grid_day),
a as (select distinct latitude from grid_day), o as (select distinct longitude from grid_day)
select t.time, round(a.latitude, 6)+0.0 as latitude, round(o.longitude, 6)+0.0 as longitude, g.t2m from t, a, o
left join grid_day g on g.time = t.time and g.latitude = a.latitude and g.longitude = o.longitude""", "grid_day")
def j3p(spark, d):
    """Put back on all combinations of the axes that the library measures; places are those of the data."""
    g = S.grid(spark, d, "grid_day")
    out = g.reindex_like(g.with_axes({dim: g.axis(dim) for dim in g.dims})).df
    return rounded(out, "latitude", "longitude")


def off_axis(spark, d):
    """``grid_day`` with the places of every other longitude moved by a third of a step in latitude."""
    moved = S.view(spark, d, "grid_day").withColumn("latitude", F.expr("latitude + if(cast(round((longitude + 129.9D) / 1.5D) as int) % 2 = 1, 0.5D, 0D)"))
    return tg.GridFrame.of(moved)


@register("j3_reindex_off_axis", """with t as (select distinct time from grid_day),
a as (select distinct latitude from grid_day), o as (select distinct longitude from grid_day)
select t.time, round(a.latitude, 6)+0.0 as latitude, round(o.longitude, 6)+0.0 as longitude, g.t2m from t, a, o
left join grid_day g on g.time = t.time and g.latitude = a.latitude and g.longitude = o.longitude
 and cast(round((g.longitude+129.9)/1.5) as int) % 2 = 0""", "grid_day")
def j3o(spark, d):
    """Data between the places of the other grid have no place there: no row is doubled, no value moves."""
    g = S.grid(spark, d, "grid_day")
    out = off_axis(spark, d).reindex_like(g.with_axes({dim: g.axis(dim) for dim in g.dims})).df
    return rounded(out, "latitude", "longitude")


# 2.5 Aggregations -----------------------------------------------------------


@register("a1_dissolve", """select distinct deployment_id, location_long as x, location_lat as y from tracks""", "tracks")
def a1(spark, d):
    multi = tg.dissolve_points(S.view(spark, d, "tracks"), part_size=50)
    return explode_rings(multi, "deployment_id").select("deployment_id", "x", "y")


def sweep_sql(name: str, boxes: str, key: str) -> str:
    """Views ``name_x`` and ``name_y``: of the union of boxes, per key, its area and the length of the sides along an axis."""

    def along(out: str, a: str, b: str) -> str:
        return f"""{out}_v as (select {key}, {a}min as v from {boxes} union select {key}, {a}max from {boxes}),
{out}_s as (select {key}, v as lo, lead(v) over (partition by {key} order by v) as hi from {out}_v),
{out}_b as (select s.{key}, s.lo, s.hi, p.{b}min as b0, p.{b}max as b1,
  max(p.{b}max) over (partition by s.{key}, s.lo order by p.{b}min, p.{b}max rows between unbounded preceding and 1 preceding) as far
  from {out}_s s join {boxes} p on p.{key} = s.{key} and p.{a}min <= s.lo and p.{a}max >= s.hi where s.hi is not null),
{out} as (select {key}, sum((hi-lo)*greatest(0e0, b1-greatest(b0, coalesce(far, b0)))) as area,
  sum(case when far is null or b0 > far then 2*(hi-lo) else 0e0 end) as side from {out}_b group by 1)"""

    return along(f"{name}_x", "x", "y") + ",\n" + along(f"{name}_y", "y", "x")


@register("a1_dissolve_polygons", f"""with p as (select brand, round(xmin, 9) as xmin, round(ymin, 9) as ymin, round(xmax, 9) as xmax,
  round(ymax, 9) as ymax from parcels),
{sweep_sql('u', 'p', 'brand')}
select u_x.brand, round(u_x.area, 5) as area, round(u_x.side + u_y.side, 5) as outline from u_x join u_y on u_x.brand = u_y.brand""",
          "parcels")
def a1p(spark, d):
    """The union of the parcels of each brand, which overlap: its area and the length of its outline."""
    united = tg.dissolve_polygons(S.parcels(spark, d), ["brand"])
    return rounded(united.select("brand", polygon_area().alias("area"), length().alias("outline")), "area", "outline", digits=5)


@register("a2_envelope", """select deployment_id, min(location_long) as xmin, min(location_lat) as ymin,
  max(location_long) as xmax, max(location_lat) as ymax from tracks group by 1""", "tracks")
def a2(spark, d):
    return tg.envelope(S.view(spark, d, "tracks"), "location_long", "location_lat", ["deployment_id"])


DIRECTIONS = [k * math.pi / 8 for k in range(16)]
DIR_SQL = "unnest([" + ", ".join(f"{{'k': {k}, 'c': {math.cos(a)!r}::double, 's': {math.sin(a)!r}::double}}"
                              for k, a in enumerate(DIRECTIONS)) + "])"


def support(verts: DataFrame, *by: str) -> DataFrame:
    """How far a set of vertices reaches in 16 directions."""
    dirs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(a)).alias("c"), F.lit(math.sin(a)).alias("s"))
                     for k, a in enumerate(DIRECTIONS)])
    rows = verts.select(*by, "x", "y", F.inline(dirs))
    reach = F.round(F.max(F.col("x") * F.col("c") + F.col("y") * F.col("s")), 6)
    return rows.groupBy(*by, "k").agg(reach.alias("reach"))


@register("a3_convex_hull", f"""with r as (select location_long as x, location_lat as y, {DIR_SQL} as d from tracks)
select d.k as k, round(max(x*d.c + y*d.s), 6) as reach from r group by 1""", "tracks")
def a3(spark, d):
    return support(tg.convex_hull(S.view(spark, d, "tracks"), "location_long", "location_lat"))


@register("a3_convex_hull_by_animal", f"""with r as (select deployment_id, location_long as x, location_lat as y,
  {DIR_SQL} as d from tracks)
select deployment_id, d.k as k, round(max(x*d.c + y*d.s), 6) as reach from r group by 1, 2""", "tracks")
def a3b(spark, d):
    hulls = tg.convex_hull(S.view(spark, d, "tracks"), "location_long", "location_lat", ["deployment_id"])
    return support(hulls, "deployment_id")


@register("a4_tracks_extent", """with b as (select min(location_long) as x0, min(location_lat) as y0,
  max(location_long) as x1, max(location_lat) as y1 from tracks),
d as (select *, 0.2e0*greatest(x1-x0, y1-y0) as d from b)
select round(x0-d, 6) as xmin, round(y0-d, 6) as ymin, round(x1+d, 6) as xmax, round(y1+d, 6) as ymax from d""", "tracks")
def a4(spark, d):
    return rounded(tg.tracks_extent(S.view(spark, d, "tracks"), buffer=0.2).drop("geom"), "xmin", "ymin", "xmax", "ymax")


@register("a4_tracks_extent_hull", """with b as (select min(location_long) as x0, min(location_lat) as y0,
  max(location_long) as x1, max(location_lat) as y1 from tracks)
select round(x0, 6) as xmin, round(y0, 6) as ymin, round(x1, 6) as xmax, round(y1, 6) as ymax from b""", "tracks")
def a4h(spark, d):
    hull = tg.tracks_extent(S.view(spark, d, "tracks"), "convex_hull")
    return rounded(hull.drop("geom"), "xmin", "ymin", "xmax", "ymax")


A5_SQL = f"""select cast(year(time) as int) as year, cast(month(time) as int) as month, {stats_sql('ndvi')}
from grid_ship group by 1, 2"""


@register("a5_groupby_multi_time", A5_SQL, "grid_ship")
def a5(spark, d):
    return stats_out(S.grid(spark, d, "grid_ship").group_stats("ndvi", ["year", "month"]))


@register("a5_groupby_multi_time_spread", A5_SQL, "grid_ship")
def a5s(spark, d):
    """The form of exact quantiles for groups that fit no single buffer."""
    from trackgrid.operators.stats import describe, with_units

    rows = with_units(S.view(spark, d, "grid_ship"), "time", ["year", "month"])
    return stats_out(describe(rows, "ndvi", ["year", "month"], input_bytes=1 << 40))


@register("a5_groupby_all", f"select {stats_sql('t2m')} from grid_day", "grid_day")
def a5a(spark, d):
    return stats_out(S.grid(spark, d, "grid_day").group_stats("t2m"))


@register("a5_groupby_dayofyear_hour", f"""select cast(dayofyear(time) as int) as dayofyear, cast(hour(time) as int) as hour,
  {stats_sql('t2m')} from grid_day group by 1, 2""", "grid_day")
def a5d(spark, d):
    return stats_out(S.grid(spark, d, "grid_day").group_stats("t2m", ["dayofyear", "hour"]))


A6_SQL = f"""with {ZONE_HIT.format(g='grid_day')}
select h.zone_id, cast(month(g.time) as int) as month, {stats_sql('t2m')}
from grid_day g join hit h on g.latitude=h.latitude and g.longitude=h.longitude group by 1,2"""


@register("a6_groupby_poly_time", A6_SQL, "grid_day zone_edges")
def a6(spark, d):
    return stats_out(S.grid(spark, d, "grid_day").zonal_stats(S.diamonds(spark, d), "zone_id", "t2m", ["month"]))


@register("a6_groupby_poly_time_rows", A6_SQL, "grid_day zone_edges")
def a6r(spark, d):
    g = S.grid(spark, d, "grid_day")
    return stats_out(g.zonal_stats(S.diamonds(spark, d), "zone_id", "t2m", ["month"], strategy="rows"))


@register("a6_groupby_poly_overlap", f"""with cells as (select distinct latitude, longitude from grid_ship),
hit as (select latitude, longitude, max(zone_id) as zone_id from (
  select c.latitude, c.longitude, z.zone_id from cells c join zones z
  on c.longitude > z.xmin-1e0 and c.longitude < z.xmax+1e0 and c.latitude > z.ymin-1e0 and c.latitude < z.ymax+1e0)
  group by 1, 2)
select h.zone_id, cast(year(g.time) as int) as year, {stats_sql('ndvi')}
from grid_ship g join hit h on g.latitude=h.latitude and g.longitude=h.longitude group by 1,2""", "grid_ship zones")
def a6o(spark, d):
    """Overlapping polygons: the later one has the cell."""
    wide = S.view(spark, d, "zones").withColumns({
        "xmin": F.col("xmin") - 1, "ymin": F.col("ymin") - 1, "xmax": F.col("xmax") + 1, "ymax": F.col("ymax") + 1})
    g = S.grid(spark, d, "grid_ship", declare=True)
    return stats_out(g.zonal_stats(tg.box_features(wide), "zone_id", "ndvi", ["year"], order_col="zone_id"))


@register("a7_spatial_mean_series", "select time, round(avg(ndvi), 6)+0.0 as ndvi from grid_ship group by 1", "grid_ship")
def a7(spark, d):
    return rounded(tg.spatial_mean_series(S.grid(spark, d, "grid_ship"), "ndvi"), "ndvi")


A8_BASE = """with ti as (select time, cast(dense_rank() over (order by time) - 1 as int) as i from (select distinct time from grid_day)),
ai as (select latitude, cast(dense_rank() over (order by latitude desc) - 1 as int) as i from (select distinct latitude from grid_day)),
oi as (select longitude, cast(dense_rank() over (order by longitude) - 1 as int) as i from (select distinct longitude from grid_day)),"""


@register("a8_coarsen", A8_BASE + """
tb as (select i//4 as b, make_timestamp(cast(floor(avg(epoch_us(time))) as bigint)) as time from ti
  where i < (select count(*) from ti)//4*4 group by 1),
ab as (select i//3 as b, avg(latitude) as latitude from ai where i < (select count(*) from ai)//3*3 group by 1),
ob as (select i//5 as b, avg(longitude) as longitude from oi where i < (select count(*) from oi)//5*5 group by 1)
select tb.time, round(ab.latitude, 6) as latitude, round(ob.longitude, 6) as longitude, round(avg(g.t2m), 6)+0.0 as t2m
from grid_day g join ti on g.time = ti.time join ai on g.latitude = ai.latitude join oi on g.longitude = oi.longitude
join tb on tb.b = ti.i//4 join ab on ab.b = ai.i//3 join ob on ob.b = oi.i//5 group by 1,2,3""", "grid_day")
def a8(spark, d):
    g = S.grid(spark, d, "grid_day")
    return rounded(g.coarsen({"time": 4, "latitude": 3, "longitude": 5}).df, "latitude", "longitude", "t2m")


@register("a8_coarsen_pad", A8_BASE + """
tb as (select i//7 as b, min(time) as time from ti group by 1),
ab as (select i//4 as b, max(latitude) as latitude from ai group by 1)
select tb.time, round(ab.latitude, 6) as latitude, round(g.longitude, 6) as longitude, round(avg(g.t2m), 6)+0.0 as t2m
from grid_day g join ti on g.time = ti.time join ai on g.latitude = ai.latitude
join tb on tb.b = ti.i//7 join ab on ab.b = ai.i//4 group by 1,2,3""", "grid_day")
def a8p(spark, d):
    g = S.grid(spark, d, "grid_day")
    out = g.coarsen({"time": 7, "latitude": 4}, boundary="pad", coord_func={"time": "min", "latitude": "max"})
    return rounded(out.df, "latitude", "longitude", "t2m")


@register("a8_coarsen_space", """with b as (select time, cast(round((59.9-latitude)/0.75) as int)//4 as a,
  cast(round((longitude+129.9)/0.75) as int)//5 as o, ndvi, snow from grid_ship)
select time, round(59.9e0-0.75e0*(4*a+1.5e0), 6) as latitude, round(-129.9e0+0.75e0*(5*o+2), 6) as longitude,
  round(avg(ndvi), 6)+0.0 as ndvi, round(avg(snow), 6)+0.0 as snow from b group by 1,2,3""", "grid_ship")
def a8s(spark, d):
    g = S.grid(spark, d, "grid_ship", declare=True)
    return rounded(g.coarsen({"latitude": 4, "longitude": 5}).df, "latitude", "longitude", "ndvi", "snow")


@register("a9_resample_down", """with o as (select date_trunc('day', min(time)) as o, max(time) as m from grid_ship),
bins as (select unnest(generate_series(o.o, o.m, interval 16 day)) as time from o),
cells as (select distinct latitude, longitude from grid_ship),
m as (select o.o + interval 16 day * cast(floor((epoch_us(g.time)-epoch_us(o.o))/1382400000000) as int) as time,
  latitude, longitude, avg(ndvi) as ndvi, avg(snow) as snow from grid_ship g, o group by 1,2,3)
select b.time, c.latitude, c.longitude, round(m.ndvi, 6)+0.0 as ndvi, round(m.snow, 6)+0.0 as snow from bins b cross join cells c
left join m on m.time = b.time and m.latitude = c.latitude and m.longitude = c.longitude""", "grid_ship")
def a9(spark, d):
    return rounded(S.grid(spark, d, "grid_ship").resample_time(16, "day").df, "ndvi", "snow")


@register("a10_track_density", """select cast(floor((location_long+130)/5e-1) as bigint) as cell_x,
  cast(floor((location_lat-45)/5e-1) as bigint) as cell_y, count(*) as n from tracks group by 1,2""", "tracks")
def a10(spark, d):
    return tg.track_density(S.view(spark, d, "tracks"), 0.5, (-130.0, 45.0))


@register("a11_count_exceeding", """select cast(year(time) as int) as year, latitude,
  count(*) filter (where ndvi > 5.5) as n_exceeding, count(ndvi) as n_values from grid_ship group by 1,2""", "grid_ship")
def a11(spark, d):
    df = S.view(spark, d, "grid_ship").withColumn("year", F.year("time"))
    return tg.count_exceeding(df, "ndvi", 5.5, ["year", "latitude"])


@register("a12_first_day_exceeded", """select latitude, longitude, cast(year(time) as int) as year,
  cast(min(time) filter (where ndvi > 6.7) as date) as first_day from grid_ship group by 1,2,3""", "grid_ship")
def a12(spark, d):
    return tg.first_day_exceeded(S.view(spark, d, "grid_ship"), "ndvi", 6.7, by=["latitude", "longitude"])


# 2.6 Interpolation and re-gridding ------------------------------------------


def interpolation_sql(source: str, freq: int, cols: list[str], cast_time: str = "time") -> str:
    """Rows interpolated to multiples of ``freq`` microseconds from the first midnight."""
    lead = ", ".join(f"lead({c}) over w as n_{c}" for c in cols)
    value = ", ".join(
        f"case when tt = us then {c} when lt = nx then {c} + (n_{c}-{c})*((tt-us)/(nx-us)::double) end as {c}" for c in cols)
    return f"""ax as (select us, lead(us) over (order by us) as nx from (select distinct epoch_us(time) as us from {source})),
o as (select epoch_us(date_trunc('day', min(time))) as o from {source}),
st as (select a.us, a.nx, g.latitude, g.longitude, {', '.join('g.' + c for c in cols)}, lead(a.us) over w as lt, {lead}
  from {source} g join ax a on a.us = epoch_us(g.time) window w as (partition by g.latitude, g.longitude order by g.time)),
tg as (select st.*, unnest(generate_series(o.o + cast(ceil((us-o.o)/{freq}.0) as bigint)*{freq},
  coalesce(nx-1, us), {freq})) as tt from st, o),
ip as (select tt, latitude, longitude, {value} from tg)"""


@register("i1_resample_up", "with " + interpolation_sql("grid_day", 6 * 3_600_000_000, ["t2m"]) + """
select make_timestamp(tt) as time, latitude, longitude, round(t2m, 6)+0.0 as t2m from ip""", "grid_day")
def i1(spark, d):
    return rounded(S.grid(spark, d, "grid_day").resample_time(6, "hour").df, "t2m")


@register("i2_resample_irregular", "with " + interpolation_sql("grid_day", 12 * 3_600_000_000, ["t2m"]) + """,
b as (select o.o + (tt-o.o)//129600000000*129600000000 as tt, latitude, longitude, t2m from ip, o)
select make_timestamp(tt) as time, latitude, longitude, round(avg(t2m), 6)+0.0 as t2m from b group by 1,2,3""", "grid_day")
def i2(spark, d):
    out = S.grid(spark, d, "grid_day").resample_time(36, "hour", interp_irreg=True, fill=False)
    return rounded(out.df, "t2m")


@register("i3_thin", A8_BASE + """ z as (select 1)
select g.time, g.latitude, g.longitude, g.t2m from grid_day g join ti on g.time = ti.time
join ai on g.latitude = ai.latitude join oi on g.longitude = oi.longitude
where ti.i % 2 = 0 and ai.i % 3 = 0 and oi.i % 4 = 0""", "grid_day")
def i3(spark, d):
    return S.grid(spark, d, "grid_day").thin({"time": 2, "latitude": 3, "longitude": 4}).df


@register("i3_thin_off_axis", """select time, latitude, longitude, t2m from grid_day
where cast(round((longitude+129.9)/1.5) as int) % 2 = 0 and cast(round((59.9-latitude)/1.5) as int) % 3 = 0""", "grid_day")
def i3o(spark, d):
    """Every third place of a declared axis; data off the axis are at none of them."""
    g = off_axis(spark, d).with_axes({"latitude": tg.RegularAxis(59.9, -1.5, 10)})
    return g.thin({"latitude": 3}).df


@register("i3_thin_all", """select time, latitude, longitude, ndvi, snow from (
  select *, cast(round((59.9-latitude)/0.75) as int) as a, cast(round((longitude+129.9)/0.75) as int) as o,
  dense_rank() over (order by time) - 1 as t from grid_ship) where a % 3 = 0 and o % 3 = 0 and t % 3 = 0""", "grid_ship")
def i3a(spark, d):
    return S.grid(spark, d, "grid_ship", declare=True).thin(3).df


TARGET = (tg.RegularAxis(58.0, -1.1, 10), tg.RegularAxis(-129.0, 1.3, 11))
REGRID_AXES = """la as (select 58.0e0 - 1.1e0*i as v from range(10) t(i)), lo as (select -129.0e0 + 1.3e0*i as v from range(11) t(i)),
lp as (select v, (59.9e0-v)/7.5e-1 as p from la), op as (select v, (v+129.9e0)/7.5e-1 as p from lo),"""


@register("i4_regrid_nearest", "with " + REGRID_AXES + """
ln as (select v, cast(case when p-floor(p) <= 0.5 then floor(p) else ceil(p) end as int) as i from lp where p between 0 and 19),
oq as (select v, cast(case when p-floor(p) <= 0.5 then floor(p) else ceil(p) end as int) as i from op where p between 0 and 24),
g as (select *, cast(round((59.9-latitude)/0.75) as int) as a, cast(round((longitude+129.9)/0.75) as int) as o from grid_ship)
select g.time, round(ln.v, 6) as latitude, round(oq.v, 6) as longitude, g.ndvi, g.snow
from g join ln on g.a = ln.i join oq on g.o = oq.i""", "grid_ship")
def i4(spark, d):
    g = S.grid(spark, d, "grid_ship", declare=True)
    return rounded(g.regrid_to(TARGET).df, "latitude", "longitude")


@register("i5_interpolate", "with " + REGRID_AXES + """
lw as (select v, cast(floor(p) as int) as i, 1-(p-floor(p)) as w from lp where p between 0 and 19
  union all select v, cast(floor(p) as int)+1, p-floor(p) from lp where p between 0 and 19 and p > floor(p)),
ow as (select v, cast(floor(p) as int) as i, 1-(p-floor(p)) as w from op where p between 0 and 24
  union all select v, cast(floor(p) as int)+1, p-floor(p) from op where p between 0 and 24 and p > floor(p)),
g as (select *, cast(round((59.9-latitude)/0.75) as int) as a, cast(round((longitude+129.9)/0.75) as int) as o from grid_ship)
select g.time, round(lw.v, 6) as latitude, round(ow.v, 6) as longitude,
  case when sum(lw.w*ow.w) > 1-1e-9 then round(sum(g.ndvi*lw.w*ow.w), 6)+0.0 end as ndvi,
  case when sum(lw.w*ow.w) > 1-1e-9 then round(sum(g.snow*lw.w*ow.w), 6)+0.0 end as snow
from g join lw on g.a = lw.i join ow on g.o = ow.i group by 1,2,3""", "grid_ship")
def i5(spark, d):
    g = S.grid(spark, d, "grid_ship", declare=True)
    return rounded(g.regrid_to(TARGET, "linear").df, "latitude", "longitude", "ndvi", "snow")


# 2.7 Geometry ---------------------------------------------------------------


@register("g1_bbox_to_polygon", """with c as (select *, unnest([0,1,2,3,4]) as vertex from zones)
select zone_id, vertex, case when vertex in (0,1,4) then xmin else xmax end as x,
  case when vertex in (0,3,4) then ymin else ymax end as y from c""", "zones")
def g1(spark, d):
    return explode_rings(S.zone_boxes(spark, d), "zone_id").select("zone_id", "vertex", "x", "y")


@register("g2_buffer_boundary", """with b as (select min(xmin) as x0, min(ymin) as y0, max(xmax) as x1, max(ymax) as y1 from zones),
d as (select *, 0.1e0*greatest(x1-x0, y1-y0) as d from b),
arc as (select unnest(range(17)) as k),
v as (select x1 as cx, y0 as cy, -90e0+k*90e0/16 as g, d from d, arc union all select x1, y1, k*90e0/16, d from d, arc
  union all select x0, y1, 90e0+k*90e0/16, d from d, arc union all select x0, y0, 180e0+k*90e0/16, d from d, arc)
select round(cx+d*cos(radians(g)), 6)+0.0 as x, round(cy+d*sin(radians(g)), 6)+0.0 as y from v""", "zones")
def g2(spark, d):
    """Round buffer of the box around all zones: the vertices of its outline."""
    row = feature_envelope(S.zone_boxes(spark, d)).first()
    box = (row["xmin"], row["ymin"], row["xmax"], row["ymax"])
    from trackgrid.operators.boundary import buffer_distance, ring_feature

    ring = buffer_convex(G.bbox_ring(box), buffer_distance(box, 0.1), "round")
    verts = explode_rings(ring_feature(spark, ring))
    return rounded(verts.where(F.col("vertex") < len(ring)).select("x", "y"), "x", "y")


# Corners of the diamonds: the edge that enters, the one that leaves, and the steps of the arc around the corner.
CORNERS = """nx as (select a.zone_id, a.x1, a.y1, a.x2, a.y2, b.x2 as x3, b.y2 as y3,
  sqrt((a.x2-a.x1)**2+(a.y2-a.y1)**2) as l, sqrt((b.x2-b.x1)**2+(b.y2-b.y1)**2) as m
  from zone_edges a join zone_edges b on a.zone_id = b.zone_id and a.x2 = b.x1 and a.y2 = b.y1),
cs as (select *, acos(((x2-x1)*(x3-x2)+(y2-y1)*(y3-y2))/(l*m)) as turn, atan2(-(x2-x1)/l, (y2-y1)/l) as start from nx),
corners as (select *, greatest(1, cast(floor(turn/(pi()/32)+0.5) as int)) as steps from cs)"""


@register("g2_buffer_polygons", f"""with {CORNERS}, d as (select 0.2e0 as d)
select round(sum((x1*y2-x2*y1)/2 + l*d + steps*d*d*sin(turn/steps)/2), 6) as area,
  round(sum(l + 2*steps*d*sin(turn/steps/2)), 6) as outline, cast(count(*)/4 as bigint) as outer_rings from corners, d""", "zones zone_edges")
def g2p(spark, d):
    """All diamonds grown with round corners: area, outline and number of outer rings."""
    grown = tg.buffer_polygons(S.diamonds(spark, d), 0.2)
    outer = F.expr("cast(size(geom.parts) as bigint)")
    return rounded(grown.select(polygon_area().alias("area"), length().alias("outline"), outer.alias("outer_rings")), "area", "outline")


def clip_sql(x0, y0, x1, y1) -> str:
    """Liang-Barsky over the segments of ``roads``: shares t0 and t1."""
    q = [f"(case when x2=x1 then (case when x1 between {x0} and {x1} then 0e0 else 2e0 end) when x2>x1 then ({x0}-x1)/(x2-x1) else ({x1}-x1)/(x2-x1) end)",
         f"(case when y2=y1 then (case when y1 between {y0} and {y1} then 0e0 else 2e0 end) when y2>y1 then ({y0}-y1)/(y2-y1) else ({y1}-y1)/(y2-y1) end)"]
    r = [f"(case when x2=x1 then 1e0 when x2>x1 then ({x1}-x1)/(x2-x1) else ({x0}-x1)/(x2-x1) end)",
         f"(case when y2=y1 then 1e0 when y2>y1 then ({y1}-y1)/(y2-y1) else ({y0}-y1)/(y2-y1) end)"]
    return f"select *, greatest(0e0, {q[0]}, {q[1]}) as t0, least(1e0, {r[0]}, {r[1]}) as t1 from roads"


@register("g3_clip_lines_box", f"""with c as ({clip_sql(*[f'({v}e0)' for v in BOX])})
select road_id, road_class, round((t1-t0)*sqrt((x2-x1)**2+(y2-y1)**2), 6) as len,
  round(x1+t0*(x2-x1), 6)+0.0 as ax, round(y1+t0*(y2-y1), 6)+0.0 as ay from c where t0 < t1""", "roads")
def g3(spark, d):
    cut = tg.clip_to_box(S.roads(spark, d), BOX)
    first = F.col("geom.parts")[0][0]
    out = cut.select("road_id", "road_class", length().alias("len"), first["x"].alias("ax"), first["y"].alias("ay"))
    return rounded(out, "len", "ax", "ay")


@register("g3_clip_lines_polygons", """with h as (select r.road_id, r.x1, r.y1, r.x2, r.y2, e.zone_id,
  (e.x2-e.x1)*(r.y1-e.y1)-(e.y2-e.y1)*(r.x1-e.x1) as s1, (e.x2-e.x1)*(r.y2-e.y1)-(e.y2-e.y1)*(r.x2-e.x1) as s2
  from roads r join zone_edges e on true
  join zones z on z.zone_id = e.zone_id and least(r.x1,r.x2) <= z.xmax and greatest(r.x1,r.x2) >= z.xmin
   and least(r.y1,r.y2) <= z.ymax and greatest(r.y1,r.y2) >= z.ymin),
t as (select road_id, zone_id, any_value(sqrt((x2-x1)**2+(y2-y1)**2)) as l,
  greatest(0e0, max(case when s1 < 0 and s2 < 0 then 2e0 when s1 < 0 and s2 > s1 then s1/(s1-s2) else 0e0 end)) as t0,
  least(1e0, min(case when s1 >= 0 and s2 < 0 then s1/(s1-s2) else 1e0 end)) as t1 from h group by 1,2)
select road_id, round(sum((t1-t0)*l), 6) as len, count(*) as pieces from t where t1-t0 > 1e-12 group by 1""",
          "roads zone_edges")
def g3p(spark, d):
    cut = tg.clip_to_polygons(S.roads(spark, d), S.diamonds(spark, d), "road_id", ["LineString"])
    out = cut.select("road_id", length().alias("len"), F.size("geom.parts").cast("bigint").alias("pieces"))
    return rounded(out, "len")


@register("g3_clip_polygons_box", """select parcel_id, brand,
  round((least(xmax,-117e0)-greatest(xmin,-123e0))*(least(ymax,55e0)-greatest(ymin,50e0)), 6) as area
from parcels where xmin < -117e0 and xmax > -123e0 and ymin < 55e0 and ymax > 50e0""", "parcels")
def g3b(spark, d):
    cut = tg.clip_to_box(S.parcels(spark, d), BOX)
    area = F.aggregate(signed_areas(), F.lit(0.0), lambda a, p: a + F.abs(p))
    return rounded(cut.select("parcel_id", "brand", area.alias("area")), "area")


@register("g3_clip_polygons_zones", """select p.parcel_id,
  round(sum((least(p.xmax,z.xmax)-greatest(p.xmin,z.xmin))*(least(p.ymax,z.ymax)-greatest(p.ymin,z.ymin))), 6) as area
from parcels p join zones z on p.xmin < z.xmax and p.xmax > z.xmin and p.ymin < z.ymax and p.ymax > z.ymin group by 1""",
          "parcels zones")
def g3z(spark, d):
    cut = tg.clip_to_polygons(S.parcels(spark, d), S.zone_boxes(spark, d), "parcel_id", ["Polygon"])
    area = F.aggregate(signed_areas(), F.lit(0.0), lambda a, p: a + F.abs(p))
    return rounded(cut.select("parcel_id", area.alias("area")), "area")


@register("g3_clip_polygons_overlap", f"""with z as (select xmin-0.5e0 as xmin, ymin-0.5e0 as ymin, xmax+0.5e0 as xmax, ymax+0.5e0 as ymax from zones),
p as (select p.parcel_id, round(greatest(p.xmin, z.xmin), 9) as xmin, round(greatest(p.ymin, z.ymin), 9) as ymin,
  round(least(p.xmax, z.xmax), 9) as xmax, round(least(p.ymax, z.ymax), 9) as ymax
  from parcels p join z on p.xmin < z.xmax and p.xmax > z.xmin and p.ymin < z.ymax and p.ymax > z.ymin),
{sweep_sql('u', 'p', 'parcel_id')}
select u_x.parcel_id, round(u_x.area, 6) as area, round(u_x.side + u_y.side, 6) as outline from u_x join u_y on u_x.parcel_id = u_y.parcel_id
where u_x.area > 1e-9""", "parcels zones")
def g3o(spark, d):
    """Parcels cut at zones that overlap each other: what two zones cover counts once."""
    wide = [(F.col(c) + F.lit(w)).alias(c) for c, w in zip(G.BOX, (-0.5, -0.5, 0.5, 0.5))]
    mask = tg.box_features(S.view(spark, d, "zones").select("zone_id", *wide))
    cut = tg.clip_to_polygons(S.parcels(spark, d), mask, kinds=["Polygon"])
    return rounded(cut.select("parcel_id", polygon_area().alias("area"), length().alias("outline")).where("area > 1e-9D"), "area", "outline")


@register("g3_clip_polygons_holes", """with z as (select *, xmin+0.8e0 as hx0, ymin+0.7e0 as hy0, xmax-0.8e0 as hx1, ymax-0.7e0 as hy1 from zones),
c as (select p.parcel_id, (least(p.xmax,z.xmax)-greatest(p.xmin,z.xmin))*(least(p.ymax,z.ymax)-greatest(p.ymin,z.ymin))
  - greatest(0e0, least(p.xmax,z.hx1)-greatest(p.xmin,z.hx0))*greatest(0e0, least(p.ymax,z.hy1)-greatest(p.ymin,z.hy0)) as area,
  case when p.xmin < z.hx0 and p.xmax > z.hx1 and p.ymin < z.hy0 and p.ymax > z.hy1 then 1 else 0 end as hole
from parcels p join z on p.xmin < z.xmax and p.xmax > z.xmin and p.ymin < z.ymax and p.ymax > z.ymin)
select parcel_id, round(sum(area), 6) as area, cast(sum(hole) as bigint) as holes from c group by 1 having sum(area) > 1e-9""", "parcels zones")
def g3h(spark, d):
    """Parcels cut at zones with a hole each; a parcel around a whole hole keeps it as a hole."""
    x0, y0, x1, y1 = [F.col(c) for c in G.BOX]
    inner = G.box_polygon(x0 + 0.8, y0 + 0.7, x1 - 0.8, y1 - 0.7)["parts"][0]
    zones = S.zone_boxes(spark, d)
    mask = tg.make_features(zones.drop("geom"), G.geometry("Polygon", F.array(G.box_polygon(x0, y0, x1, y1)["parts"][0], inner)), (x0, y0, x1, y1))
    cut = tg.clip_to_polygons(S.parcels(spark, d), mask, kinds=["Polygon"])
    holes = F.expr("size(filter(areas, a -> a * areas[0] < 0))").cast("bigint")
    cut = cut.withColumn("areas", signed_areas())
    return rounded(cut.select("parcel_id", polygon_area().alias("area"), holes.alias("holes")).where("area > 1e-9D"), "area")


@register("g3_clip_points", """select distinct e.zone_id is not null as inside, t.event_id from tracks t join zone_edges e
  on (e.y1 > t.location_lat) <> (e.y2 > t.location_lat)
 and t.location_long < (e.x2-e.x1)*(t.location_lat-e.y1)/(e.y2-e.y1)+e.x1
  group by t.event_id, e.zone_id having count(*)%2=1""", "tracks zone_edges")
def g3d(spark, d):
    dot = G.geometry("Point", F.array(F.array(G.point(F.col("location_long"), F.col("location_lat")))))
    features = tg.make_features(S.view(spark, d, "tracks").select("event_id", "location_long", "location_lat"), dot)
    cut = tg.clip_to_polygons(features, S.diamonds(spark, d), "event_id", ["Point"])
    return cut.select(F.lit(True).alias("inside"), "event_id")


@register("g4_reproject", """select event_id, round(radians(location_long)*6378137, 3) as mx,
  round(ln(tan(radians(location_lat)/2+pi()/4))*6378137, 3) as my,
  round(radians(location_long)*cos(radians(location_lat))*6371007.181, 3) as sx,
  round(radians(location_lat)*6371007.181, 3) as sy, round(location_long, 6) as rx, round(location_lat, 6) as ry from tracks""",
          "tracks")
def g4(spark, d):
    t = S.view(spark, d, "tracks")
    x, y = F.col("location_long"), F.col("location_lat")
    mx, my = tg.reproject(x, y, 4326, 3857)
    sx, sy = tg.reproject(x, y, 4326, "MODIS")
    ux, uy = tg.reproject(*tg.reproject(x, y, 4326, 32610), 32610, 4326)
    out = t.select("event_id", mx.alias("mx"), my.alias("my"), sx.alias("sx"), sy.alias("sy"), ux.alias("rx"), uy.alias("ry"))
    return rounded(rounded(out, "mx", "my", "sx", "sy", digits=3), "rx", "ry")


@register("g5_geometry_kind", """select 'LineString' as kind, count(*) as n from roads
union all select 'Polygon', count(*) from parcels""", "roads parcels")
def g5(spark, d):
    both = S.roads(spark, d).select("geom").unionByName(S.parcels(spark, d).select("geom"))
    return both.groupBy(tg.geometry_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# 2.8 Composite jobs ---------------------------------------------------------


@register("c1_subset_bbox_clip", f"""with c as ({clip_sql(*[f'({v}e0)' for v in BOX])})
select road_class, count(*) as n, round(sum((t1-t0)*sqrt((x2-x1)**2+(y2-y1)**2)), 4) as len from c where t0 < t1 group by 1""",
          "roads")
def c1(spark, d):
    out = tg.subset_features(spark, S.roads(spark, d), bbox=BOX, clip=True).subset
    return rounded(out.groupBy("road_class").agg(F.count(F.lit(1)).alias("n"), F.sum(length()).alias("len")),
                   "len", digits=4)


def tracks_box_sql(tracks: str) -> str:
    return f"""with b as (select min(location_long) as bx0, min(location_lat) as by0,
  max(location_long) as bx1, max(location_lat) as by1 from {tracks}),
k as (select bx0-d as bx0, by0-d as by0, bx1+d as bx1, by1+d as by1 from (select *, 0.01e0*greatest(bx1-bx0, by1-by0) as d from b))
select road_id, road_class from roads r, k where {segment_box_sql('r', 'bx0', 'by0', 'bx1', 'by1')}"""


def roads_near(spark, d, view, **boundary):
    out = tg.subset_features(spark, S.roads(spark, d), track_points=S.view(spark, d, view), **boundary)
    return out.subset.select("road_id", "road_class")


@register("c1_subset_all_tracks_box", tracks_box_sql("tracks"), "roads tracks")
def c1ta(spark, d):
    """Roads that meet the widened box of all tracks."""
    return roads_near(spark, d, "tracks", buffer=0.01)


@register("c1_subset_all_tracks_hull")
def c1ha(spark, d):
    """Roads that meet the widened hull of all tracks. Checked by brute force in the tests."""
    return roads_near(spark, d, "tracks", boundary_type="convex_hull", buffer=0.02, id_col="road_id")


@register("c1_subset_part_tracks_box", tracks_box_sql("tracks_part"), "roads tracks_part")
def c1tp(spark, d):
    """Roads that meet the widened box of all fixes of tracks that lie in a part of the study area."""
    return roads_near(spark, d, "tracks_part", buffer=0.01)


@register("c1_subset_part_tracks_hull")
def c1hp(spark, d):
    """Roads that meet the widened hull of all fixes of tracks in a part of the study area. Checked by brute force in the tests."""
    return roads_near(spark, d, "tracks_part", boundary_type="convex_hull", buffer=0.02, id_col="road_id")


@register("c1_subset_bbox_projected", """select event_id from tracks
where location_long between -123.005e0 and -112.345e0 and location_lat between 48.015e0 and 56.985e0""", "tracks")
def c1p(spark, d):
    """A box in degrees on fixes stored in a conic system. The box has curved edges there."""
    t = S.view(spark, d, "tracks")
    x, y = tg.reproject(F.col("location_long"), F.col("location_lat"), 4326, "ESRI:102001")
    moved = t.select("event_id", x.alias("x"), y.alias("y"))
    point = G.geometry("Point", F.array(F.array(G.point(F.col("x"), F.col("y")))))
    layer = tg.set_crs(G.with_box(moved.select("event_id", point.alias("geom"))), "ESRI:102001")
    return tg.subset_features(spark, layer, bbox=(-123.005, 48.015, -112.345, 56.985), id_col="event_id").subset.select("event_id")


@register("c1_subset_mask", f"""with {STARTS_INSIDE},
meets as (select distinct r.road_id from roads r join zone_edges e on {segments_meet_sql('r', 'e')})
select road_class, count(*) as n from roads where road_id in (select road_id from meets)
  or road_id in (select road_id from starts) group by 1""", "roads zone_edges")
def c1m(spark, d):
    out = tg.subset_features(spark, S.roads(spark, d), bounding_geom=S.diamonds(spark, d), boundary_type="mask",
                             id_col="road_id")
    return out.subset.groupBy("road_class").agg(F.count(F.lit(1)).alias("n"))


@register("c1_subset_mask_buffer_clip", f"""with {CORNERS},
d as (select 0.01e0*greatest(max(xmax)-min(xmin), max(ymax)-min(ymin)) as d from zones),
arcs as (select zone_id, x2, y2, d, start+turn*k/steps as g, start+turn*(k+1)/steps as h from corners, d, range(64) t(k) where k < steps),
rim as (select zone_id, x1+d*(y2-y1)/l as x1, y1-d*(x2-x1)/l as y1, x2+d*(y2-y1)/l as x2, y2-d*(x2-x1)/l as y2 from nx, d
  union all select zone_id, x2+d*cos(g), y2+d*sin(g), x2+d*cos(h), y2+d*sin(h) from arcs),
near as (select r.road_id, r.x1, r.y1, r.x2, r.y2, z.zone_id from roads r, d join zones z
  on least(r.x1,r.x2) <= z.xmax+d.d and greatest(r.x1,r.x2) >= z.xmin-d.d and least(r.y1,r.y2) <= z.ymax+d.d and greatest(r.y1,r.y2) >= z.ymin-d.d),
h as (select n.road_id, n.zone_id, sqrt((n.x2-n.x1)**2+(n.y2-n.y1)**2) as l,
  (e.x2-e.x1)*(n.y1-e.y1)-(e.y2-e.y1)*(n.x1-e.x1) as s1, (e.x2-e.x1)*(n.y2-e.y1)-(e.y2-e.y1)*(n.x2-e.x1) as s2
  from near n join rim e on e.zone_id = n.zone_id),
t as (select road_id, zone_id, any_value(l) as l,
  greatest(0e0, max(case when s1 < 0 and s2 < 0 then 2e0 when s1 < 0 and s2 > s1 then s1/(s1-s2) else 0e0 end)) as t0,
  least(1e0, min(case when s1 >= 0 and s2 < 0 then s1/(s1-s2) else 1e0 end)) as t1 from h group by 1,2)
select road_id, round(sum((t1-t0)*l), 5) as len from t where t1 > t0 group by 1 having sum((t1-t0)*l) > 1e-4""", "roads zones zone_edges")
def c1w(spark, d):
    """Roads cut at a mask of diamonds that is widened with round corners."""
    out = tg.subset_features(spark, S.roads(spark, d), bounding_geom=S.diamonds(spark, d), boundary_type="mask", buffer=0.01,
                             clip=True, kinds=["LineString"])
    return rounded(out.subset.select("road_id", length().alias("len")).where("len > 1e-4D"), "len", digits=5)


@register("c2_explore_grid", f"""with {ZONE_HIT.format(g='grid_ship')},
s as (select g.time, g.latitude, g.longitude, g.ndvi from grid_ship g
  where time >= timestamp '1996-01-01' and time < timestamp '2000-01-01' and month(time) between 4 and 9
  and (latitude, longitude) in (select (latitude, longitude) from hit)),
o as (select date_trunc('day', min(time)) as o from s),
m as (select o.o + interval 7 day * cast(floor((epoch_us(s.time)-epoch_us(o.o))/604800000000) as int) as time,
  latitude, longitude, avg(ndvi) as ndvi from s, o group by 1,2,3)
select cast(year(time) as int) as year, {stats_sql('ndvi')} from m group by 1""", "grid_ship zone_edges")
def c2(spark, d):
    """Range, months, area, weekly means, yearly statistics. Empty bins do not count."""
    out = tg.explore_grid(S.grid(spark, d, "grid_ship"), variables=["ndvi"], start="1996", end="1999",
                          conditions={"month_range": [4, 9]}, polygons=S.diamonds(spark, d), resample=(7, "day"),
                          stats_of="ndvi", by=["year"])
    # A year of which only empty bins are left has no statistics in the SQL.
    return stats_out(out.stats.where(F.col("count") > 0))


@register("c3_prepare_tracks", """with u as (select event_id, timestamp, deployment_id, location_long, location_lat, null as sensor
  from tracks_ship union all select event_id, timestamp, deployment_id, location_long, location_lat, sensor from tracks_order),
p as (select min(timestamp) as a, max(timestamp) as b from tracks_order)
select u.deployment_id, r.animal_taxon, count(*) as n, count(u.sensor) as n_sensor, min(u.timestamp) as first_fix
from u left join ref r on u.deployment_id is not distinct from r.deployment_id, p
where u.timestamp between p.a and p.b group by 1,2""", "tracks_ship tracks_order ref")
def c3(spark, d):
    out = tg.prepare_tracks(spark, [S.view(spark, d, "tracks_ship"), S.view(spark, d, "tracks_order")],
                            ref=S.view(spark, d, "ref"), period_of=S.view(spark, d, "tracks_order"))
    return out.tracks.groupBy("deployment_id", "animal_taxon").agg(
        F.count(F.lit(1)).alias("n"), F.count("sensor").alias("n_sensor"), F.min("timestamp").alias("first_fix"))


# 2.9 Sets and 2.10 sorts ----------------------------------------------------


@register("u1_combine_studies", f"""select {TRACK_COLS}, cast(null as varchar) as sensor from tracks_ship
union all select {TRACK_COLS}, sensor from tracks_order""", "tracks_ship tracks_order")
def u1(spark, d):
    return tg.combine_studies([S.view(spark, d, "tracks_ship"), S.view(spark, d, "tracks_order")])


@register("u2_concat_time", """select time, latitude, longitude, ndvi, snow from grid_ship where year(time) <= 1997
union all select time, latitude, longitude, ndvi, snow from grid_ship where year(time) > 1997""", "grid_ship")
def u2(spark, d):
    g = S.grid(spark, d, "grid_ship", declare=True)
    return concat_time([g.select_time_range(end="1997"), g.select_time_range(start="1998")]).df


@register("u3_selection_union", """select time, latitude, longitude, ndvi, snow from grid_ship
  where month(time) in (1, 2, 3, 4, 11)""", "grid_ship")
def u3(spark, d):
    return S.grid(spark, d, "grid_ship").select_time_cond(months=[1, 3, 11], month_range=[2, 4]).df


@register("o1_sort_by_time", f"select {TRACK_COLS} from tracks order by timestamp", "tracks")
def o1(spark, d):
    return tg.sort_by_time(S.view(spark, d, "tracks"), "timestamp")


@register("o2_sort_stats", f"""select latitude, {stats_sql('snow')} from grid_ship group by 1 order by 1""", "grid_ship")
def o2(spark, d):
    from trackgrid.operators.stats import describe

    return tg.sort_stats(stats_out(describe(S.view(spark, d, "grid_ship"), "snow", ["latitude"])), ["latitude"])
