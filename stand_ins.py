"""Tracks, reference data, grids and features derived from the given tables.

Every view exists twice with the same rows: as a Spark DataFrame for
``queries()`` and as SQL text for ``oracle_sql()``. Exponent literals are
DOUBLE in both engines. Grid variables are square roots: means of numbers with
few decimals often end in a 5 that the engines round to different sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgrid import GridFrame, RegularAxis, box_features, make_features
from trackgrid.functions import geometry as G

# name -> (source table, select list, tail)
_SIMPLE = {
    "tracks": ("events", """event_id, ts as timestamp, user_id as deployment_id,
  -1.3e2 + cast((user_id*37+event_id*13)%2000 as double)/1e2 as location_long,
  4.5e1 + cast((user_id*53+event_id*29)%1500 as double)/1e2 as location_lat""", ""),
    # All fixes, drawn together into a slanted part of the study area.
    "tracks_part": ("events", """event_id, ts as timestamp, user_id as deployment_id,
  -1.25e2 + cast((user_id*37+event_id*13)%2000 as double)/5e2 + cast((user_id*53+event_id*29)%1500 as double)/1e3 as location_long,
  4.9e1 + cast((user_id*53+event_id*29)%1500 as double)/4e2 as location_lat""", ""),
    "ref": ("customer", """c_custkey as deployment_id, c_name as animal_id, c_mktsegment as animal_taxon,
  c_acctbal as animal_mass""", "where c_acctbal >= 0"),
    "ref_all": ("customer", """c_custkey as deployment_id, c_name as animal_id, c_mktsegment as animal_taxon,
  c_acctbal as animal_mass""", ""),
    "tracks_ship": ("lineitem", """l_orderkey as event_id, l_shipdate as timestamp, l_suppkey as deployment_id,
  -1.3e2 + cast((l_orderkey*37+l_partkey*13)%2000 as double)/1e2 as location_long,
  4.5e1 + cast((l_orderkey*53+l_partkey*29)%1500 as double)/1e2 as location_lat""", ""),
    "tracks_order": ("orders", """o_orderkey as event_id, o_orderdate as timestamp, o_custkey as deployment_id,
  o_orderpriority as sensor, -1.3e2 + cast((o_orderkey*37+o_custkey*13)%2000 as double)/1e2 as location_long,
  4.5e1 + cast((o_orderkey*53+o_custkey*29)%1500 as double)/1e2 as location_lat""", ""),
    "grid_day": ("events", """cast(date_trunc('day', ts) as {ntz}) as time,
  5.99e1 - cast(user_id%10 as double)*1.5e0 as latitude,
  -1.299e2 + cast(event_id%12 as double)*1.5e0 as longitude, sqrt(round(avg(value), 6)) as t2m""", "group by 1,2,3"),
    "grid_ship": ("lineitem", """l_shipdate as time, 5.99e1 - cast(l_suppkey%20 as double)*7.5e-1 as latitude,
  -1.299e2 + cast(l_partkey%25 as double)*7.5e-1 as longitude, sqrt(avg(l_quantity)) as ndvi, sqrt(max(l_discount)) as snow""",
                  "group by 1,2,3"),
    "roads": ("orders", """o_orderkey as road_id, o_orderpriority as road_class,
  -1.3e2+cast(o_orderkey*7%2000 as double)/1e2 as x1, 4.5e1+cast(o_custkey*11%1500 as double)/1e2 as y1,
  -1.3e2+cast(o_orderkey*7%2000 as double)/1e2+cast(o_custkey%41-20 as double)/1e1 as x2,
  4.5e1+cast(o_custkey*11%1500 as double)/1e2+cast(o_orderkey%31-15 as double)/1e1 as y2""", ""),
    "parcels": ("part", """p_partkey as parcel_id, p_brand as brand,
  -1.3e2+cast(p_partkey*7%2000 as double)/1e2 as xmin, 4.5e1+cast(p_partkey*11%1500 as double)/1e2 as ymin,
  -1.3e2+cast(p_partkey*7%2000 as double)/1e2+cast(p_size+1 as double)/3e1 as xmax,
  4.5e1+cast(p_partkey*11%1500 as double)/1e2+cast(p_size+2 as double)/4e1 as ymax""", ""),
    "zones": ("nation", """n_nationkey as zone_id, n_regionkey as region_id,
  -1.3e2+4e0*cast(n_nationkey%5 as double) as xmin, 4.5e1+3e0*cast(floor(n_nationkey/5) as double) as ymin,
  -1.3e2+4e0*cast(n_nationkey%5 as double)+3.3e0 as xmax,
  4.5e1+3e0*cast(floor(n_nationkey/5) as double)+2.3e0 as ymax""", ""),
}

SQL = {
    name: f"select {cols} from {table} {tail}".format(ntz="timestamp") for name, (table, cols, tail) in _SIMPLE.items()
}
SQL["zone_edges"] = """
select zone_id, (xmin+xmax)/2e0 as x1, ymin as y1, xmax as x2, (ymin+ymax)/2e0 as y2 from zones
union all select zone_id, xmax, (ymin+ymax)/2e0, (xmin+xmax)/2e0, ymax from zones
union all select zone_id, (xmin+xmax)/2e0, ymax, xmin, (ymin+ymax)/2e0 from zones
union all select zone_id, xmin, (ymin+ymax)/2e0, (xmin+xmax)/2e0, ymin from zones"""
_NEEDS = {"zone_edges": ["zones"]}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the named views."""
    wanted: list[str] = []
    for n in names.split():
        for m in [*_NEEDS.get(n, []), n]:
            if m not in wanted:
                wanted.append(m)
    views = ",\n".join(f"{n} as ({SQL[n]})" for n in wanted)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    source, cols, tail = _SIMPLE[name]
    text = f"select {cols} from {{t}} {tail}".replace("{ntz}", "timestamp_ntz")
    return spark.sql(text, t=table(spark, sf_dir, source))


def grid(spark: SparkSession, sf_dir: str, name: str, declare: bool = False) -> GridFrame:
    """``grid_day`` or ``grid_ship``; ``declare`` states its even axes."""
    axes = {}
    if declare:
        n_lat, n_lon, step = (10, 12, 1.5) if name == "grid_day" else (20, 25, 0.75)
        axes = {"latitude": RegularAxis(59.9, -step, n_lat), "longitude": RegularAxis(-129.9, step, n_lon)}
    return GridFrame.of(view(spark, sf_dir, name), axes=axes)


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one segment each."""
    raw = view(spark, sf_dir, "roads")
    line = G.line(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2")))
    box = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    return make_features(raw, line, box).drop("x1", "y1", "x2", "y2")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_features(view(spark, sf_dir, "parcels"))


def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_features(view(spark, sf_dir, "zones"))


def diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diamond inside each zone: the polygons of the spatial queries."""
    mx, my = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    x0, y0, x1, y1 = [F.col(c) for c in G.BOX]
    ring = F.array(G.point(mx, y0), G.point(x1, my), G.point(mx, y1), G.point(x0, my), G.point(mx, y0))
    return make_features(view(spark, sf_dir, "zones"), G.geometry("Polygon", F.array(ring)), (x0, y0, x1, y1))
