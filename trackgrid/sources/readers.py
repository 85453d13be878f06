"""Reading tracks, reference data, features and grids."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.headers import clean_names, clean_report
from ..functions.timeexpr import from_days_since_2000
from ..grid import GridFrame
from ..operators.axes import RegularAxis
from ..operators.spatial import filter_bbox, filter_polygon
from ..operators.tracks import combine_studies, dissolve_points

AXES_SUFFIX = ".axes"
# The column that stored grids are partitioned by; no variable has its name.
YEAR = "__year"


def _csv(spark: SparkSession, path, schema=None, multiline: bool = False) -> tuple[DataFrame, list[str]]:
    """A CSV table with cleaned headers, and the headers as written.

    Without a schema the types are inferred, which reads the data once more.
    Files of a folder may have different headers; their columns are then matched by name.
    """
    lines = spark.read.text(path)
    if len(lines.inputFiles()) < 2:
        first = lines.first()
        return _csv_files(spark, path, first[0] if first else "", schema, multiline)
    files: dict[str, list[str]] = {}
    names = sorted(lines.inputFiles())
    for name, head in zip(names, first_lines(spark, names)):
        if head:
            files.setdefault(head, []).append(name)
    if len(files) < 2:
        return _csv_files(spark, path, next(iter(files), ""), schema, multiline)
    if schema is not None:
        raise ValueError(f"the files in {path} have {len(files)} different headers; a schema goes by position")
    tables, named = [], []
    for head, some in files.items():
        df, own = _csv_files(spark, some, head, None, multiline)
        tables.append(df)
        named += [h for h in own if h not in named]
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t, allowMissingColumns=True)
    return table, named


def first_lines(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """The first line of each file, read through Spark's file systems without a job: a header is all that is looked at."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(name: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            text = jvm.java.io.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8")
            return jvm.java.io.BufferedReader(text).readLine() or ""
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(first, files))


def _csv_files(spark: SparkSession, path, head: str, schema, multiline: bool) -> tuple[DataFrame, list[str]]:
    header = next(csv.reader([head.lstrip("\ufeff")]), []) if head else []
    named = [h if h.strip() else f"Unnamed: {i}" for i, h in enumerate(header)]
    reader = spark.read.option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if len(df.columns) != len(named):
        raise ValueError(f"{path} has {len(named)} headers, the schema has {len(df.columns)} columns")
    df = df.toDF(*clean_names(named))
    return (df if schema is not None else _plain_types(df)), named


def _plain_types(df: DataFrame) -> DataFrame:
    """Inferred types in one width: times without zone, integers as bigint."""
    wide = {T.TimestampType: "timestamp_ntz", T.IntegerType: "bigint"}
    casts = {f.name: F.col(f"`{f.name}`").cast(wide[type(f.dataType)])
             for f in df.schema.fields if type(f.dataType) in wide}
    return df.withColumns(casts) if casts else df


def _number(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


def as_tracks(df: DataFrame) -> DataFrame:
    """Cleaned headers, coordinates as double, ``timestamp`` as a plain time."""
    df = df.toDF(*clean_names(df.columns))
    missing = [c for c in ("location_long", "location_lat") if c not in df.columns]
    if missing:
        raise KeyError(f"track data need the columns {', '.join(missing)}")
    df = df.withColumns({c: _number(c) for c in ("location_long", "location_lat")})
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return df


def read_tracks(spark: SparkSession, source, schema=None, dissolve: bool = False, multiline: bool = False) -> DataFrame:
    """Track points from CSV, Parquet or a DataFrame.

    ``schema`` (for CSV, by position) saves the pass that infers types. With
    ``multiline`` quoted fields may hold line breaks; a file is then read by one task.
    ``dissolve`` gives multipoints per animal instead of fixes.
    """
    if isinstance(source, DataFrame):
        raw = source
    elif str(source).rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(str(source))
    else:
        raw, _ = _csv(spark, str(source), schema, multiline)
    tracks = as_tracks(raw)
    if not dissolve:
        return tracks
    return dissolve_points(tracks, ["deployment_id"] if "deployment_id" in tracks.columns else [])


def read_ref(spark: SparkSession, source, schema=None, multiline: bool = False) -> tuple[DataFrame, dict]:
    """Reference data and the report on its headers."""
    if isinstance(source, DataFrame):
        before, df = source.columns, source.toDF(*clean_names(source.columns))
    else:
        df, before = _csv(spark, str(source), schema, multiline)
    return df, clean_report(before, df.columns)


def read_studies(spark: SparkSession, studies: Sequence) -> DataFrame:
    """Several studies, given as paths or tables, stacked."""
    tables = []
    for s in studies:
        if not isinstance(s, DataFrame) and not hasattr(s, "__fspath__") and not isinstance(s, str):
            raise TypeError(f"a study is a DataFrame or a path, not {type(s).__name__}")
        tables.append(s if isinstance(s, DataFrame) else read_tracks(spark, str(s)))
    return combine_studies(tables)


# Features -------------------------------------------------------------------


def parts_from_geojson(kind: Column, coordinates: Column) -> Column:
    """Parts from the JSON text of a geometry's coordinates; none of an empty geometry."""
    def flat(level: int) -> Column:
        return F.from_json(coordinates, "array<" * level + "double" + ">" * level)

    pt = lambda p: G.point(p[0], p[1])
    line = lambda ps: F.transform(ps, pt)
    ring = lambda ps: G.closed(line(ps))
    # Outer rings turn one way and holes the other, so that rings of several polygons can be told apart later.
    turned = lambda rings: F.transform(rings, lambda r, k: F.when((G.twice_area(r) >= 0) == (k == 0), r).otherwise(F.reverse(r)))
    return (
        F.when(F.regexp_replace(coordinates, r"\s", "") == "[]", F.lit(None).cast(G.PARTS_TYPE))
        .when(kind == "Point", F.array(F.array(pt(flat(1)))))
        .when(kind == "MultiPoint", F.transform(flat(2), lambda p: F.array(pt(p))))
        .when(kind == "LineString", F.array(line(flat(2))))
        .when(kind == "MultiLineString", F.transform(flat(3), line))
        .when(kind == "Polygon", F.transform(flat(3), ring))
        .when(kind == "MultiPolygon", F.flatten(F.transform(F.transform(flat(4), lambda rs: F.transform(rs, ring)), turned)))
    )


# The spelling of kinds in well-known text.
_WKT_KINDS = {
    "POINT": "Point", "MULTIPOINT": "MultiPoint", "LINESTRING": "LineString",
    "MULTILINESTRING": "MultiLineString", "POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon",
}


def geometry_from_wkt(text: str | Column) -> Column:
    """Geometry from two-dimensional well-known text."""
    text = F.col(text) if isinstance(text, str) else text
    word = F.upper(F.regexp_extract(text, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1))
    kinds = F.create_map(*[F.lit(v) for kv in _WKT_KINDS.items() for v in kv])
    kind = F.element_at(kinds, word)
    inner = F.regexp_replace(F.regexp_extract(text, r"\(.*\)", 0), r"^[\s(]+|[\s)]+$", "")

    def pt(s: Column) -> Column:
        xy = F.split(F.trim(F.regexp_replace(s, r"[()]", "")), r"\s+")
        return G.point(F.get(xy, F.lit(0)).try_cast("double"), F.get(xy, F.lit(1)).try_cast("double"))

    chains = F.transform(F.split(inner, r"\)[\s)]*,[\s(]*\("), lambda s: F.transform(F.split(s, ","), pt))
    dots = F.transform(F.split(inner, ","), lambda s: F.array(pt(s)))
    parts = (
        F.when(kind.endswith("Point"), dots)
        .when(kind.endswith("Polygon"), F.transform(chains, G.closed))
        .otherwise(chains)
    )
    # An empty geometry has a kind and no parts.
    return F.when(kind.isNotNull(), G.geometry(kind, F.when(inner != "", parts)))


def _geojson(spark: SparkSession, path: str, properties: str | None, collection: bool) -> DataFrame:
    lines = spark.read.option("multiLine", collection)
    if properties is None:
        seen = lines.json(path).schema
        feature = seen["features"].dataType.elementType if "features" in seen.names else seen
        has = "properties" in feature.names and isinstance(feature["properties"].dataType, T.StructType)
        kept = feature["properties"].dataType if has else T.StructType([])
    else:
        kept = T.StructType.fromDDL(properties)
    shape = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("geometry", shape)])
    if kept.fields:
        feature.add("properties", kept)
    if collection:
        doc = T.StructType([T.StructField("features", T.ArrayType(feature))])
        rows = lines.schema(doc).json(path).select(F.inline("features"))
    else:
        rows = lines.schema(feature).json(path)
    g = F.col("geometry")
    # A feature without a geometry stays, without a place.
    geom = F.when(g["type"].isNotNull(), G.geometry(g["type"], parts_from_geojson(g["type"], g["coordinates"])))
    attrs = ["properties.*"] if kept.fields else []
    return rows.select(*attrs, geom.alias("geom"))


def read_features(
    spark: SparkSession,
    source,
    bbox: Sequence[float] | None = None,
    mask: DataFrame | None = None,
    format: str | None = None,
    wkt: str | None = None,
    properties: str | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """A feature table, optionally only what meets a box or a polygon.

    ``format`` is ``parquet``, ``csv``, ``geojsonl`` (a feature per line) or
    ``geojson`` (one document, which one task has to read: for large layers
    use the other forms). By default it follows from the name. ``wkt`` names a
    column with well-known text; Parquet written by this library needs none.
    """
    if bbox is not None and mask is not None:
        raise ValueError("give a box or a mask, not both")
    if isinstance(source, DataFrame):
        df = source
    else:
        name = str(source).rstrip("/")
        ending = name.rsplit(".", 1)[-1].lower()
        format = format or {"json": "geojson", "geojson": "geojson", "geojsonl": "geojsonl", "geojsons": "geojsonl",
                            "csv": "csv"}.get(ending, "parquet")
        if format in ("geojson", "geojsonl"):
            df = _geojson(spark, name, properties, format == "geojson")
        elif format == "csv":
            df = _csv(spark, name)[0]
        elif format == "parquet":
            df = spark.read.parquet(name)
        else:
            raise ValueError(f"cannot read features from {format}")
    if wkt is not None:
        df = df.withColumn("geom", geometry_from_wkt(wkt)).drop(wkt)
    if any(c not in df.columns for c in G.BOX):
        df = G.with_box(df)
    if bbox is not None:
        return filter_bbox(df, bbox)
    if mask is not None:
        return filter_polygon(df, mask, id_col)
    return df


# Grids ----------------------------------------------------------------------


def read_grid(spark: SparkSession, source, schema=None, axes: Mapping[str, RegularAxis] | None = None, **roles) -> GridFrame:
    """A grid from a table of cells in Parquet or CSV.

    Axes stored beside the data are declared, so that no job has to find them.
    A time stored as a number is days since 2000-01-01.
    """
    name = str(source).rstrip("/")
    if name.endswith(".csv"):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(name)
    else:
        df = spark.read.parquet(name)
    time = roles.get("time", "time")
    if time in df.columns and df.schema[time].dataType.typeName() == "double":
        df = df.withColumn(time, from_days_since_2000(F.col(time)))
    if axes is None:
        axes = _stored_axes(spark, f"{name}{AXES_SUFFIX}")
    grid = GridFrame.of(df, axes=axes, **roles)
    return grid.stored_by(YEAR) if YEAR in df.columns else grid


def _stored_axes(spark: SparkSession, path: str) -> dict[str, RegularAxis]:
    schema = "dim string, whole boolean, first double, step double, size int"
    try:
        rows = spark.read.schema(schema).json(path).collect()
    except AnalysisException:
        return {}
    made = {}
    for r in rows:
        num = int if r["whole"] else float
        made[r["dim"]] = RegularAxis(num(r["first"]), num(r["step"]), r["size"])
    return made


def stack_rasters_by_date(
    spark: SparkSession,
    path: str,
    pattern: str = r"doy(\d{7})",
    date_format: str = "yyyyDDD",
    format: str = "parquet",
    schema=None,
    time: str = "time",
    **roles,
) -> GridFrame:
    """One grid from a directory of cell tables, one date each.

    The date is taken from the path of each file, by default ``doyYYYYDDD``.
    All files are read in one scan. A file without a date is an error.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "csv":
        reader = reader.option("inferSchema", True)
    df = reader.format(format).load(path)
    text = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    dated = F.when(text == "", F.raise_error(F.concat(F.lit("no date in the name of "), F.col("_metadata.file_path"))))
    stamp = F.to_timestamp_ntz(dated.otherwise(text), F.lit(date_format))
    return GridFrame.of(df.select("*", stamp.alias(time)), time=time, **roles)
