"""Run the registered queries and their SQL side by side.

``python oracle_check.py [sf_dir] [key ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
          "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "smallint": "SMALLINT"}


def local_session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("trackgrid-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat(" ", "microseconds")
    if isinstance(v, date):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(made, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, sf_dir: str, query, sql: str | None) -> tuple[str, int, float]:
    """``("ok", rows, seconds)`` or a message in place of ``ok``."""
    start = time.time()
    df = query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return "no sql", len(got), took
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), took
    for f in df.schema.fields:
        if _TYPES.get(f.dataType.simpleString(), "?") != types[f.name].upper():
            return f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}", len(got), took
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got), took
    for a, b in zip(got, want):
        if a != b:
            return f"row {a} != {b}", len(got), took
    return "ok", len(got), took


def main(argv):
    import registered

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    keys = argv[2:] or list(registered.QUERIES)
    spark, con = local_session(), database(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for k in keys:
        try:
            state, n, took = compare(spark, con, sf_dir, registered.QUERIES[k], registered.ORACLES.get(k))
        except Exception as e:  # a report, not a handler: go on with the next
            state, n, took = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += state not in ("ok", "no sql")
        print(f"{k:32s} {n:8d} {took:7.2f}s  {state}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
