"""Helpers the text operators share: written intermediates, global row numbers, lookups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackgrid.session import configure, scratch_path

#: Rows and bytes of one Arrow batch handed to Python, so that batches of very long texts stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: A lookup table is broadcast up to this many rows; beyond it, Spark joins by shuffle and splits hot keys.
LOOKUP_ROWS = 100_000


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, plus small Arrow batches."""
    configure(spark)
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    """``left`` with the columns of the one row of ``right`` that has the same ``keys`` (nulls match nulls).

    ``right`` is broadcast if it was counted to be small. Otherwise the join shuffles, and Spark splits
    hot keys of ``left`` at run time.
    """
    if small is None:
        small = right.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    right = right.withColumnsRenamed({k: f"_tg_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_tg_key_{k}")) for k in keys])
    found = left.join(F.broadcast(right) if small else right, same, "left")
    return found.drop(*[f"_tg_key_{k}" for k in keys])


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of numbers, which the caller knows to be bounded, as arrays on the driver.

    Values travel in the bytes of whole batches, without a row object each.
    """
    kinds = {"bigint": np.int64, "int": np.int32, "double": np.float64}
    types = {name: kinds[kind] for name, kind in df.dtypes}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], names=b.schema.names)

    rows = df.mapInArrow(pack, ", ".join(f"{name} binary" for name in types)).collect()
    return {name: np.frombuffer(b"".join(r[name] for r in rows), kind) for name, kind in types.items()}


def numbered(df: DataFrame, order: Sequence[str], name: str, position: str) -> DataFrame:
    """``df``, written, with the row's place in the global order (from 0) as ``position``.

    Rows are sorted by range, not in one task. The order is fixed by writing it; a second
    pass adds how many rows the earlier ranges have, which is one number per range.
    """
    row = "_tg_row"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    staged = written(ranged, name)
    part, inner = "_tg_part", F.col(row).bitwiseAND((1 << 33) - 1)
    staged = staged.withColumn(part, F.shiftright(F.col(row), 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged.groupBy(part).agg(F.count("*").alias("_tg_n"))
    offsets = sizes.select(part, F.coalesce(F.sum("_tg_n").over(before), F.lit(0)).alias("_tg_before"))
    # One row per range: as many as there are shuffle partitions, whatever the data.
    return lookup(staged, offsets, [part], small=True).withColumn(position, F.col("_tg_before") + inner).drop(row, part, "_tg_before")


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that nothing will read again, and let go of old shuffles.

    Shuffle files are deleted by the driver's cleaner once the plans that made them are collected as garbage.
    """
    context = df.sparkSession.sparkContext
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jvm.System.gc()
