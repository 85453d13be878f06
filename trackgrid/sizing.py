"""Size checks for broadcasts, and the join to use when a side is too large.

A broadcast is hinted only after two checks: what Catalyst estimates for the
plan, which is free, and an exact row count, which is run only when the
estimate already passed. Everything else goes through :func:`skew_join`, which
keeps hot keys spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
# A key is hot when it holds at least this share of the rows, so there can be
# no more than 1 / HOT_SHARE hot keys whatever the data looks like.
HOT_SHARE = 1 / 256


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` may be broadcast. Counts rows only if the estimate passes."""
    return plan_bytes(df) <= max_bytes and df.count() <= max_rows


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small table over the cores before costly expressions.

    A small table is often one file, hence one task. Larger ones, and streams,
    are left as they are read.
    """
    if df.isStreaming or plan_bytes(df) > BROADCAST_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def task_count(df: DataFrame) -> int:
    """Tasks for costly work on each row of ``df``: 4 for every core, up to 16 by the estimate, which may be far too large."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * min(max(4, plan_bytes(df) // BROADCAST_BYTES // cores), 16)


def spread(df: DataFrame) -> DataFrame:
    """Spread a table over the cores before costly work on each row.

    Even a large table may be a few files of one row group, hence a few tasks; its rows are shuffled then.
    Streams are left as they are read.
    """
    if df.isStreaming:
        return df
    if plan_bytes(df) <= BROADCAST_BYTES:
        return spread_small(df)
    return df.repartition(task_count(df))


def sized_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    small: bool | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Join on equal ``keys``; broadcast ``right`` if it is checked to be small.

    ``small`` passes in the outcome of a check made elsewhere. With
    ``null_safe`` a null key matches a null key. ``where`` is a further
    condition over columns of both sides. The keys appear once.
    """
    if small is None:
        small = is_small(right)
    if small:
        return _equi_join(left, F.broadcast(right), keys, how, null_safe, where)
    return skew_join(left, right, keys, how, null_safe, where=where)


def _equi_join(left, right, keys, how, null_safe=False, where: Column | None = None):
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = where
    for k in keys:
        l, r = F.col(k), F.col(f"__r_{k}")
        one = l.eqNullSafe(r) if null_safe else l == r
        on = one if on is None else on & one
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def row_hash(df: DataFrame) -> Column:
    """A hash of the row and of the task that reads it, the same when a lost task is run again.

    Maps have no hash and are left out. Copies of a row in different tasks differ.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    return F.xxhash64(*plain, F.spark_partition_id())


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding at least ``share`` of the rows: at most ``1/share`` of them.

    ``__salts`` tells in how many parts of that share a key may be cut. The
    keys are found by one job and kept, so the rows are read once for them.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg((F.sum("__n") * F.lit(share)).alias("__t")).scalar()
    many = counts.select(*keys, "__n", total.alias("__t")).where("__n >= greatest(__t, 2)")
    found = many.select(*keys, F.ceil(F.col("__n") / F.col("__t")).cast("int").alias("__salts"))
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    salts: int | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Shuffled join whose hot keys are split, by default into parts of ``HOT_SHARE`` of the rows.

    Only rows of hot keys are salted on the left and repeated on the right, so
    a right side without hot keys keeps its size. Milder skew is left to
    Spark, which splits large partitions of such a join at run time.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not do {how!r} joins")
    hot = hot_keys(left, keys)
    if salts is not None:
        hot = hot.withColumn("__salts", F.lit(salts))
    spread = F.pmod(row_hash(left), F.col("__salts").cast("bigint")).cast("int")
    # Null keys are flagged too: in a left join they would share one task.
    salted = _equi_join(left, F.broadcast(hot), keys, "left", null_safe=True).withColumn(
        "__salt", F.coalesce(spread, F.lit(0))
    ).drop("__salts")
    copies = F.when(F.col("__salts").isNotNull(), F.sequence(F.lit(0), F.col("__salts") - 1)).otherwise(F.array(F.lit(0)))
    repeated = (
        _equi_join(right, F.broadcast(hot), keys, "left", null_safe=True)
        .withColumn("__salt", F.explode(copies))
        .drop("__salts")
    )
    joined = _equi_join(salted, repeated, [*keys, "__salt"], how, null_safe, where)
    return joined.drop("__salt")
