"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the rank as
a fraction of the source's size, (2 r + 1) / (2 n), spreads each source evenly
over (0, 1). Sorting all rows by the fraction interleaves the sources in
proportion, and cutting that order into equal lengths gives shards whose
mixture matches the whole and whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, numbered

SEED = 17


def interleave(docs: DataFrame, n_shards: int, by: str = "source", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    The order of rows depends on the seed, the id and the source only, so it does not change
    with partitioning. Rows of a null source are a source of their own. A null id is hashed as
    an empty one, and rows with equal ids and sources come in any order among themselves. Both new
    columns replace columns of the same names; other columns stay. With fewer rows than shards
    the last shards are empty; no rows give no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    row = docs.drop("shard", "slot").select(F.struct("*").alias("row"), F.col(by).alias("source"), F.col(id_col).alias("id"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    ranked = numbered(row.withColumn("key", key), ["source", "key", "id"], "shard-ranks", "place")
    sources = ranked.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    fraction = (2 * (F.col("place") - F.col("first")) + 1) / (2 * F.col("n"))
    spread = lookup(ranked, sources, ["source"]).withColumn("fraction", fraction)
    mixed = numbered(spread.select("row", "source", "key", "id", "fraction"), ["fraction", "source", "key", "id"], "shard-order", "place")
    total = mixed.count()
    if total == 0:
        return mixed.select("row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shard = F.expr(f"cast(place * {n_shards} div {total} as int)")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return mixed.withColumn("shard", shard).select("row.*", "shard", (F.col("place") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
