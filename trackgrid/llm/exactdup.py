"""Exact dedup: a persistent index of digests, bucketed and sorted by digest.

The index has one row per distinct text. A batch of new rows is first reduced
to one row per digest, so a text that fills a third of the batch costs one row
per task; the reduced batch is anti-joined with the index by sort-merge, and
what is new is appended. The index side of that join is read in its buckets
and never shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, prepare, text_or_empty, written

BUCKETS = 32
#: Digests with at least this share of a batch's rows are looked up by broadcast: at most 1 / HOT_SHARE of them exist.
HOT_SHARE = 1 / 2048
SCHEMA = "digest binary, keep_id long, keep_row long"


class DigestIndex:
    """The index at ``path``, made if there is none. ``path`` must be in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = prepare(spark), path.rstrip("/"), buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.table} ({SCHEMA}) using parquet"
            f" clustered by (digest) sorted by (digest) into {buckets} buckets location '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, new: DataFrame) -> None:
        """Append rows of the index's schema; the caller has checked that they are new."""
        writer = new.select("digest", "keep_id", "keep_row").repartition(self.buckets, "digest").write.mode("append").format("parquet")
        writer.option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
        """Add ``docs`` to the index. One row per input row: the id, ``digest``, ``keep_id, group_size, kept``.

        Of the equal texts of a batch the row with the largest id stays, of several rows with
        that id exactly one; a null id is smaller than any other. A null text equals the empty
        one. A text that an earlier batch added stays with that batch's row, and none of the new
        rows is kept. ``group_size`` counts the batch's rows of the text. With ``carry`` the input
        row is in the struct ``row``, so that no column name can clash. No rows give no rows.
        """
        digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
        picked = [F.struct("*").alias("row")] if carry else []
        rows = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row_no"), *picked)
        rows = written(rows, "digests")
        batch = rows.groupBy("digest").agg(F.max(F.struct("id", "row_no")).alias("keep"), F.count("*").alias("group_size"))
        batch = written(batch.select("digest", "keep.id", "keep.row_no", "group_size"), "digest-batch")

        known = self.read()
        fresh = batch.join(known.hint("merge"), "digest", "left_anti")
        fresh = written(fresh.select("digest", F.col("id").alias("keep_id"), F.col("row_no").alias("keep_row")), "digest-fresh")
        earlier = batch.join(known.hint("merge"), "digest").select("digest", F.col("keep_id"), F.lit(-1).cast("long").alias("keep_row"), "group_size")
        verdicts = fresh.join(batch.select("digest", "group_size"), "digest").select("digest", "keep_id", "keep_row", "group_size")
        verdicts = written(verdicts.unionByName(earlier), "digest-verdicts")
        self.append(fresh)

        total = rows.count()
        hot = verdicts.where(F.col("group_size") >= max(2.0, total * HOT_SHARE)).select("digest", F.lit(1).alias("hot"), F.col("keep_id").alias("hot_id"), F.col("keep_row").alias("hot_row"), F.col("group_size").alias("hot_size"))
        found = lookup(rows, hot, ["digest"], small=True)
        answers = ["keep_id", "keep_row", "group_size"]
        own = [c for c in rows.columns]
        by_hot = found.where("hot is not null").select(*own, F.col("hot_id").alias("keep_id"), F.col("hot_row").alias("keep_row"), F.col("hot_size").alias("group_size"))
        rest = found.where("hot is null").select(*own).join(verdicts, "digest").select(*own, *answers)
        return by_hot.unionByName(rest).withColumn("kept", F.col("row_no") == F.col("keep_row")).drop("row_no", "keep_row")


def exact_dedup(spark: SparkSession, docs: DataFrame, index_path: str) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, after adding them to the index at ``index_path``."""
    return DigestIndex(spark, index_path).add(docs, carry=True).where("kept").select("row.*")
