"""A corpus in stages, each made by one operator of ``trackgrid.llm``.

Every stage works on all rows that its predecessor kept, which are written as
Parquet and read again between stages. All but the last return the columns of
their input, whatever other columns there are and however they are named.

In every stage rows are told apart by themselves, not by their id: equal and null
ids are allowed, and rows are judged one by one. An empty table gives an empty
table. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackgrid.llm import decontam, exactdup, neardup, packing, quality
from trackgrid.llm.common import documents, prepare, written
from trackgrid.llm.queries import SEPARATOR_ID, VOCABULARY
from trackgrid.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are more perplexing, or less varied, than trusted ones of their language and length.

    Null and empty texts go. Equal texts of a language are judged alike. Without trusted labels all with any text stay.
    """
    prepare(spark)
    return quality.Classifier(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays: one row, also of several with that id; null is the smallest id.

    A null text equals the empty one.
    """
    return exactdup.exact_dedup(prepare(spark), docs, scratch_path(spark, "digest-index"))


#: Texts are near copies from this similarity of their five-word shingles on; op3 alone has another.
NEAR_PERCENT = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id stays.

    Null and empty texts have no words and are like nothing: they stay.
    """
    prepare(spark)
    return neardup.keep_first(docs, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Null and empty texts hold none; without items all stay."""
    prepare(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of at most 2048 tokens. A null text is an empty one: its end mark alone."""
    prepare(spark)
    return packing.pack(docs, VOCABULARY, SEPARATOR_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Perplexities, signatures and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
