"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgrid.session import scratch_path

from . import align, decontam, exactdup, licenses, neardup, packing, pitmanyor, quality, runs, secretscan, sharding, suffixdup, tokenbin
from .common import documents, text_or_empty

N_SHARDS = 8
#: Ids put after a document: between packed documents, and at the end of one in a file.
SEPARATOR_ID, END_ID = 0, 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, by rows: the mixture of sources is that of the whole."""
    docs = documents(spark, sf_dir)
    text = F.encode(text_or_empty(), "utf-8")
    sized = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.interleave(sized, N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), VOCABULARY, SEPARATOR_ID)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_dups(documents(spark, sf_dir)).drop("set_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.license_digest(licenses.scan_licenses(documents(spark, sf_dir)))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    files = tokenbin.write_token_files(documents(spark, sf_dir), scratch_path(spark, "tokens"), VOCABULARY, END_ID)
    return tokenbin.read_token_files(spark, files)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secretscan.spans_digest(secretscan.scan_secrets(documents(spark, sf_dir), RANKS))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a new digest index: which row of each text stays."""
    docs = documents(spark, sf_dir)
    found = exactdup.DigestIndex(spark, scratch_path(spark, "digest-index")).add(docs)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, and whether it is kept."""
    docs = documents(spark, sf_dir)
    return quality.Classifier(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).verdicts()


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without strings that occur earlier."""
    return suffixdup.remove_repeats(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark, one row per document and item."""
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of which get a periodic end first."""
    docs = documents(spark, sf_dir)
    return runs.runs_digest(runs.find_runs(docs, text_col=runs.planted(docs)))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the ids of two vocabularies over all documents."""
    found = align.Alignment(documents(spark, sf_dir), VOCABULARY, PIECES).documents()
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a hierarchical Pitman-Yor model of six sevenths of them."""
    found = pitmanyor.score_documents(documents(spark, sf_dir), pitmanyor.held_out())
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_best_fit_packing, op3_minhash_near_dedup, op4_license_scan, op5_token_files, op6_secret_scan, op7_exact_dedup, op8_quality_classifier, op9_suffix_array_dedup, op10_decontamination, op11_periodic_runs, op12_tokenizer_alignment, op13_lm_scores)
}

ORACLES: dict[str, str] = {
    "op1_sharding": """
with steps as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as step),
sized as (select doc_id, source, coalesce(text, '') as text, md5('17:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
summed as (select doc_id, source, key, cast(octet_length(encode(text)) + 1 as bigint) as size,
  xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: cast('0x' || b as bigint))),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32 from sized, steps),
ranked as (select *, row_number() over (partition by source order by key, doc_id nulls first) - 1 as place, count(*) over (partition by source) as n from summed),
mixed as (select *, row_number() over (order by (2 * place + 1) / (2 * n), source nulls first, key, doc_id nulls first) - 1 as pos, count(*) over () as total from ranked)
select doc_id, size, text_crc32, 'rows' as law, cast(pos * 8 // total as integer) as shard,
  cast(pos - ((pos * 8 // total) * total + 7) // 8 as bigint) as slot, cast(null as integer) as grown_shard, source from mixed""",
    "op7_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
}
