import hashlib
from collections import Counter

import pytest
from fixtures import CLASHES, ROWS, documents, ordered, tuples

from trackgrid.llm import exactdup, sharding
from trackgrid.session import scratch_path


def test_digest_index_keeps_the_largest_id_of_equal_texts(spark):
    got = exactdup.DigestIndex(spark, scratch_path(spark, "t")).add(documents(spark))
    rows = tuples(got.withColumn("digest", got.digest), "id", "keep_id", "group_size", "kept", "digest")
    groups = {}
    for d, t in ROWS:
        groups.setdefault(t or "", []).append(d)
    want = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        left = 1
        for d in ids:
            kept = d == keep and left > 0
            left -= kept
            want.append((d, keep, len(ids), kept, bytearray(hashlib.sha256(t.encode()).digest())))
    assert ordered(rows) == ordered(want)


def test_a_second_batch_is_deduplicated_against_the_first(spark):
    path = scratch_path(spark, "t")
    index = exactdup.DigestIndex(spark, path)
    index.add(documents(spark, [(1, "a"), (2, "b")]))
    later = exactdup.DigestIndex(spark, path).add(documents(spark, [(9, "a"), (8, "c"), (7, "c")]))
    assert ordered(tuples(later, "id", "keep_id", "group_size", "kept")) == ordered([(9, 1, 1, False), (8, 8, 2, True), (7, 8, 2, False)])
    assert sorted(r[0] for r in tuples(index.read(), "keep_id")) == [1, 2, 8]


def test_exact_dedup_keeps_columns(spark):
    docs = documents(spark)
    kept = exactdup.exact_dedup(spark, docs, scratch_path(spark, "t"))
    assert kept.columns == docs.columns
    assert kept.count() == len({t or "" for _, t in ROWS})
    assert exactdup.exact_dedup(spark, documents(spark, []), scratch_path(spark, "t")).count() == 0


@pytest.mark.parametrize("n_shards", [1, 3, 8, 50])
def test_interleave_matches_the_mixture(spark, n_shards):
    docs = documents(spark)
    got = sharding.interleave(docs, n_shards)
    assert set(got.columns) == set(docs.columns)
    rows = tuples(got, "shard", "slot", "source")
    sizes = Counter(s for s, _, _ in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n_shards)) <= 1
    for s in sizes:
        assert sorted(slot for k, slot, _ in rows if k == s) == list(range(sizes[s]))
    for source, total in Counter(x for _, _, x in rows).items():
        for s in range(n_shards):
            assert abs(sum(k == s and x == source for k, _, x in rows) - total / n_shards) <= 2
    assert "shard" in CLASHES and ordered(tuples(got, "doc_id", "text")) == ordered(ROWS)


def test_interleave_does_not_depend_on_partitions_and_takes_no_rows(spark):
    docs = documents(spark, [(i, str(i)) for i in range(200)])
    one, many = (tuples(sharding.interleave(docs.repartition(n), 4), "doc_id", "shard", "slot") for n in (1, 7))
    assert sorted(one) == sorted(many)
    assert sharding.interleave(documents(spark, []), 4).count() == 0


def test_write_shards(spark):
    path = scratch_path(spark, "shards")
    sharding.write_shards(sharding.interleave(documents(spark), 3).select("doc_id", "text", "shard", "slot"), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 3
