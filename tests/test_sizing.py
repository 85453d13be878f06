import pytest
from pyspark.sql import functions as F

from conftest import rows
from trackgrid.sizing import is_small, skew_join, sized_join


@pytest.fixture(scope="module")
def sides(spark):
    # Key 0 holds a third of the rows, NULL a sixth.
    left = spark.range(3000).select(
        F.expr("case when id % 3 = 0 then 0 when id % 6 = 1 then null else id % 50 end").alias("k"), F.col("id").alias("v"))
    right = spark.range(40).select(
        F.expr("case when id = 39 then null else id end").alias("k"), (F.col("id") * 10).alias("w"))
    return left, right.unionByName(right.where("k < 3").withColumn("w", F.col("w") + 1))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_skew_join_equals_plain_join(sides, how, null_safe):
    left, right = sides
    plain = sized_join(left, right, ["k"], how, null_safe, small=True)
    spread = skew_join(left, right, ["k"], how, null_safe, salts=7)
    assert plain.columns == spread.columns
    assert rows(plain) == rows(spread)


def test_hot_rows_are_spread(sides):
    left, right = sides
    from trackgrid.sizing import hot_keys

    assert {r[0] for r in hot_keys(left, ["k"], share=0.1).collect()} == {0, None}


def test_is_small(spark):
    assert is_small(spark.range(10))
    assert not is_small(spark.range(10), max_rows=5)
    assert not is_small(spark.range(10), max_bytes=8)
