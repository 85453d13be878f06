import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgrid.operators.quantiles import exact_quantiles, order_code
from trackgrid.operators.stats import PROBS, describe

CASES = {
    "ties": lambda r: np.r_[np.zeros(700), r.normal(size=300)],
    "outliers": lambda r: np.r_[r.normal(280, 10, 900), [1e30, -1e30, 1e300, 1e-300, -1e-300]],
    "signs": lambda r: r.normal(size=1001) * 10.0 ** r.integers(-12, 12, 1001),
    "infinite": lambda r: np.r_[r.normal(size=50), [np.inf, -np.inf]],
    "narrow": lambda r: 1 + r.integers(0, 10**6, 2000) * 1e-15,
    "one": lambda r: np.array([4.5]),
    "two": lambda r: np.array([-1.0, 2.0]),
}


@pytest.fixture(scope="module")
def table(spark):
    made = []
    for name, make in CASES.items():
        values = make(np.random.default_rng(7))
        made += [(name, float(v)) for v in values] + [(name, None)]
    made += [(None, 1.0), (None, 2.0), (None, 4.0), ("empty", None)]
    return spark.createDataFrame(made, "k string, v double").repartition(5)


@pytest.mark.parametrize("name", list(CASES))
def test_equals_numpy(table, name):
    got = exact_quantiles(table.where(F.col("k") == name), "v", ["k"], PROBS).first()
    want = CASES[name](np.random.default_rng(7))
    for column, p in PROBS.items():
        assert got[column] == pytest.approx(np.quantile(want, p), rel=1e-12, abs=1e-300)


def test_null_keys_and_empty_groups(table):
    got = {r["k"]: r for r in describe(table, "v", ["k"], input_bytes=1 << 40).collect()}
    assert got[None]["p50"] == 2.0 and got[None]["p25"] == 1.5
    assert got["empty"]["count"] == 0 and got["empty"]["p50"] is None


def test_both_ways_agree(table):
    for keys in (["k"], []):
        small = {r[0]: r for r in describe(table, "v", keys).collect()}
        large = {r[0]: r for r in describe(table, "v", keys, input_bytes=1 << 40).collect()}
        assert small.keys() == large.keys()
        for k, a in small.items():
            for c in PROBS:
                assert (a[c] is None and large[k][c] is None) or a[c] == pytest.approx(large[k][c], rel=1e-12, nan_ok=True)


@pytest.mark.parametrize("values, p50, p75", [
    ([1.0, 2.0, math.inf, math.inf], math.inf, math.inf), ([math.nan, 1.0, 2.0], 2.0, math.nan), ([-math.inf, 1.0, 2.0, 3.0], 1.5, 2.25),
    ([-math.inf, -math.inf, 1.0], -math.inf, -math.inf), ([math.nan, math.nan, math.inf, 0.0], math.nan, math.nan),
])
def test_infinities_and_nan(spark, values, p50, p75):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for size in (None, 1 << 40):
        got = describe(df, "v", [], input_bytes=size).first()
        assert [got["p50"], got["p75"]] == pytest.approx([p50, p75], nan_ok=True)


def test_code_keeps_order(spark):
    rng = np.random.default_rng(3)
    v = np.sort(np.r_[rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), 2.0 ** np.arange(-1074, 1024, 7.0), 0.0])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", order_code(F.col("v")).alias("c"))
    codes = [r["c"] for r in df.orderBy("v").collect()]
    assert codes == sorted(codes)


def test_approx_and_none(table):
    one = table.where("k = 'ties'")
    assert describe(one, "v", ["k"], "approx").first()["p50"] == 0.0
    assert "p50" not in describe(one, "v", ["k"], "none").columns
    with pytest.raises(ValueError):
        describe(one, "v", [], "some")
