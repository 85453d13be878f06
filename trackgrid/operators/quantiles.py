"""Exact quantiles of groups of any size.

``percentile`` keeps all distinct values of a group in one buffer. The way
here never does: values are counted first, a coarse code that keeps their
order tells which few codes hold the wanted ranks, and only the values of
those codes are sorted, in small shares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes per power of two, and shares a code is cut into.
_PER_OCTAVE = 2048
_SHARES = 1024


def order_code(v: Column) -> Column:
    """A bigint that never decreases when ``v`` grows.

    Exponent first, then the leading 11 bits of the mantissa. An outlier only
    takes a code of its own; it does not squeeze the others together.
    """
    a = F.abs(v)
    e = F.floor(F.log2(a))
    m = F.floor(a / F.pow(F.lit(2.0), e) * _PER_OCTAVE)
    code = ((e + 1100) * (4 * _PER_OCTAVE) + m).cast("bigint")
    huge = F.lit(4 * _PER_OCTAVE * 4000).cast("bigint")
    code = F.when(a == float("inf"), huge).otherwise(code)
    # NaN comes last, as it does when values are sorted.
    return F.when(F.isnan(v), huge + 1).when(v == 0, F.lit(0).cast("bigint")).when(v > 0, code).otherwise(-code)


def _on(left_keys: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in left_keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal."""
    renamed = right.withColumnsRenamed({k: f"__j_{k}" for k in keys})
    return left.join(renamed, _on(keys, "__j_"), "inner").drop(*[f"__j_{k}" for k in keys])


def exact_quantiles(df: DataFrame, value: str, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation, as columns named by ``probs``.

    Equal values are merged before anything else is done, so a value that
    fills a third of the rows is one row from then on.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    if not keys:
        base, keys_in = base.withColumn("__all", F.lit(1)), ["__all"]
    else:
        keys_in = keys
    counted = base.groupBy(*keys_in, "v").agg(F.count(F.lit(1)).alias("n")).withColumn("code", order_code(F.col("v")))

    per_code = counted.groupBy(*keys_in, "code").agg(
        F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    upto = Window.partitionBy(*keys_in).orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*keys_in)
    placed = per_code.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn(
        "total", F.sum("n").over(total)
    )

    def wanted(name: str, p: float, upper: bool) -> Column:
        at = (F.col("total") - 1) * F.lit(float(p))
        rank = (F.ceil(at) if upper else F.floor(at)).cast("bigint")
        return F.struct(F.lit(name).alias("name"), F.lit(upper).alias("upper"), rank.alias("rank"),
                        (at - F.floor(at)).alias("part"))

    ranks = F.array(*[wanted(n, p, u) for n, p in probs.items() for u in (False, True)])
    hit = placed.withColumn(
        "ranks",
        F.filter(ranks, lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("n"))),
    ).where(F.size("ranks") > 0).select(*keys_in, "code", "lo", "hi", "before", "ranks")

    # Only the values of codes that were hit, cut into shares of even width.
    width = (F.col("hi") - F.col("lo")) / _SHARES
    # Codes of one value, infinities among them, are not cut.
    share = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(_SHARES))).otherwise(0)
    near = _join(counted, hit, [*keys_in, "code"]).withColumn("share", share.cast("int"))
    per_share = near.groupBy(*keys_in, "code", "share").agg(F.sum("n").alias("sn"))
    shares_before = Window.partitionBy(*keys_in, "code").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_share.withColumn("off", F.coalesce(F.sum("sn").over(shares_before), F.lit(0))).drop("sn")
    values_before = (
        Window.partitionBy(*keys_in, "code", "share").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = near.withColumn("within", F.coalesce(F.sum("n").over(values_before), F.lit(0)))
    at = _join(inner, offsets, [*keys_in, "code", "share"]).withColumn(
        "pos", F.col("before") + F.col("off") + F.col("within")
    )
    picked = at.select(
        *keys_in, "v",
        F.inline(F.filter("ranks", lambda r: (r["rank"] >= F.col("pos")) & (r["rank"] < F.col("pos") + F.col("n")))),
    )
    outs = []
    for name in probs:
        this = F.col("name") == name
        low = F.max(F.when(this & ~F.col("upper"), F.col("v")))
        high = F.max(F.when(this & F.col("upper"), F.col("v")))
        part = F.max(F.when(this, F.col("part")))
        # Between an infinity and a number lies the infinity, as in ``percentile``.
        outs.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name))
    result = picked.groupBy(*keys_in).agg(*outs)
    return result if keys else result.drop("__all")
