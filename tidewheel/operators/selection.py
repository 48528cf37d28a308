"""Exact per-key quantiles without gathering any key's values, and the naming of heavy keys.

Distributed exact selection: each round counts values in a histogram per key (counts merge by addition, so a heavy key is reduced on the map side
like any other), finds the bin that holds each wanted rank, and looks only into that bin in the next round. The first histogram has bins of 1/32
octave, later ones 1,024 equal parts of the bin's actual [min, max]. A rank is resolved when its bin's minimum equals its maximum.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewheel.session import checkpoint, small_enough

#: First histogram: bins per octave.
PER_OCTAVE = 32
#: Later histograms: bins within the bin that holds the rank.
PARTS = 1024

def first_bin(v: Column) -> Column:
    """Number of the logarithmic bin; grows with ``v`` over negative values, zero, positive values and infinities."""
    octave = F.floor(F.log2(F.abs(v)) * PER_OCTAVE).cast("int") + F.lit(1100 * PER_OCTAVE)
    size = F.when(F.abs(v) == float("inf"), F.lit(1 << 20)).otherwise(octave)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """Which part of [lo, hi] holds ``v``; both ends have parts of their own, so that every round takes values away. On halves: no overflow."""
    span = hi / 2 - lo / 2
    inner = F.floor((v / 2 - lo / 2) / span * PARTS)
    unbounded = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf")) | (span == 0)
    return F.when(v <= lo, -1).when(v >= hi, PARTS).when(unbounded, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), inner))).cast("int")


def null_safe_join(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner", hint: bool = False) -> DataFrame:
    """Join on ``columns``, nulls matching nulls; the columns come from ``a``, all others of both sides are kept. ``hint``: broadcast ``b`` if measured small."""
    small = hint and small_enough(b)
    right = b.select(*(F.col(f"`{c}`").alias(f"{c}__r") if c in columns else F.col(f"`{c}`") for c in b.columns))
    on = reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}__r`")) for c in columns], F.lit(True))
    right = F.broadcast(right) if small else right
    return a.join(right, on, how).drop(*(f"{c}__r" for c in columns))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """One row per key with all-row count, value count and exact quantiles, however unevenly rows are spread over keys.

    Result: ``keys``, ``n_rows`` (all rows), ``n_values`` (rows whose value is neither null nor NaN), ``quantiles`` array<double> aligned with
    ``probs`` and interpolated linearly between the neighbouring ranks, null for a key without values.

    Keys may be null and then form keys of their own. Ties and repeated rows count as often as they occur; infinities are ordinary values; -0.0
    equals 0.0; an empty table gives no rows. Columns other than ``keys`` and ``value`` are ignored, whatever their names.

    Scale: two scans of the input with map-side counting. The first shuffles one row per (key, occupied bin) and task. The second keeps only rows in
    bins that hold a wanted rank (a few percent), which are checkpointed for the later rounds. A broadcast holds one row per (key, rank), and only if
    measured to be ``small_enough``.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    v = F.col(f"`{value}`").cast("double")
    base = df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)), F.when(~F.isnan(v), v + F.lit(0.0)).alias("__v"))
    first = base.withColumn("__part", first_bin(F.col("__v")))
    tally = [F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    counts = checkpoint(first.groupBy(*names, "__part").agg(*tally))
    totals = counts.groupBy(*names).agg(
        F.sum("__c").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("__part").isNotNull(), F.col("__c"))), F.lit(0)).alias("n_values")
    )
    totals = checkpoint(totals)
    at = F.explode(F.array(*map(F.lit, probs))).alias("__p")
    low = F.floor(F.col("__p") * (F.col("n_values") - 1))
    asked = totals.where("n_values > 0").select(*names, "n_values", at)
    asked = asked.select(*names, F.explode(F.array_distinct(F.array(low, F.least(low + 1, F.col("n_values") - 1)))).alias("__rank")).distinct()
    # a bin is known by the number of the key's values before it, __before
    bins = counts.where("__part is not null").withColumn("__before", F.lit(0).cast("bigint"))
    done: list[DataFrame] = []
    active = first.where("__v is not null").withColumn("__before", F.lit(0).cast("bigint"))
    asked = asked.withColumn("__before", F.lit(0).cast("bigint"))
    while True:
        w = Window.partitionBy(*names, "__before").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = bins.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__c").over(w), F.lit(0)))
        hit = null_safe_join(starts, asked, [*names, "__before"]).where("__rank >= __start and __rank < __start + __c")
        hit = checkpoint(hit.select(*names, "__before", "__part", "__start", "__lo", "__hi", "__rank"))
        done.append(hit.where("__lo = __hi").select(*names, "__rank", F.col("__lo").alias("__x")))
        open_ = hit.where("__lo < __hi")
        if not open_.limit(1).count():
            break
        inside = open_.select(*names, "__before", "__part", "__start", "__lo", "__hi").distinct()
        kept = null_safe_join(active, inside, [*names, "__before", "__part"], hint=True)
        part = _part(F.col("__v"), F.col("__lo"), F.col("__hi")).alias("__part")
        active = checkpoint(kept.select(*names, "__v", F.col("__start").alias("__before"), part))
        bins = active.groupBy(*names, "__before", "__part").agg(*tally)
        asked = open_.select(*names, "__rank", F.col("__start").alias("__before"))
    values = reduce(DataFrame.unionByName, done).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__at"))
    out = null_safe_join(totals, values, names, "left")

    def quantile(p: float) -> Column:
        at = F.lit(p) * (F.col("n_values") - 1)
        low = F.floor(at)
        a, b = F.try_element_at("__at", low), F.try_element_at("__at", F.least(low + 1, F.col("n_values") - 1))
        return F.when((at == low) | (a == b), a).otherwise(a + (b - a) * (at - low))

    picked = F.when(F.col("n_values") > 0, F.array(*(quantile(p) for p in probs))).cast(T.ArrayType(T.DoubleType()))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "n_rows", "n_values", picked.alias("quantiles"))


def skew_safe_summary(df: DataFrame, keys: list[str], value: str, probs: list[float], hot_share: float) -> DataFrame:
    """``exact_quantiles`` plus ``row_share`` (of all rows of ``df``, also those of incomplete keys) and ``is_hot`` (share >= ``hot_share``).

    Keys with a null part are counted in the total but get no row. ``n_rows`` counts every row of the key. An empty table gives no rows.
    """
    every = exact_quantiles(df, keys, value, probs)
    total = every.agg(F.sum("n_rows")).first()[0] or 0  # from the counts by key, without another scan
    got = every.where(reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys], F.lit(True)))
    return got.withColumn("row_share", F.col("n_rows") / F.lit(max(total, 1))).withColumn("is_hot", F.col("n_rows") >= F.lit(Decimal(str(hot_share)) * total))
