"""Weighted statistics, scaling, sensitivity and budget operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranges import ordered

TINY = 1e-12


def weighted_mean(v: Column, w: Column) -> Column:
    """AGG1, AGG2; null where the weights' sum is at most TINY. A negative weight is an error, as in the source of the definition."""
    checked = F.when(w < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(w)
    return F.when(F.sum(w) > TINY, F.sum(checked * v) / F.sum(w))


def weighted_std(df: DataFrame, keys: list[str], v: str, w: str) -> DataFrame:
    """AGG3: weighted mean and weighted population deviation by key, in two passes over grouped sums."""
    mean = df.groupBy(*keys).agg(weighted_mean(F.col(v), F.col(w)).alias("mean"))
    joined = df.join(F.broadcast(mean), keys) if not keys else df.join(mean, keys)
    return joined.groupBy(*keys).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col(w) * F.pow(F.col(v) - F.col("mean"), 2)) / F.sum(w)).alias("std"))


def quantiles(df: DataFrame, keys: list[str], v: str, shares: dict[str, float]) -> DataFrame:
    """AGG5: (keys, a column for each share): exact points, between two values in proportion, nulls left out.

    Different values are counted, put in order over ranges, and found by the counts before them: no group is in one task.
    """
    of = F.struct(F.lit(0).alias("0_"), *keys).alias("key_")
    rows = ordered(df.filter(F.col(v).isNotNull()).groupBy(of, F.col(v).alias("v_")).agg(F.count("*").alias("n_")), ["key_", "v_"])
    # Of each key one row a range.
    own = rows.groupBy("key_", "range_").agg(F.sum("n_").alias("n_"))
    w = Window.partitionBy("key_")
    told = own.select("key_", "range_", (F.sum("n_").over(w.orderBy("range_")) - F.col("n_")).alias("before_"), F.sum("n_").over(w).alias("all_"))
    upto = F.sum("n_").over(Window.partitionBy("range_", "key_").orderBy("place_"))
    met = rows.withColumn("upto_", upto).join(told, ["key_", "range_"]).withColumn("to_", F.col("before_") + F.col("upto_")).withColumn("from_", F.col("to_") - F.col("n_"))
    found, parts = [], []
    for name, share in shares.items():
        at = (F.col("all_") - 1) * F.lit(share)
        for end, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            found.append(F.max(F.when((F.col("from_") <= place) & (place < F.col("to_")), F.col("v_").cast("double"))).alias(f"{end}_{name}"))
        found.append(F.max(at - F.floor(at)).alias(f"part_{name}"))
        low, high, part = (F.col(f"{x}_{name}") for x in ("low", "high", "part"))
        parts.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return met.groupBy("key_").agg(*found).select(*[F.col(f"key_.{k}").alias(k) for k in keys], *parts)


def describe(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """AGG4: count, mean, population deviation, extremes, relative deviation in percent, exact 5 % and 95 % points."""
    c = F.col(v)
    out = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))
    points = quantiles(df, keys, v, {"p05": 0.05, "p95": 0.95}).withColumnsRenamed({k: f"{k}_" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.lit(True))
    return out.join(points, same, "left").drop(*[f"{k}_" for k in keys]).withColumn("rsd", F.when(F.abs("mean") > TINY, 100 * F.col("std") / F.abs("mean")))


def deviation_band(df: DataFrame, keys: list[str], v: str, k: float = 2.0) -> DataFrame:
    """MTH11: mean minus and plus k deviations."""
    s = df.groupBy(*keys).agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sigma"))
    return s.select(*keys, (F.col("mu") - F.abs(k * F.col("sigma"))).alias("low"), (F.col("mu") + F.abs(k * F.col("sigma"))).alias("high"))


def with_totals(df: DataFrame, aggregates: list[Column]) -> DataFrame:
    """The rows beside one row of aggregates over all of them: a side of one row, not a product of tables."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def minmax_scaled(df: DataFrame, column: str) -> DataFrame:
    """PRJ10: to [0, 1] by the data's own bounds; a constant column becomes 0."""
    both = with_totals(df, [F.min(column).alias("lo_"), F.max(column).alias("hi_")])
    span = F.col("hi_") - F.col("lo_")
    return both.withColumn("unit", F.when(span > TINY, (F.col(column) - F.col("lo_")) / span).otherwise(0.0)).drop("lo_", "hi_")


def standardised(df: DataFrame, column: str) -> DataFrame:
    """PRJ11: minus the mean, over the population deviation (1 if that is at most TINY)."""
    both = with_totals(df, [F.avg(column).alias("m_"), F.stddev_pop(column).alias("s_")])
    return both.withColumn("z", (F.col(column) - F.col("m_")) / F.when(F.col("s_") > TINY, F.col("s_")).otherwise(1.0)).drop("m_", "s_")


def median_split_sensitivity(df: DataFrame, inputs: list[str], response: str) -> DataFrame:
    """NUM3: for each input the variance between the means at or below and above its median, over the total variance.

    Groups of fewer than two rows give 0; the share is clipped to [0, 1]; a total of at most 1e-300 gives 0.
    """
    medians = df.agg(*[F.median(c).alias(f"m_{c}") for c in inputs], F.var_pop(response).alias("total"), F.avg(response).alias("mean"), F.count(response).alias("n"))
    both = df.crossJoin(F.broadcast(medians))
    longer = both.select("total", "mean", "n", F.col(response).alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("input"), (F.col(c) <= F.col(f"m_{c}")).alias("low")) for c in inputs])))
    groups = longer.groupBy("input", "low").agg(F.count("y").alias("k"), F.avg("y").alias("g"), F.first("total").alias("total"), F.first("mean").alias("mean"), F.first("n").alias("n"))
    shares = groups.groupBy("input").agg(F.sum(F.col("k") * F.pow(F.col("g") - F.col("mean"), 2) / F.col("n")).alias("between"), F.min("k").alias("least"), F.count("*").alias("sides"), F.first("total").alias("total"))
    share = F.when((F.col("sides") < 2) | (F.col("least") < 2) | (F.col("total") <= 1e-300), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("between") / F.col("total"))))
    return shares.select("input", share.alias("share"))


def variance_shares(df: DataFrame, score: str) -> DataFrame:
    """NUM25: percent of the scores' sum; 0 where the sum is not positive."""
    both = with_totals(df, [F.sum(score).alias("sum_")])
    return both.withColumn("share", F.when(F.col("sum_") > TINY, 100 * F.col(score) / F.col("sum_")).otherwise(0.0)).drop("sum_")


def softmax(df: DataFrame, gain: str, eta: float = 0.5) -> DataFrame:
    """MTH20: probabilities of choices, shifted by the largest gain."""
    both = with_totals(df, [F.max(gain).alias("top_")]).withColumn("e_", F.exp(eta * (F.col(gain) - F.col("top_"))))
    total = with_totals(both, [F.sum("e_").alias("sum_")])
    return total.withColumn("p", F.col("e_") / F.col("sum_")).drop("top_", "e_", "sum_")


def filter_threshold(s2_df: Column, s2_lf: Column, least: Column, mean: Column) -> tuple[Column, Column]:
    """MTH18: the weight omega and the threshold T of the two-fidelity filter."""
    omega = 1 / (1 + F.sqrt(s2_df / s2_lf))
    return omega, omega * least + (1 - omega) * mean


def r_squared(y: Column, fitted: Column, mean: Column) -> Column:
    """AGG16: 1 - residual over total squares; a constant target gives 1 if it is met, else 0."""
    residual, total = F.sum(F.pow(y - fitted, 2)), F.sum(F.pow(y - mean, 2))
    return F.when(total > TINY, 1 - residual / total).otherwise(F.when(residual <= TINY, 1.0).otherwise(0.0))


def best_so_far(df: DataFrame, keys: list[str], order: list[str], y: str, fmin: float = 0.0) -> DataFrame:
    """WIN8, WIN9, NUM37: running least value of an evaluation log, and its regret over the known optimum."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.min(y).over(w)).withColumn("regret", F.col("best") - fmin)
