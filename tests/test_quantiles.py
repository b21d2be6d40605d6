"""Exact points over ranges against the engine's own, and no group in one task."""

from pyspark.sql import functions as F

from lodestone.operators import stats


def test_points_equal_the_engines_over_many_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, (F.col("id") * 7919 % 401 / 3)).alias("v"))
    more = spark.createDataFrame([(8, None), (9, 5.0), (10, float("nan")), (10, 1.0)], "g long, v double")
    df = rows.unionByName(more)
    got = {r.g: (r.p05, r.p95, r.n) for r in stats.describe(df, ["g"], "v").collect()}
    want = {r.g: (r.a, r.b, r.n) for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.05)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b"), F.count("v").alias("n")).collect()}
    assert got.keys() == want.keys() and got[8] == (None, None, 0) and got[9] == (5.0, 5.0, 1)
    for g in set(want) - {8, 10}:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], want[g]))


def test_no_group_is_gathered_in_one_buffer(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    assert "percentile" not in stats.describe(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
