"""The error function and improvements as columns; designs and draws by hashes; refits without a point."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import models, normal
from lodestone.operators import fits, sampling


def test_erf_within_the_stated_error(spark):
    values = [k / 37 for k in range(-260, 261)] + [0.0, normal.CUT, -normal.CUT, 1e-300, 27.0, -40.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert max(abs(r.e - math.erf(r.x)) for r in df.select("x", normal.erf(F.col("x")).alias("e")).collect()) < 1e-14
    r = spark.range(1).select(normal.erf(F.lit(float("nan"))).alias("a"), normal.erf(F.lit(None).cast("double")).alias("b")).first()
    assert math.isnan(r.a) and r.b is None


def test_the_text_says_the_same():
    duckdb = pytest.importorskip("duckdb")
    got = duckdb.sql(f"SELECT x, {normal.erf_sql('x')} AS e FROM (SELECT i / 37.0 AS x FROM range(-260, 261) t(i))").fetchall()
    assert max(abs(e - math.erf(float(x))) for x, e in got) < 1e-14


def test_improvements_equal_the_models(spark):
    rows = [(m / 3, s / 4, 1.0) for m in range(-6, 12) for s in range(5)] + [(None, 1.0, 1.0), (0.0, None, 1.0), (5000.0, 1e-3, 1.0)]
    df = spark.createDataFrame(rows, "m double, s double, b double")
    ei = normal.improvement(F.col("m"), F.col("s"), F.col("b"))
    for r in df.select("m", "s", ei.alias("ei"), *[normal.generalised(F.col("m"), F.col("s"), F.col("b"), g).alias(f"g{g}") for g in (1, 2, 3)]).collect():
        if r.m is None or r.s is None:
            assert r.ei is None and r.g2 is None
        elif r.m < 1000:
            m, s = [__import__("numpy").array([x]) for x in (r.m, r.s)]
            assert r.ei == pytest.approx(models.expected_improvement(m, s, 1.0)[0], abs=1e-12) and r.g1 == pytest.approx(r.ei, abs=1e-12)
            assert r.g3 == pytest.approx(models.generalised_improvement(m, s, 1.0, 3)[0], abs=1e-10)
        else:
            assert r.ei == 0


def test_restrained(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), ([6.0, 8.0],)], "x array<double>")
    got = [r[0] for r in df.select(normal.restrained(F.lit(2.0), F.col("x"), F.array(F.lit(0.0), F.lit(0.0)), 5.0)).collect()]
    assert got == [2.0, 0.0, 2.0]


def test_latin_batches_and_grid(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").otherwise("c").alias("l"))
    rows = sampling.latin(df, "k", 3, 1).collect()
    for dim in range(3):
        assert sorted(r.stratum for r in rows if r.dim == dim) == list(range(100))
    assert all(r.stratum <= 100 * r.x < r.stratum + 1 for r in rows) and rows != sampling.latin(df, "k", 3, 2).collect()
    drawn = sampling.batches(df, "k", "l", {"a": 6, "b": 40}, 4).collect()
    for batch in range(4):
        of = [(r.l, r.k) for r in drawn if r.batch == batch]
        assert len(set(of)) == len(of) and sum(x == "a" for x, _ in of) == 6 and sum(x == "b" for x, _ in of) == 25 and not any(x == "c" for x, _ in of)
    assert sampling.latin(df.limit(0), "k", 3).count() == sampling.batches(df.limit(0), "k", "l", {"a": 1}, 2).count() == 0
    grid = sampling.control_grid(spark.createDataFrame([("x", 0.0, 1.0, 2.0, 4.0)], "g string, a double, b double, c double, d double"), ["g"], [("a", "b", 2), ("c", "d", 1)])
    assert sorted(tuple(r) for r in grid.collect()) == [("x", i, j, i / 2, 2.0 + 2 * j) for i in range(3) for j in range(2)]


def test_covered_share(spark):
    front = spark.createDataFrame([(k / 20, (1 - k / 20) ** 2) for k in range(21)], "f1 double, f2 double")
    points = spark.range(20_000).select((1.2 * sampling.uniform(sampling.digest(F.lit(1), F.col("id")))).alias("f1"), (1.2 * sampling.uniform(sampling.digest(F.lit(1), F.col("id")), 1)).alias("f2"))
    exact = sum(0.05 * (1.2 - (1 - k / 20) ** 2) for k in range(20)) + 0.2 * 1.2
    assert sampling.covered(points, front).first()[0] * 1.44 == pytest.approx(exact, rel=0.02)


def test_left_out(spark):
    df = spark.createDataFrame([("a", [float(x)], float(y)) for x, y in ((0, 0), (1, 1), (2, 4), (3, 3))] + [("b", [0.0], 1.0)], "group string, x array<double>, y double")
    got = {r.group: (r.n, r.rmse) for r in fits.left_out(df, lambda: models.Radial("linear")).collect()}
    # Beyond the ends the line through the ends that are left: 1 - 1 = 0 at 0 is right, 4 at 3 misses by 4 - ... of the rest.
    errors = [(1 + (0 - 1) * (3 - 1) / (3 - 1)) - 0, 2 - 1, 2 - 4, (0 + 3 * (4 - 0) / 2) - 3]
    assert got["a"] == (4, pytest.approx(math.sqrt(sum(e * e for e in errors) / 4))) and got["b"] == (0, None)
