"""Models of groups of rows: states put away and got back, designs, blocks, and how well they predict."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import fits


def camel(x):
    a, b = x[:, 0], x[:, 1]
    return (4 - 2.1 * a**2 + a**4 / 3) * a**2 + a * b + (4 * b**2 - 4) * b**2


def rows(spark, groups, n, seed=0):
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        x = rng.uniform([-2, -1], [2, 1], (n, 2)) * 0.5
        out += [(f"g{g}", g * n + k, [float(v) for v in p], float(y)) for k, (p, y) in enumerate(zip(x, (1 + g) * camel(x)))]
    return spark.createDataFrame(out, "group string, id long, x array<double>, y double").repartition(4)


@pytest.mark.parametrize("make", [lambda: models.Kriging(sweeps=1, steps=8), lambda: models.Radial("thin_plate"), lambda: models.Radial("gaussian", eps=2.0)])
def test_a_state_predicts_as_its_model(make):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (30, 2))
    model = make().fit(x, camel(x))
    again = fits._got(fits._put(model))
    for a, b in zip(model.predict(x + 0.1), again.predict(x + 0.1)):
        assert np.array_equal(a, b)


def test_two_fidelities_put_away():
    rng = np.random.default_rng(3)
    a, b = rng.uniform(-1, 1, (30, 2)), rng.uniform(-1, 1, (8, 2))
    model = models.CoKriging(grid=np.linspace(0, 2, 5)).fit(a, camel(a) * 0.5, b, camel(b))
    assert np.array_equal(fits._got(fits._put(model)).predict(a)[0], model.predict(a)[0])


def test_kriging_of_each_group(spark):
    df = rows(spark, 3, 300)
    states = fits.fit(df.select("group", "x", "y"), lambda: models.Kriging(), 40).cache()
    assert sorted((r.group, r.n) for r in states.collect()) == [("g0", 40), ("g1", 40), ("g2", 40)]
    found = fits.predict(states, df, block=70).cache()
    assert found.count() == 900 and all(r.r2 > 0.9 and r.n == 300 for r in fits.explained(found).collect())
    # A model meets its own points, where nothing can be improved beyond them.
    design = fits.designs(df.withColumn("level", F.lit(0)), 40).select("group", F.col("x").alias("p"), F.col("y").alias("want"))
    own = found.join(df.select("group", "id", "x"), ["group", "id"]).join(design, ["group"]).filter(F.col("x") == F.col("p"))
    assert own.count() == 120 and own.filter((F.abs(F.col("mean") - F.col("want")) > 1e-3) | (F.col("sd") > 1e-2)).count() == 0


def test_groups_that_teach_nothing(spark):
    inf = float("inf")
    data = [("a", 1, [0.0, 0.0], 1.0), ("a", 2, [0.0, 0.0], 3.0), ("b", 3, [None, 1.0], 1.0), ("b", 4, [1.0, inf], 1.0), ("b", 5, None, 1.0), (None, 6, [0.0, 1.0], 1.0), ("c", 7, [1.0, 1.0], None)]
    df = spark.createDataFrame(data, "group string, id long, x array<double>, y double")
    # Equal inputs are one point of the design, with their mean.
    assert [(r.group, r.y) for r in fits.designs(df.withColumn("level", F.lit(0))).collect()] == [("a", 2.0)]
    states = fits.fit(df, lambda: models.Radial())
    assert states.count() == 0 and fits.predict(states, df).count() == 0


def test_ensemble_of_two_fidelities(spark):
    df = rows(spark, 2, 120, 4)
    level = F.when(F.col("id") % 8 == 0, 0).otherwise(1)
    two = df.select("group", level.alias("level"), "x", F.when(level == 0, F.col("y")).otherwise(F.col("y") * 0.5 + F.get("x", F.lit(0))).alias("y"))
    states = fits.fit(two, lambda: models.CoKriging(grid=np.linspace(0, 3, 7)), 60)
    assert all(r.r2 > 0.8 for r in fits.explained(fits.predict(states, df)).collect())
