"""Literal fixtures with answers worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models, physics, testbed
from lodestone.operators import audit, cluster, graph, pareto, search, stats, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_weighted(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0)], "v double, w double")
    assert df.agg(stats.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 1.25
    r = stats.weighted_std(spark.createDataFrame([("k", 1.0, 1.0), ("k", 3.0, 1.0)], "k string, v double, w double"), ["k"], "v", "w").first()
    assert (r["mean"], r["std"]) == (2.0, 1.0)
    assert spark.createDataFrame([(1.0, 0.0)], "v double, w double").agg(stats.weighted_mean(F.col("v"), F.col("w"))).first()[0] is None


def test_physics(spark):
    x = lambda v: F.lit(float(v))
    r = one(
        spark, a=physics.loss_coefficient(x(100), x(100), x(90)), b=physics.loss_coefficient(x(100), x(90), x(90)), c=physics.static_pressure_coefficient(x(101325), x(100000), x(5000)), d=physics.film_effectiveness(x(1500), x(1050), x(600)),
        e=physics.nusselt(x(850), x(0.02), x(0.06)), f=physics.relative_change(x(91.62), x(91.20)), g=physics.point_change(x(91.62), x(91.20)), h=physics.loss_coefficient(x(1), x(1), x(1)),
    )
    assert (r.a, r.b, r.d, r.h) == (0, 1, 0.5, None)
    assert r.c == pytest.approx(0.265) and r.e == pytest.approx(283.3333, abs=1e-4) and r.f == pytest.approx(0.4605, abs=1e-4) and r.g == pytest.approx(0.42)


def test_filter_threshold(spark):
    for args, want in (((0.0, 1.0, 2.0, 5.0), (1.0, 2.0)), ((1.0, 1.0, 2.0, 5.0), (0.5, 3.5))):
        omega, t = stats.filter_threshold(*map(F.lit, args))
        r = one(spark, omega=omega, t=t)
        assert (r.omega, r.t) == want


FRONTS = [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1), (2, 6), (3, 5), (6, 6)]


def test_fronts(spark):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(FRONTS)] + [(8, 3.0, 3.0), (9, None, 1.0)], "id int, a double, b double")
    assert sorted(r.id for r in pareto.pareto_front(df, F.col("a"), F.col("b")).collect()) == [0, 1, 2, 3, 4, 8]
    assert {r.id: r.front for r in pareto.front_ranks(df, [F.col("a"), F.col("b")]).collect()} == dict(enumerate([0, 0, 0, 0, 0, 1, 1, 2])) | {8: 0}
    assert search.front_ranks(np.array(FRONTS, float)).tolist() == [0, 0, 0, 0, 0, 1, 1, 2]
    front = pareto.pareto_front(df.filter("id < 5"), F.col("a"), F.col("b"))
    c = {r.id: (r.is_boundary, r.crowding) for r in pareto.crowding(front, ["f1", "f2"], "id").collect()}
    assert c[0] == c[4] == (True, None) and c[2] == (False, 1.0)
    empty = df.filter("id < 0")
    assert pareto.pareto_front(empty, F.col("a"), F.col("b")).count() == 0 and pareto.front_ranks(empty, [F.col("a"), F.col("b")]).count() == 0


def test_hypervolume_and_igd(spark):
    for points, want in (([(3.0, 3.0)], 12.25), ([(3.0, 3.0), (2.0, 2.0)], 20.25)):
        front = pareto.pareto_front(spark.createDataFrame(points, "a double, b double"), F.col("a"), F.col("b"))
        assert pareto.hypervolume(front, (6.5, 6.5)).first()[0] == want
        assert search.hypervolume_sampled(np.array(points), (6.5, 6.5)) == pytest.approx(want, rel=0.02)
    ref = [(k / 20, 1 - (k / 20) ** 2) for k in range(21)]
    assert pareto.igd(spark.createDataFrame(ref, "f1 double, f2 double"), ref).first()[0] == 0


def test_linkage_and_density(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.01, 0.0), (2, 1.0, 0.0), (3, 5.0, 0.0)], "id long, x double, y double")
    for limit, n in ((0.1, 3), (10.0, 1), (0.0, 4)):
        assert cluster.single_linkage(points, limit).select("cluster").distinct().count() == n
    blobs = [(i, (i // 20) * 5 + (i % 5) * 0.05, (i // 20) * 5 + (i % 4) * 0.05) for i in range(40)] + [(40, 20.0, 20.0)]
    got = {r.id: r.cluster for r in cluster.dbscan(spark.createDataFrame(blobs, "id long, x double, y double"), 0.5, 4).collect()}
    assert got == {i: 0 for i in range(20)} | {i: 20 for i in range(20, 40)} | {40: -1}
    labels = models.density_labels(np.array([b[1:] for b in blobs]), 0.5, 4)
    assert labels.tolist() == [0] * 20 + [1] * 20 + [-1]


def test_groups(spark):
    ids = spark.range(5)
    for pairs, want in (([(0, 1)], [0, 0, 2, 3, 4]), ([(0, 1), (1, 4)], [0, 0, 2, 3, 0])):
        got = cluster.union_groups(ids, spark.createDataFrame(pairs, "a long, b long"))
        assert [r.group for r in got.orderBy("id").collect()] == want
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (7, 7)]
    assert {r.id: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {i: 0 for i in range(1, 41)} | {102: 100}


def test_test_function_optima(spark):
    n = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    trid = [i * (11 - i) for i in range(1, 11)]
    hartman = (0.20169, 0.150011, 0.476874, 0.275332, 0.311652, 0.6573)
    r = one(
        spark, sphere=testbed.sphere(n(0, 0)), rosenbrock=testbed.rosenbrock(n(1, 1, 1)), ackley=testbed.ackley(n(0, 0)), griewank=testbed.griewank(n(0, 0)), levy=testbed.levy(n(1, 1, 1)), trid=testbed.trid(n(*trid)),
        branin=testbed.branin(F.lit(math.pi), F.lit(2.275)), camel=testbed.camel6(F.lit(0.0898), F.lit(-0.7126)), hartman=testbed.hartman6(n(*hartman)), shekel=testbed.shekel4(n(4, 4, 4, 4)), shifted=testbed.shifted_rosenbrock(n(0.5, 0.5)),
    )
    want = {"sphere": 0, "rosenbrock": 0, "ackley": 0, "griewank": 0, "levy": 0, "trid": -210, "branin": 0.397887, "camel": -1.0316, "hartman": -3.32237, "shekel": -10.536, "shifted": 0}
    assert {k: pytest.approx(v, abs=5e-3) for k, v in want.items()} == r.asDict()


def test_text(spark):
    df = spark.createDataFrame([(1, "😀ab x AB"), (2, None), (3, ""), (4, "xx")], "id int, t string")
    assert [(r.id, r.start, r.end) for r in text.literal_hits(df, "t", "ab").orderBy("id", "start").collect()] == [(1, 1, 3), (1, 6, 8)]
    assert text.normal("ﬁ­x\0 /u0041  b\n\n\n\nc") == "fix A b\n\nc" and text.normal(None) is None
    fence = spark.createDataFrame([(0, "# a"), (1, "```"), (2, "# b"), (3, "```"), (4, "# c")], "line_no int, line string").withColumn("k", F.lit(1))
    got = [(r.in_fence, r.line) for r in text.demoted(text.fenced(fence, ["k"])).orderBy("line_no").collect()]
    assert got == [(False, "## a"), (True, "```"), (True, "# b"), (True, "```"), (False, "## c")]
    rows = spark.createDataFrame([(1, "x Abstract This is it. " + "w " * 400 + "Introduction more"), (2, None), (3, "Abstract at the start")], "id long, t string")
    got = {r.id: r.a for r in rows.select("id", text.abstract_window(F.col("t")).alias("a")).collect()}
    assert got[1].startswith("This is it.") and "Introduction" not in got[1] and got[2] == got[3] == ""
    stamps = {text.stamp(spark.createDataFrame(rows, "k int, v string").repartition(2), "k", "v").first().stamp for rows in ([(1, "a"), (2, "b")], [(2, "b"), (1, "a")])}
    assert len(stamps) == 1


def test_arithmetic_rule(spark):
    df = spark.createDataFrame([(1, "1500/20000 = 7.5%"), (2, "1500/20000 = 15.0%"), (3, None)], "id int, t string")
    assert [r.id for r in audit.stated_arithmetic(df, "id", "t").collect()] == [2]


def test_negative_weight_is_an_error(spark):
    with pytest.raises(Exception, match="negative weight"):
        spark.createDataFrame([(1.0, -1.0), (1.0, 3.0)], "v double, w double").agg(stats.weighted_mean(F.col("v"), F.col("w"))).collect()
