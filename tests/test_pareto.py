"""Scans in order over more than one range, and fronts of two to four objectives, against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import pareto, ranges


@pytest.fixture
def many(spark):
    """As many ranges as a small table allows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(n, m, values, seed=0):
    rnd = random.Random(seed)
    return [(i, *(float(rnd.randrange(values)) for _ in range(m))) for i in range(n)]


def test_neighbours_and_least_before_over_ranges(spark, many):
    rnd = random.Random(3)
    data = [(i, rnd.choice([None, "a", "b", "c", "c", "c", "c"]), rnd.randrange(25), rnd.choice([None, 5.0, 1.0, rnd.random()])) for i in range(150)]
    df = spark.createDataFrame(data, "id long, k string, o int, v double").repartition(5)
    assert ranges.ordered(df, ["k", "o", "id"]).select("range_").distinct().count() > 4
    got = {r.id: (r.before_ and r.before_.id, r.after_ and r.after_.id) for r in ranges.neighbours(df, ["k"], ["o", "id"], ["id"]).collect()}
    least = {r.id: r.m for r in ranges.least_before(df, ["k"], ["o", "id"], "v", "m").collect()}
    numbers = {r.id: r.n for r in ranges.numbered(df, ["o", "id"], "n").collect()}
    for k in (None, "a", "b", "c"):
        order = sorted((o, i, v) for i, kk, o, v in data if kk == k)
        for at, (_, i, _) in enumerate(order):
            assert got[i] == (order[at - 1][1] if at else None, order[at + 1][1] if at + 1 < len(order) else None)
            assert least[i] == min((v for _, _, v in order[:at] if v is not None), default=None)
    assert [i for i, _ in sorted(numbers.items(), key=lambda x: x[1])] == [i for _, i in sorted((o, i) for i, _, o, _ in data)]
    assert sorted(numbers.values()) == list(range(150))
    empty = df.limit(0)
    assert ranges.neighbours(empty, ["k"], ["o"], ["id"]).count() == ranges.least_before(empty, [], ["o"], "v", "m").count() == ranges.numbered(empty, ["o"], "n").count() == 0


def plain_ranks(points):
    """Fronts peeled one after another."""
    rank, left, k = {}, set(points), 0
    while left:
        front = {p for p in left if not any(q != p and all(a <= b for a, b in zip(q, p)) for q in left)}
        rank |= dict.fromkeys(front, k)
        left -= front
        k += 1
    return rank


@pytest.mark.parametrize("m,values,size", [(1, 9, None), (2, 12, 40), (3, 6, None), (3, 6, 40), (4, 5, 40)])
def test_front_ranks_and_skyline(spark, m, values, size):
    data = rows(150, m, values, m)
    names = [f"o{k}" for k in range(m)]
    df = spark.createDataFrame([*data, (900, *[None] * m), (901, float("nan"), *[1.0] * (m - 1))], "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    want = plain_ranks([r[1:] for r in data])
    got = {r.id: r.front for r in pareto.front_ranks(df, [F.col(c) for c in names], size).collect()}
    assert got == {r[0]: want[r[1:]] for r in data}
    assert {r.id for r in pareto.skyline(df, [F.col(c) for c in names]).collect()} == {i for i, k in got.items() if k == 0}
    if m == 2:
        assert {r.id for r in pareto.pareto_front(df.filter("id < 900"), F.col("o0"), F.col("o1")).collect()} == {i for i, k in got.items() if k == 0}


def test_fronts_without_rows_and_with_infinite_values(spark):
    df = spark.createDataFrame([(1, float("inf"), 0.0), (2, 0.0, float("-inf")), (3, 1.0, 1.0), (4, float("inf"), float("inf"))], "id long, a double, b double")
    objectives = [F.col("a"), F.col("b")]
    assert {r.id: r.front for r in pareto.front_ranks(df, objectives).collect()} == {2: 0, 1: 1, 3: 1, 4: 2}
    assert [r.id for r in pareto.skyline(df, objectives).collect()] == [2]
    empty = df.limit(0)
    assert pareto.front_ranks(empty, objectives).count() == pareto.skyline(empty, objectives).count() == 0


def test_a_chain_and_one_front(spark):
    chain = spark.createDataFrame([(i, float(i), float(i), float(i)) for i in range(64)], "id long, a double, b double, c double")
    assert {r.id: r.front for r in pareto.front_ranks(chain, [F.col(c) for c in "abc"], 16).collect()} == {i: i for i in range(64)}
    line = chain.withColumn("b", -F.col("b"))
    assert {r.front for r in pareto.front_ranks(line, [F.col(c) for c in "abc"], 16).collect()} == {0} and pareto.skyline(line, [F.col("a"), F.col("b")]).count() == 64


def test_crowding_by_front_over_ranges(spark, many):
    data = [(i, i % 3, *o) for i, *o in rows(90, 3, 15, 8)] + [(900, 7, 1.0, 2.0, 3.0), (901, 7, 2.0, 2.0, 1.0), (902, 8, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "id long, front int, a double, b double, c double")
    got = {r.id: (r.is_boundary, r.crowding) for r in pareto.crowding(df, ["a", "b", "c"], "id", ["front"]).collect()}
    for k in (0, 1, 2, 7, 8):
        part = [r for r in data if r[1] == k]
        total, edge = {r[0]: 0.0 for r in part}, {r[0]: len(part) <= 2 for r in part}
        for o in (2, 3, 4):
            order, span = sorted(part, key=lambda r: (r[o], r[0])), max(r[o] for r in part) - min(r[o] for r in part)
            if span > 0:
                edge[order[0][0]] = edge[order[-1][0]] = True
                for at in range(1, len(order) - 1):
                    total[order[at][0]] += (order[at + 1][o] - order[at - 1][o]) / span
        for i in total:
            assert got[i] == (edge[i], None if edge[i] else pytest.approx(total[i]))


def test_spread_and_hypervolume_over_ranges(spark, many):
    points = [(k / 49, 1 - k / 49) for k in range(50)]
    front = spark.createDataFrame(points, "f1 double, f2 double").repartition(5)
    assert pareto.spread(front).first()[0] < 0.1
    want = sum(((points[k + 1][0] if k < 49 else 2.0) - a) * (2.0 - b) for k, (a, b) in enumerate(points))
    assert pareto.hypervolume(front, (2.0, 2.0)).first()[0] == pytest.approx(want)
    assert np.isclose(pareto.hypervolume(front.limit(0), (2.0, 2.0)).first()[0], 0)
