"""Distance joins in any dimension against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import metric

INF = float("inf")


def points(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id long, v array<double>").repartition(3)


def plain(rows, eps, least):
    """DBSCAN by all pairs: {id: (is_core, smallest core of the cluster or -1)}, and linkage {id: smallest id}."""
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)}
    near = {i: {j for j in good if ((good[i] - good[j]) ** 2).sum() <= eps * eps} for i in good} | {i: {i} for i, _ in rows if i not in good}

    def reached(start, ok):
        seen, todo = {start}, [start]
        while todo:
            new = {j for j in near[todo.pop()] if ok(j)} - seen
            seen |= new
            todo += new
        return min(seen)

    core = {i for i in near if len(near[i]) >= least}
    name = {i: reached(i, core.__contains__) for i in core}
    found = {i: (i in core, name[i] if i in core else min((name[j] for j in near[i] if j in core), default=-1)) for i in near}
    return found, {i: reached(i, lambda j: True) for i in near}


def cases():
    rng = np.random.default_rng(0)
    two = np.vstack([rng.normal(0, 0.05, (20, 2)), rng.normal(5, 0.05, (20, 2)), [[20, 20]]])
    yield list(enumerate(two)), 0.5, 4
    # Clumps of different density in twelve dimensions, a chain, copies, and vectors that are near nothing.
    clumps = np.vstack([rng.normal(rng.normal(0, 3, 12), s, (60, 12)) for s in (0.1, 0.3, 0.6, 1.0)])
    chain = np.arange(50)[:, None] * np.eye(12)[3] * 0.9 + 40
    yield [*enumerate(np.vstack([clumps, chain, clumps[:5], clumps[:1], clumps[:1]])), (900, None), (901, []), (902, [None] * 12), (903, [INF] * 12), (904, [float("nan")] * 12)], 1.0, 5
    yield [(i, [float(i % 7)]) for i in range(300)], 1.0, 3
    yield [(7, [1.0]), (8, None)], 1.0, 1


@pytest.mark.parametrize("case,block", [(0, 2048), (1, 7), (2, 2048), (3, 2048)])
def test_clusters_equal_all_pairs(spark, monkeypatch, case, block):
    monkeypatch.setattr(metric, "BLOCK", block)
    monkeypatch.setattr(metric, "ROWS_A_PIVOT", 20)
    rows, eps, least = list(cases())[case]
    df, (want, linked) = points(spark, rows), plain(rows, eps, least)
    assert {r.id: (r.is_core, r.cluster) for r in metric.dbscan(df, eps, least).collect()} == want
    assert {r.id: r.cluster for r in metric.linkage(df, eps).collect()} == linked


def test_limits(spark):
    df = points(spark, [(0, [0.0]), (1, [0.01]), (2, [1.0]), (3, [5.0]), (4, [5.0])])
    groups = lambda limit: {r.id: r.cluster for r in metric.linkage(df, limit).collect()}
    assert groups(0.1) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3} and set(groups(10.0).values()) == {0} and groups(0.0) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}
    empty = df.filter("id < 0")
    assert metric.linkage(empty, 1.0).count() == metric.dbscan(empty, 1.0).count() == 0
    for wrong in (lambda: metric.linkage(df, -1.0), lambda: metric.dbscan(df, 0.0), lambda: metric.dbscan(df, 0.5, 0)):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("block", [16])
def test_nearest_equals_all_pairs_and_skips_cells(spark, monkeypatch, block):
    monkeypatch.setattr(metric, "BLOCK", block)
    rng = np.random.default_rng(1)
    v = np.vstack([rng.normal(rng.normal(0, 5, 8), 0.5, (100, 8)) for _ in range(20)])
    v[50] = v[51] = v[52]
    rows = [*enumerate(v), (5000, None), (5001, [INF] * 8)]
    df = points(spark, rows)
    found, looked = metric.nearest(df, df.filter("id % 50 = 0"), 4)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    want = {q: [i for _, i in sorted((((v[q] - v[i]) ** 2).sum(), i) for i in range(len(v)) if i != q)[:4]] for q in range(0, len(v), 50)}
    assert got == want
    share = looked.agg(F.avg(F.col("looked").cast("double"))).first()[0]
    assert looked.select("cell").distinct().count() > 20 and share < 0.3


def test_nearest_of_few_or_none(spark):
    df = points(spark, [(1, [0.0]), (2, [3.0]), (3, None)])
    found, _ = metric.nearest(df, df, 5)
    assert sorted((r.query, r.id, r.rank, r.d) for r in found.collect()) == [(1, 2, 1, 3.0), (2, 1, 1, 3.0)]
    assert metric.nearest(df.filter("id = 3"), df, 5)[0].count() == 0


def directions(n, dim=64):
    v = np.random.default_rng(5).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_vectors_that_pivots_do_not_part_are_written_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK", 32)
    monkeypatch.setattr(metric, "SPLITS", 5)
    monkeypatch.setattr(metric, "TILE", (16, 24))
    monkeypatch.setattr(metric, "ROWS_A_PIVOT", 8)
    v = directions(300)
    rows = [*enumerate(v), (300, v[3]), (301, v[3]), (400, None)]
    written = []
    grid = metric.gridded
    monkeypatch.setattr(metric, "gridded", lambda home, other, block, counts, *a: written.append(-(-counts[0] // block)) or grid(home, other, block, counts, *a))
    df, (want, linked) = points(spark, rows), plain(rows, 1.15, 5)
    assert {r.id: (r.is_core, r.cluster) for r in metric.dbscan(df, 1.15).collect()} == want
    assert {r.id: r.cluster for r in metric.linkage(df, 1.0).collect()} == plain(rows, 1.0, 5)[1]
    assert len(set(want.values())) > 2 and written and max(written) == 5


def test_links_are_united():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (50, 20), (50, 60), (400, 390)):
        u, v = rng.integers(0, n, (2, m))
        want = np.arange(n)
        for _ in range(n):
            for i, j in zip(u, v):
                want[i] = want[j] = min(want[i], want[j])
        assert (metric.united(n, u, v) == want).all()
    chain = np.arange(999)
    assert (metric.united(1000, chain + 1, chain) == 0).all()
