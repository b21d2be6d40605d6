"""Discrepancies by pairs of blocks, with stated widths and with the median rule, against all pairs."""

import numpy as np
import pytest

from lodestone.operators import kernels


def sets(dim=3, seed=1):
    rng = np.random.default_rng(seed)
    return {0: rng.normal(0, 1, (37, dim)), 1: rng.normal(0.5, 1, (50, dim)), 2: np.repeat(rng.normal(3, 2, (5, dim)), 4, 0), 5: rng.normal(0, 1, (1, dim)), 9: np.round(rng.normal(0, 1, (30, dim)))}


def rows(spark, data):
    listed = [(k, [float(x) for x in v]) for k, m in data.items() for v in m] + [(None, [1.0] * 3), (1, None), (1, [float("nan")] * 3), (2, [])]
    return spark.createDataFrame(listed, "label int, v array<double>").repartition(3)


def plain(data, target, sigma):
    d = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(2)
    t, out = data[target], {}
    for k, x in data.items():
        if k != target:
            middle = np.median(np.concatenate([d(x, x).ravel(), d(t, t).ravel()]))
            s = sigma or (np.sqrt(middle / 2) if middle > 1e-12 else 1.0)
            e = lambda a, b, s=s: np.exp(-d(a, b) / (2 * s * s)).mean()
            out[k] = (s, max(0.0, e(x, x) + e(t, t) - 2 * e(x, t)))
    return out


@pytest.mark.parametrize("block", [None, 8])
def test_equal_to_all_pairs(spark, block):
    data = sets()
    df = rows(spark, data)
    got = {r.label: r.mmd2 for r in kernels.discrepancies(df, 0, 1.3, block).collect()}
    assert got == {k: pytest.approx(m, abs=1e-9) for k, (_, m) in plain(data, 0, 1.3).items()}
    got = {r.label: (r.sigma, r.mmd2) for r in kernels.median_discrepancies(df, 0, block).collect()}
    assert got == {k: (pytest.approx(s, rel=1e-9), pytest.approx(m, abs=1e-9)) for k, (s, m) in plain(data, 0, None).items()}


def test_equal_rows_and_missing_sets(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in (0, 0, 1, 1, 1)], "label int, v array<double>")
    assert [tuple(r) for r in kernels.median_discrepancies(same, 0).collect()] == [(1, 1.0, 0.0)]
    for df in (same.filter("label = 1"), same.filter("label = 0"), same.limit(0)):
        assert kernels.median_discrepancies(df, 0).count() == kernels.discrepancies(df, 0, 1.0).count() == 0


def test_a_row_is_written_a_fixed_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 8)
    rows = [(k % 3, [float(x) for x in np.random.default_rng(k).normal(size=3)]) for k in range(400)]
    df = spark.createDataFrame(rows, "label long, v array<double>")
    sets = kernels.Sets(df, 0)
    assert {r.blocks for r in sets.many.collect()} == {kernels.SPLITS}
    small = {r.label: (r.sigma, r.mmd2) for r in kernels.median_discrepancies(df, 0, 50).collect()}
    for r in kernels.median_discrepancies(df, 0).collect():
        assert abs(r.sigma - small[r.label][0]) < 1e-9 and abs(r.mmd2 - small[r.label][1]) < 1e-9
