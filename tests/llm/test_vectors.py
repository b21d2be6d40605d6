import numpy as np
import pytest

from lodestone.llm import vectors as v


def plain(rows, cosine=0.95):
    unit = []
    for i, x in rows:
        ok = i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)
        unit.append(np.array(x, float) / np.linalg.norm(np.array(x, float)) if ok else None)
    n = len(rows)
    link = [[j for j in range(n) if j != k and unit[k] is not None and unit[j] is not None and len(unit[k]) == len(unit[j]) and unit[k] @ unit[j] >= cosine] for k in range(n)]
    out = []
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            new = [j for j in link[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(ids) if ids else None
        out.append((rows[k][0], len(link[k]), root, root is None or rows[k][0] == root))
    return sorted(out, key=str)


def sample(n=700, dim=24):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((n, dim))
    for k in range(0, n // 2):
        base[k] = base[n - 1 - k % 40] + rng.standard_normal(dim) * 0.05
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    nan = float("nan")
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [nan] + [1.0] * (dim - 1), [float("inf")] * dim, [1.0, 0.0], [2.0, 0.1], rows[5][1]]
    return rows + [(1000 + k, x) for k, x in enumerate(odd)] + [(None, rows[5][1]), (3, rows[3][1])]


@pytest.mark.parametrize("split,small", [(512, 24), (16, 2)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, split, small):
    monkeypatch.setattr(v, "SMALL", small)
    monkeypatch.setattr(v.links, "__defaults__", (0.95, split))
    rows = sample()
    spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, label int, n long").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in v.op4_near_vectors(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)


def test_calibrated_count_prunes():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    (a, u), perm = v.cells(x / np.linalg.norm(x, axis=1, keepdims=True)), rng.permutation(3000)
    count = ((a == a[perm]) & (abs(u - u[perm]) <= v.WINDOW)).sum(1)
    count[perm == np.arange(3000)] = 0
    assert v.needed(64) > 1 and (count >= 1).sum() > 0 and (count >= v.needed(64)).sum() == 0


def test_many_equal_and_near_vectors(spark):
    rng = np.random.default_rng(5)
    one = rng.standard_normal(24)
    near = [(one + rng.standard_normal(24) * 0.02).tolist() for _ in range(120)]
    rows = [(i, one.tolist()) for i in range(400)] + [(500 + i, x) for i, x in enumerate(near)] + [(900, (-one).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in v.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), split=32).collect()}
    assert got == {i: ((519, 0) if i != 900 else (0, 900)) for i, _ in rows}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    (a, u), (b, w) = v.cells(x), v.cells(y)
    assert (((a == b) & (abs(u - w) <= v.WINDOW)).sum(1) >= v.needed(64)).mean() > 0.995


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert v.op4_near_vectors(spark, str(tmp_path)).count() == 0
