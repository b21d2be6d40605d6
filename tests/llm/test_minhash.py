import random
import re

import numpy as np

from lodestone.llm import minhash as mh


def plain_set(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain_groups(docs):
    sets = {i: plain_set(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def sample():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(500)] + ["été", "x,y", "Zz"]
    docs = []
    for g in range(30):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 20, 60, 300]))]
        for _ in range(rnd.choice([1, 2, 6])):
            ws = list(base)
            for _ in range(rnd.choice([0, 0, 1, 3])):
                ws[rnd.randrange(len(ws))] = rnd.choice(words)
            docs.append(" ".join(ws))
    docs += [docs[0].upper(), docs[5] + "\n", None, "", "!!", None, "same " * 20000]
    return list(enumerate(docs))


def test_shingles_equal_plain_sets():
    texts = [t for _, t in sample()] + ["a\x00b c", "ab", "ba", "a b", "\x00"]
    got = mh.shingles(texts)
    plain = [plain_set(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(plain[i] & plain[j])


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    wx, wy = rng.uniform(0.1, 6, 400), rng.uniform(0.1, 6, 400)
    want = np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()
    a, b = mh.signature(x, wx, 2000), mh.signature(x, wy, 2000)
    assert abs((a == b).mean() - want) < 0.05
    a, b = mh.signature(x[:300], k=2000), mh.signature(x[100:], k=2000)
    assert abs((a == b).mean() - 0.5) < 0.05


def test_query_equals_brute_force(spark, tmp_path):
    docs = sample()
    rows = [(i, t, 1) for i, t in docs] + [(None, docs[3][1], 1), (3, docs[3][1], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = mh.op1_near_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == plain_groups(docs)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    left = mh.dedup(spark.read.parquet(f"{tmp_path}/documents.parquet"), broadcast_rows=0)
    assert left.columns == ["doc_id", "text", "size"]
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([*set(plain_groups(docs).values()), None], key=str)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert mh.op1_near_dedup(spark, str(tmp_path)).count() == 0
