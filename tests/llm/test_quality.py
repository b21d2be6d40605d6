import random
import zlib

import numpy as np

from lodestone.llm import quality as q


def plain(net, x):
    """The score of one text by loops over its windows."""
    n = max(1, -(-len(x) // q.HALF))
    data = np.concatenate([np.frombuffer(x, np.uint8), np.zeros(n * q.HALF - len(x) + q.WIDTH, np.uint8)])
    tops, same = [], []
    for r in range(n):
        tops.append(np.max([sum(net.filters[k, data[p + k]] for k in range(q.WIDTH)) for p in range(r * q.HALF, (r + 1) * q.HALF, q.STRIDE)], 0))
        real = [p for p in range(r * q.HALF, (r + 1) * q.HALF) if data[p]]
        same.append([sum(p >= lag and data[p] == data[p - lag] for p in real) / max(1, len(real)) for lag in q.LAGS])
    chunks = [np.maximum(np.maximum(tops[r], tops[min(n - 1, r + 1)]) + np.maximum(same[r], same[min(n - 1, r + 1)]) @ net.lags + net.bias, 0) for r in range(n)]
    value = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)]) @ net.out + net.base
    return 1 / (1 + np.exp(-value))


def test_score_equals_plain_windows_alone_batched_and_reordered(monkeypatch):
    net = q.Network(1)
    net.out, net.bias = np.random.default_rng(2).standard_normal(2 * q.FILTERS) * 0.05, np.linspace(-0.5, 0.5, q.FILTERS).astype(np.float32)
    rnd = random.Random(4)
    texts = [bytes(rnd.randrange(1, 255) for _ in range(n)) for n in (0, 1, 5, 509, 511, 512, 513, 1500, 1023, 3000, 512)] + [b"ab " * 700, b"\xff" * 512]
    alone = [net.score([x])[0] for x in texts]
    assert np.allclose(alone, [plain(net, x) for x in texts], atol=1e-5)
    assert net.score(texts).tolist() == alone
    order = rnd.sample(range(len(texts)), len(texts))
    assert net.score([texts[i] for i in order]).tolist() == [alone[i] for i in order]
    monkeypatch.setattr(q, "_ROWS", 3)
    assert net.score(texts).tolist() == alone


def test_no_score_depends_on_the_batch():
    net, rnd, rng = q.Network(3), random.Random(8), np.random.default_rng(9)
    net.out, net.lags = rng.standard_normal(2 * q.FILTERS) * 0.05, rng.standard_normal(net.lags.shape).astype(np.float32)
    texts = [bytes(rnd.choice(b"ab cd") for _ in range(rnd.randrange(3000))) for _ in range(400)]
    assert net.score(texts).tolist() == [net.score([x])[0] for x in texts]


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c" * 2000)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(1, 1), (2, 1), (2, 1)], 2.5 / 3), ([(1, 0), (None, 1)], 0.25), ([(8, 1), (9, 0)], 0.5)):
        model = q.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.quality_score for r in q.score(docs, model).collect()} == {want}


def test_learns_and_scores(spark, tmp_path):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    good = lambda: " ".join(word() for _ in range(rnd.randrange(5, 200)))
    bad = lambda: rnd.choice([" ".join(word() + "###" for _ in range(80)), (word() + " ") * 90])
    rows = [(i, bad() if i % 4 == 0 else good(), 9) for i in range(600)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(500)] + [(None, 1, 0), (7000, 0, 0), (3, None, 0)]
    rows += [(1000, None, 9), (1001, "", 9), (None, good(), 9), (1002, "x" * 300_000, 9), (1, rows[1][1], 9)]
    spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op10_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held)
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.9


def test_one_label_and_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert q.op10_quality(spark, str(tmp_path)).count() == 0
