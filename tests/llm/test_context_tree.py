import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import context_tree as ct


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def plain_ctw(train, texts, depth):
    """log10 probabilities by recursion over explicit context trees, one for each decision node."""
    counts = Counter()
    for t in train:
        data = [255] * depth + [*lower(t), 255]
        for i in range(depth, len(data)):
            ctx = tuple(reversed(data[i - depth : i]))
            for d in range(depth + 1):
                for level in range(8):
                    counts[ctx[:d], level, data[i] >> (8 - level), (data[i] >> (7 - level)) & 1] += 1
    children = {}
    for ctx, level, prefix, _ in counts:
        if ctx:
            children.setdefault((ctx[:-1], level, prefix), set()).add(ctx)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(ctx, level, prefix):
        key = ctx, level, prefix
        if key not in memo:
            own = kt(counts[(*key, 0)], counts[(*key, 1)])
            if len(ctx) == depth:
                memo[key] = own
            else:
                memo[key] = np.logaddexp(own, sum(weighted(c, level, prefix) for c in sorted(children.get(key, ())))) - math.log(2)
        return memo[key]

    def p(ctx, d, level, prefix, bit):
        key = ctx[:d], level, prefix
        own = (counts[(*key, bit)] + 0.5) / (counts[(*key, 0)] + counts[(*key, 1)] + 1)
        if d == depth:
            return own
        stay = math.exp(kt(counts[(*key, 0)], counts[(*key, 1)]) - math.log(2) - weighted(*key))
        return stay * own + (1 - stay) * p(ctx, d + 1, level, prefix, bit)

    out = []
    for t in texts:
        data, total = [255] * depth + [*lower(t), 255], 0.0
        for i in range(depth, len(data)):
            ctx = tuple(reversed(data[i - depth : i]))
            total += sum(math.log10(p(ctx, 0, level, data[i] >> (8 - level), (data[i] >> (7 - level)) & 1)) for level in range(8))
        out.append(total)
    return out


def plain_base(train, texts):
    cut = lambda t: [*lower(t).split(), None]
    c = Counter(w for t in train for w in cut(t))
    n, v = sum(c.values()), len(c)
    return [(len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in cut(t))) for t in texts]


@pytest.mark.parametrize("block,depth,piece", [(1 << 20, 2, 1 << 20), (300, 4, 64), (1 << 20, 5, 100)])
def test_query_equals_plain_recursion(spark, tmp_path, monkeypatch, block, depth, piece):
    monkeypatch.setattr(ct.score, "__defaults__", (depth, block))
    monkeypatch.setattr(ct, "CODES", block)
    monkeypatch.setattr(ct, "PIECE", piece)
    monkeypatch.setattr(ct, "MERGE", piece)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["the", "The", "cat", "été", "\tsat,", "on\n"]) for _ in range(rnd.randrange(0, 12))) for _ in range(40)] + [None, "", "zz top", "a\x0bb\x0cc d", "the " * 300]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, "no id")]
    spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [t for i, t in rows if not held(i)]
    want = [(i, held(i), *b, s) for (i, t), b, s in zip(rows, plain_base(train, [t for _, t in rows]), plain_ctw(train, [t for _, t in rows], depth), strict=True)]
    got = ct.op6_context_tree(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for g, w in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(want, key=lambda r: (r[0] is None, r[0])), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9) and g.score == pytest.approx(w[6], rel=1e-6)


def test_long_text_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 1000)
    rnd = random.Random(2)
    long = " ".join(rnd.choice(["one", "two", "three", "x" * 40]) for _ in range(3000))
    rows = [(1, "a b")] * 10_000 + [(2, long), (3, long + "!"), (4, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, held int").repartition(3)
    got = ct.score(docs, ct.F.col("doc_id") == 3, block=4096).collect()
    train = [t for i, t in rows if i != 3]
    some = [("a b",), (long,), (long + "!",), (None,)]
    want = {i: (b[3], s) for i, b, s in zip((1, 2, 3, 4), plain_base(train, [t for (t,) in some]), plain_ctw(train, [t for (t,) in some], ct.DEPTH), strict=True)}
    assert len(got) == len(rows) and {r.doc_id for r in got} == {1, 2, 3, 4}
    for r in got:
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id], rel=1e-6)


def test_probabilities_sum_to_one():
    data = np.frombuffer(b"abracadabra\xffabab\xff", np.uint8)
    codes, counts = np.unique(ct.grams(data, 3), return_counts=True)
    asked = np.union1d(codes, (98 << 24) | (98 << 16) | (97 << 8) | np.arange(256))
    n = np.zeros(len(asked))
    n[np.searchsorted(asked, codes)] = counts
    trees = ct.Trees(asked, n, 3)
    last = np.unique(trees.pairs & 255)
    sums = [np.array([x[trees.pairs & 255 == k].sum(0) for k in last]) for x in (trees.decisions, trees.below)]
    got = trees.log10(ct.Shallow(last, *sums))
    assert np.power(10, got[asked >> 8 == (98 << 16) | (98 << 8) | 97]).sum() == pytest.approx(1)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ct.op6_context_tree(spark, str(tmp_path)).count() == 0
