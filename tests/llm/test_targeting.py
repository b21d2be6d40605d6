import hashlib
import math
import random
import re
import zlib
from collections import Counter

from lodestone.llm import targeting as t

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(docs, items):
    """{(doc_id, n_features, weight, score, rank)} by loops over all features."""
    s, tt = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[1])
    for x in items:
        tt.update(feats(x)[1])
    big_s, big_t = sum(s.values()), sum(tt.values())
    gain = [math.floor(1000 * math.log((tt[k] + 1) * (big_s + 10000) / ((s[k] + 1) * (big_t + 10000)))) for k in range(10000)]
    rows = []
    for i, x in docs:
        n, f = feats(x)
        w = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def query(spark, tmp_path, docs, items):
    spark.createDataFrame([(*d, 0, "mine") for d in docs], "doc_id long, text string, score int, place string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"b{i}", x) for i, x in enumerate(items)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(map(tuple, t.op11_resample(spark, str(tmp_path)).collect()), key=repr)


def test_query_equals_loops(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["the", "É", "of", "alpha", "Beta", "漢字", "x1", "éa", "ÀB", "😀"]) + rnd.choice(["", "s", "t"])
    text = lambda n: rnd.choice(["", " ", ".\n"]) + " ".join(word() for _ in range(n)) + rnd.choice(["", "!"])
    docs = [(i, text(rnd.randrange(60))) for i in range(250)] + [(300, None), (301, ""), (302, " .,- "), (303, "one"), (304, "Ab " * 60_000), (None, text(30))]
    docs += [(7, docs[7][1]), (7, docs[7][1])]
    items = [text(25) for _ in range(20)] + [None, ""]
    assert query(spark, tmp_path, docs, items) == plain(docs, items)


def test_more_ranges_than_rows_and_ties(spark):
    docs = spark.createDataFrame([(i, 20, 5 + i % 2) for i in range(40)] + [(99, 19, 100)], "doc_id long, n_words int, score long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.doc_id: r["rank"] for r in t.draw(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {k: v for k, v in got.items() if v} == {2 * k + 1: k + 1 for k in range(10)} and got[99] is None


def test_empty_tables(spark, tmp_path):
    assert query(spark, tmp_path / "a", [], ["b c"]) == []
    docs = [(i, "a b " * 10) for i in range(8)]
    assert query(spark, tmp_path / "b", docs, []) == plain(docs, [])
