import hashlib
import random
import re

import pytest

from lodestone.llm import decontaminate as dc

DOCS = "doc_id long, text string, key string, ws int"
ITEMS = "item_id string, text string, w int"


def plain(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for i, t in items:
        ws = cut(t)
        n = min(13, len(ws))
        windows |= {(i or "", tuple(ws[a : a + n])) for a in range(len(ws) - n + 1)} if ws else set()
    out = []
    for d, t in docs:
        ws, hit, ids = cut(t), set(), set()
        for i, w in windows:
            for a in range(len(ws) - len(w) + 1):
                if tuple(ws[a : a + len(w)]) == w:
                    hit |= set(range(a, a + len(w)))
                    ids.add(i)
        out.append((d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def run(spark, tmp_path, docs, items, **kw):
    spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, 1) for i in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted((tuple(r) for r in dc.op3_decontaminate(spark, str(tmp_path)).collect()), key=str)


def sample():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["to", "é", "alpha", "Beta", "gamma", "ÉTÉ", "x1"])
    items = [(str(k), " ".join(word() for _ in range(n))) for k, n in enumerate([30, 13, 14, 4, 1, 7, 26, 13])] + [("9", "to " * 20), ("10", ""), ("11", None), (None, "lone item without an id"), ("9", "to " * 20)]
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 40)))]
        if k % 3:
            ws = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(0, max(1, len(ws) - 12))
            parts += [" ".join(ws[a : a + rnd.randrange(10, 20)]).upper() if k % 2 else ", ".join(ws[a:]), word()]
        docs.append((k, "\n".join(parts)))
    return docs + [(None, "lone item without an id"), (3, docs[3][1]), (3, "other text"), (70, None), (71, ""), (72, "to " * 3000)], items


def test_equals_brute_force(spark, tmp_path):
    docs, items = sample()
    assert run(spark, tmp_path, docs, items) == plain(docs, items)


def test_without_broadcast(spark, tmp_path, monkeypatch):
    docs, items = sample()
    monkeypatch.setattr(dc.hits, "__defaults__", (13, 5, 0))
    assert run(spark, tmp_path, docs, items) == plain(docs, items)


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty_tables(spark, tmp_path, empty):
    docs, items = ([] if empty != "items" else [(1, "a b c")]), ([] if empty != "docs" else [("1", "a b c")])
    assert run(spark, tmp_path, docs, items) == plain(docs, items)


def test_clean_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", 1), (2, "x " * 90, "a", 1), (None, None, None, None)], DOCS)
    items = spark.createDataFrame([("1", "one two three", 1)], ITEMS)
    got = dc.clean(docs, items)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["2", "None"]
