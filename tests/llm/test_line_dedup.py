import random
import re

import pytest

from lodestone.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, key string, removed int"


def plain(docs):
    """{(doc_id, text, copy): (n_lines, removed)} by comparing every line with all earlier ones."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    seen, out = [], {}
    for i in order:
        gone, lines = [], (docs[i][1] or "").split("\n")
        for k, line in enumerate(lines):
            ws = {w for w in re.split("[ \t\x0b\f\r]+", line.lower()) if w}
            if ws:
                if any(5 * len(ws & e) >= 4 * len(ws | e) for e in seen):
                    gone.append(k)
                seen.append(ws)
        out.setdefault((docs[i][0], len(lines), ",".join(map(str, gone))), []).append(i)
    return sorted(((d, n, len(r.split(",")) if r else 0, r) for (d, n, r), v in out.items() for _ in v), key=str)


def sample():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "The", "été", "ÉTÉ"]
    base = [[rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 12, 30, 80]))] for _ in range(40)]
    docs = []
    for i in range(50):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            ws = list(rnd.choice(base))
            for _ in range(rnd.randrange(0, 3)):
                ws[rnd.randrange(len(ws))] = rnd.choice(words)
            lines.append((" " if rnd.random() < 0.8 else " \t ").join(ws) + rnd.choice(["", " ", "\r"]))
        docs.append((i, "\n".join(lines + [""] * (i % 3))))
    return docs + [(100, None), (101, ""), (102, "  \n\n "), (None, docs[3][1]), (103, docs[5][1]), (103, docs[5][1]), (104, "x " * 5000)]


def write(spark, tmp_path, docs):
    spark.createDataFrame([(*d, "z", 1) for d in docs], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")


@pytest.mark.parametrize("large,rounds,rows", [(256, 2, 400_000), (0, 2, 400_000), (4, 1, 400_000), (0, 0, 0)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, large, rounds, rows):
    monkeypatch.setattr(ld.later, "__defaults__", (large, rounds))
    monkeypatch.setattr(ld, "BROADCAST_ROWS", rows)
    docs = sample()
    write(spark, tmp_path, docs)
    assert sorted((tuple(r) for r in ld.op5_line_dedup(spark, str(tmp_path)).collect()), key=str) == plain(docs)


def test_clean(spark, tmp_path):
    write(spark, tmp_path, [(1, "a b c d e\n\nx"), (2, "a b c d e f\nnew line"), (3, "A b c d e"), (4, None), (5, ""), (6, "x\ny"), (6, "x\ny")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = ld.clean(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text is not None) == [(1, "a b c d e\n\nx"), (2, "new line"), (5, ""), (6, "y")]
    assert [r.doc_id for r in got.collect() if r.text is None] == [4]


def test_empty(spark, tmp_path):
    write(spark, tmp_path, [])
    assert ld.op5_line_dedup(spark, str(tmp_path)).count() == 0


def test_near_copies_meet_few_others(spark, tmp_path, monkeypatch):
    """Of a large group of near copies of one line most match a close one; their pairs with the others aren't written."""
    rnd, staged, written = random.Random(5), ld.staged, {}
    line = [f"w{k}" for k in range(50)]
    docs = [(i, " ".join(f"new{i}x{k}" if k in gone else w for k, w in enumerate(line))) for i in range(400) for gone in [set(rnd.sample(range(50), rnd.randrange(1, 7)))]]

    def counted(df, name, keep=False):
        out = staged(df, name, keep)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ld, "staged", counted)
    monkeypatch.setattr(ld.later, "__defaults__", (16, 2))
    write(spark, tmp_path, docs)
    assert sorted((tuple(r) for r in ld.op5_line_dedup(spark, str(tmp_path)).collect()), key=str) == plain(docs)
    # All pairs are 79 800.
    assert written["line-candidates"] < 20 * len(docs)


def counting(monkeypatch):
    staged, written = ld.staged, {}

    def counted(df, name, keep=False):
        out = staged(df, name, keep)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ld, "staged", counted)
    return written


@pytest.mark.parametrize("large", [256, 0])
def test_wide_lines_equal_brute_force(spark, tmp_path, monkeypatch, large):
    """Lines on both sides of WIDE, with as many words changed as a match allows or some more or less."""
    monkeypatch.setattr(ld.later, "__defaults__", (large, 2))
    rnd, words = random.Random(7), [f"w{k}" for k in range(300)]
    lines = []
    for n in [50, 58, 62, 64, 65, 66, 70, 90, 140] * 3:
        base = rnd.sample(words, n)
        lines.append(base)
        for less, more in [(0, n // 4), (n // 5, 0), (n // 9, n // 9), (n // 10, n // 9), (n // 7, n // 8)]:
            lines.append(rnd.sample(base, n - less) + rnd.sample([w for w in words if w not in base], more))
    docs = [(i, " ".join(line)) for i, line in enumerate(lines)]
    rnd.shuffle(docs)
    write(spark, tmp_path, docs)
    assert sorted((tuple(r) for r in ld.op5_line_dedup(spark, str(tmp_path)).collect()), key=str) == plain(docs)


def test_tokens_of_one_line_are_not_entered(spark, tmp_path, monkeypatch):
    """Of lines that share frequent words alone, rare ones pair nothing; nothing is settled first where no group is large."""
    written = counting(monkeypatch)
    docs = [(i, " ".join(["the", "of", *[f"own{i}x{k}" for k in range(20)]])) for i in range(50)] + [(60, "a b c d e f g h i j"), (61, "a b c d e f g h i k")]
    write(spark, tmp_path, docs)
    first = ld.heads(ld.classes(spark.read.parquet(f"{tmp_path}/documents.parquet"))).withColumn("settled", ld.F.lit(False))
    assert {r.k1 for r in ld.entries(first).select("k1").distinct().collect()} <= {r.k1 for r in first.filter("doc_id >= 60").collect()}
    assert sorted((tuple(r) for r in ld.op5_line_dedup(spark, str(tmp_path)).collect()), key=str) == plain(docs)
    assert not {"line-hubs", "line-marked"} & set(written)


def test_large_groups_are_entered_once(spark, tmp_path, monkeypatch):
    """Entries of large groups are made once, classes aren't written again to mark the settled ones, and tokens are sorted as longs."""
    written = counting(monkeypatch)
    monkeypatch.setattr(ld.later, "__defaults__", (4, 2))
    docs = sample()
    write(spark, tmp_path, docs)
    assert sorted((tuple(r) for r in ld.op5_line_dedup(spark, str(tmp_path)).collect()), key=str) == plain(docs)
    assert "line-crowd" in written and "line-marked" not in written
    found = ld.hashed(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    levels = spark.range(1).select(ld.F.array(ld.F.lit(3).cast("tinyint")).alias("levels"))
    assert not found.crossJoin(levels).select(ld._ordered(ld.F.col("h"), ld.F.col("levels")).alias("all")).schema["all"].dataType.containsNull
