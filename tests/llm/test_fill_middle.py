import hashlib
import random

import numpy as np

from lodestone.llm import fill_middle as f


def plain(key, text):
    """n, form, prefix and middle length, output by slicing the decoded text."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_rank_and_select_equal_counting():
    rnd = random.Random(3)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 4000):
        text = "".join(rnd.choice("aé漢😀") for _ in range(size))
        data = np.frombuffer(text.encode(), np.uint8)
        at = f.Boundaries(data)
        begins = [i for i, c in enumerate(data) if c & 0xC0 != 0x80]
        assert at.directory[-1] == size
        assert at.select(np.arange(size + 2)).tolist() == begins + [len(data)] * 2
        assert at.rank(np.arange(len(data) + 1)).tolist() == [sum(b < i for b in begins) for i in range(len(data) + 1)] if size < 600 else True


def test_restoring_with_halves_of_sentinels_beside_the_cuts():
    for form in (f.PSM, f.SPM, f.PLAIN):
        for parts in ((b"<", b"S>", b"<M"), (b"<P", b">", b"<S"), (b"<S", b"<M", b"P>"), (b"", b"", b""), (b"a<M", b"", b">")):
            p, m, s = parts
            assert f.restored(f.joined(form, p, m, s), form) == p + m + s


def test_query(spark, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", "a", "é", "<P> inside", "x<S", "<M", "😀" * 70, "é漢" * 40_000, "same", "same"]
    texts += ["".join(rnd.choice("ab é漢😀<PSM>") for _ in range(rnd.randrange(300))) for _ in range(300)]
    rows = [(i, t, "mine", -1) for i, t in enumerate(texts)] + [(None, "no id", "mine", 0), (9, "same", "mine", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = f.op13_fill_middle(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = f.restore(f.transform(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert sorted(r.restored for r in back.collect()) == sorted(t or "" for _, t, *_ in rows)


def test_seed_and_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert f.op13_fill_middle(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(str(i), "word " * 50) for i in range(40)], "doc_id string, text string")
    assert f.transform(docs).collect() == f.transform(docs).collect() != f.transform(docs, seed=2).collect()
