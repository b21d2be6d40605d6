import random
import zlib

import numpy as np
import pytest

from lodestone.llm import language as lg


def plain_phrases(text, sample):
    n = 0
    while text:
        k = 1
        while k < len(text) and text[: k + 1] in sample:
            k += 1
        text, n = text[k:], n + 1
    return n


@pytest.mark.parametrize("piece", [3, 64, 512])
def test_lockstep_equals_plain_parsing(piece):
    rnd = random.Random(1)
    words = {x: ["".join(rnd.choice(a) for _ in range(rnd.randrange(1, 7))) for _ in range(40)] for x, a in (("aa", "abcde"), ("bb", "cdefg "), ("cc", "xyé"), ("dd", "日本語中"))}
    samples = {x: " ".join(rnd.choice(w) for _ in range(120)) for x, w in words.items()}
    model = lg.Model(samples)
    texts = [" ".join(rnd.choice(words[rnd.choice(list(words))]) for _ in range(n)) for n in (1, 3, 40, 400)] + ["a", "", "q", "zzz qq", "abc" * 300, samples["aa"], samples["dd"] * 2, "x" * 128, "日" * 100]
    got = model.phrases([t.encode() for t in texts], piece)
    for i, t in enumerate(texts):
        # bytes outside the samples share a class that no sample has
        assert got[i].tolist() == [plain_phrases(t.encode(), samples[x].encode()) for x in model.labels], t


def test_numbers_are_no_letters():
    model = lg.Model({"a": "some text"})
    assert model.predict(["½ ²", "Ⅷ①", "12 _", "é", "日"])[0] == ["und", "und", "und", "a", "a"]


def test_rows_of_all_lengths_teach_and_none_fills_the_sample(spark):
    rows = [(1, "x" * 30, "a"), (2, "yy", "a"), (2, "yy", "a"), (3, "z" * 40, "b"), (4, "w" * 50, "b"), (None, None, "b"), (5, "q", None)]
    got = lg.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs=9, chars=10)
    # Ten of the thirty characters, a blank, and two texts of two; two passages of ten.
    assert got.labels == ["a", "b"] and got.cost.tolist() == [np.log2(16), np.log2(21)]
    text = "".join(chr(0x4E00 + k) for k in range(5000))
    sample = lg.learn(spark.createDataFrame([(k, text, "c") for k in range(30)], "doc_id long, text string, lang string"), docs=30, chars=20)
    assert sample.cost.tolist() == [np.log2(30 * 20 * 3 + 29)]


def test_automaton_knows_exactly_the_substrings():
    s = np.array([0, 1, 1, 0, 2, 0, 1, 1, 2])
    t = lg.automaton(s, 3)
    text = "".join(map(str, s))
    for word in ("011", "0112", "110201", "22", "2012", "10"):
        state = 0
        for c in word:
            state = t[state, int(c)] if state >= 0 else -1
        assert (state >= 0) == (word in text)


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")


def test_query(spark, tmp_path):
    rnd = random.Random(2)
    vocabulary = {"xx": ["ba", "bobu", "bibi", "obab"], "yy": ["kiz", "zek", "ikzi", "zzk"]}
    rows = [(i, " ".join(rnd.choice(vocabulary[x]) for _ in range(rnd.randrange(3, 80))).title(), x, "s") for i in range(200) for x in ("xx", "yy") if (i % 2 == 0) == (x == "xx")]
    rows += [(500, None, "xx", "s"), (501, "", "xx", "s"), (502, "12 -- !!", None, None), (503, "ba bobu", None, None), (None, "kiz zek kiz", None, None), (0, "kiz", "yy", None), (504, "ba " * 20000, "xx", None)]
    write(spark, tmp_path, rows)
    got = lg.op8_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (500, 501, 502, 503, None, 504)] == ["und", "und", "und", "xx", "yy", "xx"]
    assert all(by[i].lang_pred == ("yy" if i % 2 else "xx") for i in range(1, 200))
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1, 200)) and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_and_empty(spark, tmp_path):
    write(spark, tmp_path, [(1, "some text", None, None)])
    assert [(r.lang_pred, r.score) for r in lg.op8_language(spark, str(tmp_path)).collect()] == [("und", 0.0)]
    write(spark, f"{tmp_path}/e", [])
    assert lg.op8_language(spark, f"{tmp_path}/e").count() == 0
