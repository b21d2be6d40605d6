import math
import random
import zlib

import numpy as np

from lodestone.llm import toxicity as t


def test_folding():
    fold = t.fold
    assert fold(None) == fold("") == fold(" .,!") == " "
    assert fold("You IDIOT!") == " you idiot "
    assert fold("1d10t, ídіоt; idi​ot ＩＤＩＯＴ") == " idiot idiot idiot idiot "
    assert fold("$tupid m0r0n @sshole st!nk wow!! a@b cost$ 455 5.") == " stupid moron asshole stink wow aab cost 455 5 "
    assert fold("漢字 Straße réeux") == " 漢字 straße reeux "


def test_longest_keys_stems_and_exceptions():
    s = t.Scorer({" trash ": 2.0, " bad": 1.0, " badge ": 0.0, " idiot ": 3.0, " id": 0.5}, ("trash can", "very idiot proof"))
    found = lambda x: [(t.fold(x)[a:b].strip(), w) for a, b, w in s.matches(t.fold(x))]
    assert found("trash trash") == [("trash", 2.0)] * 2
    assert found("a trash can of trash, trash cans") == [("trash", 2.0)] * 2
    assert found("badly badge badges unbad") == [("bad", 1.0)] * 2
    assert found("idiot idle very idiot proof idiot") == [("idiot", 3.0), ("id", 0.5), ("idiot", 3.0)]
    total, words = s.sums("trash Trash badly other")
    assert words == 4 and math.isclose(total, 2 * (1 + math.log(2)) + 1)
    assert s.sums(None) == s.sums("...") == (0, 0)


def plain_matches(folded, weights, exceptions):
    """By looking at each word's beginning for every key."""
    spans = [(i, i + len(e)) for e in map(t.fold, exceptions) for i in range(len(folded)) if folded.startswith(e, i)]
    out = []
    for i in range(len(folded)):
        met = [k for k in weights if folded.startswith(k, i)]
        if met:
            k = max(met, key=len)
            if weights[k] > 0 and not any(a <= i and i + len(k) <= b for a, b in spans):
                out.append((i, i + len(k), weights[k]))
    return out


def test_matches_equal_looking_everywhere():
    rnd = random.Random(1)
    for _ in range(300):
        word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5)))
        weights = {f" {word()}{rnd.choice(['', ' '])}": float(rnd.randrange(3)) for _ in range(6)}
        exceptions = [" ".join(word() for _ in range(rnd.randrange(1, 4))) for _ in range(3)]
        folded = t.fold(" ".join(word() for _ in range(30)))
        assert t.Scorer(weights, exceptions).matches(folded) == plain_matches(folded, weights, exceptions)


def test_lexicon_of_counts():
    got = t.lexicon({" zap": (60, 0), " zapp": (60, 0), " zapp ": (60, 0), " fro": (50, 40), " fros": (20, 2), " frot": (25, 3), " fro ": (0, 35), " the ": (90, 900), " rare ": (3, 0), " trash ": (10, 200)}, 100, 1000)
    assert " zapp " in got and " zap" not in got and " the " not in got and " rare " not in got
    assert got[" fro"] > 0 and got[" fro "] == 0
    assert got[" trash "] == 0 and got[" idiot "] == t.SEED_WEIGHT


def written(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, toxicity string, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return t.op12_toxicity(spark, str(path)).collect()


def test_learns_and_scores(spark, tmp_path):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    insults = ["zonk", "grumpf", "idiot", "m0r0n"]

    def text(toxic):
        words = [word() for _ in range(rnd.randrange(5, 150))]
        if toxic:
            for _ in range(2 + len(words) // 30):
                words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        elif rnd.random() < 0.1:
            words.append("trash can")
        return " ".join(words)

    rows = [(i, text(i % 5 == 1), "mine", "xx") for i in range(900)]
    labels = [(i, 1, int(i % 5 == 1)) for i in range(800)] + [(None, 0, 1), (7000, 1, 0), (3, 1, None)]
    rows += [(1000, None, "mine", None), (1001, "", "", None), (None, text(True), "mine", None), (1002, "x " * 300_000, "mine", None), (1, rows[1][1], "mine", None)]
    got = written(spark, tmp_path, rows, labels)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held)
    assert np.mean([r.predicted == (r.doc_id % 5 == 1) for r in held]) > 0.97
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] and max(by[1000], by[1002]) < 0.5 < by[None]


def test_no_labels_one_label_and_empty(spark, tmp_path):
    rows = [(1, "you idiot, you pathetic moron", None, None), (2, "the weather is fine", None, None), (3, None, None, None)]
    for name, labels in (("none", []), ("one", [(1, 1, 1)]), ("strangers", [(8, 1, 1), (9, 1, 0)])):
        got = {r.doc_id: r.predicted for r in written(spark, tmp_path / name, rows, labels)}
        assert got == {1: 1, 2: 0, 3: 0}
    assert written(spark, tmp_path / "empty", [], [(1, 1, 1)]) == []
