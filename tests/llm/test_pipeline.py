import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_minhash import plain_groups
from tests.llm.test_decontaminate import plain as plain_hits

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")


def sample():
    rnd = random.Random(12)
    vocabulary = {"xx": ["ba", "bobu", "bibi", "obab", "bub", "aboo", "uba", "boba"], "yy": ["kiz", "zek", "ikzi", "zzk", "kek", "izz", "ezik", "kizek"]}
    line = lambda x, n: " ".join(rnd.choice(vocabulary[x]) + rnd.choice(["", "", "ok", "um"]) for _ in range(n))
    items = [(str(k), line("xx", 20)) for k in range(4)] + [("9", None)]
    docs = []
    for i in range(80):
        x = rnd.choice(["xx", "yy"])
        docs.append([i, "\n".join(line(x, rnd.randrange(6, 30)) for _ in range(rnd.randrange(1, 5))), x])
    docs[10][1] += "\n" + docs[3][1].split("\n")[0]
    docs[11][1] = docs[4][1]
    docs[12][1] = "\n".join(x + " um" for x in docs[5][1].split("\n"))
    docs[13][1] += "\n" + items[1][1]
    docs[14][1] = line("yy", 400) + " " + items[2][1][:60]
    docs += [[90, None, "xx"], [91, "", None], [92, "12 !!", None], [93, "", "yy"]]
    return [tuple(d) for d in docs], items


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = sample()
    rows = [(i, t, x, "s", len(t or "")) for i, t, x in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for (name, stage), k in zip(corpus_pipeline.STAGES, range(5), strict=True):
        before = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
        got = stage(spark, now, str(tmp_path))
        if k < 4:
            assert got.columns == columns
            after = {r.doc_id: r.text for r in got.collect()}
        if k == 0:
            assert after == {i: t for i, t in before if t and any(c.isalpha() for c in t)}
        elif k == 1:
            want = {}
            for (i, _, _, gone) in plain_lines(before):
                text = dict(before)[i].split("\n")
                kept = [x for n, x in enumerate(text) if str(n) not in gone.split(",")]
                if any(x.strip() for x in kept):
                    want[i] = "\n".join(kept)
            assert after == want and len(want) < len(before)
        elif k == 2:
            assert after == {i: t for i, t in before if plain_groups(before)[i] == i}
        elif k == 3:
            assert sorted(after) == sorted(r[0] for r in plain_hits(before, items) if not r[5]) and len(after) < len(before)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = {i: (len(sp.encode(t)), zlib.crc32(np.array(sp.encode(t), "<u4").tobytes()), True) for i, t in before}
            assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
        now = got
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == got.count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_a_long_text(spark, tmp_path):
    docs, items = sample()
    docs = docs[:30] + [(95, "\n".join(f"kiz zek ikzi {k} zzk kek izz {k * 7} ezik" for k in range(8000)), "yy")]
    names = ["key", "copy", "h", "n", "p", "ws", "head", "size", "line_no", "lines_gone", "near_rank", "bad_id", "root", "block", "lang_pred", "lang_score", "whole_"]
    extra = [f"x{k}" for k in range(len(names))]
    spark.createDataFrame([(i, t, x, "s", len(t or ""), *extra) for i, t, x in docs], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bare = now.drop(*names)
    for name, stage in corpus_pipeline.STAGES:
        now, bare = (corpus_pipeline.staged(stage(spark, x, str(tmp_path)), name) for x in (now, bare))
        if name != "sentencepiece":
            assert now.columns[5:] == names
            assert all(tuple(r)[5:] == tuple(extra) for r in now.collect())
        assert sorted(map(tuple, now.select(*bare.columns).collect()), key=str) == sorted(map(tuple, bare.collect()), key=str)
    assert 95 in {r.doc_id for r in now.collect()}
