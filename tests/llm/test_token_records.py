import zlib

import numpy as np
import pytest

from lodestone.llm import token_records as tr

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "plain words, and more. Words\nnext line", "A,b, c.. d., \"e,\" 3, é, ², 你. x\u0301, a\u0300.\n.b,\n,", "a  b   c", "a \nb\n c \n\n d", " lead", "trail ", "", "tab\tx y", "é ü ñ 你好 😀 x", "it's we'll 12 345 $$$ <|endoftext|> z",
    "nb sp a b", "x y z", "a \u0085b c", "one", " ", "\n", "w " * 3000, "  a", "a\x1cb c", "…. ​ x", "﻿x y",
]


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library_on_whole_texts():
    got = [np.frombuffer(x, "<u2").tolist() for x in tr.Encoder(PATH)(TEXTS)]
    assert got == whole(TEXTS)


def test_frames():
    data = tr.frame(7, b"\x01\x00\x02\x00", 2) + tr.frame(-1, b"", 2)
    doc, ids, at = tr.unframe(data)
    assert (doc, ids.tolist()) == (7, [1, 2])
    assert tr.unframe(data, at - 1 + 0)[0] == -1
    with pytest.raises(ValueError):
        tr.unframe(data.replace(b"\x02", b"\x03"))


def test_query(spark, tmp_path):
    rows = [(100 - i, t, i) for i, t in enumerate(TEXTS)] + [(None, None, 0), (5, "twice", 0), (5, "twice", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tr.op9_token_records(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    ids = whole([r[1] or "" for r in want])
    start = 0
    for g, w, x in zip(got, want, ids, strict=True):
        x = [*x, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (w[0], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)


def test_shuffled_reads(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    tr.write(docs, PATH, f"{tmp_path}/t")
    found = tr.write_index(spark, f"{tmp_path}/t")
    got = {r.doc_id: r.ids for r in tr.read(spark, f"{tmp_path}/t", found.filter("doc_id in (3, 17)")).collect()}
    want = whole(["text number 3", "text number 17"])
    assert got == {3: [*want[0], 0], 17: [*want[1], 0]}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tr.op9_token_records(spark, str(tmp_path)).count() == 0


def test_shards_grow_with_the_text_and_split_a_repeated_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tr, "SHARD", 1000)
    monkeypatch.setattr(tr, "RECORDS", 7)
    docs = spark.createDataFrame([(5, f"text number {i} " * 20) for i in range(60)] + [(4, "x " * 9000), (6, None)], "doc_id long, text string")
    tr.write(docs, PATH, f"{tmp_path}/t")
    found = tr.starts(tr.write_index(spark, f"{tmp_path}/t")).collect()
    assert len({r.shard for r in found}) > 10 and [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [4, *[5] * 60, 6]
    monkeypatch.setattr(tr, "BROADCAST_ROWS", 0)
    index = spark.read.parquet(f"{tmp_path}/t.index")
    got = tr.read(spark, f"{tmp_path}/t", index.filter("doc_id = 6")).collect()
    assert [(r.doc_id, r.ids) for r in got] == [(6, [0])]
