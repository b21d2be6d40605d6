import random
import zlib

import numpy as np
import pytest

from lodestone.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "hello  world", "  lead", "trail  ", "a\nb", "a \nb\n c", "\n\nx", "\rx\r\ny", "tab\tx", "ﬁ x² é 你好😀 ▁x ▁▁y", "<s> x </s> <unk> <0x41>", "", " ", "   ", "the " * 3000,
    "Zürich straße façade", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "1234567890.5e-7", "$$$%%%###", "à​﻿b", "\x00\x01",
]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_paths_equal_the_library():
    rnd = random.Random(11)
    sp, m = library(), pieces.machine(PATH)
    syllables = ["th", "er", "ing", "é", "ou", "ß", "q", "tion", "A", ",", ".", " ", " ", "▁", "\n", "你", "7"]
    texts = TEXTS + ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 60))) for _ in range(800)]
    got = [np.frombuffer(x, m.kind).tolist() for x in m.encode(texts)]
    for t, g in zip(texts, got, strict=True):
        assert g == sp.encode(t), t
        assert m.decode(g) == t.replace("▁", " ")


def test_memory_of_segments_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "_MEMO", 5)
    m = pieces.Machine(open(PATH, "rb").read())
    for _ in range(3):
        assert [np.frombuffer(x, m.kind).tolist() for x in m.encode(TEXTS)] == library().encode(TEXTS)


def test_query_and_columns(spark, tmp_path):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, None, "n"), (0, TEXTS[0], None)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = pieces.op7_pieces(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    want = {i: library().encode(t) for i, t in enumerate(TEXTS)} | {None: []}
    for r in got:
        assert (r.n_pieces, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()))
    both = pieces.decode(pieces.encode(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH), PATH)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(r.decoded == (r.text or "").replace("▁", " ") and r.ids == want[r.doc_id] for r in both.collect())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pieces.op7_pieces(spark, str(tmp_path)).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Machine(b"")
