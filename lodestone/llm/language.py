"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is cut, from
left to right, into the longest phrases that occur in the sample; each phrase costs log2 of the sample's
length, and the language with the lowest cost wins (the smallest label on ties). Text is lower-cased, each
run of characters that aren't letters becomes one space, and automata read its UTF-8 bytes, so the letters of
all scripts are told apart.

The whole text is parsed, in pieces of PIECE bytes in lockstep over transition tables, for all languages at
once. Each piece is parsed from its own start; then the parse of the piece before goes on into it until both
begin a phrase at the same place, from where they agree, and the difference is settled. Where they don't meet
within the piece the text is parsed again in one go, so phrases don't depend on pieces or batches.

The sample: of at most DOCS documents per language, those with the smallest hash of their id, whatever their
length, a passage of at most CHARS characters at a place that the hash draws. Everything else covers all rows.
Null texts and texts without a letter are `und` with score 0; so is every text if there is nothing to learn
from. Rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import crc_mod, slices, table

DOCS, CHARS = 40, 750
PIECE = 512
UNKNOWN = "und"


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=1)
def _not_letters() -> tuple[re.Pattern, re.Pattern]:
    """Runs of what isn't a letter: also numbers that aren't decimal digits, as superscripts and fractions; those beyond the first plane apart."""
    points = [c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
    return re.compile(r"[\W\d_" + "".join(c for c in points if c <= "￿") + "]+"), re.compile("[ " + "".join(c for c in points if c > "￿") + "]+")


def letters_of(text: str | None) -> str:
    first, beyond = _not_letters()
    found = first.sub(" ", (text or "").lower())
    return found if found.isascii() or not _ASTRAL.search(found) else beyond.sub(" ", found)


def automaton(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the suffix automaton of a sequence; -1 where there is none. State 0 is the root."""
    nexts, link, length = [dict()], [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table_ = np.full((len(nexts), n_symbols), -1, np.int32)
    for s, row in enumerate(nexts):
        if row:
            table_[s, list(row)] = list(row.values())
    return table_


class Model:
    """Automata of all languages in one table.

    An entry is the offset of the next state's row; where the phrase ends, the complement of the row that
    the symbol leads to from the root.
    """

    def __init__(self, samples: dict[str, str]):
        self.labels = sorted(samples)
        data = {k: x.encode("utf-8", "replace") for k, x in samples.items()}
        #: Class 0 is the space, 1 any byte that no sample has.
        self.classes = np.ones(256, np.uint8)
        self.classes[ord(" ")] = 0
        known = sorted(set(b"".join(data.values())) - {ord(" ")})
        self.classes[known] = np.arange(2, len(known) + 2)
        self.width = len(known) + 2
        tables, self.starts, at = [], [], 0
        for label in self.labels:
            t = automaton(self.encode(data[label]), self.width)
            # One more state, in which a text starts and an unknown symbol leaves it: every symbol starts a phrase.
            out = len(t)
            t = np.vstack([t, np.full((1, self.width), -1, np.int32)])
            begun = ~((np.where(t[0] >= 0, t[0], out) + at) * self.width)
            tables.append(np.where(t >= 0, (t + at) * self.width, begun[None, :]).astype(np.int32))
            self.starts.append((out + at) * self.width)
            at += len(t)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.cost = np.array([np.log2(max(2, len(data[x]))) for x in self.labels])

    def encode(self, data: bytes) -> np.ndarray:
        return self.classes[np.frombuffer(data, np.uint8)]

    def phrases(self, texts: list[bytes], piece: int = PIECE) -> np.ndarray:
        """The number of phrases of each text in each language."""
        n_lang, lengths = len(self.labels), np.array([len(x) for x in texts])
        symbols = self.encode(b"".join(texts))
        pieces = -(-lengths // piece)
        of = np.repeat(np.arange(len(texts)), pieces)
        n = len(of)
        if not n:
            return np.zeros((len(texts), n_lang))
        first = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(np.cumsum(lengths) - lengths, pieces) + first * piece
        sizes = np.minimum(piece, np.repeat(lengths, pieces) - first * piece)
        order = np.argsort(-sizes, kind="stable")
        begin, long = starts[order], sizes[order]
        state = np.repeat(np.array(self.starts, np.int32)[:, None], n, 1)
        count = np.zeros((n_lang, n), np.int32)
        #: Where a phrase begins, by language.
        marks = np.zeros((n_lang, len(symbols)), bool)
        active = np.searchsorted(-long, -np.arange(long[0]), side="left")
        for t, a in enumerate(active.tolist()):
            at = begin[:a] + t
            step = self.table.take(state[:, :a] + symbols.take(at)[None, :])
            ended = step >> 31
            marks[:, at] = ended
            count[:, :a] -= ended
            state[:, :a] = step ^ ended
        total = np.stack([np.bincount(of[order], weights=c, minlength=len(texts)) for c in count], 1)
        # The parse of each piece goes on into the next piece of its text.
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        on = np.flatnonzero(first[1:] > 0) if n > 1 else np.zeros(0, np.int64)
        lang, left = np.repeat(np.arange(n_lang), len(on)), np.tile(on, n_lang)
        now = state[lang, back[left]]
        for t in range(piece):
            # Where the text's last piece ends, its phrases are counted.
            inside = t < sizes[left + 1]
            lang, left, now = lang[inside], left[inside], now[inside]
            if not len(left):
                break
            at = starts[left + 1] + t
            step = self.table.take(now + symbols.take(at))
            ended = step >> 31
            there = marks[lang, at]
            np.add.at(total, (of[left], lang), -ended - there)
            going = ~((ended < 0) & there)
            lang, left, now = lang[going], left[going], (step ^ ended)[going]
        redo = np.unique(of[left])
        if len(redo):
            total[redo] = self.phrases([texts[i] for i in redo], int(lengths[redo].max()))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        clean = [letters_of(x) for x in texts]
        known = np.array([bool(x.strip()) for x in clean], bool) if self.labels else np.zeros(len(texts), bool)
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known.any():
            rows = np.flatnonzero(known)
            bits = self.phrases([clean[i].encode("utf-8", "replace") for i in rows]) * self.cost
            best = bits.argmin(1)
            scores[rows] = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
            for i, k in zip(rows, best, strict=True):
                labels[i] = self.labels[k]
        return labels, scores


def learn(labelled: DataFrame, docs: int = DOCS, chars: int = CHARS) -> Model:
    """A model of the languages of labelled (doc_id, text, lang); rows without a language or letters teach nothing."""
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))
    rows = labelled.filter("lang is not null and text is not null").select("lang", "doc_id", F.xxhash64("text").alias("t"), h.alias("h"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t")))
    # At most docs rows a language: a side of bounded size, joined to one text of each.
    part = ranked.filter(F.col("k") <= docs).select("lang", "k", "h", F.col("doc_id").alias("doc_"), "t").withColumnRenamed("lang", "lang_")
    same = F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.xxhash64("text") == F.col("t")) & (F.col("lang") == F.col("lang_"))
    start = F.pmod(F.xxhash64("h", "t"), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    passage = F.substring("text", start.cast("int") + 1, F.lit(chars))
    found = labelled.select("doc_id", "lang", "text").join(F.broadcast(part), same).groupBy("lang_", "k").agg(F.min(passage).alias("text")).orderBy("lang_", "k")
    sample: dict[str, list[str]] = {}
    for r in found.collect():
        sample.setdefault(r["lang_"], []).append(letters_of(r["text"]).strip())
    return Model({k: text for k, v in sample.items() if (text := " ".join(x for x in v if x))})


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with columns lang_pred and lang_score added (existing ones of these names are replaced)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.drop("lang_pred", "lang_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024, "text"):
            labels, scores = shared.value.predict(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])

    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(fields))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = learn(docs.filter(~held).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
