"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exceptions.

Folding: compatibility decomposition, marks and invisible characters dropped, lower case, look-alikes of other
scripts and digits or signs that stand for letters inside a word replaced by the letters meant, all else one space.
A text then is its words with one space around each, so a key " word " matches a whole word and a key " stem" matches
words that begin so. Of the keys that begin at a word the longest counts: a longer key of lower weight is an
exception to a stem. Exception phrases (" trash can ") hide the keys inside them.

The lexicon is SEEDS and the keys that the labelled texts teach. A key's weight is the logarithm of the share of toxic
texts that hold it over that of the others; it is taken where that differs from what the keys above it say by more
than chance would. A text's sum takes each of its distinct words once, its repeats by their logarithm. Two values, the
sum and the sum by length, and the length itself go through one logistic unit, fitted to sums that lexicons of the
other half of the sample give.

At most DOCS labelled texts of either label teach, those with the smallest hash of their id, whole; counting is
weighted back to the labels' shares. Scoring covers whole texts. Null texts count as empty. With no labels, or labels
of one kind, SEEDS and a fixed unit score alone. Of rows that repeat an id the least text's hash teaches.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, scratch, slices, staged, table

DOCS = 3000
#: A key needs so many texts of its label, and so many standard errors; the least weight of a key with none above it.
SUPPORT, ERRORS, LEAST = 4, 2.5, 1.2
#: Stems have so many characters.
STEMS = range(3, 13)
#: The score from which a text is predicted to be toxic.
TOXIC = 0.5
SEEDS = ("idiot", "moron", "imbecile", "scum", "scumbag", "loser", "pathetic", "worthless", "disgusting", "stupid", "dumbass", "jackass", "asshole", "bastard", "bitch", "dickhead", "trash", "clown", "vermin", "subhuman", "degenerate", "crybaby", "halfwit", "dimwit")
SEED_WEIGHT = 4.0
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "trash collection", "take out the trash", "clown fish", "circus clown", "class clown", "sore loser bracket", "stupid mistake of mine")
#: The unit that is used with nothing to learn from: weights of log(1 + sum), log(1 + sum for 1000 words), log(1 + words), and the rest.
UNIT = np.array([1.2, 0.8, 0.0, -5.5])

#: Letters of other scripts that look like Latin ones, and what digits and signs stand for.
LOOKALIKES = dict(zip("абвгдезіїјклмнорѕтухчшԁԛԝαβγεηικνορτυχωɑɡıℓ", ["a", "b", "b", "r", "d", "e", "3", "i", "i", "j", "k", "l", "m", "h", "o", "p", "s", "t", "y", "x", "4", "w", "d", "q", "w", "a", "b", "y", "e", "n", "i", "k", "v", "o", "p", "t", "u", "x", "w", "a", "g", "i", "l"], strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_SIGN = re.compile(r"(?<=[^\W_])[@$!|€](?=[^\W\d_])|(?<![^\W_])[@$€](?=[^\W\d_])")
_DIGITAL = re.compile(r"\S*[0-9]\S*")
_DIGITS = str.maketrans(DIGITS)


class _Folding(dict):
    """Code point to its folded text, found when it is first met."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).lower()):
            kind = unicodedata.category(c)
            out.append("" if kind in ("Mn", "Me", "Cf") else LOOKALIKES.get(c, c) if kind[0] == "L" else c if "0" <= c <= "9" else " ")
        self[code] = found = "".join(out)
        return found


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """The folded words of a text, one space before, between and after them; one space if it has none."""
    if not text:
        return " "
    if any(c in text for c in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    words = " ".join(text.translate(_FOLDING).split())
    if not words:
        return " "
    # Numbers stay numbers: only words that hold a letter too have digits for letters.
    return f" {_DIGITAL.sub(lambda m: m[0] if m[0].isdigit() else m[0].translate(_DIGITS), words)} "


def keys(folded: str) -> set[str]:
    """All keys that a text holds: of each word its stems and the word itself."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEMS if k <= len(w))
    return out


def lexicon(counts: dict[str, tuple[float, float]], toxic: float, clean: float) -> dict[str, float]:
    """Key to weight, from the number of toxic and of other texts that hold each key and of all of them."""

    def weighed(a: float, c: float) -> tuple[float, float]:
        return math.log((a + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)), math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))

    # The way in which most toxic texts go on from a stem: the stem has to say something without it too.
    longest: dict[str, tuple[float, float]] = {}
    for key, (a, c) in counts.items():
        longest[key[:-1]] = max(longest.get(key[:-1], (0, 0)), (a, c))
    kept: dict[str, float] = {}
    for key in sorted(counts, key=len):
        a, c = counts[key]
        if a + c < SUPPORT:
            continue
        w, error = weighed(a, c)
        above = next((kept[key[:k]] for k in range(len(key) - 1, 1, -1) if key[:k] in kept), None)
        if above is None:
            u, wide = weighed(*(max(0, x - y) for x, y in zip((a, c), longest.get(key, (0, 0)), strict=True)))
            if a >= SUPPORT and w - ERRORS * error >= LEAST and (key[-1] == " " or u - wide >= LEAST / 2):
                kept[key] = w
        elif w - ERRORS * error > above or w + ERRORS * error < above:
            kept[key] = max(w, 0.0)
    for word in SEEDS:
        key = f" {word} "
        a, c = counts.get(key, (0, 0))
        kept[key] = max(weighed(a, c)[0], 0.0) if a + c >= SUPPORT else SEED_WEIGHT
    return kept


class Scorer:
    """The automaton of a lexicon and its exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for key, w in weights.items():
            self.automaton.add_word(key, (len(key), w))
        for phrase in exceptions:
            key = fold(phrase)
            self.automaton.add_word(key, (len(key), None))
        self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the longest key at each word, without those inside an exception phrase."""
        found: dict[int, tuple[int, float]] = {}
        hidden: list[tuple[int, int]] = []
        for last, (size, w) in self.automaton.iter(folded):
            start, end = last + 1 - size, last + 1
            if w is None:
                hidden.append((start, end))
            elif start not in found or end > found[start][0]:
                found[start] = end, w
        # Phrases that begin no later, by how far they reach, hide all that ends before.
        hidden.sort()
        out, reach, k = [], -1, 0
        for start in sorted(found):
            while k < len(hidden) and hidden[k][0] <= start:
                reach, k = max(reach, hidden[k][1]), k + 1
            end, w = found[start]
            if end > reach and w > 0:
                out.append((start, end, w))
        return out

    def sums(self, text: str | None) -> tuple[float, int]:
        """A text's weighted sum and its number of words."""
        folded = fold(text)
        words: Counter[str] = Counter()
        weights: dict[str, float] = {}
        for start, _, w in self.matches(folded):
            word = folded[start + 1 : folded.index(" ", start + 1)]
            words[word] += 1
            weights[word] = w
        return sum(weights[x] * (1 + math.log(n)) for x, n in words.items()), folded.count(" ") - 1


def inputs(sums: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(sums), np.log1p(1000 * sums / (words + 50)), np.log1p(np.maximum(words, 0)), np.ones(len(sums))], 1)


def unit(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A logistic unit by Newton's steps on the weighted log loss, held by a small ridge."""
    w, ridge = UNIT.copy(), np.diag([1e-2, 1e-2, 1e-1, 1e-4]) * weights.sum() / max(1, len(y)) * 10
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, x.T @ (weights * (y - p)) - ridge @ (w - UNIT))
        w = w + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, weights: dict[str, float], logistic: np.ndarray):
        self.weights, self.logistic = weights, logistic

    def scorer(self) -> Scorer:
        return Scorer(self.weights)

    def probabilities(self, sums: list[tuple[float, int]]) -> list[float]:
        x = inputs(*np.array(sums, float).reshape(-1, 2).T)
        # Summed input by input, so that no text's rounding depends on how many are scored together.
        z = x[:, 0] * self.logistic[0] + x[:, 1] * self.logistic[1] + x[:, 2] * self.logistic[2] + self.logistic[3]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, half, key, n) of batches of (y, half, text): how many texts of a slice hold each key."""
    for b in slices(batches, 256, "text", 1 << 20):
        found: dict[tuple[int, int], Counter[str]] = {}
        for y, half, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault((y, half), Counter()).update(keys(fold(text)))
        for (y, half), c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(c), pa.int32()), pa.array([half] * len(c), pa.int32()), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["y", "half", "key", "n"])


def sample(documents: DataFrame, labels: DataFrame, docs: int = DOCS) -> tuple[DataFrame | None, dict[int, int]]:
    """(y, half, text) of at most docs labelled texts of either label, and how many rows have each label."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").distinct()
    many = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(many) < 2:
        return None, many
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))
    share = F.when(F.col("y") == 1, F.lit(2.0 * docs / many[1])).otherwise(F.lit(2.0 * docs / many[0]))
    part = rows.withColumn("h", h).filter(F.col("h") <= share * (1 << 40))
    part = part.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))).filter(F.col("k") <= docs)
    # At most 2 * docs rows: a side of constant size, and one text of each.
    met = documents.select("doc_id", "text").join(F.broadcast(part.select("doc_id", "y", "h")), "doc_id")
    met = met.groupBy("h", "doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return met.select("y", (F.col("h") % 2).cast("int").alias("half"), "text"), many


def learn(documents: DataFrame, labels: DataFrame, docs: int = DOCS) -> Model:
    """A model from labels (doc_id, toxic) of documents (doc_id, text); null ids, labels and other labels teach nothing."""
    seeds = Model(lexicon({}, 1, 1), UNIT)
    found, many = sample(documents, labels, docs)
    if found is None:
        return seeds
    found = staged(found, "op12-sample")
    sizes = {(r.y, r.half): r["count"] for r in found.groupBy("y", "half").count().collect()}
    if not all(sizes.get((y, half)) for y in (0, 1) for half in (0, 1)):
        return seeds
    n = lambda y, half: F.sum(F.when((F.col("y") == y) & (F.col("half") == half), F.col("n")).otherwise(0))
    counted = found.mapInArrow(_counted, "y int, half int, key string, n long").groupBy("key").agg(*[n(y, half).alias(f"n{y}{half}") for y in (0, 1) for half in (0, 1)])
    # Keys of enough texts of a bounded sample: stems met in enough toxic texts, and words met in enough of either.
    enough = (F.col("n10") + F.col("n11") >= SUPPORT) | (F.col("key").endswith(" ") & (F.col("n00") + F.col("n01") >= SUPPORT))
    rows = [tuple(r) for r in counted.filter(enough).collect()]

    def built(halves: tuple[int, ...]) -> dict[str, float]:
        counts = {r[0]: (sum(r[3 + h] for h in halves), sum(r[1 + h] for h in halves)) for r in rows}
        return lexicon(counts, sum(sizes[1, h] for h in halves), sum(sizes[0, h] for h in halves))

    other = [built((1,)), built((0,))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(w) for w in other]
        for b in slices(batches, 256, "text"):
            out = [(y, *scorers[half].sums(text)) for y, half, text in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["y", "total", "words"])

    # Three numbers for each text of the sample, in an order that no schedule changes.
    sums = np.array(sorted(map(tuple, found.mapInArrow(summed, "y int, total double, words long").collect())), float)
    y = sums[:, 0]
    weights = np.where(y == 1, many[1] / (y == 1).sum(), many[0] / (y == 0).sum())
    return Model(built((0, 1)), unit(inputs(sums[:, 1], sums[:, 2]), y, weights / weights.mean()))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with a column toxicity added (an existing one is replaced)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in slices(batches, 256, "text"):
            sums = [scorer.sums(x) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.probabilities(sums), pa.float64())], names=[*b.schema.names, "toxicity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, toxicity double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    with scratch(spark, "op12"):
        model = learn(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held))
    found = score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= TOXIC, 1).otherwise(0).alias("predicted"))
