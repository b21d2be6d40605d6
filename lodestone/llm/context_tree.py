"""Language-model scoring by context-tree weighting over bytes, with a smoothed word model beside it.

Each byte is eight binary decisions; each decision node has a context tree over the bytes before it, DEPTH of
them at most. Every tree node holds a Krichevsky-Trofimov estimate of its decision, and the weighting mixes
the estimates of all depths: a node weighs its own estimate by one half against its children's product, over
the whole training text. A text's score is the log10 probability of its bytes (A-Z in lower case, then an end
mark) under the mixture learned from the training documents; the code length per byte follows from it.

Nothing that grows with the corpus is broadcast or collected. Documents are dealt to blocks of about BLOCK
bytes; a block asks for the counts of its words and of its (DEPTH + 1)-grams of bytes and adds its training
part to them, the counts are summed over all blocks, the trees are solved below each pair of last bytes, and
the answers go back to the blocks that asked, where texts are scored. Solving collects one row of 765 numbers
for each of at most 256 last bytes: what depths 0 and 1 need. A block's answers come before its documents in one
sorted stream, so a task holds one block's answers and PIECE bytes of text, however long a text or large a block.

Null and empty texts have the end token and the end mark alone. Rows are independent once the model is learned;
repeated rows count as often as they occur. With nothing to train on, every decision has probability one half.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, slices, staged, table, tidy, unstage

DEPTH = 5
BLOCK = 12 << 20
#: So many bytes of text are coded at a time.
PIECE = 1 << 20
#: So many codes of new text are kept before they are merged with the block's others.
MERGE = 1 << 20
#: So many codes are solved at a time, or all of one pair of last bytes.
CODES = 150_000
ALPHA = 0.1
#: Ends a text and fills the context before it; no UTF-8 text has this byte.
END = 0xFF
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LN10 = np.log(10.0)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series after eight steps up."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


#: The decision node and the branch taken of each byte at each level.
_BYTES = np.arange(256)
PATH = np.stack([(1 << level) - 1 + (_BYTES >> (8 - level)) for level in range(8)], 1)
TAKEN = np.stack([(_BYTES >> (7 - level)) & 1 for level in range(8)], 1)


class Trees:
    """The context trees below some pairs of last bytes: nodes at depths 2 to depth.

    A code holds the context bytes, farthest first, then the next byte; all codes of a pair must be there.
    Only decisions that some code reaches have nodes, numbered within their depth.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        self.codes, self.depth = codes, depth
        path, taken = PATH[codes & 255], TAKEN[codes & 255]
        contexts = codes >> 8
        flat = np.repeat(counts, 8)
        self.at, self.n, self.stay, self.weighted = {}, {}, {}, {}
        for d in range(depth, 1, -1):
            _, near = np.unique(contexts & ((1 << (8 * d)) - 1), return_inverse=True)
            _, first, at = np.unique((near[:, None] * 256 + path).ravel(), return_index=True, return_inverse=True)
            n = np.stack([np.bincount(at, np.where(taken.ravel() == bit, flat, 0), len(first)) for bit in (0, 1)], 1)
            own = kt(n[:, 0], n[:, 1])
            if d == depth:
                weighted, stay = own, np.ones_like(own)
            else:
                weighted = np.logaddexp(own, np.bincount(at[below_first], below, len(first))) - np.log(2)
                stay = np.exp(np.minimum(0, own - np.log(2) - weighted))
            self.at[d], self.n[d], self.stay[d] = at.reshape(-1, 8), n, stay
            below_first, below = first, weighted
        pairs, which = np.unique(contexts & 0xFFFF, return_inverse=True)
        self.pairs = pairs
        self.decisions, self.below = np.zeros((len(pairs), 255, 2)), np.zeros((len(pairs), 255))
        where = which[below_first // 8], path.ravel()[below_first]
        self.decisions[where], self.below[where] = n, weighted

    def log10(self, shallow: Shallow) -> np.ndarray:
        """log10 probability of each code's next byte given its context."""
        byte, last = self.codes & 255, (self.codes >> 8) & 255
        path, taken = PATH[byte], TAKEN[byte]
        p = None
        for d in range(self.depth, 1, -1):
            at, n = self.at[d], self.n[d]
            own = (n[at, taken] + 0.5) / (n[at, 0] + n[at, 1] + 1)
            p = own if p is None else self.stay[d][at] * own + (1 - self.stay[d][at]) * p
        for n, stay, at in ((shallow.n1, shallow.stay1, (last[:, None], path)), (shallow.n0, shallow.stay0, (0, path))):
            own = (n[(*at, taken)] + 0.5) / (n[(*at, 0)] + n[(*at, 1)] + 1)
            p = stay[at] * own + (1 - stay[at]) * p
        return np.log10(p).sum(1)


class Shallow:
    """The nodes at depths 0 and 1, from the sums of decisions and of weighted logarithms below each last byte."""

    def __init__(self, last: np.ndarray, decisions: np.ndarray, below: np.ndarray):
        self.n1, under = np.zeros((256, 255, 2)), np.zeros((256, 255))
        self.n1[last], under[last] = decisions, below
        own = kt(self.n1[..., 0], self.n1[..., 1])
        weighted = np.logaddexp(own, under) - np.log(2)
        self.stay1 = np.exp(np.minimum(0, own - np.log(2) - weighted))
        self.n0 = self.n1.sum(0, keepdims=True)
        own, under = kt(self.n0[..., 0], self.n0[..., 1]), weighted.sum(0, keepdims=True)
        self.stay0 = np.exp(np.minimum(0, own - np.logaddexp(own, under)))


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The code of each byte of texts that end in END: the depth bytes before it above it, END before a text's start.

    Data that is cut off before its last END is coded as far as it goes.
    """
    code, have = data.astype(np.int64), 1
    while have <= depth:
        step = min(have, depth + 1 - have)
        low = code if step == have else code & ((1 << (8 * step)) - 1)
        longer = code.copy()
        longer[have:] |= low[:-have] << (8 * have)
        code, have = longer, have + step
    starts = np.concatenate([[0], np.flatnonzero(data[:-1] == END) + 1])
    lengths = np.diff(np.concatenate([starts, [len(data)]]))
    for k in range(depth):
        # All bits set is END: what lies before a text's start is wiped out.
        code[starts[lengths > k] + k] |= ((1 << (8 * depth)) - (1 << (8 * k))) << 8
    return code


class Lookup:
    """Values of 64-bit keys in an open-addressed table; every key asked for must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            slot, left = (slot[~placed] + 1) & self.mask, left[~placed]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        slot = self._slot(asked)
        left = np.flatnonzero(self.keys.take(slot) != asked)
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            left = left[self.keys.take(slot[left]) != asked[left]]
        return self.values.take(slot)


def pieces(texts: list[bytes], depth: int) -> Iterator[np.ndarray]:
    """The codes of texts, each followed by END, PIECE bytes at a time."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    for at in range(0, len(data), PIECE):
        low = max(0, at - depth)
        yield grams(data[low : at + PIECE], depth)[at - low :]


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of some PIECE bytes at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            m = _SPACE.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end].split()
        at = end


def _text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_FOLD)


def _requests(depth: int):
    """A block's documents -> (block, kind, word, code, count): what it asks for and what its training part counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, codes, fresh = None, {}, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if words:
                n = len(words)
                yield _batch(block, 0, pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(words.values()), pa.int64()))
            if codes:
                unique, count = _merged(codes)
                yield _batch(block, 1, pa.nulls(len(unique), pa.binary()), pa.array(unique), pa.array(count))

        for part in slices(batches, 512, "text", PIECE):
            own, held = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = [_text_bytes(x) for x in part.column(2).to_pylist()]
            for s, e in _runs(own):
                if own[s] != block:
                    yield from out()
                    block, words, codes, fresh = own[s], {}, [], 0
                for x, h in zip(texts[s:e], held[s:e], strict=True):
                    for ws in _words(x):
                        for w in ws:
                            words[w] = words.get(w, 0) + (not h)
                for keep in (0, 1):
                    some = [x for x, h in zip(texts[s:e], held[s:e], strict=True) if h == keep]
                    for got in pieces(some, depth) if some else ():
                        unique, n = np.unique(got, return_counts=True)
                        codes.append((unique, n * (1 - keep)))
                        fresh += len(unique)
                        if fresh >= MERGE:
                            codes, fresh = [_merged(codes)], 0
        yield from out()

    return run


def _merged(codes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of sorted runs and the sums of their counts."""
    every, n = (np.concatenate([x[k] for x in codes]) for k in (0, 1))
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[starts], np.add.reduceat(n, starts)


def _runs(values: list) -> list[tuple[int, int]]:
    edges = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
    return list(zip(edges[:-1], edges[1:], strict=True)) if values else []


def _batch(block, kind: int, word: pa.Array, code: pa.Array, count: pa.Array) -> pa.RecordBatch:
    n = len(count)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int64)), pa.array(np.full(n, kind, np.int32)), word, code, count], names=["block", "kind", "word", "code", "n"])


def _whole_pairs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[Trees]:
    """Trees of rows (pair, code, n) sorted by pair, as many whole pairs at a time as make some CODES codes."""
    kept: list[tuple[np.ndarray, ...]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate([k[i] for k in kept]) for i in range(3)]

    for b in batches:
        kept.append(tuple(b.column(i).to_numpy() for i in range(3)))
        if sum(len(k[0]) for k in kept) >= CODES:
            pair, code, n = joined()
            edge = np.searchsorted(pair, pair[-1])
            if edge:
                yield Trees(code[:edge], n[:edge].astype(float), depth)
            kept = [(pair[edge:], code[edge:], n[edge:])]
    if kept:
        _, code, n = joined()
        yield Trees(code, n.astype(float), depth)


def _solve_parts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pairs(batches, depth):
            last, of = np.unique(t.pairs & 255, return_inverse=True)
            sums = [np.zeros((len(last), x[0].size)) for x in (t.decisions, t.below)]
            for s, x in zip(sums, (t.decisions, t.below), strict=True):
                np.add.at(s, of, x.reshape(len(x), -1))
            yield pa.RecordBatch.from_arrays([pa.array(last), *(pa.array(s.tolist(), pa.list_(pa.float64())) for s in sums)], names=["last", "decisions", "below"])

    return run


def _solve_codes(depth: int, shallow: Shallow):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pairs(batches, depth):
            yield pa.RecordBatch.from_arrays([pa.array(t.codes), pa.array(t.log10(shallow))], names=["code", "logp"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """The sums of rows of one last byte."""
    sums = {c: np.sum(np.array(rows[c].to_pylist()), 0) for c in ("decisions", "below")}
    return pa.table({"last": rows["last"][:1]} | {c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in sums.items()})


class _Answers:
    """What one block asked for: words' counts and codes' values, added batch by batch, then read."""

    def __init__(self):
        self.words, self.counts, self.codes, self.values = [], [], [], []

    def add(self, kind: int, b: pa.RecordBatch) -> None:
        a = b.column(b.schema.get_field_index("a")).to_numpy()
        if kind == 0:
            self.words += b.column(b.schema.get_field_index("word")).to_pylist()
            self.counts.append(a)
        else:
            self.codes.append(a)
            self.values.append(b.column(b.schema.get_field_index("logp")).to_numpy())

    def close(self) -> None:
        none = [np.zeros(0, np.int64)]
        self.number = dict(zip(self.words, range(len(self.words)), strict=True))
        self.count = np.concatenate(self.counts or none)
        self.base = np.log10(self.count + ALPHA)
        self.value = Lookup(np.concatenate(self.codes or none), np.concatenate(self.values or none))
        self.words = self.counts = self.codes = self.values = None

    def score(self, b: pa.RecordBatch, depth: int) -> pa.RecordBatch:
        texts = [_text_bytes(x) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
        sizes, known, base = ([] for _ in range(3))
        for x in texts:
            n, k, total = 0, 0, 0.0
            for ws in _words(x):
                ids = np.fromiter((self.number[w] for w in ws), np.int64, len(ws))
                n, k, total = n + len(ws), k + np.count_nonzero(self.count[ids]), total + self.base[ids].sum()
            sizes.append(n), known.append(k), base.append(total)
        lengths = np.array([len(x) for x in texts])
        if len(texts) == 1:
            scores = [sum(self.value(g).sum() for g in pieces(texts, depth))]
        else:
            scores = np.add.reduceat(np.concatenate([self.value(g) for g in pieces(texts, depth)]), np.cumsum(lengths + 1) - lengths - 1)
        columns = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "held")]
        columns += [pa.array(np.array(sizes) + 1, pa.int64()), *(pa.array(x, t) for x, t in ((known, pa.int64()), (base, pa.float64()), (scores, pa.float64()), (lengths, pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, schema=_ROWS)


def _score(depth: int):
    """Rows sorted by block and kind, a block's answers (kinds 0 and 1) before its documents (kind 2) -> rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers, closed = None, _Answers(), False
        for b in batches:
            own, kinds = (b.column(k).to_numpy() for k in (0, 1))
            for s, e in _runs((own * 4 + kinds).tolist()):
                part = b.slice(s, e - s)
                if own[s] != block:
                    block, answers, closed = own[s], _Answers(), False
                if kinds[s] < 2:
                    answers.add(kinds[s], part)
                    continue
                if not closed:
                    answers.close()
                    closed = True
                for some in slices([part], 512, "text", PIECE):
                    yield answers.score(some, depth)

    return run


_PARTS = "last long, decisions array<double>, below array<double>"
_ROWS = pa.schema([("doc_id", pa.int64()), ("held", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def score(documents: DataFrame, held: Column, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:  # depth: 2 to 7
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of each row.

    held: a condition on the documents; its rows aren't learned from.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.cast("int").alias("held"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count_if(F.col("held") == 0)).first()
    n_blocks = max(1, -(-size[0] // block), -(-size[1] // 20_000))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"), "held", "text", "doc_id")
    asked = dealt.repartition("block").sortWithinPartitions("block").select("block", "held", "text").mapInArrow(_requests(depth), "block long, kind int, word binary, code long, n long")
    asked = staged(asked, "lm-requests")

    words = staged(asked.filter("kind = 0").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    total = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    train, distinct = total[0] + size[2], total[1] + (size[2] > 0)
    codes = staged(asked.filter("kind = 1").groupBy("code").agg(F.sum("n").alias("n")), "lm-codes")
    pairs = codes.select(F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF)).alias("pair"), "code", "n").repartition("pair").sortWithinPartitions("pair")
    parts = pairs.mapInArrow(_solve_parts(depth), _PARTS).groupBy("last").applyInArrow(_added, _PARTS).collect()  # a row for each of at most 256 last bytes
    shallow = Shallow(np.array([r["last"] for r in parts], int), np.array([r.decisions for r in parts]).reshape(-1, 255, 2), np.array([r.below for r in parts]).reshape(-1, 255))
    solved = staged(pairs.mapInArrow(_solve_codes(depth, shallow), "code long, logp double"), "lm-solved")

    blank = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held", "int"), ("text", "string"))]
    known = asked.filter("kind = 0").select("block", "word").join(words, "word").select("block", F.lit(0).alias("kind"), "word", F.col("c").alias("a"), F.lit(None).cast("double").alias("logp"))
    valued = asked.filter("kind = 1").select("block", "code").join(solved, "code").select("block", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("word"), F.col("code").alias("a"), "logp")
    answers = staged(known.unionByName(valued), "lm-answers")
    unstage(asked, words, codes, solved)
    stream = dealt.select("block", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("double").alias("logp"), "doc_id", "held", "text")
    stream = answers.select("*", *blank).unionByName(stream).repartition("block").sortWithinPartitions("block", "kind")
    rows = stream.mapInArrow(_score(depth), "doc_id long, held int, n_tokens long, n_known long, base double, score double, n_bytes long")
    # The end token's count is the number of training documents.
    end = float(np.log10(size[2] + ALPHA))
    norm = float(np.log10(train + ALPHA * (distinct + 1)))
    return rows.select(
        "doc_id", (F.col("held") == 1).alias("held_out"), "n_tokens", (F.col("n_known") + int(size[2] > 0)).alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + end - F.col("n_tokens") * norm).alias("base_score"), "score", "n_bytes", (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


@tidy
def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the word model and the context trees."""
    found = score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
