"""Fill-in-the-middle: texts cut at two code points and put together in another order, by rank and select over bytes.

The bytes of a batch of texts have one bit each, set where a code point begins, packed into 64-bit words. A directory
holds the number of set bits before each block of BLOCK words. rank(i) counts the set bits before bit i from the
directory and the popcounts of the words of i's block; select(r) finds the place of the set bit of rank r by a search
of the directory, then of the block's words, then of the word's bits. The difference of the ranks of a text's ends is
its number of code points, and select on the ranks of the two cuts gives the bytes at which it is cut; no text is
decoded.

Where a text is cut and how it is put together depends on its doc_id alone (and its length), so repeated rows give
repeated results and a lost task gives the same result again. Null texts count as empty; a null doc_id is hashed as
the empty text. Very long texts are alone in their slice. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import slices, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts so many are left plain, and of 100 of the others so many have the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20
SEED = 1
#: Words of 64 bits in a block of the directory.
BLOCK = 8


class Boundaries:
    """The places in UTF-8 bytes at which code points begin, as a bitvector with rank and select."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        blocks = max(1, -(-len(bits) // (8 * BLOCK)))
        self.words = np.zeros(blocks * BLOCK, "<u8")
        self.words.view(np.uint8)[: len(bits)] = bits
        self.ones = np.bitwise_count(self.words).astype(np.int64).reshape(blocks, BLOCK)
        self.directory = np.concatenate([[0], np.cumsum(self.ones.sum(1))])
        self.size = len(data)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many code points begin before each of the places."""
        word, bit = np.divmod(places, 64)
        block, at = np.divmod(word, BLOCK)
        # The end of the last block is the directory's last entry.
        inside = np.minimum(block, len(self.ones) - 1)
        before = np.where(np.arange(BLOCK) < at[:, None], self.ones[inside], 0).sum(1)
        last = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.directory[block] + np.where(block < len(self.ones), before + np.bitwise_count(last), 0)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Where the code point of each rank begins; the number of bytes for a rank beyond the last."""
        found = np.full(len(ranks), self.size, np.int64)
        on = np.flatnonzero(ranks < self.directory[-1])
        block = np.searchsorted(self.directory, ranks[on], "right") - 1
        left = ranks[on] - self.directory[block]
        upto = np.cumsum(self.ones[block], 1)
        word = (upto <= left[:, None]).sum(1)
        left -= np.take_along_axis(upto - self.ones[block], word[:, None], 1)[:, 0]
        bits = np.unpackbits(self.words[block * BLOCK + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, 1, dtype=np.int64) <= left[:, None]).sum(1)
        found[on] = (block * BLOCK + word) * 64 + bit
        return found


def draws(key: str | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the seed and the document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == PLAIN:
        return prefix + middle + suffix
    if form == PSM:
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(output: bytes, form: str) -> bytes:
    """The text that joined() was given. Texts with a sentinel stay plain, and no sentinel overlaps itself, so the first one found is the one put in."""
    if form == PLAIN:
        return output
    head, middle = output[len(PREFIX) :].split(MIDDLE, 1)
    first, second = head.split(SUFFIX if form == PSM else PREFIX, 1)
    return first + middle + second if form == PSM else second + middle + first


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each begins and ends in them; null texts take no bytes."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _cut(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text="text", size=1 << 20):
        data, ends = _buffer(b.column(1).fill_null(""))
        at, raw = Boundaries(data), data.tobytes()
        ranks = at.rank(ends)
        n = np.diff(ranks)
        drawn = np.array([draws(k, seed) for k in b.column(0).to_pylist()], np.int64).reshape(-1, 4)
        cuts = np.sort(drawn[:, :2] % (n[:, None] + 1), 1)
        # A cut after the last code point is the text's end, where the next text may begin.
        places = np.where(cuts == n[:, None], ends[1:, None], at.select((ranks[:-1, None] + cuts).ravel()).reshape(-1, 2))
        forms, outputs, counts = [], [], []
        for i in range(len(n)):
            start, first, second, end = int(ends[i]), int(places[i, 0]), int(places[i, 1]), int(ends[i + 1])
            text = raw[start:end]
            plain = not text or drawn[i, 2] % 100 >= 100 - PLAIN_SHARE or PREFIX in text or SUFFIX in text or MIDDLE in text
            form = PLAIN if plain else SPM if drawn[i, 3] % 100 < SPM_SHARE else PSM
            forms.append(form)
            counts.append((None, None) if plain else (int(cuts[i, 0]), int(cuts[i, 1] - cuts[i, 0])))
            outputs.append(joined(form, raw[start:first], raw[first:second], raw[second:end]))
        columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True)), pa.array(outputs, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*b.columns[2:], *columns], names=[*b.schema.names[2:], "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, seed)

    docs = documents.select(F.col("doc_id").cast("string").alias("key"), "text", "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _back(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text="output", size=1 << 20):
        outputs = b.column(b.schema.get_field_index("output")).cast(pa.binary()).to_pylist()
        texts = [None if x is None else restored(x, form) for x, form in zip(outputs, b.column(b.schema.get_field_index("form")).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=names)


def restore(transformed: DataFrame) -> DataFrame:
    """What transform() returned, with the text rebuilt from output and form alone as a column restored."""
    names = [*transformed.columns, "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _back(batches, names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema.fields)
    return transformed.mapInArrow(run, f"{fields}, restored string")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document is cut and put together, and digests of its output and of the text rebuilt from it."""
    found = restore(transform(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP13_SQL = """
WITH keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM keyed
), cut AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
