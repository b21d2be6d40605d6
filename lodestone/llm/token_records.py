"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard is a file of records in ascending doc_id order; shard names sort in that order too. A record is

    u32 body length | u32 masked crc32 of those four bytes | body | u32 masked crc32 of the body | newline

all little-endian; the body is i64 doc_id | u8 width | ids as unsigned integers of that many bytes (2 where
the vocabulary fits, else 4). A mask is crc rotated right by 15 bits plus 0xA282EAD8, so that a checksum
of bytes that hold checksums stays meaningful. The newline is the line end of Spark's text sink, which
writes the shards: its commit protocol survives lost executors and works on any file system Spark knows.

The index is a Parquet table (shard, position, offset, length, doc_id, n_tokens, start_in_shard, ids_crc32).

Shards hold some SHARD bytes of text each, however many there are, and RECORDS records at most, so that one is
read as a whole. The library's special tokens, written out in a text, become their ids.

Null and empty texts become a record of the end id alone. Repeated doc_ids stay, in the order of their
texts' hashes; null doc_ids are written first, as the smallest 64-bit integer.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, slices, staged, table

NULL_ID = -(2**63)
_MASK = 0xA282EAD8
#: Texts with double or unusual white space are encoded in one piece.
_ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_OTHER_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words kept by a worker: at most twice as many.
_MEMO_WORDS = 400_000
#: Bytes of text in a shard, about, and records in one file of it.
SHARD, RECORDS = 16 << 20, 100_000
#: Offsets of chosen records are broadcast while there are at most so many, so that no shard is shuffled.
BROADCAST_ROWS = 200_000


def _odd(text: str) -> bool:
    return "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in _ASCII_SPACE) or (not text.isascii() and any(c in text for c in _OTHER_SPACE))


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int, ids: bytes, width: int) -> bytes:
    body = struct.pack("<qB", doc_id, width) + ids
    head = struct.pack("<I", len(body))
    return b"".join((head, struct.pack("<I", masked(head)), body, struct.pack("<I", masked(body))))


def unframe(data: bytes, at: int = 0) -> tuple[int, np.ndarray, int]:
    """(doc_id, ids, offset of the next record) of the record at an offset; ValueError if a checksum is wrong."""
    head = data[at : at + 4]
    length, check = struct.unpack_from("<II", data, at)
    body = data[at + 8 : at + 8 + length]
    if masked(head) != check or masked(body) != struct.unpack_from("<I", data, at + 8 + length)[0]:
        raise ValueError(f"damaged record at offset {at}")
    doc_id, width = struct.unpack_from("<qB", body)
    return doc_id, np.frombuffer(body, f"<u{width}", offset=9), at + 13 + length


class Encoder:
    """A tokenizers model, with the ids of recent words kept.

    The byte-level pre-tokenizer always cuts before a single space or newline between other characters, so
    a text without double or unusual white space is the sequence of its words, each encoded alone with the
    space or newline that leads it. The words met since the last change of generation are kept, and those
    of the generation before it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Their strings become their ids wherever they stand in a text, as the library does it.
        self.special = tuple(t.content for t in self.model.get_added_tokens_decoder().values())
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Which ids' tokens begin with the byte-level signs of a space and of a newline.
        names = self.model.get_vocab()
        self.first = {c: np.zeros(max(names.values()) + 1, bool) for c in (" ", "\n")}
        for name, i in names.items():
            for c, sign in ((" ", "\u0120"), ("\n", "\u010a")):
                self.first[c][i] = name.startswith(sign)

    def _encode(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, all encoded in one call."""
        if not words:
            return []
        e = self.model.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, f"<u{self.width}").tobytes()
        ends = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))) * self.width
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _led(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of words that all begin with a space, or all with a newline, and have no other: encoded as one text.

        The text is cut before each lead, so each word's ids begin where a token begins with it.
        """
        if not words:
            return []
        ids = np.array(self.model.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.int64)
        starts = np.flatnonzero(self.first[lead][ids])
        if len(starts) != len(words):
            return self._words(words)
        data, ends = ids.astype(f"<u{self.width}").tobytes(), [*(starts[1:] * self.width).tolist(), len(ids) * self.width]
        return [data[a:b] for a, b in zip((starts * self.width).tolist(), ends, strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > _MEMO_WORDS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        # A leading \r marks the word that nothing leads; one that a newline leads has the newline.
        split = [None if _odd(x) or any(t in x for t in self.special) else ("\r" + x.replace("\n", " \n")).split(" ") for x in texts]
        missing = set().union(*filter(None, split)).difference(new)
        kept = missing.intersection(old)
        new.update(zip(kept, map(old.__getitem__, kept), strict=True))
        missing -= kept
        # The pre-tokenizer also cuts between a letter and a comma or full stop at the word's end.
        stems = {w: w[:-1] for w in missing if w[-1:] in (",", ".") and w[-2:-1].isalpha()}
        need = list((missing - stems.keys()).union(x for x in stems.values() if x not in new))
        for at in range(0, len(need), 20_000):
            part = need[at : at + 20_000]
            bare, lines = [w for w in part if w[:1] == "\r"], [w for w in part if w[:1] == "\n"]
            spaced = [w for w in part if w[:1] not in ("\r", "\n")]
            new.update(zip(bare, self._words([w[1:] for w in bare]), strict=True))
            new.update(zip(lines, self._led(lines, "\n"), strict=True))
            new.update(zip(spaced, self._led([" " + w for w in spaced], " "), strict=True))
        if stems:
            ends = dict(zip(",.", self._words([",", "."]), strict=True))
            new.update((w, new[x] + ends[w[-1]]) for w, x in stems.items())
        whole = iter(self._encode([x for x, words in zip(texts, split, strict=True) if words is None]))
        return [next(whole) if words is None else b"".join(map(new.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder in each worker process, kept from task to task."""
    return Encoder(path)


def _frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches, 1024, "text"):
            end = np.array([end_id], f"<u{encode.width}").tobytes()
            ids = encode([x or "" for x in b.column(1).to_pylist()])
            rows = [frame(NULL_ID if d is None else d, x + end, encode.width) for d, x in zip(b.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    return run


def write(documents: DataFrame, tokenizer_path: str, out: str, end_id: int = 0) -> None:
    """Encode each text, append the end id and write the shards, in ascending doc_id order, under a new folder."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ordered = docs.repartitionByRange(max(1, -(-size // SHARD)), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    framed = ordered.mapInArrow(_frames(tokenizer_path, end_id), "value binary")
    framed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS).text(out)


_INDEX = "shard string, position long, offset long, length long, doc_id long, n_tokens long, start_in_shard long, ids_crc32 long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        shard, data = b.column(0)[0].as_py(), b.column(1)[0].as_buffer()
        data, at, position, start = memoryview(data), 0, 0, 0
        rows: list[tuple] = []
        while at < len(data):
            doc_id, ids, after = unframe(data, at)
            rows.append((shard, position, at, after - at - 1, doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
            at, position, start = after, position + 1, start + len(ids)
            if len(rows) == 20_000 or at >= len(data):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=[x.split()[0] for x in _INDEX.split(", ")])
                rows = []


def index(spark: SparkSession, out: str) -> DataFrame:
    """Read the shards whole, check every record and say where each lies."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(_scan, _INDEX)


def write_index(spark: SparkSession, out: str) -> DataFrame:
    index(spark, out).write.parquet(f"{out}.index")
    return spark.read.schema(_INDEX).parquet(f"{out}.index")


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        data, at = memoryview(b.column(0)[0].as_buffer()), b.column(1)[0].as_py()
        got = [unframe(data, x)[:2] for x in at]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([i.astype(np.int32) for _, i in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def read(spark: SparkSession, out: str, chosen: DataFrame) -> DataFrame:
    """(doc_id, ids) of chosen rows of the index, in any order, through their offsets.

    While few rows are chosen their offsets are sent to the shards, of which only those asked for are read;
    beyond that shards are joined to them by shuffle.
    """
    wanted = chosen.groupBy("shard").agg(F.collect_list("offset").alias("at"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    if chosen.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return files.join(wanted, "shard").select("content", "at").mapInArrow(_picked, "doc_id long, ids array<int>")


def starts(found: DataFrame) -> DataFrame:
    """The index with the number of ids before each record: one row per shard is summed over all shards."""
    from pyspark.sql import Window

    shards = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(shards.select("shard", before.alias("before")), "shard").withColumn("start", F.col("before") + F.col("start_in_shard"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and write all documents, read the files back, and give each document's place and checksum."""
    import public_tokenizers

    with scratch(spark, "tokens") as out:
        write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
        found = staged(index(spark, out), "tokens-index", keep=True)
    doc_id = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id")
    return starts(found).select(doc_id, "start", "n_tokens", "ids_crc32")
