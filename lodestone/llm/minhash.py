"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the set of its shingles: every WORDS consecutive words (runs of characters outside
[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] in lower case), or all its words if it has fewer. Each shingle has a weight
(1 here; the function takes others). Darts are thrown at the plane of weight and rank over each shingle: its
weight axis is cut at 1, 2, 4, ..., and over each such region darts arrive along the rank axis as a Poisson
process as dense as the region is wide, all drawn from hashes of the shingle and the region. A dart below the
shingle's weight counts; it carries a random coordinate. Each coordinate of the signature keeps the dart of
lowest rank. Only darts up to a rank at which each coordinate has one for certain are drawn: about
k ln k + 2k darts for any document, whatever its length.

The signature is cut into BANDS bands of ROWS coordinates; documents that agree in a band are candidates
(at similarity 0.8 all but 3 in a hundred thousand pairs are), and are verified by the exact Jaccard similarity of their
shingles. Documents with equal shingle sets form a class first, and only classes are joined. In a bucket, all
are compared with the class that meets most others; then classes that aren't connected yet are compared with
all others, unless sizes or parities (see parity) prove that they can't be similar enough: large groups of
near copies aren't paired with themselves, and no link is lost.

Groups are connected components over matches. Null and empty texts and texts without words are alone in their
group. Repeated rows share a row of the result each. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import slices, staged, table, tidy, whole
from lodestone.operators.graph import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Bits of a set's parity, and rounds in which only a bucket's middle is compared with its others.
PARITY, ROUNDS = 2048, 1
#: Ids of documents that share a band are broadcast while they are at most so many.
BROADCAST_ROWS = 500_000
SEED = 0x9E3779B97F4A7C15
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each 64-bit number."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from a hash."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words of each text, computed on bytes."""
    joined = "\x00".join(texts).encode() + b"\x00"
    data = np.frombuffer(joined, np.uint8)
    inside = _IN_WORD.take(data)
    edges = np.flatnonzero(np.diff(inside, prepend=np.uint8(0)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    # Sums of byte values times powers of an odd number that depend on the place in the word only.
    length = ends - starts
    place = np.arange(len(data), dtype=np.int64) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    terms = (data.astype(_U) + _U(1)) * _POWERS.take(place & 0xFFFF) * inside
    return mix(np.add.reduceat(terms, starts) + length.astype(_U) * _U(SEED)), np.diff(np.searchsorted(starts, np.concatenate([[-1], np.flatnonzero(data == 0)])))


_IN_WORD = np.array([not (b < 0x30 or 0x3A <= b < 0x61 or 0x7B <= b < 0x80) for b in range(256)], np.uint8)
_POWERS = np.cumprod(np.full(0x10000, 0x100000001B3, _U), dtype=_U)


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes([(x or "").lower().replace("\x00", " ") for x in texts])
    total = len(hashes)
    rolled = np.zeros(total, _U)
    for k in range(words):
        rolled[: total - k] += mix(hashes[k:] + _U((SEED * (k + 1)) & (2**64 - 1)))
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            few = np.array([n], _U)
            for k in range(n):
                few = few + mix(hashes[at + k : at + k + 1] + _U((SEED * (k + 1)) & (2**64 - 1)))
            out.append(mix(few))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def darts(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, hash, place of its element) of all darts that hit the weighted elements below each one's limit of rank."""
    ranks, marks, places = [], [], []
    low, high, region = 0.0, 1.0, 0
    top = float(weights.max(initial=0))
    while low < top:
        at = np.flatnonzero(weights > low)
        seed = mix(elements[at] + _U((region * 0xD1B54A32D192ED03) & (2**64 - 1)))
        rank, step, width = np.zeros(len(seed)), 0, high - low
        while len(seed):
            step += 1
            draw = mix(seed + _U((step * SEED) & (2**64 - 1)))
            rank = rank - np.log(uniform(draw)) / width
            keep = np.flatnonzero(rank < limits[at])
            seed, rank, draw, at = seed[keep], rank[keep], draw[keep], at[keep]
            mark = mix(draw + _U(SEED))
            # Where all of the region lies below the weight, every dart in it hits.
            hit = slice(None) if top == high and (weights[at] >= high).all() else np.flatnonzero(low + width * uniform(mark) < weights[at])
            ranks.append(rank[hit])
            marks.append(mix(mark[hit] + _U(1)))
            places.append(at[hit])
        low, high, region = high, high * 2, region + 1
    return np.concatenate(ranks), np.concatenate(marks), np.concatenate(places)


def signatures(items: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """For each weighted set the dart of lowest rank of each of k coordinates, as its hash; a set must have an element."""
    sizes = np.array([len(x) for x in items])
    elements, owner = np.concatenate(items), np.repeat(np.arange(len(items)), sizes)
    mass = np.ones(len(elements)) if weights is None else np.concatenate(weights)
    limits = (k * np.log(k) + 2 * k) / np.bincount(owner, mass)
    out = np.zeros((len(items), k), _U)
    todo = np.arange(len(items))
    while len(todo):
        chosen = np.flatnonzero(np.isin(owner, todo)) if len(todo) < len(items) else np.arange(len(elements))
        rank, mark, place = darts(elements[chosen], mass[chosen], limits[owner[chosen]])
        key = owner[chosen[place]] * k + (mark % _U(k)).astype(np.int64)
        order = np.argsort(-rank)
        best = np.full(len(items) * k, -1)
        best[key[order]] = order
        best = best.reshape(-1, k)[todo]
        full = (best >= 0).all(1)
        out[todo[full]] = mark[best[full]]
        todo = todo[~full]
        limits[todo] *= 2
    return out


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    return signatures([elements], None if weights is None else [weights], k)[0]


def parity(elements: np.ndarray) -> np.ndarray:
    """PARITY bits in 64-bit numbers: whether an odd number of elements falls on each.

    Two sets differ by as many elements at least as their parities have different bits.
    """
    odd = np.bincount((elements & _U(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of coordinates, of one signature or of each row of many."""
    parts = sig.reshape(*sig.shape[:-1], -1, rows)
    total = np.arange(1, parts.shape[-2] + 1, dtype=_U) * _U(SEED)
    for k in range(rows):
        total = mix(total + parts[..., k])
    return total


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, set hashes (null without shingles), size, band keys, parities."""
    for b in slices(batches, 256, "text"):
        sets = shingles(b.column(1).to_pylist())
        some = [s for s in sets if len(s)]
        keys = bands(signatures(some)).view(np.int64) if some else np.zeros((0, BANDS), np.int64)
        odd = np.stack([parity(s) for s in some]) if some else np.zeros((0, PARITY // 64), np.int64)
        h1 = [int(mix(s).sum(dtype=_U).astype(np.int64)) if len(s) else None for s in sets]
        h2 = [int(np.bitwise_xor.reduce(mix(s + _U(SEED))).astype(np.int64)) if len(s) else None for s in sets]
        ends = np.cumsum([0, *(len(s) > 0 for s in sets)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends * np.int32(x.shape[1])), pa.array(x.ravel())) for x in (keys, odd)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), *lists], names=["doc_id", "h1", "h2", "size", "bands", "parity"])


_SIGNED = "doc_id long, h1 long, h2 long, size int, bands array<long>, parity array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256, "text"):
        rows = [s.tobytes() for s in shingles(b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["doc_id", "items"])


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(sets: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) of doc_ids those whose shingles, in sets (doc_id, items), have the similarity."""
    both = found.join(sets.withColumnsRenamed({"doc_id": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "items": "y"}), "b")
    return staged(both.select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a long, b long"), "near-matches")


def groups(documents: DataFrame, similarity: float = SIMILARITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; rows without an id have no component."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(docs.mapInArrow(_sign, _SIGNED), "near-signatures")
    known = signed.filter("doc_id is not null and h1 is not null")
    classes = staged(known.groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("head")), "near-classes")
    odd = [f"odd{i}" for i in range(PARITY // 64)]
    heads = known.join(classes, ["h1", "h2", "size"]).filter("doc_id = head").dropDuplicates(["doc_id"])
    rows = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("head"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowd = staged(rows.join(shared, "key"), "near-buckets")
    # How many others a class meets, over all bands: the one that meets most stands in a bucket's middle.
    met = staged(crowd.groupBy("head").agg(F.sum("n").alias("met")).join(heads.select(F.col("doc_id").alias("head"), "size", *[F.get("parity", F.lit(i)).alias(c) for i, c in enumerate(odd)]), "head"), "near-wanted")
    crowd = crowd.join(met, "head")

    # The ids are broadcast while there are few; beyond that texts are shuffled to them.
    hint = F.broadcast if met.count() <= broadcast_rows else (lambda df: df)
    texts = docs.join(hint(met.select(F.col("head").alias("doc_id"))), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = staged(texts.mapInArrow(_sets, "doc_id long, items binary"), "near-sets")

    # At a similarity s, sets of sizes x and y differ by (1 - s) / (1 + s) * (x + y) elements at most.
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in odd])
    near = (F.least("size", "size_b") >= similarity * F.greatest("size", "size_b") - 1e-9) & (apart <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("size_b")) + 1e-9)
    other = {c: f"{c}_b" for c in ("head", "size", "root", *odd)}

    links = None
    rooted = crowd.withColumn("root", F.col("head"))
    for _ in range(ROUNDS):
        # Each bucket's middle is compared with the others.
        hubs = rooted.groupBy("key").agg(F.max(F.struct("met", "head")).alias("hub")).select("key", F.col("hub.head").alias("head"))
        hubs = rooted.join(hubs, ["key", "head"]).withColumnsRenamed(other).drop("n", "met")
        star = rooted.join(hubs, "key").filter((F.col("root") != F.col("root_b")) & near).select(F.least("head", "head_b").alias("a"), F.greatest("head", "head_b").alias("b")).distinct()
        found = verified(sets, star, similarity)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        rooted = crowd.join(roots.withColumnRenamed("id", "head"), "head", "left").withColumn("root", F.coalesce("root", "head"))
        # A bucket whose classes are all connected is done.
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        rooted = staged(rooted.join(mixed, "key"), "near-mixed")
    # What is left: pairs in a bucket that aren't connected yet.
    rest = rooted.join(rooted.withColumnsRenamed(other).drop("n", "met"), "key").filter((F.col("root") < F.col("root_b")) & near)
    more = verified(sets, rest.select(F.least("head", "head_b").alias("a"), F.greatest("head", "head_b").alias("b")).distinct(), similarity)
    roots = components(links.unionByName(more))
    joined = known.select("doc_id", "size", "h1", "h2").join(classes, ["h1", "h2", "size"]).join(roots.withColumnRenamed("id", "head"), "head", "left")
    grouped = joined.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("root", "head").alias("component_id"))
    return grouped.unionByName(signed.filter("doc_id is null or h1 is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def dedup(documents: DataFrame, **kw) -> DataFrame:
    """The documents without those whose group has a smaller doc_id; of rows that repeat an id one stays."""
    gone = groups(documents, **kw).filter("component_id <> doc_id").select("doc_id").distinct()
    left = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    first = left.filter("doc_id is not null").select(whole(left), rank.alias("rank_")).filter("rank_ = 1").select("whole_.*")
    return first.unionByName(left.filter("doc_id is null"))


@tidy
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each document, and whether it is the one that stays."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
