"""Near-duplicate vectors by counting collisions of sorted one-dimensional projections.

Each of TURNS turns projects a unit vector onto LINES random lines. The two lines with the largest absolute
projections, with their signs, name the line on which the vector takes part in that turn: vectors that share it
are sorted by the first of the two projections, and a vector collides with those in the window of WINDOW around
it. Pairs with at least a calibrated number of collisions are verified by their cosine in double precision. The
number is the largest that simulated pairs at the threshold reach in RECALL of cases (3 of 40 turns in 64
dimensions), so a pair just at the threshold is found with at least about that probability, closer ones more
surely; chance pairs seldom collide twice.

Equal vectors form a class first, and only classes are projected. A line is cut into tiles as wide as the window:
a class stands in its own tile and visits the next one, so tiles are sorted and searched apart. A pair is looked
at in the first turn in which it collides and nowhere else, so links are counted once. Tiles of more than SPLIT
classes are dealt into blocks, and blocks meet in pairs; a task holds two blocks. Of links only counts and, in
large tiles, spanning stars leave a task, so a group of near copies isn't expanded into pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without
vec_id; vectors of different lengths don't link. Repeated rows are vectors of their own that link with each
other. A component is named by its smallest vec_id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import staged, table, tidy
from lodestone.operators.graph import components

COSINE = 0.95
TURNS, LINES = 40, 64
WINDOW = 0.8
#: Tiles are a little wider, so that rounding leaves no pair of a window two tiles apart.
TILE = 1.001 * WINDOW
RECALL = 0.999
SPLIT, SMALL = 2048, 24


@lru_cache(maxsize=8)
def lines(dim: int) -> np.ndarray:
    """(dim, TURNS * LINES) random directions, the same in every process."""
    return np.random.default_rng([20240607, dim]).standard_normal((dim, TURNS * LINES)).astype(np.float32)


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector and turn: the code of its line, and its place on it."""
    n, dim = unit.shape
    codes, places = np.empty((n, TURNS), np.int32), np.empty((n, TURNS), np.float32)
    for at in range(0, n, 1024):
        g = (unit[at : at + 1024].astype(np.float32) @ lines(dim)).reshape(-1, TURNS, LINES)
        size = np.abs(g)
        first = size.argmax(2)
        value = np.take_along_axis(g, first[..., None], 2)[..., 0]
        np.put_along_axis(size, first[..., None], -1, 2)
        second = size.argmax(2)
        other = np.take_along_axis(g, second[..., None], 2)[..., 0]
        codes[at : at + 1024] = ((first * 2 + (value < 0)) * LINES + second) * 2 + (other < 0)
        places[at : at + 1024] = np.abs(value)
    return codes, places


def collisions(codes: np.ndarray, places: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs (i, j) of rows collide, by turn."""
    return (codes[i] == codes[j]) & (np.abs(places[i] - places[j]) <= WINDOW)


@lru_cache(maxsize=8)
def needed(dim: int, cosine: float = COSINE) -> int:
    """The number of collisions from which a pair is verified."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return 1
    y = rng.standard_normal((4000, dim))
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    (a, u), (b, v) = cells(x), cells(y)
    count = ((a == b) & (np.abs(u - v) <= WINDOW)).sum(1)
    return max(1, int(np.quantile(count, 1 - RECALL, method="lower")))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, vec_id, embedding -> uid, vec_id, the unit vector's doubles; null where it links with nothing."""
    for b in batches:
        rows = b.column(2).to_pylist()
        data = [None] * len(rows)
        for i, x in enumerate(rows):
            if x and b.column(1)[i].is_valid and None not in x and np.isfinite(x).all() and any(x):
                # Scaled first, so that no square overflows or vanishes.
                v = np.array(x, np.float64)
                v /= np.abs(v).max()
                data[i] = (v / np.linalg.norm(v) + 0.0).tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["uid", "vec_id", "data"])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, n, data -> uid, n, data, codes and places."""
    for b in batches:
        data = b.column(2).to_pylist()
        codes, places = np.zeros((len(data), TURNS), np.int32), np.zeros((len(data), TURNS), np.float32)
        by_dim: dict[int, list[int]] = {}
        for i, x in enumerate(data):
            by_dim.setdefault(len(x) // 8, []).append(i)
        for dim, some in by_dim.items():
            codes[some], places[some] = cells(np.frombuffer(b"".join([data[i] for i in some]), np.float64).reshape(-1, dim))
        ends = pa.array(np.arange(len(data) + 1, dtype=np.int32) * np.int32(TURNS))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (codes, places)]
        yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=["uid", "n", "data", "codes", "places"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by group, as tables of whole groups of some thousand rows or one larger group."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(x.num_rows for x in kept) < 4096:
            continue
        t = pa.Table.from_batches(kept)
        key = t["group"].to_numpy()
        edge = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if edge:
            yield t.slice(0, edge)
            kept = t.slice(edge).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _close(unit: np.ndarray, codes: np.ndarray, places: np.ndarray, turn: int | np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Whether pairs (i, j) collide first in this turn, often enough, and are as near as asked."""
    hit = collisions(codes, places, i, j)
    ok = (hit.argmax(1) == turn) & hit.any(1) & (hit.sum(1) >= needed(unit.shape[1], cosine))
    ok[ok] = np.einsum("ij,ij->i", unit[i[ok]], unit[j[ok]]) >= cosine
    return ok


def _tile(unit: np.ndarray, codes: np.ndarray, places: np.ndarray, turn: int, block: np.ndarray, visits: np.ndarray, cosine: float) -> np.ndarray:
    """The links (row, row) within one large tile, or between two blocks of it, rows in order of their places.

    A row is held against the later ones in its window; visitors aren't compared with each other here.
    """
    n, own = len(unit), places[:, turn]
    link = np.zeros((n, n), bool)
    both = block.min() != block.max()
    ends = np.searchsorted(own, own + np.float32(TILE), "right")
    for r in range(n):
        later = np.arange(r + 1, ends[r])
        keep = ~(visits[r] & visits[later])
        # A block's own pairs are looked at where it meets itself.
        later = later[keep & (block[later] != block[r])] if both else later[keep]
        if len(later):
            link[r, later] = _close(unit, codes, places, turn, np.full(len(later), r), later, cosine)
    return link | link.T


def _stars(link: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """For each row the smallest uid that it reaches by links."""
    label, least = uid.copy(), None
    while least is None or not (least == label).all():
        label = label if least is None else least
        least = label.copy()
        for a in range(0, len(uid), 256):
            least[a : a + 256] = np.minimum(label[a : a + 256], np.where(link[a : a + 256], label[None, :], np.iinfo(np.int64).max).min(1))
    return label


def _linked(cosine: float):
    """Rows of tiles, in order of their places -> (uid, n, other): links counted here, and an edge that connects uid.

    n counts rows of the classes linked to uid's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            uid, group, turn, block, visits, weight = (t[c].to_numpy() for c in ("uid", "group", "turn", "block", "visits", "n"))
            data = t["data"].to_pylist()
            codes, places = (pc.list_flatten(t[c]).to_numpy().reshape(len(uid), -1) for c in ("codes", "places"))
            dims = np.array([len(x) // 8 for x in data])
            edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            sizes = np.diff(np.append(edges, len(group)))
            size_of = np.repeat(sizes, sizes)
            out_u, out_n, out_o = [], [], []
            for dim in np.unique(dims).tolist():
                unit = np.zeros((len(uid), dim))
                own = np.flatnonzero(dims == dim)
                unit[own] = np.frombuffer(b"".join([data[k] for k in own]), np.float64).reshape(len(own), -1)
                here = places[np.arange(len(uid)), turn]
                for step in range(1, int(min(SMALL, sizes.max()))):
                    same = (group[:-step] == group[step:]) & (size_of[:-step] <= SMALL) & (dims[:-step] == dim) & ~(visits[:-step] & visits[step:])
                    i = np.flatnonzero(same & (here[step:] - here[:-step] <= np.float32(WINDOW)))
                    ok = _close(unit, codes, places, turn[i], i, i + step, cosine)
                    a, b = i[ok], i[ok] + step
                    out_u += [uid[a], uid[b]]
                    out_o += [uid[b], uid[a]]
                    out_n += [weight[b], weight[a]]
                for at, n in zip(edges[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                    # A tile's classes all have one dimension.
                    if dims[at] == dim:
                        rows = slice(at, at + n)
                        link = _tile(unit[rows], codes[rows], places[rows], int(turn[at]), block[rows], visits[rows], cosine)
                        some = link.any(1)
                        out_u.append(uid[rows][some])
                        out_n.append((link[some] * weight[rows][None, :]).sum(1))
                        out_o.append(_stars(link, uid[rows])[some])
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_u, out_n, out_o)], names=["uid", "n", "other"])

    return run


def links(embeddings: DataFrame, cosine: float = COSINE, split: int = SPLIT) -> DataFrame:
    """(vec_id, n_links, component_id) of each row."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "embedding")
    every = staged(rows.mapInArrow(_units, "uid long, vec_id long, data binary"), "vectors").withColumn("h", F.xxhash64("data")).withColumn("h2", F.xxhash64(F.lit(1), "data"))
    known = every.filter("data is not null")
    classes = staged(known.groupBy("h", "h2").agg(F.min("uid").alias("head"), F.count("*").alias("n")), "vector-classes")
    heads = known.select("uid", "data").join(classes.select(F.col("head").alias("uid"), "n"), "uid")
    coded = staged(heads.select("uid", "n", "data").mapInArrow(_coded, "uid long, n long, data binary, codes array<int>, places array<float>"), "vector-codes")
    member = coded.select("uid", F.posexplode(F.arrays_zip("codes", "places")).alias("turn", "c"), F.octet_length("data").alias("dim")).select("uid", "turn", "c.codes", F.col("c.places").alias("place"), "dim")
    tile = F.floor(F.col("place") / TILE).cast("int")
    member = member.select("uid", "turn", "codes", "dim", "place", F.explode(F.array(F.struct(tile.alias("tile"), F.lit(False).alias("visits")), F.struct((tile + 1).alias("tile"), F.lit(True).alias("visits")))).alias("t"))
    member = member.select("uid", "place", "turn", "t.visits", F.xxhash64("turn", "codes", "dim", "t.tile").alias("tile"))
    crowded = member.groupBy("tile").agg(F.count("*").alias("size"), F.count_if(~F.col("visits")).alias("own")).filter("size > 1 and own > 0")
    blocks = F.ceil(F.col("size") / split).cast("int")
    met = member.join(crowded, "tile").withColumn("block", F.pmod(F.xxhash64("uid"), blocks).cast("int"))
    met = met.select("uid", "place", "turn", "visits", "tile", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    met = met.select("uid", "place", "turn", "visits", "block", F.when(F.col("block") == F.col("with"), F.xxhash64("tile", "block")).otherwise(F.xxhash64("tile", F.least("block", "with"), F.greatest("block", "with"))).alias("group"))
    dealt = met.join(coded, "uid").repartition("group").sortWithinPartitions("group", "place")
    found = dealt.select("uid", "group", "turn", "block", "visits", "n", "data", "codes", "places").mapInArrow(_linked(cosine), "uid long, n long, other long")
    found = staged(found, "vector-links")
    counts = found.groupBy("uid").agg(F.sum("n").alias("linked"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    named = every.select("vec_id", "uid", "h", "h2", F.col("data").isNotNull().alias("good")).join(classes, ["h", "h2"], "left")
    named = named.select("vec_id", F.when(F.col("good"), F.col("head")).otherwise(F.col("uid")).alias("uid"), F.when(F.col("good"), F.col("n") - 1).otherwise(0).alias("copies"))
    named = named.join(roots.withColumnRenamed("id", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    names = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    n_links = (F.col("copies") + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links")
    return named.join(names, "root").join(counts, "uid", "left").select("vec_id", n_links, "component_id")


@tidy
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it stays, of each vector."""
    found = links(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n WHERE a.n > 0 AND b.n > 0),
r AS (WITH RECURSIVE t(a, b) AS (SELECT vec_id, vec_id FROM u UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a) SELECT a AS vec_id, min(b) AS component_id FROM t GROUP BY a),
c AS (SELECT a AS vec_id, count(*) AS m FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(m, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM u LEFT JOIN r USING (vec_id) LEFT JOIN c USING (vec_id)
"""
