"""Distance joins of vectors of any dimension: density and linkage clusters, and nearest rows, without all pairs.

A bounded set of pivots cuts space into cells, each vector's nearest pivot being its cell. A vector also visits the
cells that its distance to the plane between two pivots doesn't rule out, so each vector meets in its own cell all that
lie within eps of it. Within a cell vectors lie on rings of width eps around the pivot, and only neighbouring rings meet
(triangle inequality). What meets is dealt into blocks, each pair of blocks one piece of matrix work; pairs are
aggregated where they are made, none is written.

Where a vector has about the same distance to everything (many dimensions), the pivots rule out next to nothing and a
row would be written once a cell. So it is looked first how many cells rows of a sample visit; if there are fewer blocks
than that, all blocks meet, each two once, and a row is written once a block. There are SPLITS blocks, so that what is
written grows with the rows, until a block would hold more than WIDE bytes; beyond that more blocks keep memory bounded.

Vectors are array<double>. Rows whose vector is null, empty or holds null or non-finite components are near nothing.
All other vectors must have one length. Equal vectors are handled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import components
from lodestone.sources.staging import staged

#: The largest number of pivots: their distances to each other and to a batch of rows fit in a task's memory.
PIVOTS = 256
#: Rows for each pivot, and rows on each side of one piece of matrix work, at most.
ROWS_A_PIVOT, BLOCK = 64, 2048
#: Blocks that rows are dealt into, if those are not too large: bytes of vectors in a block. Rows whose visits are counted.
SPLITS, WIDE, ASKED = 24, 32 << 20, 256
#: Rows and columns of a piece of a matrix of distances.
TILE = (512, 2048)
_SLACK = 1 + 1e-9


def usable(v: Column) -> Column:
    """Whether a vector is near anything at all."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, odd), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances of the rows of two matrices, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of two matrices are at most eps apart; what rounding leaves open is summed again term by term."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    slack = 1e-12 * (1 + max(aa.max(initial=0), bb.max(initial=0)))
    # One product gives squared distances less the rows' own lengths; it is compared in place.
    d = (a * -2.0) @ b.T
    d += bb[None, :]
    limit = (eps * eps - aa)[:, None]
    near, sure = d <= limit + slack, d < limit - slack
    if np.count_nonzero(near) != np.count_nonzero(sure):
        i, j = np.nonzero(near ^ sure)
        for at in range(0, len(i), 65536):
            m, n = i[at : at + 65536], j[at : at + 65536]
            near[m, n] = ((a[m] - b[n]) ** 2).sum(1) <= eps * eps
    return near


def tiles(n: int, m: int, same: bool) -> Iterator[tuple[slice, slice]]:
    """Pieces of a matrix of so many rows and columns; same: of two equal sides only those on and above the diagonal."""
    for i in range(0, n, TILE[0]):
        for j in range(i - i % TILE[1] if same else 0, m, TILE[1]):
            yield slice(i, min(n, i + TILE[0])), slice(j, min(m, j + TILE[1]))


def pivots(distinct: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """At most so many of the different vectors, those with the smallest hashes; which they are changes speed alone."""
    many = min(most, max(1, distinct.count() // ROWS_A_PIVOT))
    return np.array([r.v for r in distinct.orderBy(F.xxhash64("v"), "v").limit(many).select("v").collect()], float)


def _placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray, eps: float | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, x) with their cell and distance to its pivot; with eps also in each cell that may hold rows within eps."""
    apart = np.sqrt(squared(centres, centres))
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            d2 = squared(_matrix(b.column("v")), centres)
            own = d2.argmin(1)
            keep = np.zeros(d2.shape, bool)
            if eps is not None:
                with np.errstate(divide="ignore", invalid="ignore"):
                    keep = (d2 - d2[np.arange(len(own)), own][:, None]) / (2 * apart[own]) <= eps * _SLACK + 1e-9
            keep[np.arange(len(own)), own] = True
            row, cell = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.sqrt(d2[row, cell])), *(b.column(c).take(pa.array(row)) for c in ("id", "v", "x"))], names=["cell", "far", "id", "v", "x"])


def placed(rows: DataFrame, centres: np.ndarray, eps: float | None = None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    return rows.select("id", "v", "x").mapInArrow(lambda it: _placed(it, shared.value, eps), "cell long, far double, id long, v array<double>, x long")


def meet(home: DataFrame, other: DataFrame, keys: list[str], body: Callable[[pa.Table], pa.Table], schema: str, block: int | None = None) -> DataFrame:
    """The body's rows for each pair of blocks (side 0: home, side 1: other) of rows (id, v, x) that share their keys."""
    block = block or BLOCK
    sizes = home.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("homes_")).join(other.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("others_")), keys)
    row = [*keys, "homes_", "others_", "side_", "id", "v", "x"]
    h = home.withColumn("side_", F.lit(0)).join(sizes, keys).select(*row).withColumn("h_", F.pmod(F.xxhash64("id"), "homes_")).withColumn("o_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others_") - 1)))
    o = other.withColumn("side_", F.lit(1)).join(sizes, keys).select(*row).withColumn("o_", F.pmod(F.xxhash64("id"), "others_")).withColumn("h_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes_") - 1)))
    return h.unionByName(o).groupBy(*keys, "h_", "o_").applyInArrow(body, schema)


def _sides(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """id, v and x of the home rows and of the others."""
    side, found = t["side_"].to_numpy(), []
    for k in (0, 1):
        part = t.filter(pa.array(side == k))
        found.append([part["id"].to_numpy(), _matrix(part["v"]) if len(part) else np.zeros((0, 1)), part["x"].to_numpy()])
    return found[0], found[1]


def visited(rows: DataFrame, centres: np.ndarray, eps: float) -> float:
    """How many cells a row visits, on average over at most ASKED rows with the smallest hashes; it changes speed alone."""
    asked = rows.orderBy(F.xxhash64("v", F.lit(1)), "v").limit(ASKED).select("v").collect()
    batch = pa.RecordBatch.from_pydict({"id": range(len(asked)), "v": [r.v for r in asked], "x": range(len(asked))})
    return sum(b.num_rows for b in _placed(iter([batch]), centres, eps)) / max(1, len(asked))


def gridded(home: DataFrame, other: DataFrame, block: int, counts: tuple[int, int], body: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """The body's rows for all pairs of blocks of home rows and other rows (id, v, x); of one table with itself each two blocks once (columns h_, o_)."""
    homes, others = (max(1, -(-n // block)) for n in counts)
    dealt = lambda df, n: df.select("id", "v", "x", F.pmod(F.xxhash64("id"), F.lit(n)).alias("own_"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if home is other:
        met = dealt(home, homes).withColumn("m_", each(homes))
        met = met.select(F.least("own_", "m_").alias("h_"), F.greatest("own_", "m_").alias("o_"), (F.col("own_") > F.col("m_")).cast("int").alias("side_"), "id", "v", "x")
    else:
        h = dealt(home, homes).select(F.col("own_").alias("h_"), each(others).alias("o_"), F.lit(0).alias("side_"), "id", "v", "x")
        met = h.unionByName(dealt(other, others).select(F.col("own_").alias("o_"), each(homes).alias("h_"), F.lit(1).alias("side_"), "id", "v", "x"))
    return met.groupBy("h_", "o_").applyInArrow(body, schema)


def near(home: DataFrame, other: DataFrame, centres: np.ndarray, eps: float, body: Callable, schema: str) -> DataFrame:
    """JN13: the body's rows for pieces in which each home row (id, v, x) meets all other rows within eps of it, each once.

    body(once) gives what is run on a piece; once: pieces of one table with itself, each two blocks in one order only.
    """
    n = home.count()
    m = n if home is other else other.count()
    block = max(BLOCK, min(-(-max(n, m) // SPLITS), WIDE // (8 * centres.shape[1])))
    if visited(other, centres, eps) >= max(1, -(-max(n, m) // block)):
        return gridded(home, other, block, (n, m), body(home is other), schema)
    ring = F.floor(F.col("far") / (eps * _SLACK)).alias("ring")
    h = staged(placed(home, centres).select("cell", ring, "id", "v", "x"), "near-home")
    o = placed(other, centres, eps).select("cell", F.explode(F.sequence(F.floor(F.col("far") / (eps * _SLACK)) - 1, F.floor(F.col("far") / (eps * _SLACK)) + 1)).alias("ring"), "id", "v", "x")
    # Rings that no home row has are dropped before vectors are written.
    o = staged(o.join(h.select("cell", "ring").distinct(), ["cell", "ring"], "left_semi"), "near-other")
    return meet(h, o, ["cell", "ring"], body(False), schema, block)


def _met(t: pa.Table, once: bool) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """A piece's two sides, and whether they are one block."""
    a, b = _sides(t)
    same = once and t["h_"][0].as_py() == t["o_"][0].as_py()
    return a, a if same else b, same


def _degrees(eps: float):
    def run(t: pa.Table, once: bool) -> pa.Table:
        (a, av, ax), (b, bv, bx), same = _met(t, once)
        n, m = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        more_a, more_b = (np.flatnonzero(x > 1) for x in (ax, bx))
        if len(a) and len(b):
            for i, j in tiles(len(a), len(b), False):
                met = within(av[i], bv[j], eps)
                k = more_b[(more_b >= j.start) & (more_b < j.stop)]
                n[i] += np.count_nonzero(met, axis=1) + met[:, k - j.start] @ (bx[k] - 1)
                if once and not same:
                    k = more_a[(more_a >= i.start) & (more_a < i.stop)]
                    m[j] += np.count_nonzero(met, axis=0) + (ax[k] - 1) @ met[k - i.start]
        if once and not same:
            a, n = np.concatenate([a, b]), np.concatenate([n, m])
        return pa.table({"id": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64())})

    return lambda once: lambda t: run(t, once)


def parts(near_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a home-by-other matrix of links the part of each home row and of each other row, -1 of those without a link."""
    rows, cols, k = np.full(near_.shape[0], -1), np.full(near_.shape[1], -1), 0
    for start in range(len(rows)):
        if rows[start] < 0 and near_[start].any():
            front = np.array([start])
            rows[start] = k
            while len(front):
                reached = np.flatnonzero(near_[front].any(0) & (cols < 0))
                cols[reached] = k
                front = np.flatnonzero(near_[:, reached].any(1) & (rows < 0)) if len(reached) else reached
                rows[front] = k
            k += 1
    return rows, cols


def united(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each of n nodes the smallest node that it reaches by links (u, v)."""
    root = np.arange(n)
    while len(u):
        u, v = root[u], root[v]
        open_ = u != v
        u, v = u[open_], v[open_]
        # Each root goes to the smallest root that it is linked with, then all go on to the ends.
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return root


def _stars(eps: float):
    def run(t: pa.Table, once: bool) -> pa.Table:
        (a, av, _), (b, bv, _), same = _met(t, once)
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        at, bt = where[: len(a)], where[len(a) :]
        root, waiting, size = np.arange(len(ids)), [], 0

        def settle() -> None:
            nonlocal root, size
            u, v = (np.concatenate(x) for x in zip(*waiting)) if waiting else (np.zeros(0, np.int64),) * 2
            root, size = united(len(ids), np.concatenate([np.arange(len(ids)), u]), np.concatenate([root, v])), 0
            waiting.clear()

        if len(a) and len(b):
            for i, j in tiles(len(a), len(b), same):
                # What is one cluster already needs no more links.
                if (root[at[i]] == root[at[i.start]]).all() and (root[bt[j]] == root[at[i.start]]).all():
                    continue
                r, c = parts(within(av[i], bv[j], eps))
                part, node = np.concatenate([r[r >= 0], c[c >= 0]]), np.concatenate([at[i][r >= 0], bt[j][c >= 0]])
                least = np.full(part.max(initial=-1) + 1, len(ids))
                np.minimum.at(least, part, node)
                waiting.append((least[part], node))
                size += len(part)
                if size > 1 << 18:
                    settle()
            settle()
        other = root != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[root[other]], pa.int64()), "b": pa.array(ids[other], pa.int64())})

    return lambda once: lambda t: run(t, once)


def _smallest(eps: float):
    def run(t: pa.Table, once: bool) -> pa.Table:
        (a, av, _), (b, bv, x), _ = _met(t, once)
        top = np.iinfo(np.int64).max
        best = np.full(len(a), top)
        if len(a) and len(b):
            for i, j in tiles(len(a), len(b), False):
                best[i] = np.minimum(best[i], np.where(within(av[i], bv[j], eps), x[None, j], top).min(1))
        met = best < top
        return pa.table({"id": pa.array(a[met], pa.int64()), "least": pa.array(best[met], pa.int64())})

    return lambda once: lambda t: run(t, once)


def _distinct(points: DataFrame) -> DataFrame:
    """(id, v, x): each different usable vector with its smallest id and the number of rows that have it."""
    return points.filter(usable(F.col("v"))).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("x")).select("id", "v", "x")


def _roots(rows: DataFrame, centres: np.ndarray, eps: float) -> DataFrame:
    """(id, root): of each row the smallest id that it reaches by steps of at most eps."""
    stars = near(rows, rows, centres, eps, _stars(eps), "a long, b long")
    return rows.select("id").join(components(stars), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def linkage(points: DataFrame, limit: float) -> DataFrame:
    """NUM13: (id, cluster) of rows (id, v) linked by steps of at most limit; a cluster is named by its smallest id.

    Equal vectors are one cluster at any limit; a row without a usable vector is alone.
    """
    if limit < 0:
        raise ValueError("a limit is not negative")
    rows = staged(_distinct(points), "linkage-rows")
    roots = _roots(rows, pivots(rows), limit) if limit and not rows.isEmpty() else rows.select("id", F.col("id").alias("root"))
    named = rows.join(roots, "id").select("v", "root")
    return points.join(named, "v", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def dbscan(points: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """NUM14: (id, is_core, cluster) of rows (id, v): cores count themselves; a cluster is named by its smallest core, -1 is noise.

    A border row goes to the neighbouring cluster with the smallest name. A row without a usable vector counts itself only.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps is positive, min_samples at least 1")
    rows = staged(_distinct(points), "dbscan-rows")
    alone = points.filter(~usable(F.col("v"))).select("id", F.lit(min_samples == 1).alias("is_core"), (F.col("id") if min_samples == 1 else F.lit(-1).cast("long")).alias("cluster"))
    if rows.isEmpty():
        return alone
    centres = pivots(rows)
    degrees = near(rows, rows, centres, eps, _degrees(eps), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    known = staged(rows.join(degrees, "id").select("id", "v", (F.col("n") >= min_samples).alias("is_core")), "dbscan-known")
    cores = known.filter("is_core").select("id", "v", F.lit(0).cast("long").alias("x"))
    named = staged(cores.drop("x").join(_roots(cores, centres, eps), "id").select("id", "v", F.col("root").alias("x")), "dbscan-cores")
    rest = known.filter("not is_core").select("id", "v", F.lit(0).cast("long").alias("x"))
    border = near(rest, named, centres, eps, _smallest(eps), "id long, least long").groupBy("id").agg(F.min("least").alias("least"))
    found = known.join(named.select("id", "x"), "id", "left").join(border, "id", "left").select("v", "is_core", F.coalesce("x", "least", F.lit(-1)).alias("cluster"))
    return points.filter(usable(F.col("v"))).join(found, "v").select("id", "is_core", "cluster").unionByName(alone)


def _best(k: int):
    def run(t: pa.Table) -> pa.Table:
        (q, qv, _), (ids, v, _) = _sides(t)
        out: list[tuple[int, int, float]] = []
        for i in range(len(q)):
            d = ((v - qv[i]) ** 2).sum(1) if len(ids) else np.zeros(0)
            d[ids == q[i]] = np.inf
            # Ties of the last one kept are all kept here.
            limit = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
            out += [(int(q[i]), int(ids[j]), float(np.sqrt(d[j]))) for j in np.flatnonzero((d <= limit) & np.isfinite(d))]
        return pa.table({"query": pa.array([o[0] for o in out], pa.int64()), "id": pa.array([o[1] for o in out], pa.int64()), "d": pa.array([o[2] for o in out], pa.float64())})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k)


def visits(queries: DataFrame, cells: list[tuple[int, float, int]], centres: np.ndarray, k: int) -> DataFrame:
    """(query, v, cell, far, first, floor): the cells of each query (id, v) with the least distance that a row of it can have.

    first marks a query's nearest cells that hold k + 1 rows between them. cells: (cell, radius, rows).
    """
    shared = queries.sparkSession.sparkContext.broadcast((centres, np.array([c[0] for c in cells]), np.array([c[1] for c in cells]), np.array([c[2] for c in cells])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, cell, radius, rows = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                d = np.sqrt(squared(_matrix(b.column("v")), centres[cell]))
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(rows[order], 1) - rows[order]
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order, before < k + 1, 1)
                n, m = d.shape
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(np.repeat(np.arange(n), m))), pa.array(np.tile(cell, n), pa.int64()), pa.array(d.ravel()), pa.array(first.ravel()), pa.array(np.maximum(d - radius[None, :], 0).ravel() * (1 - 1e-9) - 1e-9)],
                    names=["query", "cell", "far", "first", "floor"],
                )

    return queries.select("id", "v").mapInArrow(run, "query long, cell long, far double, first boolean, floor double")


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """JN14: (query, rank, id, d), the k nearest rows (id, v) of each of a stated set of queries (id, v), others than itself, ties by id.

    A query first looks at its nearest cells that hold k + 1 rows; the k-th distance there bounds what it looks for, so
    it goes on only to cells whose nearest possible row is within it. Also returns (query, cell, looked): which cells
    each query looked at. The distances of a query to the cells, of which there are at most PIVOTS, are its only rows.
    """
    good = staged(rows.filter(usable(F.col("v"))).select("id", "v", F.lit(0).cast("long").alias("x")), "nearest-rows")
    asked = staged(queries.filter(usable(F.col("v"))).select("id", "v", F.lit(0).cast("long").alias("x")), "nearest-queries")
    schema = "query long, id long, d double"
    if good.isEmpty():
        return rows.sparkSession.createDataFrame([], "query long, rank int, id long, d double"), rows.sparkSession.createDataFrame([], "query long, cell long, looked boolean")
    centres = pivots(good)
    inside = staged(placed(good, centres), "nearest-placed")
    cells = [(r.cell, r.radius, r.n) for r in inside.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()]
    bounds = staged(visits(asked, cells, centres, k), "nearest-visits")
    others = inside.select("cell", "id", "v", "x")

    def look(pairs: DataFrame) -> DataFrame:
        return meet(pairs.join(asked.withColumnRenamed("id", "query"), "query").select("cell", F.col("query").alias("id"), "v", "x"), others, ["cell"], _best(k), schema)

    first = staged(_ranked(look(bounds.filter("first").select("query", "cell")), k).select("query", "id", "d", "rank"), "nearest-first")
    # Fewer than k rows met: no bound.
    limit = first.filter(F.col("rank") == k).select("query", F.col("d").alias("limit"))
    after = staged(bounds.join(limit, "query", "left").withColumn("again", ~F.col("first") & (F.col("limit").isNull() | (F.col("floor") <= F.col("limit")))), "nearest-again")
    found = first.drop("rank").unionByName(look(after.filter("again").select("query", "cell")))
    return _ranked(found, k).select("query", "rank", "id", "d"), after.select("query", "cell", (F.col("first") | F.col("again")).alias("looked"))
