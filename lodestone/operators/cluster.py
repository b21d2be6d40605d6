"""Density and linkage clustering by distance joins over grid cells, and nearest rows of a stated query set."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import components
from lodestone.sources.staging import staged


def _cells(points: DataFrame, eps: float) -> DataFrame:
    """Rows (id, x, y, ...) with their cell (cx, cy); rows of one cell are within eps of each other."""
    side = eps / math.sqrt(2) * (1 - 1e-9)
    return points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))


def _met(probes: DataFrame, rows: DataFrame, eps: float) -> DataFrame:
    """JN13: cell rows of probes (their columns end in _p) beside all rows within eps of them, by an equi-join over cells.

    What follows aggregates the pairs where they are made, so that no pair is shuffled.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-2, 3) for j in range(-2, 3)])).alias("d")
    asked = probes.withColumnsRenamed({c: f"{c}_p" for c in probes.columns}).select("*", around)
    asked = asked.withColumn("cx", F.col("cx_p") + F.col("d.dx")).withColumn("cy", F.col("cy_p") + F.col("d.dy")).drop("d")
    far = F.pow(F.col("x_p") - F.col("x"), 2) + F.pow(F.col("y_p") - F.col("y"), 2)
    return asked.join(rows, ["cx", "cy"]).filter(far <= eps * eps)


def _linked_cells(points: DataFrame, eps: float) -> DataFrame:
    """(cx, cy, root): of each cell the smallest id that its rows reach by steps of at most eps."""
    rows = _cells(points, eps).dropna(subset=["cx", "cy"])
    names = rows.groupBy("cx", "cy").agg(F.min("id").alias("name"))
    after = (F.col("cx") > F.col("cx_p")) | ((F.col("cx") == F.col("cx_p")) & (F.col("cy") > F.col("cy_p")))
    pairs = _met(rows, rows, eps).filter(after).groupBy("cx_p", "cy_p", "cx", "cy").agg(F.count("*").alias("n")).drop("n")
    edges = pairs.join(names, ["cx", "cy"]).withColumnRenamed("name", "a").drop("cx", "cy").withColumnsRenamed({"cx_p": "cx", "cy_p": "cy"}).join(names, ["cx", "cy"]).select("a", F.col("name").alias("b"))
    return names.join(components(edges).withColumnRenamed("id", "name"), "name", "left").select("cx", "cy", F.coalesce("root", "name").alias("root"))


def single_linkage(points: DataFrame, limit: float) -> DataFrame:
    """NUM13: clusters of rows linked by steps of at most limit, named by their smallest id (a non-positive limit joins nothing).

    A row without a coordinate is alone.
    """
    if limit <= 0:
        return points.select("id", F.col("id").alias("cluster"))
    return _cells(points, limit).join(_linked_cells(points, limit), ["cx", "cy"], "left").select("id", F.coalesce("root", "id").alias("cluster"))


def dbscan(points: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """NUM14: (id, is_core, cluster): cores count themselves; a cluster is named by its smallest core, -1 is noise.

    All rows of a cell of min_samples rows are cores; only the others count their neighbours. A border row goes to
    the neighbouring cluster with the smallest name, the one discovered first. A row without a coordinate is alone.
    """
    rows = _cells(points.select("id", "x", "y"), eps)
    sizes = rows.groupBy("cx", "cy").agg(F.count("*").alias("size"))
    sized = rows.join(sizes, ["cx", "cy"], "left").withColumn("size", F.coalesce("size", F.lit(1)))
    sparse = sized.filter(F.col("size") < min_samples).drop("size")
    degree = _met(sparse, rows, eps).groupBy(F.col("id_p").alias("id")).agg(F.count("*").alias("n"))
    ids = staged(sized.join(degree, "id", "left").select("id", "x", "y", ((F.col("size") >= min_samples) | (F.coalesce("n", F.lit(0)) >= min_samples)).alias("is_core")), "dbscan-cores")
    cores = ids.filter("is_core").select("id", "x", "y")
    named = _cells(cores, eps).join(_linked_cells(cores, eps), ["cx", "cy"]).select("id", "x", "y", "cx", "cy", F.col("root").alias("cluster"))
    border = _met(_cells(ids.filter("not is_core").select("id", "x", "y"), eps), named, eps).groupBy(F.col("id_p").alias("id")).agg(F.min("cluster").alias("near"))
    joined = ids.join(named.select("id", "cluster"), "id", "left").join(border, "id", "left")
    return joined.select("id", "is_core", F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"))


def union_groups(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """NUM16: (id, group) of all ids under pairs (a, b); a group is named by its smallest member."""
    return ids.join(components(pairs), "id", "left").select("id", F.coalesce("root", "id").alias("group"))


def pair_classes(scored: DataFrame, confirmed: list[tuple[int, int]], n_suspected: int, threshold: float) -> DataFrame:
    """NUM17: pairs (i, j, score) as confirmed, suspected (the best above the threshold) or ignored."""
    known = F.lit(False)
    for i, j in confirmed:
        known = known | ((F.col("i") == i) & (F.col("j") == j))
    marked = scored.withColumn("known", known)
    # A ranking of a stated size: the n best rows of what isn't confirmed.
    best = marked.filter(~F.col("known") & (F.col("score") > threshold)).orderBy(F.desc("score"), "i", "j").limit(n_suspected).select("i", "j", F.lit(True).alias("best"))
    out = F.when(F.col("known"), "confirmed").when(F.col("best"), "suspected").otherwise("ignored")
    return marked.join(best, ["i", "j"], "left").select("i", "j", "score", out.alias("kind"))


#: Queries are broadcast while there are at most so many; beyond that they are dealt into blocks of as many.
QUERIES = 10_000


def nearest(rows: DataFrame, queries: DataFrame, k: int, distance: Column, limit: int = QUERIES) -> DataFrame:
    """JN14: the k nearest rows (id, v) of each of a stated set of queries (query, q), others than itself; ties by id.

    Queries, counted first, go to the rows, in blocks if there are many. Each task keeps a query's k best before
    anything is shuffled (the filter on row_number() becomes a limit by group there).
    """
    blocks = max(1, -(-queries.count() // limit))
    if blocks == 1:
        met = rows.join(F.broadcast(queries), F.col("id") != F.col("query"))
    else:
        dealt = queries.withColumn("block_", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        every = rows.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block_", F.col("block_").cast("long"))
        met = every.join(dealt, "block_").filter(F.col("id") != F.col("query"))
    order = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    return met.select("query", "id", distance.alias("d")).withColumn("rank", order).filter(F.col("rank") <= k).select("query", "rank", "id", "d")
