"""Pareto fronts, crowding, hypervolume and distances of fronts; all objectives are minimised."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranges import least_before, neighbours, numbered
from lodestone.sources.staging import staged, unstage

TINY = 1e-12
#: Shares whose own fronts are found first.
SHARES = 64
#: Points that are ranked in one round, and compared with each other in one task.
ROUND = 8192


def dominates(a: list[Column], b: list[Column]) -> Column:
    """NUM4: no objective is worse and one is better."""
    both = list(zip(a, b, strict=True))
    return reduce(lambda x, y: x & y, [p <= q for p, q in both]) & reduce(lambda x, y: x | y, [p < q for p, q in both])


def _survivors(points: DataFrame, keys: list[str]) -> DataFrame:
    """Different (f1, f2) of each key that no point of the key dominates, by one scan in order of f1."""
    least = points.groupBy(*keys, "f1").agg(F.min("f2").alias("f2"))
    found = least_before(least, keys, ["f1"], "f2", "before_")
    return found.filter(F.col("before_").isNull() | (F.col("f2") < F.col("before_"))).drop("before_")


def pareto_front(df: DataFrame, f1: Column, f2: Column, keys: list[str] | None = None) -> DataFrame:
    """NUM6 in two objectives: all rows on the front of their key, duplicates kept; rows with a null objective are left out."""
    keys = keys or []
    points = df.withColumn("f1", f1).withColumn("f2", f2).filter("f1 is not null and f2 is not null")
    return points.join(_survivors(points, keys), [*keys, "f1", "f2"])


def _beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points any of the others dominates."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(points), 256):
        p = points[at : at + 256, None, :]
        for k in range(0, len(by), 4096):
            q = by[None, k : k + 4096]
            out[at : at + 256] |= ((q <= p).all(2) & (q < p).any(2)).any(1)
    return out


def minimal(points: np.ndarray) -> np.ndarray:
    """The different points that no other dominates: in lexicographic order, a point is dominated by earlier ones only."""
    points = np.unique(points, axis=0)
    kept: list[np.ndarray] = []
    for at in range(0, len(points), 1024):
        part = points[at : at + 1024]
        for k in kept:
            part = part[~_beaten(part, k)]
        kept.append(part[~_beaten(part, part)])
    return np.concatenate(kept) if kept else points


def _undominated(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of rows of n objectives those that no other row of the partition dominates, kept as they come."""
    kept = np.zeros((0, n))
    for b in batches:
        kept = minimal(np.concatenate([kept, np.column_stack([b.column(k).to_numpy() for k in range(n)])]))
    yield pa.RecordBatch.from_arrays([pa.array(kept[:, k]) for k in range(n)], names=[f"f{k}" for k in range(n)])


def _objectives(df: DataFrame, objectives: list[Column]) -> tuple[DataFrame, list[str]]:
    """df with its objectives f0, f1, ... as doubles; rows with a null or NaN one are left out."""
    names = [f"f{k}" for k in range(len(objectives))]
    return df.select("*", *[o.cast("double").alias(c) for o, c in zip(objectives, names, strict=True)]).dropna(subset=names), names


def skyline(df: DataFrame, objectives: list[Column]) -> DataFrame:
    """NUM4, NUM6 in any number of objectives: all rows that no row dominates, duplicates kept, null objectives left out.

    Shares of the different points give their own fronts. What is left is dealt into shares by the sum of the
    objectives; a point asks only those shares whose best values could dominate it, so the fronts are never in one place.
    """
    rows, names = _objectives(df, objectives)
    n = len(objectives)
    schema = ", ".join(f"{c} double" for c in names)
    local = staged(rows.select(*names).distinct().mapInArrow(lambda it: _undominated(it, n), schema), "fronts")
    total = reduce(lambda a, b: a + b, [F.col(c) for c in names])
    bounds = sorted(set(local.select(total.alias("s")).approxQuantile("s", [k / SHARES for k in range(1, SHARES)], 0.002)))
    share = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<double>"), lambda b: b <= total)).cast("long")
    local = staged(local.select(*names, share.alias("share")), "fronts-shared")
    best = [r for r in local.groupBy("share").agg(*[F.min(c).alias(c) for c in names]).collect()]
    told = F.array(*[F.struct(F.lit(r.share).alias("share"), *[F.lit(r[c]).alias(c) for c in names]) for r in best]) if best else None
    if told is None:
        return rows.select(*df.columns, *names)
    could = F.filter(told, lambda s: reduce(lambda a, b: a & b, [s[c] <= F.col(c) for c in names]))
    asked = local.drop("share").withColumn("share", F.explode(F.transform(could, lambda s: s["share"])))
    other = local.select(*[F.col(c).alias(f"o{k}") for k, c in enumerate(names)], F.col("share").alias("share_"))
    worse = dominates([F.col(f"o{k}") for k in range(n)], [F.col(c) for c in names])
    beaten = asked.join(other, (asked["share"] == other["share_"]) & worse, "left_semi").select(*names).distinct()
    return rows.join(local.drop("share").distinct().join(beaten, names, "left_anti"), names).select(*df.columns, *names)


def _ranked(points: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Ranks of points in lexicographic order: one more than the highest rank of what dominates them, base at least."""
    out = base.copy()
    for at in range(0, len(points), 128):
        part = points[at : at + 128]
        if at:
            for k in range(0, at, 4096):
                q, r = points[k : min(at, k + 4096)], out[k : min(at, k + 4096)]
                over = (q[None] <= part[:, None]).all(2)
                out[at : at + 128] = np.maximum(out[at : at + 128], np.where(over, r[None] + 1, 0).max(1))
        for i in range(1, len(part)):
            over = (part[:i] <= part[i]).all(1)
            if over.any():
                out[at + i] = max(out[at + i], out[at : at + i][over].max() + 1)
    return out


def front_ranks(df: DataFrame, objectives: list[Column], size: int | None = None) -> DataFrame:
    """NUM5 in any number of objectives: all rows with f0, f1, ... and front, from 0; null objectives left out, duplicates alike.

    A point's rank is one more than the highest rank of the points that dominate it, all of which come before it in
    lexicographic order. The different points are ranked in that order in rounds of at most so many: those ranked before
    are asked side by side for the highest rank that dominates each of the round's, which then are compared with each
    other. Of a front's points before a round only those matter that no other of them beats in the objectives but the first.
    """
    size = size or ROUND
    rows, names = _objectives(df, objectives)
    spark, n = df.sparkSession, len(objectives)
    points = staged(numbered(rows.select(*names).distinct(), names, "number").withColumn("round", F.expr(f"number div {size}")), "front-points")
    rounds = points.agg(F.max("round")).first()[0]
    if rounds is None:
        return rows.withColumn("front", F.lit(0))
    schema = ", ".join(f"{c} double" for c in names) + ", front int"
    matter, done = None, []

    def thinned(t: pa.Table) -> pa.Table:
        kept = minimal(np.column_stack([t[c].to_numpy() for c in names[1:]])) if n > 1 else np.zeros((1, 0))
        columns = {names[0]: pa.array(np.full(len(kept), -np.inf))} | {c: pa.array(kept[:, k]) for k, c in enumerate(names[1:])}
        return pa.table(columns | {"front": pa.array(np.full(len(kept), t["front"][0].as_py()), pa.int32())})

    for r in range(rounds + 1):
        now = points.filter(F.col("round") == r)
        base = None
        if matter is not None:
            asked = now.orderBy("number").select("number", *names).collect()
            shared = spark.sparkContext.broadcast(np.array([tuple(x)[1:] for x in asked], float).reshape(-1, n))
            first = asked[0].number

            def over(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
                new = shared.value
                best = np.zeros(len(new), np.int32)
                for b in batches:
                    old, front = np.column_stack([b.column(k).to_numpy() for k in range(n)]), b.column(n).to_numpy()
                    for at in range(0, len(new), 512):
                        for k in range(0, len(old), 2048):
                            met = (old[None, k : k + 2048] <= new[at : at + 512, None]).all(2)
                            best[at : at + 512] = np.maximum(best[at : at + 512], np.where(met, front[None, k : k + 2048] + 1, 0).max(1))
                on = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(on + first, pa.int64()), pa.array(best[on], pa.int32())], names=["number", "base"])

            base = matter.mapInArrow(over, "number long, base int").groupBy("number").agg(F.max("base").alias("base"))
        joined = now.withColumn("base", F.lit(0)) if base is None else now.join(base, "number", "left").withColumn("base", F.coalesce("base", F.lit(0)))

        def resolve(t: pa.Table) -> pa.Table:
            t = t.sort_by("number")
            x = np.column_stack([t[c].to_numpy() for c in names])
            ranks = _ranked(x, t["base"].to_numpy().astype(np.int32))
            return pa.table({c: t[c] for c in names} | {"front": pa.array(ranks, pa.int32())})

        found = staged(joined.select("number", "round", "base", *names).groupBy("round").applyInArrow(resolve, schema), "front-ranks")
        done.append(found)
        if r < rounds:
            both = found if matter is None else matter.unionByName(found)
            after = staged(both.withColumn("share", F.pmod(F.xxhash64(*names[1:], F.lit(0)), F.lit(max(SHARES, r + 1)))).groupBy("front", "share").applyInArrow(thinned, schema), "front-matter")
            if matter is not None:
                unstage(matter)
            matter = after
    return rows.join(reduce(DataFrame.unionByName, done), names)


def crowding(front: DataFrame, objectives: list[str], order: str, keys: list[str] | None = None) -> DataFrame:
    """WIN7: sum over objectives of the neighbours' distance over the span; boundary rows have null and is_boundary.

    keys: the columns that tell fronts apart, not null, each with its own spans. Two rows or fewer are all boundary; an objective
    of span at most TINY adds nothing. Ties are ordered by a key.
    """
    keys = keys or []
    spans = front.groupBy(*keys).agg(F.count("*").alias("n_"), *[(F.max(c) - F.min(c)).alias(f"span{k}_") for k, c in enumerate(objectives)])
    # Without keys the spans are one row.
    rows = front.join(spans, keys) if keys else front.join(F.broadcast(spans))
    rows = rows.withColumn("crowding", F.lit(0.0)).withColumn("is_boundary", F.col("n_") <= 2)
    for k, c in enumerate(objectives):
        rows = neighbours(rows, keys, [c, order], [c])
        wide, low, high = F.col(f"span{k}_") > TINY, F.col(f"before_.{c}"), F.col(f"after_.{c}")
        rows = rows.withColumn("is_boundary", F.col("is_boundary") | (wide & (low.isNull() | high.isNull())))
        rows = rows.withColumn("crowding", F.col("crowding") + F.when(wide, F.coalesce(high - low, F.lit(0.0)) / F.col(f"span{k}_")).otherwise(0.0)).drop("before_", "after_")
    return rows.withColumn("crowding", F.when(~F.col("is_boundary"), F.col("crowding"))).select(*front.columns, "is_boundary", "crowding")


def hypervolume(front: DataFrame, ref: tuple[float, float]) -> DataFrame:
    """NUM7 over the rows of a front: area to the reference point, clamped at 0 in total only."""
    steps = neighbours(front.select("f1", "f2").distinct(), [], ["f1"], ["f1"])
    width = F.coalesce(F.col("after_.f1"), F.lit(ref[0])) - F.col("f1")
    return steps.agg(F.greatest(F.lit(0.0), F.coalesce(F.sum(width * (ref[1] - F.col("f2"))), F.lit(0.0))).alias("hypervolume"))


def spread(front: DataFrame, objectives: list[str] | None = None) -> DataFrame:
    """WIN10: deviation over mean of the gaps between neighbours along the first objective; fewer than three rows give 0."""
    objectives = objectives or ["f1", "f2"]
    rows = neighbours(front.select(*objectives), [], objectives, objectives)
    gap = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f"after_.{c}") - F.col(c), 2) for c in objectives]))
    s = rows.select(gap.alias("gap")).agg(F.count("*").alias("n"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    return s.select(F.when((F.col("n") < 3) | (F.col("m") <= TINY), 0.0).otherwise(F.col("s") / F.col("m")).alias("spread"))


def igd(points: DataFrame, reference: list[tuple[float, float]]) -> DataFrame:
    """NUM9: mean over the stated reference points of the distance to the nearest row; null without rows."""
    refs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(reference)])
    far = points.select("f1", "f2", F.explode(refs).alias("r")).groupBy("r.i").agg(F.min(F.sqrt(F.pow(F.col("f1") - F.col("r.a"), 2) + F.pow(F.col("f2") - F.col("r.b"), 2))).alias("d"))
    return far.agg(F.avg("d").alias("igd"))
