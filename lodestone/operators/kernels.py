"""Kernel sums over all pairs of rows, block by block, and surrogate scores of whole columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.models import expected_improvement
from lodestone.operators.metric import _matrix, squared, usable
from lodestone.sources.staging import staged

#: Rows of a block at least, and of a piece of its matrix; blocks of the largest label, if none holds more than WIDE bytes of vectors.
#: So each row is written a fixed number of times, until the bound on memory asks for more blocks.
BLOCK, SPLITS, WIDE = 1024, 6, 32 << 20
#: Counting goes on in so many shares of the range that the median lies in, until it is so narrow relative to the largest distance.
SHARES, NARROW = 4096, 1e-15


class Sets:
    """Rows (label, v) of several labels in blocks, and the pairs of blocks that count: a label's with each other and with the target's.

    Pairs are made of names alone, from the labels' sizes (one row a label at the driver); vectors follow them once.
    """

    def __init__(self, rows: DataFrame, target: int, block: int | None = None):
        self.spark, self.target = rows.sparkSession, target
        good = rows.select(F.col("label").cast("long").alias("label"), "v").filter(usable(F.col("v")) & F.col("label").isNotNull())
        sizes = staged(good.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")), "kernel-counts")
        top = sizes.agg(F.max("n").alias("n"), F.max("dim").alias("dim")).first()
        block = block or max(BLOCK, min(-(-(top.n or 0) // SPLITS), WIDE // (8 * (top.dim or 1))))
        many = sizes.select("label", "n", F.ceil(F.col("n") / block).alias("blocks"))
        self.dealt = staged(good.join(many.select("label", "blocks"), "label").withColumn("block", F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), "blocks")).select("label", "block", "v"), "kernel-blocks")
        self.many = staged(many, "kernel-sizes")
        self.n = {r.label: r.n for r in self.many.collect()}
        self.labels = sorted(x for x in self.n if x != target) if target in self.n else []

    def pairs(self, cross: bool, shared: bool = False) -> DataFrame:
        """(for_, p, i, q, j): pairs of blocks for each label but the target, i <= j within one label.

        cross: with the target's blocks too. shared: the target's own pairs stand once, for the target.
        """
        upto = lambda a, n: F.explode(F.sequence(a, n - 1))
        zero, b = F.lit(0).cast("long"), F.col("blocks").cast("long")
        one = self.many.select(F.col("label").alias("p"), b.alias("blocks"), upto(zero, b).alias("i"))
        own = one.select("p", "i", F.col("p").alias("q"), upto(F.col("i"), F.col("blocks")).alias("j"))
        out = own.filter(F.col("p") != self.target).select(F.col("p").alias("for_"), "p", "i", "q", "j")
        base = own.filter(F.col("p") == self.target)
        who = F.lit(self.target).cast("long") if shared else F.explode(F.array(*[F.lit(x).cast("long") for x in self.labels]))
        out = out.unionByName(base.select(who.alias("for_"), "p", "i", "q", "j"))
        if cross:
            target = self.many.filter(F.col("label") == self.target).select(b.alias("tb"))
            # One row.
            met = one.filter(F.col("p") != self.target).crossJoin(F.broadcast(target))
            out = out.unionByName(met.select(F.col("p").alias("for_"), "p", "i", F.lit(self.target).cast("long").alias("q"), upto(zero, F.col("tb")).alias("j")))
        return out

    def over(self, pairs: DataFrame, told: dict, body, schema: str) -> DataFrame:
        """The body's rows for each pair: body(for_, p, q, same, a, b, told of for_) of two matrices."""
        shared, names = self.spark.sparkContext.broadcast(told), [c.split()[0] for c in schema.split(", ")]
        keys = ["for_", "p", "i", "q", "j"]
        left = pairs.join(self.dealt, (F.col("p") == F.col("label")) & (F.col("i") == F.col("block"))).select(*keys, F.lit(0).alias("side"), "v")
        right = pairs.filter("p <> q or i <> j").join(self.dealt, (F.col("q") == F.col("label")) & (F.col("j") == F.col("block"))).select(*keys, F.lit(1).alias("side"), "v")

        def run(t: pa.Table) -> pa.Table:
            f, p, i, q, j = (t[c][0].as_py() for c in keys)
            side, v, same = t["side"].to_numpy(), _matrix(t["v"]), p == q and i == j
            a = v[side == 0]
            b = a if same else v[side == 1]
            found = body(f, p, q, same, a, b, shared.value[f]) if len(a) and len(b) else [[] for _ in names]
            return pa.table({n: pa.array(np.asarray(c, float if n == "total" else np.int64)) for n, c in zip(names, found, strict=True)})

        return left.unionByName(right).groupBy(*keys).applyInArrow(run, schema)


def _squared(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[np.ndarray]:
    """All squared distances of two blocks, in pieces of at most BLOCK rows and columns."""
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            d = squared(a[i : i + BLOCK], b[j : j + BLOCK])
            if same and i == j:
                np.fill_diagonal(d, 0)
            yield d


def _kernel_sum(for_, p, q, same: bool, a: np.ndarray, b: np.ndarray, sigma: float) -> list:
    total = sum(np.exp(d / (-2 * sigma**2)).sum() for d in _squared(a, b, same))
    # A pair of different blocks of one label stands for both orders.
    return [[for_], [p], [q], [float(total if same or p != q else 2 * total)]]


def _compared(sets: Sets, sigmas: dict[int, float], shared: bool) -> DataFrame:
    """(label, sigma, mmd2): the biased estimate of each label's discrepancy from the target, with the label's width."""
    if not sets.labels:
        return sets.spark.createDataFrame([], "label long, sigma double, mmd2 double")
    found = sets.over(sets.pairs(True, shared), sigmas, _kernel_sum, "for_ long, p long, q long, total double")
    sums = {(r.for_, r.p, r.q): r.total for r in found.groupBy("for_", "p", "q").agg(F.sum("total").alias("total")).collect()}  # three a label
    n, t = sets.n, sets.target
    rows = []
    for x in sets.labels:
        base = sums[t if shared else x, t, t]
        rows.append((x, sigmas[x], max(0.0, sums[x, x, x] / n[x] ** 2 + base / n[t] ** 2 - 2 * sums[x, x, t] / (n[x] * n[t]))))
    return sets.spark.createDataFrame(rows, "label long, sigma double, mmd2 double")


def discrepancies(rows: DataFrame, target: int, sigma: float, block: int | None = None) -> DataFrame:
    """NUM10, NUM11: (label, mmd2) of each other label's rows against the target's, of (label, v), by a Gaussian kernel.

    All pairs are summed, block by block, and none is written. The diagonal is kept, so the estimate is the biased one.
    Rows without a label or a usable vector are left out; without rows of the target there is no result.
    """
    sets = Sets(rows, target, block)
    return _compared(sets, dict.fromkeys([*sets.labels, target], float(sigma)), True).select("label", "mmd2")


def _counts(for_, p, q, same: bool, a: np.ndarray, b: np.ndarray, told: list[tuple[float, float]]) -> list:
    """For each range how many of the pairs' squared distances lie below it (-1), in each share of it and beyond it (SHARES)."""
    n = np.zeros((len(told), SHARES + 2), np.int64)
    for d in _squared(a, b, same):
        for k, (low, high) in enumerate(told):
            share = np.clip(np.floor((d.ravel() - low) / (high - low) * SHARES), -1, SHARES).astype(np.int64)
            n[k] += np.bincount(share + 1, minlength=SHARES + 2)
    k, share = np.nonzero(n)
    return [np.full(len(k), for_), k, share - 1, n[k, share] if same else 2 * n[k, share]]


def median_widths(sets: Sets) -> dict[int, float]:
    """NUM10, AGG5: the width of each label: the root of half the median of squared distances within its rows and within the target's.

    Pairs of a row with itself count, each other pair twice. The median is found by counting: the range that holds it is
    cut into shares, each pair of blocks counts its distances in them, and the share that holds the median is the next
    range, until that is as narrow as rounding. Counts leave a task, at most so many a label; no distance does.
    """
    length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    largest = 4 * (sets.dealt.select(F.max(length)).first()[0] or 0.0) * (1 + 1e-9) + 1e-300
    total = {x: sets.n[x] ** 2 + sets.n[sets.target] ** 2 for x in sets.labels}
    # Of each label the two places in the middle, and the range that holds each.
    state = {(x, k): (0.0, largest) for x in sets.labels for k in {(total[x] - 1) // 2, total[x] // 2}}
    found: dict[tuple[int, int], float] = {}
    own = sets.pairs(False)
    while state:
        told: dict[int, list[tuple[float, float]]] = {}
        for (x, _), r in state.items():
            if r not in told.setdefault(x, []):
                told[x].append(r)
        asked = own.filter(F.col("for_").isin(list(told)))
        counted: dict[tuple[int, int], dict[int, int]] = {}
        for r in sets.over(asked, told, _counts, "for_ long, k long, share long, n long").groupBy("for_", "k", "share").agg(F.sum("n").alias("n")).collect():
            counted.setdefault((r.for_, r.k), {})[r.share] = r.n
        after = {}
        for (x, k), (low, high) in state.items():
            shares = counted[x, told[x].index((low, high))]
            below, share = shares.get(-1, 0), 0
            for share in sorted(s for s in shares if s >= 0):
                below += shares[share]
                if k < below:
                    break
            ends = [min(high, low + (share + e) * ((high - low) / SHARES)) for e in (0, 1)]
            if ends[1] - ends[0] <= NARROW * largest or ends == [low, high]:
                found[x, k] = 0.0 if ends[0] == 0 else sum(ends) / 2
            else:
                after[x, k] = tuple(ends)
        state = after
    middle = {x: (found[x, (total[x] - 1) // 2] + found[x, total[x] // 2]) / 2 for x in sets.labels}
    return {x: float(np.sqrt(m / 2)) if m > 1e-12 else 1.0 for x, m in middle.items()}


def median_discrepancies(rows: DataFrame, target: int, block: int | None = None) -> DataFrame:
    """NUM10, JN12, AGG5: (label, sigma, mmd2) as discrepancies(), each label with its own width of the median rule; sets of any size."""
    sets = Sets(rows, target, block)
    return _compared(sets, median_widths(sets), False)


_SCORE = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType()), T.StructField("ei", T.DoubleType())])


def scored(df: DataFrame, inputs: Column, model, best: float) -> DataFrame:
    """NUM19, NUM21, NUM22: mean, deviation and expected improvement of a fitted model at each row's inputs.

    The fitted state is as large as the design it was fitted to, some hundred rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_SCORE)
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.array(part.tolist(), float)
            mean, sd = shared.value.predict(x) if len(x) else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"mean": mean, "sd": sd, "ei": expected_improvement(mean, sd, best)})

    return df.withColumn("score", predict(inputs)).select(*df.columns, "score.mean", "score.sd", "score.ei")


def ranked(found: DataFrame, by: str, name: str) -> DataFrame:
    """TOP4, NUM11: rows of a small table (one a label) with their rank, the smallest value first, ties by name."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(by, name)))
