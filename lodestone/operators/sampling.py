"""Designs and draws over the rows of a table: strata, batches and covered shares, by hashes, so that they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranges import least_before, numbered


def digest(*parts: Column | str) -> Column:
    """The SHA-256 of parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"), 256)


def uniform(hashed: Column, k: int = 0) -> Column:
    """A number in [0, 1) from the k-th eight digits of a digest."""
    return F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("double") / 4294967296


def latin(df: DataFrame, key: str, dims: int, seed: int = 0) -> DataFrame:
    """NUM1, WIN13: (key, dim, stratum, x): each row is a point; in each dimension each of as many strata as rows has one.

    Strata are given in the order of hashes, found over ranges of rows; x lies in its stratum where the hash puts it.
    Keys are unique.
    """
    n = df.count()
    each = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))
    each = each.withColumn("h_", digest(F.lit(seed), F.col("dim"), F.col(key)))
    placed = numbered(each, ["dim", "h_", key], "at_").withColumn("stratum", F.col("at_") - F.col("dim").cast("long") * n)
    return placed.select(key, "dim", "stratum", ((F.col("stratum") + uniform(F.reverse("h_"))) / n).alias("x"))


def batches(df: DataFrame, key: str, label: str, per_batch: dict, n: int, seed: int = 0) -> DataFrame:
    """NUM12: (batch, label, key): of each label so many rows a batch, drawn without replacement within it, by hashes.

    per_batch: label to number; rows of other labels are left out, and a label with fewer rows gives all it has. Before
    anything is shuffled each task keeps a batch's best rows only (a limit by group).
    """
    many = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in per_batch.items()])
    rows = df.select(key, label, many.alias("many_")).filter("many_ is not null")
    drawn = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("h_", digest(F.lit(seed), F.col("batch"), F.col(key)))
    order = F.row_number().over(Window.partitionBy("batch", label).orderBy("h_", key))
    return drawn.withColumn("k_", order).filter(F.col("k_") <= max(per_batch.values())).filter("k_ <= many_").select("batch", label, key)


def covered(points: DataFrame, front: DataFrame) -> DataFrame:
    """NUM8: (share): of points (f1, f2) the share that a row of the front (f1, f2) is no worse than, by one scan in order of f1."""
    both = points.select("f1", "f2", F.lit(None).cast("double").alias("front_"), F.lit(1).alias("kind_")).unionByName(front.select("f1", "f2", F.col("f2").cast("double").alias("front_"), F.lit(0).alias("kind_")))
    met = least_before(both, [], ["f1", "kind_"], "front_", "least_").filter("kind_ = 1")
    return met.agg(F.avg(F.coalesce(F.col("least_") <= F.col("f2"), F.lit(False)).cast("double")).alias("share"))


def control_grid(boxes: DataFrame, keys: list[str], axes: list[tuple[str, str, int]]) -> DataFrame:
    """JN16: keys and i0, u0, i1, u1, ...: the control points of each row's box, n + 1 evenly from low to high on each axis (low, high, n)."""
    out = boxes
    for k, (_, _, n) in enumerate(axes):
        out = out.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.lit(n))))
    places = [(F.col(low) + (F.col(high) - F.col(low)) * F.col(f"i{k}") / F.lit(float(n))).alias(f"u{k}") for k, (low, high, n) in enumerate(axes)]
    return out.select(*keys, *[f"i{k}" for k in range(len(axes))], *places)
