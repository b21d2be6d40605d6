"""Connected components (union-find groups) of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.staging import staged, unstage


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of links (a, b) reaches, by alternating large and small stars.

    Ids without a link to another id have no row. Every round is written out, so lineage stays short.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small, "stars")
        state = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        unstage(edges)
        edges, same, before = new, state == before, state
        if same:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
