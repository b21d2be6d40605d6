"""Queries of surrogates, kernel discrepancies, designs and searches; those of random or iterative operators have no SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import fits, kernels
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}
BRANIN = [(-5.0, 10.0), (0.0, 15.0)]


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


def branin(x: np.ndarray) -> np.ndarray:
    a = x[:, 1] - 5.1 / (4 * math.pi**2) * x[:, 0] ** 2 + 5 / math.pi * x[:, 0] - 6
    return a * a + 10 * (1 - 1 / (8 * math.pi)) * np.cos(x[:, 0]) + 10


def _design(n: int, seed: int = 0) -> np.ndarray:
    low, high = np.array(BRANIN).T
    return low + models.latin_hypercube(n, 2, seed) * (high - low)


def _inputs():
    return F.array(F.col("p_size") / 50.0 * 15 - 5, (F.col("p_retailprice") - 900) / 1200 * 15)


_MMD = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
k AS (SELECT a.label AS p, b.label AS q, avg(exp(-(list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e)) / 2)) AS m FROM v a, v b GROUP BY 1, 2)
SELECT CAST(p AS BIGINT) AS label, round(greatest(0, (SELECT m FROM k o WHERE o.p = k.p AND o.q = k.p) + (SELECT m FROM k o WHERE o.p = 0 AND o.q = 0) - 2 * m), 6) AS mmd2 FROM k WHERE q = 0 AND p <> 0"""


@query(_MMD)
def source_discrepancies(spark, d):
    """NUM10, NUM11: each label's vectors against those of label 0."""
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return kernels.discrepancies(rows, 0, 1.0).select("label", F.round("mmd2", 6).alias("mmd2"))


_LABEL_MMD = """WITH v AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT x.label AS lx, y.label AS ly, greatest(0, list_dot_product(x.e, x.e) + list_dot_product(y.e, y.e) - 2 * list_dot_product(x.e, y.e)) AS d FROM v x, v y), l AS (SELECT DISTINCT label FROM v WHERE label <> 0),
w AS (SELECT label, CASE WHEN m > 1e-12 THEN sqrt(m / 2) ELSE 1 END AS sigma FROM (SELECT label, median(CASE WHEN d < 1e-12 THEN 0 ELSE d END) AS m FROM l JOIN p ON lx = ly AND (lx = label OR lx = 0) GROUP BY 1)),
k AS (SELECT label, sigma, avg(CASE WHEN lx = label AND ly = label THEN exp(-d / (2 * sigma * sigma)) END) AS xx, avg(CASE WHEN lx = 0 AND ly = 0 THEN exp(-d / (2 * sigma * sigma)) END) AS yy, avg(CASE WHEN lx = label AND ly = 0 THEN exp(-d / (2 * sigma * sigma)) END) AS xy FROM w, p GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS label, round(sigma, 6) AS sigma, round(greatest(0, xx + yy - 2 * xy), 6) AS mmd2 FROM k"""


@query(_LABEL_MMD)
def label_discrepancies(spark, d):
    """NUM10, JN12: each label's vectors against those of label 0, each with the width of the median rule."""
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return kernels.median_discrepancies(rows, 0).select("label", F.round("sigma", 6).alias("sigma"), F.round("mmd2", 6).alias("mmd2"))


@query(f"SELECT label, mmd2, row_number() OVER (ORDER BY mmd2, label) AS rank FROM ({_MMD})")
def ranked_sources(spark, d):
    """TOP4, NUM11: labels by how little they differ from label 0."""
    return kernels.ranked(source_discrepancies(spark, d), "mmd2", "label").withColumn("rank", F.col("rank").cast("long"))


@query("""WITH v AS (SELECT s_nationkey % 5 AS label, s_acctbal AS a, CAST(s_suppkey AS DOUBLE) AS b FROM supplier), p AS (SELECT x.label AS lx, y.label AS ly, (x.a - y.a) ** 2 + (x.b - y.b) ** 2 AS d FROM v x, v y), l AS (SELECT DISTINCT label FROM v WHERE label <> 0),
w AS (SELECT label, CASE WHEN m > 1e-12 THEN sqrt(m / 2) ELSE 1 END AS sigma FROM (SELECT label, median(d) AS m FROM l JOIN p ON lx = ly AND (lx = label OR lx = 0) GROUP BY 1)),
k AS (SELECT label, sigma, avg(CASE WHEN lx = label AND ly = label THEN exp(-d / (2 * sigma * sigma)) END) AS xx, avg(CASE WHEN lx = 0 AND ly = 0 THEN exp(-d / (2 * sigma * sigma)) END) AS yy, avg(CASE WHEN lx = label AND ly = 0 THEN exp(-d / (2 * sigma * sigma)) END) AS xy FROM w, p GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS label, round(sigma, 4) AS sigma, round(greatest(0, xx + yy - 2 * xy), 6) AS mmd2 FROM k""")
def median_rule_discrepancies(spark, d):
    """NUM10, JN12: shelves of suppliers against shelf 0, each with the width of the median rule."""
    rows = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("label"), F.array(F.col("s_acctbal").cast("double"), F.col("s_suppkey").cast("double")).alias("v"))
    out = kernels.median_discrepancies(rows, 0)
    return out.select("label", F.round("sigma", 4).alias("sigma"), F.round("mmd2", 6).alias("mmd2"))


@query("""WITH d AS (SELECT p_brand AS g, CAST(p_size AS DOUBLE) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1, 2), n AS (SELECT g, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM d WINDOW w AS (PARTITION BY g ORDER BY x))
SELECT p_partkey, round(y + (p_size + 0.3141592 - x) * (y2 - y) / (x2 - x), 4) AS mean FROM part JOIN n ON p_brand = g AND p_size = x WHERE x2 IS NOT NULL""")
def radial_by_brand(spark, d):
    """NUM21: a model of each brand's mean prices by size, asked between the sizes. With a linear kernel of one input it is the broken line."""
    part = table(spark, d, "part").withColumn("x", F.col("p_size").cast("double"))
    states = fits.fit(part.select(F.col("p_brand").alias("group"), F.array("x").alias("x"), F.col("p_retailprice").alias("y")), lambda: models.Radial("linear"))
    last = part.groupBy("p_brand").agg(F.max("x").alias("last"))
    asked = part.join(last, "p_brand").filter("x < last").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id"), F.array(F.col("x") + 0.3141592).alias("x"))
    return fits.predict(states, asked).select(F.col("id").alias("p_partkey"), F.round("mean", 4).alias("mean"))


def _charges(spark, d):
    """What a unit line costs after discount and tax, by supplier."""
    l = table(spark, d, "lineitem")
    y = F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    id_ = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    return l.select("l_returnflag", "l_linestatus", F.col("l_suppkey").alias("group"), id_.alias("id"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")).alias("x"), y.cast("double").alias("y"))


@query(None)
def kriging_by_supplier(spark, d):
    """NUM18, NUM19, NUM22, NUM27: a Kriging model of each supplier's charges from sixty of its lines, and how well it tells all of them."""
    rows = _charges(spark, d)
    states = fits.fit(rows.select("group", "x", "y"), lambda: models.Kriging(sweeps=2, steps=12, starts=2), 60)
    found = fits.predict(states, rows)
    counted = found.groupBy("group").agg(F.avg("sd").alias("mean_sd"), F.max("ei").alias("best_ei"))
    return fits.explained(found).join(counted, "group").select(F.col("group").cast("long").alias("l_suppkey"), "n", "r2", "mean_sd", "best_ei")


@query(None)
def two_fidelity_by_flag(spark, d):
    """NUM26: charges by return flag and status; sixty coarse lines without tax, and a dozen fine ones."""
    rows = _charges(spark, d).select(F.concat("l_returnflag", "l_linestatus").alias("group"), "id", "x", "y")
    coarse = rows.select("group", F.lit(1).alias("level"), "x", (F.get("x", F.lit(0)) * (1 - F.get("x", F.lit(1))) * 0.8 + 3).alias("y"))
    # The finer lines are fewer: those of the smallest hashes.
    fine = fits.designs(rows.withColumn("level", F.lit(0)), 12).select("group", "level", "x", "y")
    states = fits.fit(fits.designs(coarse, 60).select("group", "level", "x", "y").unionByName(fine), lambda: models.CoKriging(grid=np.linspace(0, 2, 9)), 60)
    return fits.explained(fits.predict(states, rows)).withColumnRenamed("group", "flag")


@query(None)
def kriging_scores(spark, d):
    """NUM18, NUM19, NUM22: a model of 40 design points at every part."""
    x = _design(40)
    y = branin(x)
    return kernels.scored(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), _inputs(), models.Kriging().fit(x, y), float(y.min())).select("p_partkey", "mean", "sd", "ei")


@query(None)
def radial_scores(spark, d):
    """NUM21."""
    x = _design(60, 1)
    y = branin(x)
    return kernels.scored(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), _inputs(), models.Radial().fit(x, y), float(y.min())).select("p_partkey", "mean")


@query(None)
def two_fidelity_scores(spark, d):
    """NUM26: coarse responses are a scaled and shifted form of the fine ones."""
    coarse, fine = _design(40, 2), _design(12, 3)
    model = models.CoKriging(grid=np.linspace(0, 2, 9)).fit(coarse, 0.5 * branin(coarse) + coarse.sum(1), fine, branin(fine))
    return kernels.scored(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), _inputs(), model, float(branin(fine).min())).select("p_partkey", "mean", "sd")


@query(None)
def ensemble_scores(spark, d):
    """NUM28: Co-Kriging with local models where fine points are dense."""
    coarse, fine = _design(40, 2), _design(10, 3)
    model = models.Ensemble().fit(coarse, 0.5 * branin(coarse) + coarse.sum(1), fine, branin(fine))
    return kernels.scored(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), _inputs(), model, float(branin(fine).min())).select("p_partkey", "mean", "sd")
