"""Queries of improvements, designs, draws and refits over the rows of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import models, normal
from lodestone.operators import fits, pareto, sampling
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


_BELOW, _DENSITY = normal.below_sql("u"), normal.density_sql("u")
#: Prices as means, sizes as deviations, none for every seventh part.
_MEANS = "m AS (SELECT p_partkey, p_brand, p_retailprice AS y, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_size * 3.0 END AS sd FROM part)"


def _means(spark, d):
    sd = F.when(F.col("p_partkey") % 7 == 0, 0.0).otherwise(F.col("p_size") * 3.0)
    return table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("size"), sd.alias("sd"))


@query(f"""WITH {_MEANS}, b AS (SELECT *, 950.0 AS best FROM m), n AS (SELECT *, CASE WHEN sd > 1e-12 THEN (best - y) / sd ELSE 0 END AS u FROM b), f AS (SELECT *, {_BELOW} AS m0, -{_DENSITY} AS m1 FROM n), g AS (SELECT *, -u * -m1 + m0 AS m2, -u * u * -m1 + 2 * m1 AS m3 FROM f)
SELECT p_partkey, CASE WHEN sd > 1e-12 THEN round(greatest(0, (best - y) * m0 + sd * -m1), 6) ELSE 0 END AS ei, CASE WHEN sd > 1e-12 THEN round(greatest(0, sd ** 2 * (u * u * m0 - 2 * u * m1 + m2)), 5) ELSE 0 END AS second, CASE WHEN sd > 1e-12 THEN round(greatest(0, sd ** 3 * (u ** 3 * m0 - 3 * u * u * m1 + 3 * u * m2 - m3)), 3) ELSE 0 END AS third FROM g""")
def improvement_scores(spark, d):
    """MTH12, NUM22, NUM23: the expected improvement of each part, and its generalised forms of orders two and three."""
    m, best = _means(spark, d), F.lit(950.0)
    of = lambda g: normal.generalised(F.col("y"), F.col("sd"), best, g)
    return m.select("p_partkey", F.round(normal.improvement(F.col("y"), F.col("sd"), best), 6).alias("ei"), F.round(of(2), 5).alias("second"), F.round(of(3), 3).alias("third"))


@query(f"""WITH {_MEANS}, s AS (SELECT p_brand, min(y) AS best, median(y) AS middle, arg_min([size, y / 10], (y, p_partkey)) AS inc FROM m GROUP BY 1), j AS (SELECT m.*, best, middle, best + 0.1 * (middle - best) AS goal, sqrt((size - inc[1]) ** 2 + (y / 10 - inc[2]) ** 2) AS far FROM m JOIN s USING (p_brand)),
e AS (SELECT *, CASE WHEN sd > 1e-12 THEN (best - y) / sd ELSE 0 END AS u FROM j), e2 AS (SELECT * EXCLUDE (u), CASE WHEN sd > 1e-12 THEN round(greatest(0, (best - y) * {_BELOW} + sd * {_DENSITY}), 9) ELSE 0 END AS ei, CASE WHEN sd > 1e-12 THEN (goal - y) / sd ELSE 0 END AS u FROM e),
e3 AS (SELECT *, CASE WHEN sd > 1e-12 THEN round(greatest(0, (goal - y) * {_BELOW} + sd * {_DENSITY}), 9) ELSE 0 END AS cei FROM e2), e4 AS (SELECT *, CASE WHEN far > 1e-3 AND far <= 20 THEN 0 ELSE cei END AS rei FROM e3),
p AS (SELECT p_brand, any_value(middle) AS middle, arg_min((p_partkey, y), (-ei, p_partkey)) AS a, arg_min(p_partkey, (-cei, p_partkey)) AS c, arg_min(p_partkey, (-rei, p_partkey)) AS r FROM e4 GROUP BY 1)
SELECT p_brand, CASE WHEN a[2] <= middle THEN 'EI+REI' ELSE 'CEI+REI' END AS mode, CASE WHEN a[2] <= middle THEN a[1] ELSE c END AS first, r AS second FROM p""")
def improvement_choice(spark, d):
    """NUM29, NUM30: of each brand the two parts that the calibrated step asks for."""
    m = _means(spark, d)
    x = F.array("size", F.col("y") / 10)
    s = m.groupBy("p_brand").agg(F.min("y").alias("best"), F.median("y").alias("middle"), F.min_by(x, F.struct("y", "p_partkey")).alias("at"))
    j = m.join(s, "p_brand")
    gain = lambda goal: F.round(normal.improvement(F.col("y"), F.col("sd"), goal), 9)
    cei = gain(F.col("best") + 0.1 * (F.col("middle") - F.col("best")))
    scored = j.select("p_brand", "p_partkey", "y", "middle", gain(F.col("best")).alias("ei"), cei.alias("cei"), normal.restrained(cei, x, F.col("at"), 20.0).alias("rei"))
    first = lambda c, v: F.min_by(v, F.struct(-F.col(c), F.col("p_partkey")))
    picks = scored.groupBy("p_brand").agg(F.first("middle").alias("middle"), first("ei", F.struct("p_partkey", "y")).alias("a"), first("cei", F.col("p_partkey")).alias("c"), first("rei", F.col("p_partkey")).alias("r"))
    plain = F.col("a.y") <= F.col("middle")
    return picks.select("p_brand", F.when(plain, "EI+REI").otherwise("CEI+REI").alias("mode"), F.when(plain, F.col("a.p_partkey")).otherwise(F.col("c")).alias("first"), F.col("r").alias("second"))


@query("""WITH e AS (SELECT c_custkey, dim, sha256('3:' || dim || ':' || c_custkey) AS h FROM customer, range(4) t(dim)), s AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY h, c_custkey) - 1 AS stratum, count(*) OVER (PARTITION BY dim) AS n FROM e)
SELECT c_custkey, CAST(dim AS INT) AS dim, stratum, round((stratum + ('0x' || left(reverse(h), 8))::BIGINT / 4294967296.0) / n, 9) AS x FROM s""")
def hypercube_strata(spark, d):
    """NUM1, WIN13: customers as the points of a Latin hypercube of four dimensions."""
    return sampling.latin(table(spark, d, "customer"), "c_custkey", 4, 3).withColumn("x", F.round("x", 9))


@query("""WITH e AS (SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 8 WHEN 'MACHINERY' THEN 16 END AS many, batch, sha256('5:' || batch || ':' || c_custkey) AS h FROM customer, range(10) t(batch)), k AS (SELECT *, row_number() OVER (PARTITION BY batch, c_mktsegment ORDER BY h, c_custkey) AS k FROM e WHERE many IS NOT NULL)
SELECT CAST(batch AS INT) AS batch, c_mktsegment, c_custkey FROM k WHERE k <= many""")
def stratified_batches(spark, d):
    """NUM12: ten batches of customers, so many of either segment."""
    return sampling.batches(table(spark, d, "customer"), "c_custkey", "c_mktsegment", {"BUILDING": 8, "MACHINERY": 16}, 10, 5)


@query("""WITH p AS (SELECT p_retailprice AS f1, -CAST(p_size AS DOUBLE) AS f2 FROM part), f AS (SELECT DISTINCT f1, f2 FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2))), h AS (SELECT sha256('11:' || o_orderkey) AS h FROM orders),
q AS (SELECT 900 + 300 * (('0x' || h[1:8])::BIGINT / 4294967296.0) AS f1, -60 + 60 * (('0x' || h[9:16])::BIGINT / 4294967296.0) AS f2 FROM h) SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.f1 <= q.f1 AND f.f2 <= q.f2) THEN 1.0 ELSE 0.0 END) * 300 * 60, 6) AS area FROM q""")
def sampled_hypervolume(spark, d):
    """NUM8: the area that the front of parts covers of a box, by as many points as there are orders."""
    h = sampling.digest(F.lit(11), F.col("o_orderkey"))
    points = table(spark, d, "orders").select((900 + 300 * sampling.uniform(h)).alias("f1"), (-60 + 60 * sampling.uniform(h, 1)).alias("f2"))
    front = pareto.pareto_front(table(spark, d, "part").select("p_retailprice", "p_size"), F.col("p_retailprice"), -F.col("p_size").cast("double"))
    return sampling.covered(points, front).select(F.round(F.col("share") * 300 * 60, 6).alias("area"))


@query("""WITH d AS (SELECT p_brand AS g, CAST(p_size AS DOUBLE) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1, 2), n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY g) AS n, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2,
 nth_value(x, 2) OVER a AS s1, nth_value(y, 2) OVER a AS t1, first_value(x) OVER a AS s0, first_value(y) OVER a AS t0, first_value(x) OVER z AS e0, first_value(y) OVER z AS u0, nth_value(x, 2) OVER z AS e1, nth_value(y, 2) OVER z AS u1 FROM d WINDOW w AS (PARTITION BY g ORDER BY x), a AS (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), z AS (PARTITION BY g ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT g, y, CASE WHEN k = 1 THEN t1 + (x - s1) * (u0 - t1) / (e0 - s1) WHEN k = n THEN t0 + (x - s0) * (u1 - t0) / (e1 - s0) ELSE y0 + (x - x0) * (y2 - y0) / (x2 - x0) END AS m FROM n)
SELECT g AS p_brand, count(*) AS n, round(sqrt(avg((m - y) ** 2)), 4) AS rmse FROM e GROUP BY 1""")
def left_out_by_brand(spark, d):
    """NUM20: how far the broken line through each brand's mean prices by size misses a size that it hasn't seen; beyond its ends it is the line through them."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("group"), F.array(F.col("p_size").cast("double")).alias("x"), F.col("p_retailprice").alias("y"))
    return fits.left_out(part, lambda: models.Radial("linear")).select(F.col("group").alias("p_brand"), "n", F.round("rmse", 4).alias("rmse"))


@query("""WITH b AS (SELECT c_nationkey, min(c_acctbal) AS l0, max(c_acctbal) AS h0, CAST(min(c_custkey) AS DOUBLE) AS l1, CAST(max(c_custkey) AS DOUBLE) AS h1 FROM customer GROUP BY 1)
SELECT c_nationkey, CAST(i AS INT) AS i0, CAST(j AS INT) AS i1, round(l0 + (h0 - l0) * i / 5.0, 6) AS u0, round(l1 + (h1 - l1) * j / 4.0, 6) AS u1 FROM b, range(6) s(i), range(5) t(j)""")
def control_grid(spark, d):
    """JN16: 6 x 5 control points over the box of each nation's customers."""
    boxes = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("l0"), F.max("c_acctbal").alias("h0"), F.min("c_custkey").cast("double").alias("l1"), F.max("c_custkey").cast("double").alias("h1"))
    grid = sampling.control_grid(boxes, ["c_nationkey"], [("l0", "h0", 5), ("l1", "h1", 4)])
    return grid.select("c_nationkey", "i0", "i1", F.round("u0", 6).alias("u0"), F.round("u1", 6).alias("u1"))
