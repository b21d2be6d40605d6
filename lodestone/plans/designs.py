"""Queries of Pareto, clustering, neighbour, group and test-function operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import testbed
from lodestone.operators import cluster, metric, pareto, stats
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")


_F = "SELECT p_partkey, p_brand, p_retailprice AS f1, -CAST(p_size AS DOUBLE) AS f2 FROM part"
_FRONT = f"p AS ({_F}), front AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2)))"
_REF = [(x / 20, 1 - (x / 20) ** 2) for x in range(21)]


def _front(spark, d, keys=None):
    return pareto.pareto_front(_parts(spark, d), F.col("p_retailprice"), -F.col("p_size").cast("double"), keys)


@query(f"WITH {_FRONT} SELECT p_partkey, f1, f2 FROM front")
def pareto_front_part(spark, d):
    """NUM6: cheap and large parts."""
    return _front(spark, d).select("p_partkey", "f1", "f2")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS f0, -l_quantity AS f1, l_discount AS f2 FROM lineitem WHERE l_returnflag = 'R'), x AS (SELECT DISTINCT f0, f1, f2 FROM p), g AS (SELECT f1, f2, min(f0) AS f0 FROM x GROUP BY 1, 2)
SELECT p.* FROM p JOIN (SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.f0 <= a.f0 AND b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f0 < a.f0 OR b.f1 < a.f1 OR b.f2 < a.f2))) s ON p.f0 = s.f0 AND p.f1 = s.f1 AND p.f2 = s.f2""")
def skyline_lineitem(spark, d):
    """NUM4, NUM6: cheap, large and undiscounted lines that came back, in three objectives."""
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("c"))
    return pareto.skyline(rows, [F.col("p"), -F.col("q"), F.col("c")]).select("l_orderkey", "l_linenumber", "f0", "f1", "f2")


@query(f"WITH p AS ({_F}) SELECT p_partkey, p_brand, f1, f2 FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_brand = a.p_brand AND b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2))")
def pareto_front_by_brand(spark, d):
    """NUM6 by key."""
    return _front(spark, d, ["p_brand"]).select("p_partkey", "p_brand", "f1", "f2")


@query("""WITH RECURSIVE v AS (SELECT s_suppkey, round(s_acctbal, -2) AS f1, CAST(s_nationkey AS DOUBLE) AS f2 FROM supplier),
p AS (SELECT DISTINCT f1, f2 FROM v), t(f1, f2, r) AS (SELECT f1, f2, 0 FROM p UNION SELECT b.f1, b.f2, r + 1 FROM t JOIN p b ON t.f1 <= b.f1 AND t.f2 <= b.f2 AND (t.f1 < b.f1 OR t.f2 < b.f2)), m AS (SELECT f1, f2, max(r) AS front FROM t GROUP BY 1, 2)
SELECT s_suppkey, front FROM v JOIN m USING (f1, f2)""")
def front_ranks_supplier(spark, d):
    """NUM5 over balances in hundreds and nations."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return pareto.front_ranks(s, [F.round("s_acctbal", -2), F.col("s_nationkey")]).select("s_suppkey", "front")


@query("""WITH RECURSIVE v AS (SELECT p_partkey, round(p_retailprice, -1) AS f0, -CAST(p_size AS DOUBLE) AS f1, CAST(p_partkey % 13 AS DOUBLE) AS f2 FROM part), p AS (SELECT DISTINCT f0, f1, f2 FROM v),
t(f0, f1, f2, r) AS (SELECT f0, f1, f2, 0 FROM p UNION SELECT b.f0, b.f1, b.f2, r + 1 FROM t JOIN p b ON t.f0 <= b.f0 AND t.f1 <= b.f1 AND t.f2 <= b.f2 AND (t.f0 < b.f0 OR t.f1 < b.f1 OR t.f2 < b.f2)), m AS (SELECT f0, f1, f2, max(r) AS front FROM t GROUP BY 1, 2, 3),
u AS (SELECT v.*, front, count(*) OVER w AS n, """ + ", ".join(f"max(f{k}) OVER w - min(f{k}) OVER w AS s{k}, lag(f{k}) OVER (PARTITION BY front ORDER BY f{k}, p_partkey) AS l{k}, lead(f{k}) OVER (PARTITION BY front ORDER BY f{k}, p_partkey) AS h{k}" for k in range(3)) + """ FROM v JOIN m USING (f0, f1, f2) WINDOW w AS (PARTITION BY front)),
e AS (SELECT *, n <= 2 OR """ + " OR ".join(f"(s{k} > 1e-12 AND (l{k} IS NULL OR h{k} IS NULL))" for k in range(3)) + " AS edge FROM u) SELECT p_partkey, front, edge AS is_boundary, CASE WHEN NOT edge THEN round(" + " + ".join(f"CASE WHEN s{k} > 1e-12 THEN coalesce(h{k} - l{k}, 0) / s{k} ELSE 0 END" for k in range(3)) + ", 6) END AS crowding FROM e")
def front_ranks_part(spark, d):
    """NUM5, WIN7 in three objectives: each part's front and its crowding there."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    ranked = pareto.front_ranks(p, [F.round("p_retailprice", -1), -F.col("p_size"), F.col("p_partkey") % 13])
    found = pareto.crowding(ranked, ["f0", "f1", "f2"], "p_partkey", ["front"])
    return found.select("p_partkey", "front", "is_boundary", F.round("crowding", 6).alias("crowding"))


@query(f"""WITH {_FRONT}, u AS (SELECT *, count(*) OVER () AS n, max(f1) OVER () - min(f1) OVER () AS s1, max(f2) OVER () - min(f2) OVER () AS s2,
 lag(f1) OVER (ORDER BY f1, p_partkey) AS l1, lead(f1) OVER (ORDER BY f1, p_partkey) AS h1, lag(f2) OVER (ORDER BY f2, p_partkey) AS l2, lead(f2) OVER (ORDER BY f2, p_partkey) AS h2 FROM front),
e AS (SELECT *, n <= 2 OR (s1 > 1e-12 AND (l1 IS NULL OR h1 IS NULL)) OR (s2 > 1e-12 AND (l2 IS NULL OR h2 IS NULL)) AS edge FROM u)
SELECT p_partkey, edge AS is_boundary, CASE WHEN NOT edge THEN round(CASE WHEN s1 > 1e-12 THEN coalesce(h1 - l1, 0) / s1 ELSE 0 END + CASE WHEN s2 > 1e-12 THEN coalesce(h2 - l2, 0) / s2 ELSE 0 END, 6) END AS crowding FROM e""")
def crowding_distance(spark, d):
    """WIN7 on the front."""
    return pareto.crowding(_front(spark, d), ["f1", "f2"], "p_partkey").select("p_partkey", "is_boundary", F.round("crowding", 6).alias("crowding"))


@query(f"""WITH {_FRONT}, x AS (SELECT DISTINCT f1, f2 FROM front), w AS (SELECT (lead(f1, 1, 2500) OVER (ORDER BY f1) - f1) * (0 - f2) AS a FROM x) SELECT round(greatest(0, sum(a)), 4) AS hypervolume FROM w""")
def hypervolume_2d(spark, d):
    """NUM7, WIN11."""
    return pareto.hypervolume(_front(spark, d), (2500.0, 0.0)).select(F.round("hypervolume", 4).alias("hypervolume"))


@query(f"""WITH {_FRONT}, g AS (SELECT sqrt((lead(f1) OVER w - f1) ** 2 + (lead(f2) OVER w - f2) ** 2) AS g FROM front WINDOW w AS (ORDER BY f1, f2))
SELECT CASE WHEN (SELECT count(*) FROM front) < 3 OR avg(g) <= 1e-12 THEN 0.0 ELSE round(stddev_pop(g) / avg(g), 6) END AS spread FROM g""")
def front_spread(spark, d):
    """WIN10."""
    return pareto.spread(_front(spark, d)).select(F.round("spread", 6).alias("spread"))


@query(f"""WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) - min(p_retailprice) AS w, max(p_size) AS m FROM part), p AS (SELECT (p_retailprice - lo) / w AS f1, 1 - CAST(p_size AS DOUBLE) / m AS f2 FROM part, b),
r AS (SELECT * FROM (VALUES {", ".join(f"({a!r}, {b!r})" for a, b in _REF)}) AS t(a, b)), n AS (SELECT a, b, min(sqrt((f1 - a) ** 2 + (f2 - b) ** 2)) AS d FROM p, r GROUP BY 1, 2) SELECT round(avg(d), 6) AS igd FROM n""")
def inverted_distance(spark, d):
    """NUM9 against 21 stated points of the curve f2 = 1 - f1^2."""
    both = stats.with_totals(_parts(spark, d), [F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.max("p_size").alias("m")])
    points = both.select(((F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("f1"), (1 - F.col("p_size").cast("double") / F.col("m")).alias("f2"))
    return pareto.igd(points, _REF).select(F.round("igd", 6).alias("igd"))


_POINTS = "pt AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 100.0 AS y FROM supplier), l AS (SELECT a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {e2})"


def _points(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))


@query("WITH RECURSIVE " + _POINTS.format(e2="90000.0") + ", t(id, r) AS (SELECT id, id FROM pt UNION SELECT t.id, l.b FROM t JOIN l ON t.r = l.a) SELECT id, min(r) AS cluster FROM t GROUP BY id")
def single_linkage_supplier(spark, d):
    """NUM13 with steps of at most 300."""
    return cluster.single_linkage(_points(spark, d), 300.0)


@query("WITH RECURSIVE " + _POINTS.format(e2="160000.0") + """, c AS (SELECT id FROM pt LEFT JOIN l ON id = a GROUP BY id HAVING count(a) + 1 >= 4),
t(id, r) AS (SELECT id, id FROM c UNION SELECT t.id, l.b FROM t JOIN l ON t.r = l.a WHERE l.b IN (SELECT id FROM c)), n AS (SELECT id, min(r) AS cluster FROM t GROUP BY id),
b AS (SELECT l.a AS id, min(n.cluster) AS near FROM l JOIN n ON l.b = n.id GROUP BY 1)
SELECT pt.id, c.id IS NOT NULL AS is_core, coalesce(n.cluster, b.near, -1) AS cluster FROM pt LEFT JOIN c ON pt.id = c.id LEFT JOIN n ON pt.id = n.id LEFT JOIN b ON pt.id = b.id""")
def dbscan_supplier(spark, d):
    """NUM14 with eps 400 and four samples."""
    return cluster.dbscan(_points(spark, d), 400.0, 4)


@query("""WITH RECURSIVE v AS (SELECT n_nationkey AS id FROM nation), l AS (SELECT n_nationkey AS a, (n_nationkey * 7) % 25 AS b FROM nation WHERE n_nationkey % 3 = 0), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(id, r) AS (SELECT id, id FROM v UNION SELECT t.id, s.b FROM t JOIN s ON t.r = s.a) SELECT id, min(r) AS "group" FROM t GROUP BY id""")
def union_groups_nation(spark, d):
    """NUM16: pairs of variables made of nation numbers."""
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    pairs = ids.filter("id % 3 = 0").select(F.col("id").alias("a"), ((F.col("id") * 7) % 25).alias("b"))
    return cluster.union_groups(ids, pairs)


@query("""WITH s AS (SELECT s_nationkey AS i, CAST(s_suppkey % 5 AS INT) AS j, avg(s_acctbal) AS score FROM supplier GROUP BY 1, 2), k AS (SELECT *, (i = 0 AND j = 1) OR (i = 3 AND j = 2) AS known FROM s),
b AS (SELECT i, j FROM k WHERE NOT known AND score > 1000 ORDER BY score DESC, i, j LIMIT 10)
SELECT k.i, k.j, round(score, 4) AS score, CASE WHEN known THEN 'confirmed' WHEN b.i IS NOT NULL THEN 'suspected' ELSE 'ignored' END AS kind FROM k LEFT JOIN b ON k.i = b.i AND k.j = b.j""")
def pair_classes(spark, d):
    """NUM17, TOP7."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("i"), (F.col("s_suppkey") % 5).cast("int").alias("j")).agg(F.avg("s_acctbal").alias("score"))
    return cluster.pair_classes(s, [(0, 1), (3, 2)], 10, 1000.0).withColumn("score", F.round("score", 4))


_NEAR = "l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)) <= {e2})"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query("WITH RECURSIVE " + _NEAR.format(e2="1.21") + ", t(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.id, l.b FROM t JOIN l ON t.r = l.a) SELECT id, min(r) AS cluster FROM t GROUP BY id")
def single_linkage_vectors(spark, d):
    """NUM13, JN13 in all dimensions, with steps of at most 1.1."""
    return metric.linkage(_vectors(spark, d), 1.1)


@query("WITH RECURSIVE " + _NEAR.format(e2="1.44") + """, c AS (SELECT vec_id AS id FROM embeddings LEFT JOIN l ON vec_id = a GROUP BY 1 HAVING count(a) + 1 >= 5),
t(id, r) AS (SELECT id, id FROM c UNION SELECT t.id, l.b FROM t JOIN l ON t.r = l.a WHERE l.b IN (SELECT id FROM c)), n AS (SELECT id, min(r) AS cluster FROM t GROUP BY id),
b AS (SELECT l.a AS id, min(n.cluster) AS near FROM l JOIN n ON l.b = n.id GROUP BY 1)
SELECT vec_id AS id, c.id IS NOT NULL AS is_core, coalesce(n.cluster, b.near, -1) AS cluster FROM embeddings LEFT JOIN c ON vec_id = c.id LEFT JOIN n ON vec_id = n.id LEFT JOIN b ON vec_id = b.id""")
def dbscan_vectors(spark, d):
    """NUM14, JN13 in all dimensions, with eps 1.2 and five samples."""
    return metric.dbscan(_vectors(spark, d), 1.2)


@query("""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT query, vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.e, v.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))) AS d FROM q JOIN embeddings v ON query <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM n) SELECT query, rank, id, round(d, 6) AS d FROM r WHERE rank <= 5""")
def nearest_vectors(spark, d):
    """JN14: of every vector whose id is divisible by 100, the five nearest of all."""
    rows = _vectors(spark, d)
    out, _ = metric.nearest(rows, rows.filter("id % 100 = 0"), 5)
    return out.select("query", F.col("rank").cast("long").alias("rank"), "id", F.round("d", 6).alias("d"))


def _lists(expression: str) -> str:
    return f"list_sum(list_transform(range(1, 7), lambda i: {expression}))"


@query(f"""WITH t AS (SELECT p_partkey, [p_size / 50.0, p_retailprice / 2000.0, p_partkey % 7 / 7.0, p_partkey % 5 / 5.0, p_partkey % 3 / 3.0, 0.5] AS x FROM part)
SELECT p_partkey, round({_lists("x[i] ** 2")}, 6) AS sphere, round(list_sum(list_transform(range(1, 6), lambda i: 100 * (x[i + 1] - x[i] ** 2) ** 2 + (1 - x[i]) ** 2)), 6) AS rosenbrock,
 round(-20 * exp(-0.2 * sqrt({_lists("x[i] ** 2")} / 6)) - exp({_lists("cos(2 * pi() * x[i])")} / 6) + 20 + exp(1), 6) AS ackley,
 round({_lists("x[i] ** 2")} / 4000 - list_product(list_transform(range(1, 7), lambda i: cos(x[i] / sqrt(i)))) + 1, 6) AS griewank,
 round({_lists("(x[i] - 1) ** 2")} - list_sum(list_transform(range(2, 7), lambda i: x[i] * x[i - 1])), 6) AS trid,
 round((x[2] - 5.1 / (4 * pi() ** 2) * x[1] ** 2 + 5 / pi() * x[1] - 6) ** 2 + 10 * (1 - 1 / (8 * pi())) * cos(x[1]) + 10, 6) AS branin,
 round((4 - 2.1 * x[1] ** 2 + x[1] ** 4 / 3) * x[1] ** 2 + x[1] * x[2] + (-4 + 4 * x[2] ** 2) * x[2] ** 2, 6) AS camel6,
 round(sin(pi() * (1 + (x[1] - 1) / 4)) ** 2 + list_sum(list_transform(range(1, 6), lambda i: ((x[i] - 1) / 4) ** 2 * (1 + 10 * sin(pi() * (1 + (x[i] - 1) / 4) + 1) ** 2))) + ((x[6] - 1) / 4) ** 2 * (1 + sin(2 * pi() * (1 + (x[6] - 1) / 4)) ** 2), 6) AS levy,
 round(-({" + ".join(f"{a} * exp(-({' + '.join(f'{c} * (x[{i + 1}] - {p}) ** 2' for i, (c, p) in enumerate(zip(r, q, strict=True)))}))" for a, r, q in zip(testbed.HARTMAN_ALPHA, testbed.HARTMAN_A, testbed.HARTMAN_P, strict=True))}), 6) AS hartman6,
 round(-({" + ".join(f"1 / ({' + '.join(f'(x[{i + 1}] - {c}) ** 2' for i, c in enumerate(w))} + {b})" for b, w in zip(testbed.SHEKEL_BETA, testbed.SHEKEL_C, strict=True))}), 6) AS shekel4 FROM t""")
def test_functions(spark, d):
    """MTH21 at points made of part columns."""
    x = F.array((F.col("p_size") / 50.0), F.col("p_retailprice") / 2000.0, F.col("p_partkey") % 7 / 7.0, F.col("p_partkey") % 5 / 5.0, F.col("p_partkey") % 3 / 3.0, F.lit(0.5))
    t = table(spark, d, "part").select("p_partkey", x.alias("x"))
    two = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    names = {n: getattr(testbed, n)(F.col("x")) for n in ("sphere", "rosenbrock", "ackley", "griewank", "trid", "levy", "hartman6", "shekel4")} | {"branin": testbed.branin(*two), "camel6": testbed.camel6(*two)}
    return t.select("p_partkey", *[F.round(c, 6).alias(n) for n, c in names.items()])


@query("""WITH r AS (SELECT s_suppkey, abs(s_acctbal) / 5000 AS r FROM supplier) SELECT s_suppkey, round(r ** 3, 6) AS cubic, round(r, 6) AS linear, round(CASE WHEN r > 1e-12 THEN r * r * ln(r) ELSE 0 END, 6) AS thin_plate, round(exp(0 - (0.5 * r) ** 2), 6) AS gaussian FROM r""")
def radial_kernels(spark, d):
    """MTH22."""
    r = F.abs("s_acctbal") / 5000
    return table(spark, d, "supplier").select("s_suppkey", *[F.round(testbed.kernel(r, k, 0.5), 6).alias(k) for k in ("cubic", "linear", "thin_plate", "gaussian")])


@query("SELECT vec_id, round(exp(-(0.5 * (CAST(embedding[1] AS DOUBLE) - 0.1) ** 2 + 2.0 * (CAST(embedding[2] AS DOUBLE) + 0.2) ** 2)), 6) AS r FROM embeddings")
def ard_correlation(spark, d):
    """MTH23 of the first two components with a stated point."""
    x = F.slice(F.col("embedding").cast("array<double>"), 1, 2)
    r = testbed.ard_correlation(x, F.array(F.lit(0.1), F.lit(-0.2)), F.array(F.lit(0.5), F.lit(2.0)))
    return table(spark, d, "embeddings").select("vec_id", F.round(r, 6).alias("r"))


@query("""WITH e AS (SELECT s_nationkey AS g, s_suppkey AS id, list_value(s_acctbal / 10000, 0.5, 0.25) AS x FROM supplier), b AS (SELECT g, min(x[1]) AS lo, max(x[1]) AS hi, arg_max(x[1], id) AS last FROM e GROUP BY 1),
w AS (SELECT g, CASE WHEN hi - lo <= 1e-12 THEN -1.0 ELSE last - (hi - lo) * 0.25 END AS a, CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE last + (hi - lo) * 0.25 END AS b FROM b) SELECT g, round(greatest(-1.0, a), 4) AS lo, round(least(1.0, b), 4) AS hi FROM w""")
def shrunk_bounds(spark, d):
    """ARR4: bounds [-1, 1] cut to half the elite's range around its last value; a range of no width keeps the bounds."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", (F.col("s_acctbal") / 10000).alias("x"))
    b = s.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max_by("x", "s_suppkey").alias("last"))
    width = F.col("hi") - F.col("lo")
    low = F.when(width <= 1e-12, -1.0).otherwise(F.greatest(F.lit(-1.0), F.col("last") - width * 0.25))
    high = F.when(width <= 1e-12, 1.0).otherwise(F.least(F.lit(1.0), F.col("last") + width * 0.25))
    return b.select("g", F.round(low, 4).alias("lo"), F.round(high, 4).alias("hi"))


@query("""WITH e AS (SELECT s_suppkey, [0.0, 0.0, 0.0, 0.0, 0.0] AS z, s_acctbal AS v, CAST(s_suppkey % 5 AS INT) AS k FROM supplier) SELECT s_suppkey, round(list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i = k + 1 THEN v ELSE z[i] END * i)), 4) AS digest FROM e""")
def scattered_elite(spark, d):
    """ARR2, ARR3: a subspace's solution put into the elite vector, summed by place."""
    z = F.array(*[F.lit(0.0)] * 5)
    elite = F.transform(z, lambda v, i: F.when(i == (F.col("s_suppkey") % 5).cast("int"), F.col("s_acctbal")).otherwise(v))
    return table(spark, d, "supplier").select("s_suppkey", F.round(testbed.total(F.transform(elite, lambda v, i: v * (i + 1))), 4).alias("digest"))
