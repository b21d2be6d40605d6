"""Queries of statistics, scaling, physics and evaluation-log operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import physics
from lodestone.operators import stats
from lodestone.sources import table
from lodestone.streaming import windows

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def weighted_mean_by_flag(spark, d):
    """AGG1, AGG2."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("mean"))


@query("""WITH m AS (SELECT l_returnflag, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(any_value(mean), 4) AS mean, round(sqrt(sum(l_quantity * (l_extendedprice - mean) ** 2) / sum(l_quantity)), 4) AS std FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def weighted_std_by_flag(spark, d):
    """AGG3."""
    out = stats.weighted_std(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(100 * stddev_pop(l_extendedprice) / abs(avg(l_extendedprice)), 4) AS rsd FROM lineitem GROUP BY 1""")
def describe_by_flag(spark, d):
    """AGG4-6."""
    out = stats.describe(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", "low", "high", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p05", "p95", "rsd")])


@query("""WITH y AS (SELECT year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1), p AS (SELECT y, v, lag(v) OVER (ORDER BY y) AS b FROM y)
SELECT CAST(y AS INT) AS year, round(100 * (v - b) / abs(b), 4) AS relative, round(v - b, 4) AS points FROM p""")
def change_by_year(spark, d):
    """MTH9, MTH10 over one row per year."""
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v"))
    base = F.lag("v").over(Window.orderBy("year"))
    p = y.withColumn("b", base)
    return p.select("year", F.round(physics.relative_change(F.col("v"), F.col("b")), 4).alias("relative"), F.round(physics.point_change(F.col("v"), F.col("b")), 4).alias("points"))


@query("SELECT c_mktsegment, round(avg(c_acctbal) - 2 * stddev_pop(c_acctbal), 4) AS low, round(avg(c_acctbal) + 2 * stddev_pop(c_acctbal), 4) AS high FROM customer GROUP BY 1")
def deviation_band_by_segment(spark, d):
    """MTH11."""
    return stats.deviation_band(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)), 6) AS unit FROM part")
def minmax_scale_part(spark, d):
    """PRJ10."""
    return stats.minmax_scaled(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("unit", 6).alias("unit"))


@query("SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_pop(s_acctbal) FROM supplier), 6) AS z FROM supplier")
def standardise_supplier(spark, d):
    """PRJ11."""
    return stats.standardised(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", F.round("z", 6).alias("z"))


_SENSITIVITY = """WITH t AS (SELECT var_pop(l_extendedprice) AS v, avg(l_extendedprice) AS m, count(*) AS n FROM lineitem), g AS (
{parts})
SELECT input, round(least(1.0, greatest(0.0, sum(k * (a - (SELECT m FROM t)) ** 2 / (SELECT n FROM t)) / (SELECT v FROM t))), 6) AS share FROM g GROUP BY input""".format(
    parts=" UNION ALL ".join(f"SELECT '{c}' AS input, {c} <= (SELECT median({c}) FROM lineitem) AS low, count(*) AS k, avg(l_extendedprice) AS a FROM lineitem GROUP BY 2" for c in ("l_quantity", "l_discount", "l_tax"))
)


@query(_SENSITIVITY)
def median_split_sensitivity(spark, d):
    """NUM3."""
    out = stats.median_split_sensitivity(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return out.select("input", F.round("share", 6).alias("share"))


@query("""WITH p AS (SELECT p_partkey, 100.0 + p_size AS pti, 100.0 + p_size * 0.5 AS pto, 90.0 AS psi, 300.0 + p_size AS tti, 300.0 + p_size * 0.4 AS tto, p_retailprice AS price FROM part)
SELECT p_partkey, round((pti - pto) / (pti - psi), 6) AS loss, round((price - 900) / 500, 6) AS cp,
 round((1 - tto / tti) / (1 - (pto / pti) ** (0.4 / 1.4)), 6) AS turbine, round(((pti / pto) ** (0.4 / 1.4) - 1) / (tti / tto - 1), 6) AS compressor,
 round((tti - tto) / (tti - 200), 6) AS film, round(price * 0.02 / 0.06, 6) AS nusselt, round(price * 0.06 / 0.02, 6) AS h, round(price + 2 * 0.5 + 500000.0 * 0.001, 6) AS vae FROM p""")
def physics_coefficients(spark, d):
    """MTH1-8, MTH16 over conditions made of part sizes and prices."""
    size, price, lit = F.col("p_size"), F.col("p_retailprice"), F.lit
    pti, pto, tti, tto = 100.0 + size, 100.0 + size * 0.5, 300.0 + size, 300.0 + size * 0.4
    columns = {
        "loss": physics.loss_coefficient(pti, pto, lit(90.0)), "cp": physics.static_pressure_coefficient(price, lit(900.0), lit(500.0)),
        "turbine": physics.turbine_efficiency(pti, pto, tti, tto), "compressor": physics.compressor_efficiency(pto, pti, tto, tti),
        "film": physics.film_effectiveness(tti, tto, lit(200.0)), "nusselt": physics.nusselt(price, lit(0.02), lit(0.06)), "h": physics.heat_transfer_coefficient(price, lit(0.02), lit(0.06)),
        "vae": physics.vae_loss(price, lit(0.5), lit(0.001), lam1=2.0),
    }
    return table(spark, d, "part").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in columns.items()])


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS lf FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey, o_totalprice, lf FROM orders JOIN l ON o_orderkey = l_orderkey),
t AS (SELECT var_pop(o_totalprice - lf) AS d, var_pop(lf) AS v, min(o_totalprice) AS least, avg(o_totalprice) AS mean, count(*) AS n FROM j), w AS (SELECT *, 1 / (1 + sqrt(d / v)) AS omega FROM t),
f AS (SELECT omega, omega * least + (1 - omega) * mean AS threshold, n FROM w)
SELECT round(omega, 6) AS omega, round(threshold, 4) AS threshold, (SELECT count(*) FROM j WHERE lf < threshold) AS n_hf, n - (SELECT count(*) FROM j WHERE lf < threshold) AS n_lf,
 round((SELECT count(*) FROM j WHERE lf < threshold) + 0.1 * (n - (SELECT count(*) FROM j WHERE lf < threshold)), 4) AS budget FROM f""")
def two_fidelity_filter(spark, d):
    """MTH17, MTH18, FLT10: orders as the fine response, the sum of their lines as the coarse one."""
    lf = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("lf"))
    j = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(lf, "o_orderkey")
    totals = j.agg(F.var_pop(F.col("o_totalprice") - F.col("lf")).alias("d"), F.var_pop("lf").alias("v"), F.min("o_totalprice").alias("least"), F.avg("o_totalprice").alias("mean"))
    omega, threshold = stats.filter_threshold(F.col("d"), F.col("v"), F.col("least"), F.col("mean"))
    both = j.crossJoin(F.broadcast(totals.select(omega.alias("omega"), threshold.alias("threshold"))))
    out = both.groupBy("omega", "threshold").agg(F.count_if(F.col("lf") < F.col("threshold")).alias("n_hf"), F.count_if(F.col("lf") >= F.col("threshold")).alias("n_lf"))
    return out.select(F.round("omega", 6).alias("omega"), F.round("threshold", 4).alias("threshold"), "n_hf", "n_lf", F.round(F.col("n_hf") + 0.1 * F.col("n_lf"), 4).alias("budget"))


@query("""WITH g AS (SELECT o_orderpriority AS choice, avg(o_totalprice) / 1000 AS gain FROM orders GROUP BY 1), e AS (SELECT choice, gain, exp(0.5 * (gain - (SELECT max(gain) FROM g))) AS e FROM g)
SELECT choice, round(gain, 6) AS gain, round(e / (SELECT sum(e) FROM e), 6) AS p FROM e""")
def softmax_choice(spark, d):
    """MTH20."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("choice")).agg((F.avg("o_totalprice") / 1000).alias("gain"))
    return stats.softmax(g, "gain").select("choice", F.round("gain", 6).alias("gain"), F.round("p", 6).alias("p"))


@query("""WITH s AS (SELECT p_brand AS brand, var_pop(p_retailprice) AS score FROM part GROUP BY 1) SELECT brand, round(100 * score / (SELECT sum(score) FROM s), 6) AS share FROM s""")
def variance_shares_by_brand(spark, d):
    """NUM25."""
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.var_pop("p_retailprice").alias("score"))
    return stats.variance_shares(s, "score").select("brand", F.round("share", 6).alias("share"))


@query("""SELECT event_id, round(min(value) OVER w, 6) AS best, round(min(value) OVER w + 1, 6) AS regret FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def best_so_far_by_user(spark, d):
    """WIN8, WIN9, NUM37."""
    log = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return stats.best_so_far(log, ["user_id"], ["ts", "event_id"], "value", fmin=-1.0).select("event_id", F.round("best", 6).alias("best"), F.round("regret", 6).alias("regret"))


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS f FROM lineitem GROUP BY 1), j AS (SELECT o_orderpriority, o_totalprice AS y, f FROM orders JOIN l ON o_orderkey = l_orderkey), m AS (SELECT o_orderpriority, avg(y) AS m FROM j GROUP BY 1)
SELECT o_orderpriority, round(1 - sum((y - f) ** 2) / sum((y - m) ** 2), 6) AS r2, round(sqrt(avg((y - f) ** 2)), 4) AS rmse FROM j JOIN m USING (o_orderpriority) GROUP BY 1""")
def fit_quality(spark, d):
    """AGG16, AGG17."""
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("f"))
    j = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("y")).join(f, "o_orderkey")
    m = j.groupBy("o_orderpriority").agg(F.avg("y").alias("m"))
    out = j.join(m, "o_orderpriority").groupBy("o_orderpriority").agg(stats.r_squared(F.col("y"), F.col("f"), F.col("m")).alias("r2"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("f"), 2))).alias("rmse"))
    return out.select("o_orderpriority", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"))


@query("""WITH s AS (SELECT p_type AS kind, sum(p_size) AS v FROM part GROUP BY 1) SELECT kind, v, round(sum(v) OVER (ORDER BY v DESC, kind ROWS UNBOUNDED PRECEDING) / (SELECT sum(v) FROM s), 6) AS share FROM s""")
def cumulative_share(spark, d):
    """WIN6 over one row per type."""
    s = table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.sum("p_size").alias("v"))
    w = Window.orderBy(F.desc("v"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = stats.with_totals(s, [F.sum("v").alias("t")])
    return both.select("kind", "v", F.round(F.sum("v").over(w) / F.col("t"), 6).alias("share"))


@query("""SELECT l_returnflag, round(avg(greatest(0, (1.0 - l_discount * 20) / 1.0) ** 2), 6) AS penalty FROM lineitem GROUP BY 1""")
def trailing_edge_penalty(spark, d):
    """MTH15: mean squared hinge below a reference radius of 1."""
    hinge = F.pow(F.greatest(F.lit(0.0), 1.0 - F.col("l_discount") * 20), 2)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(hinge), 6).alias("penalty"))


@query("""WITH e AS (SELECT l_returnflag, avg(l_discount) AS w, avg(l_tax) AS wo FROM lineitem GROUP BY 1) SELECT l_returnflag, round(w - wo, 6) AS delta, CASE WHEN abs(wo) > 1e-12 THEN round(w / wo, 6) END AS ratio, w - wo > 0.001 AS negative FROM e""")
def negative_transfer(spark, d):
    """MTH19: whether an error with a source exceeds the one without by more than the tolerance."""
    e = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("w"), F.avg("l_tax").alias("wo"))
    delta = F.col("w") - F.col("wo")
    return e.select("l_returnflag", F.round(delta, 6).alias("delta"), F.round(F.when(F.abs("wo") > 1e-12, F.col("w") / F.col("wo")), 6).alias("ratio"), (delta > 0.001).alias("negative"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS best FROM events GROUP BY 1, 2""")
def hourly_events(spark, d):
    """Extension: tumbling windows, the same plan that runs on a stream."""
    return windows.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))
