"""Queries of audit rules: uniqueness, coverage, order, forbidden words, arithmetic, scores, verdicts and mutations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import audit, text
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


FORBIDDEN = ("stupid", "idiot", "password=", "All rights reserved")
EXCUSE = "(license|License)"


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, d):
    """D2, AGG15."""
    return audit.duplicates(table(spark, d, "orders"), "o_custkey")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def unlabelled_documents(spark, d):
    """JN8, JN10, SET3: keys of one side alone."""
    return audit.missing_both_ways(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""WITH a AS (SELECT DISTINCT n_nationkey AS k FROM nation), p AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT (SELECT k FROM p UNION SELECT k FROM s))) AS uncovered, (SELECT count(*) FROM (SELECT k FROM p INTERSECT SELECT k FROM s)) AS shared, (SELECT count(*) FROM (SELECT k FROM p EXCEPT SELECT k FROM s)) AS only_left""")
def set_coverage(spark, d):
    """SET1-3, D6: union covers all, overlap, difference, over one row per nation."""
    a, p, s = (table(spark, d, t).select(F.col(c).cast("long").alias("k")).distinct() for t, c in (("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, x in (("uncovered", a.exceptAll(p.union(s).distinct())), ("shared", p.intersect(s)), ("only_left", p.exceptAll(s)))]
    one = reduce(DataFrame.unionByName, parts)
    return one.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in ("uncovered", "shared", "only_left")])


@query("SELECT conv_id, turn, rn - 1 AS expected FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE turn <> rn - 1")
def turn_gaps(spark, d):
    """WIN12, S5."""
    return audit.gaps(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn").select("conv_id", "turn", F.col("expected").cast("long").alias("expected"))


_PLACES = " UNION ALL ".join(f"SELECT doc_id, text, '{n}' AS needle, {len(n)} AS n, string_split(text, '{n}') AS p FROM t WHERE contains(text, '{n}')" for n in FORBIDDEN)


@query(f"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN ' stupid License' || repeat(' and more', 20) || ' stupid' ELSE '' END AS text FROM documents), s AS ({_PLACES}), h AS (SELECT *, unnest(range(len(p) - 1)) AS k FROM s), q AS (SELECT doc_id, text, needle, n, CAST(list_sum(list_transform(list_slice(p, 1, k + 1), lambda x: length(x))) AS BIGINT) + k * n AS start FROM h)
SELECT doc_id, needle, min(start) AS start FROM q WHERE NOT regexp_matches(substring(text, greatest(start - 90, 0) + 1, least(start, 90) + n + 90), '{EXCUSE}') GROUP BY 1, 2""")
def forbidden_words(spark, d):
    """D3, D4b, A7, FLT7: in some texts a first place is excused and a later one isn't."""
    late = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" stupid License"), F.repeat(F.lit(" and more"), 20), F.lit(" stupid"))).otherwise(F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", late).alias("text"))
    out = audit.forbidden(docs, "doc_id", "text", list(FORBIDDEN), EXCUSE)
    return out.select("doc_id", "needle", F.col("start").cast("long").alias("start"))


_SUM = "o_orderkey || ' + ' || o_custkey || ' = ' || (o_orderkey + o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 40 ELSE 0 END) || ', ' || (o_custkey % 50 + 1) || '/' || 64 || ' ≈ ' || ((o_custkey % 50 + 1) * 100 div 64) || '%, 1000^(1/' || (o_orderkey % 3 + 1) || ') ≈ ' || CASE o_orderkey % 3 WHEN 0 THEN '1000.00' WHEN 1 THEN '31.6228' ELSE '10.50' END"


@query("WITH o AS (SELECT o_orderkey AS id, o_orderkey % 400000 AS o_orderkey, o_custkey % 400000 AS o_custkey FROM orders), " + """t AS (SELECT id, 'sum' AS form, o_orderkey || ' + ' || o_custkey || ' = ' || (o_orderkey + o_custkey + 40) AS said, CAST(o_orderkey + o_custkey AS DOUBLE) AS real, CAST(o_orderkey + o_custkey + 40 AS DOUBLE) AS c, greatest(0.005 * (o_orderkey + o_custkey + 40), 0.015) AS tol FROM o WHERE o_orderkey % 5 = 0
UNION ALL SELECT id, 'share', (o_custkey % 50 + 1) || '/64 ≈ ' || ((o_custkey % 50 + 1) * 100 // 64) || '%', 100 * (CAST(o_custkey % 50 + 1 AS DOUBLE) / 64), CAST((o_custkey % 50 + 1) * 100 // 64 AS DOUBLE), greatest(0.05 * greatest(1, (o_custkey % 50 + 1) * 100 // 64), 0.05) FROM o
UNION ALL SELECT id, 'root', '1000^(1/3) ≈ 10.50', pow(1000.0, 1.0 / 3), 10.5, 0.002 FROM o WHERE o_orderkey % 3 = 2) SELECT id AS o_orderkey, form, said, round(real, 6) AS real FROM t WHERE abs(real - c) > tol""")
def wrong_sums(spark, d):
    """MTH14, CMP14: three forms of stated arithmetic, written from orders."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 400_000).alias("o_orderkey"), (F.col("o_custkey") % 400_000).alias("o_custkey"))
    return audit.wrong_sums(o.select(F.col("id").alias("o_orderkey"), F.expr(_SUM).alias("t")), "o_orderkey", "t").withColumn("real", F.round("real", 6))


#: What an order's text states: a share of 64 in whole percents, every third one 7 too high, and one of nothing.
_SHARES = "'have ' || (o_custkey % 50 + 1) || '/64 = ' || ((o_custkey % 50 + 1) * 100 div 64 + CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 0 END) || '% and ' || (o_orderkey % 9) || ' / ' || (o_orderkey % 4) || ' ≈ 50%'"


@query("""WITH s AS (SELECT o_orderkey, 100.0 * (o_custkey % 50 + 1) / 64 AS v, CAST((o_custkey % 50 + 1) * 100 // 64 + CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 0 END AS DOUBLE) AS c FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 100.0 * (o_orderkey % 9) / (o_orderkey % 4) END, 50.0 FROM orders) SELECT o_orderkey, c FROM s WHERE coalesce(abs(v - c) > greatest(0.03 * c, 1e-9), true)""")
def stated_arithmetic(spark, d):
    """MTH13, A8: shares that orders state, held against what they are."""
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_SHARES).alias("t"))
    return audit.stated_arithmetic(o, "o_orderkey", "t").select("o_orderkey", "c")


@query("""WITH i AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS v, 100.0 AS t FROM lineitem), s AS (SELECT k, sum(v) AS known, count(*) FILTER (WHERE v IS NULL) AS missing, max(t) AS total FROM i GROUP BY 1)
SELECT k, round(known, 4) AS known, missing, CASE WHEN missing = 1 THEN round(total - known, 4) END AS inferred, CAST(CASE WHEN missing = 0 THEN abs(known - total) <= 1e-6 WHEN missing = 1 THEN total - known > 0 END AS INT) AS balanced FROM s""")
def score_balance(spark, d):
    """AGG13: an order's quantities as scores, one of them missing."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("v"), F.lit(100.0).alias("t"))
    s = audit.balanced_scores(i, ["k"], "v", "t")
    return s.select("k", F.round("known", 4).alias("known"), "missing", F.round("inferred", 4).alias("inferred"), F.col("balanced").cast("int").alias("balanced"))


@query("""WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS s, max(o_totalprice) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT k, abs(s - w) <= 1e-6 AS ok FROM s""")
def allocation_check(spark, d):
    """AGG14: lines against their order's total."""
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), "k")
    return audit.allocations(parts, ["k"], "l_extendedprice", "o_totalprice").select("k", "ok")


_LEXICON = [("density", "eau", "eau", "Les "), ("words", "the", "the ", "idiot"), ("words", "lich", "lich", "zu ")]


@query("""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, n, line, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM l),
x AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS family, '{c}' AS concept, * FROM w WHERE contains(line, '{i}') AND NOT contains(line, '{e}')" for f, c, i, e in _LEXICON) + """), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, concept ORDER BY n) AS k FROM x)
SELECT doc_id, family, concept, n AS line_no, contains(near, ' is ') AS explained FROM r WHERE k = 1""")
def concept_audit(spark, d):
    """FLT5, WIN5, CMP17."""
    rows = text.lines(table(spark, d, "documents").select("doc_id", "text"), "text")
    lexicon = spark.createDataFrame(_LEXICON, "family string, concept string, include string, exclude string")
    out = audit.first_concepts(rows, ["doc_id"], lexicon, " is ")
    return out.select("doc_id", "family", "concept", F.col("line_no").cast("long").alias("line_no"), "explained")


def _tables(spark, d) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("documents", "conversations", "labels", "orders", "lineitem")}


RULES: dict[str, audit.Rule] = {
    "document-id-unique": lambda t: audit.violations(audit.duplicates(t["documents"], "doc_id"), "document-id-unique", F.col("doc_id"), F.col("n")),
    "length-as-declared": lambda t: audit.violations(t["documents"].filter(F.col("n_chars") != F.length("text")), "length-as-declared", F.col("doc_id"), F.col("n_chars")),
    "label-has-document": lambda t: audit.violations(t["labels"].join(t["documents"].select("doc_id"), "doc_id", "left_anti"), "label-has-document", F.col("doc_id"), F.lit("")),
    "turns-in-order": lambda t: audit.violations(audit.gaps(t["conversations"].select("conv_id", "turn"), ["conv_id"], "turn"), "turns-in-order", F.col("conv_id"), F.col("turn")),
    "role-known": lambda t: audit.violations(t["conversations"].filter(~F.col("role").isin("system", "user", "assistant")), "role-known", F.col("conv_id"), F.col("role")),
    "discount-in-range": lambda t: audit.violations(t["lineitem"].filter(~F.col("l_discount").between(0, 1)), "discount-in-range", F.col("l_orderkey"), F.col("l_discount")),
    "status-known": lambda t: audit.violations(t["orders"].filter(~F.col("o_orderstatus").isin("O", "F", "P")), "status-known", F.col("o_orderkey"), F.col("o_orderstatus")),
}

_VERDICT_SQL = """WITH n AS (SELECT 'document-id-unique' AS rule, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'length-as-declared', (SELECT count(*) FROM documents WHERE n_chars <> length(text))
UNION ALL SELECT 'label-has-document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'turns-in-order', (SELECT count(*) FROM (SELECT turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations) WHERE turn <> e)
UNION ALL SELECT 'role-known', (SELECT count(*) FROM conversations WHERE role NOT IN ('system', 'user', 'assistant')) UNION ALL SELECT 'discount-in-range', (SELECT count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 1)
UNION ALL SELECT 'status-known', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P'))) """


@query(_VERDICT_SQL + "SELECT rule, CAST(n AS BIGINT) AS n_violations, n = 0 AS passed FROM n")
def audit_verdicts(spark, d):
    """DM11, SNK5: all rules over all rows."""
    return audit.verdicts(_tables(spark, d), RULES)


#: A defect for each rule: table, where, column, value.
DEFECTS = {
    "length-as-declared": ("documents", "doc_id = 0", "n_chars", "n_chars + 1"),
    "document-id-unique": ("documents", "doc_id = 1", "doc_id", "0"),
    "label-has-document": ("labels", "doc_id = (SELECT min(doc_id) FROM {labels})", "doc_id", "-5"),
    "turns-in-order": ("conversations", "conv_id = 0 AND turn = 0", "turn", "99"),
    "role-known": ("conversations", "conv_id = 0 AND turn = 0", "role", "'robot'"),
    "discount-in-range": ("lineitem", "l_orderkey = (SELECT min(l_orderkey) FROM {lineitem})", "l_discount", "1.5"),
    "status-known": ("orders", "o_orderkey = (SELECT min(o_orderkey) FROM {orders})", "o_orderstatus", "'X'"),
}


@query(None)
def mutation_verdicts(spark, d):
    """CMP18: each rule fails once its defect is in a copy of the tables."""
    out = []
    for rule, (name, where, column, value) in DEFECTS.items():
        tables = _tables(spark, d)
        hit = spark.sql(f"SELECT *, {where} AS hit_ FROM {{{name}}}", **{name: tables[name]})
        tables[name] = audit.mutated(hit, F.col("hit_"), column, F.expr(value)).drop("hit_")
        out.append(RULES[rule](tables).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), (F.col("n") > 0).alias("caught")))
    return reduce(DataFrame.unionByName, out)


@query(_VERDICT_SQL + """SELECT '[' || string_agg('{"rule":"' || rule || '","n_violations":' || n || ',"passed":' || (n = 0) || '}', ',' ORDER BY rule) || ']' AS report FROM n""")
def audit_report(spark, d):
    """SNK4."""
    return audit.report_json(audit.verdicts(_tables(spark, d), RULES))


@query("""WITH e AS (SELECT doc_id, left(text, 300) AS t, doc_id % 3 = 0 AS open FROM documents) SELECT doc_id, CASE WHEN open THEN 'draft ' || doc_id ELSE t END AS card FROM e""")
def protected_merge(spark, d):
    """SNK3: cards that still say TODO are drafted anew."""
    docs = table(spark, d, "documents")
    existing = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "TODO").otherwise(F.substring("text", 1, 300)).alias("card"))
    drafted = docs.select("doc_id", F.concat(F.lit("draft "), F.col("doc_id").cast("string")).alias("card"))
    return audit.merge_protected(existing, drafted, "doc_id", "card")
