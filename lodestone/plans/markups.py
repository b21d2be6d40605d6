"""Queries of structured-text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import markup, text
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


_LINES = "l AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"""WITH {_LINES}, c AS (SELECT source, CASE WHEN regexp_matches(line, '^\\|') OR len(regexp_extract_all(line, '\\|')) >= 2 THEN 'table' WHEN regexp_matches(line, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(line, '^>') THEN 'quote'
 WHEN regexp_matches(line, '^(!\\[|Figure|Table)') THEN 'caption' WHEN regexp_matches(line, '\\$\\$|[=<>]') THEN 'formula' ELSE 'body' END AS kind FROM l) SELECT source, kind, count(*) AS n FROM c GROUP BY 1, 2""")
def line_classes(spark, d):
    """STR19."""
    rows = text.lines(table(spark, d, "documents").select("source", "text"), "text")
    return rows.groupBy("source", markup.line_class(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\$\$[^$]+\$\$')) AS formulas, len(regexp_extract_all(text, '!\[[^\]]*\]\(')) AS images, len(regexp_extract_all(text, '\|')) AS bars, len(regexp_extract_all(text, '[A-Z]{2,}!!')) AS shouts FROM documents""")
def text_counters(spark, d):
    """STR16, STR24."""
    return table(spark, d, "documents").select("doc_id", *[c.cast("long").alias(n) for n, c in markup.counters(F.col("text")).items()])


@query("""SELECT conv_id, turn, last_value(CASE WHEN length(trim(text)) > 0 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations""")
def previous_turns(spark, d):
    """WIN14."""
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.col("text").alias("line"))
    return markup.previous_filled(rows, ["conv_id"]).select("conv_id", F.col("line_no").alias("turn"), "previous")


@query("""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 20) AS p FROM documents)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_paragraphs, CASE WHEN len(p) > 0 THEN round(list_sum(list_transform(p, lambda x: length(x))) / len(p), 4) END AS mean_length FROM p""")
def paragraph_stats(spark, d):
    """AGG12."""
    out = markup.paragraphs(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.col("n_paragraphs").cast("long").alias("n_paragraphs"), F.round("mean_length", 4).alias("mean_length"))


@query("""WITH w AS (SELECT CAST(max(length(CAST(n_nationkey AS VARCHAR))) AS DOUBLE) AS a, max(length(n_name)) AS b, max(length(CAST(n_regionkey AS VARCHAR))) AS c FROM nation), s AS (SELECT greatest(a / (a + b + c), 0.07) AS a, greatest(b / (a + b + c), 0.07) AS b, greatest(c / (a + b + c), 0.07) AS c FROM w)
SELECT 'n_nationkey' AS "column", round(a / (a + b + c), 6) AS share FROM s UNION ALL SELECT 'n_name', round(b / (a + b + c), 6) FROM s UNION ALL SELECT 'n_regionkey', round(c / (a + b + c), 6) FROM s""")
def column_widths(spark, d):
    """PRJ16."""
    return markup.width_shares(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"]).withColumn("share", F.round("share", 6))


@query("""SELECT DISTINCT c FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE length(c) > 0 AND NOT regexp_matches(c, '[\\x00-\\x7f]')""")
def uncovered_characters(spark, d):
    """CMP20: characters outside ASCII."""
    return markup.uncovered_characters(table(spark, d, "documents"), "text", F.col("c").rlike(r"[\x00-\x7f]"))


@query("""WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM documents), p AS (SELECT DISTINCT unnest(regexp_extract_all(html, '[0-9]+')) AS number FROM pages)
SELECT doc_id, number FROM n WHERE number NOT IN (SELECT number FROM p)""")
def number_provenance(spark, d):
    """JN9, STR12, CMP14: numbers of documents that no page has."""
    n = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).alias("number"))
    p = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("[0-9]+"), F.lit(0))).alias("number")).distinct()
    return n.join(p, "number", "left_anti").select("doc_id", "number")


@query("""SELECT region, sum(n) AS nations, string_agg(name || ':' || n, ',' ORDER BY name) AS listed FROM (SELECT r_name AS region, n_name AS name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) GROUP BY 1""")
def curated_dimension(spark, d):
    """JN1, JN6, JN7: rows against a small dimension."""
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = joined.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",")
    return per.groupBy("region").agg(F.sum("n").alias("nations"), listed.alias("listed"))
