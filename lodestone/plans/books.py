"""Queries of books: parts by markers, contents and their anchors, counts without a source, identities, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import reports, rules, text
from lodestone.plans.corpora import DIMENSIONS
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


#: A book around a document's text, by its id: contents, anchors, parts at markers, counts with and without a source.
BOOK = """'# Title ' || doc_id || chr(10) || '## Contents' || chr(10) || '- [one](#ch-1)' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '- [two](#ch-2)' WHEN 1 THEN '- [two](#ch-3)' ELSE '- [zwei](#größe)' END || chr(10) || '---' || chr(10) || chr(10)
 || '<a id="ch-1"></a>' || chr(10) || '# Part one' || chr(10) || chr(10) || 'It took 1500 CFD runs.' || CASE doc_id % 4 WHEN 0 THEN ' [source 3]' WHEN 1 THEN ' The old edition said so.' ELSE '' END || chr(10) || chr(10) || 'Up by 5% in ' || doc_id || ' runs' || chr(10) || chr(10)
 || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<a id="ch-2"></a>' || chr(10) || '# Part two' || chr(10) END || replace(coalesce(text, ''), '#', '') || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '# Annex' || chr(10) || 'The end of ' || doc_id || chr(10) END"""
_BOOKS = f"b AS (SELECT doc_id, {BOOK} AS text FROM documents)"
_CONTENTS, _MARKS = r"(?s)## Contents *\n(.*?)\n---", ["# Part one", "# Part two", "# Annex"]
_COUNT, _CLAIM, _CITED, _DEBUNKED = "[0-9][0-9,]* *(CFD )?runs", r"[0-9]+(\.[0-9]+)? ?%", r"\[source [0-9]+\]", "old edition|deleted"


def books(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(BOOK).alias("text"))


_STARTS = ", ".join(f"list_position(list_transform(l, lambda x: starts_with(x, '{m}')), true) - 1 AS m{k}" for k, m in enumerate(_MARKS))


@query(f"""WITH {_BOOKS}, l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM b), s AS (SELECT doc_id, l, {_STARTS}, len(l) - 1 - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END AS fin FROM l), t AS (SELECT doc_id, l, fin, [0, m0, m1, m2] AS s, unnest(range(4)) AS part FROM s),
c AS (SELECT doc_id, l, part, s[part + 1] AS first_line, coalesce(list_min(list_filter(s, lambda x: x > s[part + 1])) - 1, fin) AS last_line, s[part] AS before FROM t)
SELECT doc_id, CAST(part AS INT) AS part, CAST(coalesce(first_line, -1) AS INT) AS first_line, CASE WHEN first_line IS NOT NULL THEN CAST(last_line AS INT) ELSE -1 END AS last_line, md5(CASE WHEN first_line IS NOT NULL THEN array_to_string(l[first_line + 1 : last_line + 1], chr(10)) END) AS digest,
 CASE WHEN first_line IS NULL THEN 'missing' WHEN first_line < before THEN 'out of order' WHEN last_line - first_line + 1 < 3 THEN 'short' END AS fault FROM c""")
def book_parts(spark, d):
    """CMP10: books cut at their markers, each part to the line before the next, the last to the end."""
    found = reports.split_at(books(spark, d), "doc_id", "text", _MARKS, 3)
    line = lambda c: F.coalesce(c, F.lit(-1)).cast("int").alias(c)
    return found.select("doc_id", "part", line("first_line"), line("last_line"), F.md5(F.col("text").cast("binary")).alias("digest"), "fault")


@query(f"""WITH {_BOOKS}, i AS (SELECT doc_id, regexp_extract_all(regexp_extract(text, '{_CONTENTS}', 1), '\\]\\(#([^)]+)\\)', 1) AS t, regexp_extract_all(text, '<a +id="([^"]+)"', 1) AS ids FROM b),
f AS (SELECT doc_id, len(t) AS n_links, array_to_string(list_filter(t, lambda x: NOT list_contains(ids, x)), ',') AS dangling, array_to_string(list_filter(['ch-1', 'ch-2'], lambda r: NOT list_contains(t, r) OR NOT list_contains(ids, r)), ',') AS lacking, array_to_string(list_filter(t, lambda x: regexp_matches(x, '[^\\x00-\\x7f]')), ',') AS foreign_ FROM i)
SELECT doc_id, n_links, dangling, lacking, foreign_ AS "foreign", n_links >= 2 AND dangling = '' AND lacking = '' AND foreign_ = '' AS ok FROM f""")
def contents_faults(spark, d):
    """A10: contents whose links lead nowhere, required anchors that are missing, names that aren't ASCII."""
    return rules.contents_faults(books(spark, d), "doc_id", "text", _CONTENTS, ["ch-1", "ch-2"], 2)


@query(f"""WITH {_BOOKS}, k AS (SELECT doc_id, unnest(range(len(string_split_regex(text, '\\n[ \\t]*\\n')))) AS block_no, unnest(string_split_regex(text, '\\n[ \\t]*\\n')) AS block FROM b)
SELECT doc_id, block_no FROM k WHERE regexp_matches(block, '{_COUNT}') AND NOT regexp_matches(block, '{_CITED}') AND NOT regexp_matches(block, '{_DEBUNKED}') AND NOT regexp_matches(block, '{_CLAIM}')""")
def uncited_counts(spark, d):
    """A5: counts of runs without a source, those called wrong in the same block aside."""
    rows = rules.blocks(books(spark, d), "doc_id", "text")
    found = rules.uncited_counts(rows, "doc_id", _CLAIM, _COUNT, _CITED, _DEBUNKED)
    return found.select("doc_id", F.col("block_no").cast("long").alias("block_no"))


@query("""WITH r AS (SELECT p_partkey, CAST(p_partkey % 100 AS VARCHAR) AS title, CASE WHEN p_partkey % 11 > 0 THEN CAST((p_partkey + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END) % 100 AS VARCHAR) END AS meta, lower('10.1/P' || (p_partkey % 130)) AS doi FROM part), k AS (SELECT lower('10.1/p' || s_suppkey) AS doi, CAST(s_suppkey % 97 AS VARCHAR) AS owner FROM supplier),
m AS (SELECT r.*, owner FROM r LEFT JOIN k USING (doi)), f AS (SELECT p_partkey, unnest(list_filter([CASE WHEN meta IS NULL THEN 'no metadata id' END, CASE WHEN title <> meta THEN 'title and metadata' END, CASE WHEN owner <> meta THEN 'DOI and metadata' END], lambda x: x IS NOT NULL)) AS fault FROM m) SELECT * FROM f""")
def identity_faults(spark, d):
    """Ids of titles, of metadata and of the owners of DOIs that don't agree."""
    k = F.col("p_partkey")
    meta = F.when(k % 11 > 0, ((k + F.when(k % 9 == 0, 1).otherwise(0)) % 100).cast("string"))
    known = table(spark, d, "supplier").select(F.concat(F.lit("10.1/p"), F.col("s_suppkey").cast("string")).alias("doi"), (F.col("s_suppkey") % 97).cast("string").alias("id"))
    return rules.identities(table(spark, d, "part"), "p_partkey", (k % 100).cast("string"), meta, F.concat(F.lit(" 10.1/P"), (k % 130).cast("string")), known)


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 45) AS large, max(l_discount) AS top FROM lineitem GROUP BY 1), v AS (SELECT l_suppkey, unnest(range(3)) AS check_no, unnest([CASE WHEN n >= 600 THEN '[PASS] ' ELSE '[FAIL] ' END || 'lines: ' || n, CASE WHEN large * 10 <= n THEN '[PASS] ' ELSE '[FAIL] ' END || 'large orders: ' || large, CASE WHEN top < 0.1 THEN '[PASS] ' ELSE '[FAIL] ' END || 'discount: ']) AS line FROM s)
SELECT l_suppkey, CAST(check_no AS INT) AS check_no, line FROM v""")
def supplier_verdicts(spark, d):
    """SNK5: a report's checks as lines of text."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 45).alias("large"), F.max("l_discount").alias("top"))
    checks = {"lines": (F.col("n") >= 600, F.col("n")), "large orders": (F.col("large") * 10 <= F.col("n"), F.col("large")), "discount": (F.col("top") < 0.1, F.lit(None).cast("string"))}
    return reports.verdicts(s, "l_suppkey", checks)


_WS = r"[ \t\n\r\f\x0b]+"
_SQUEEZED = f"trim(regexp_replace(c, '{_WS}', ' ', 'g'))"
_CLAIMS_OF = lambda p: f"list_filter(list_transform(regexp_extract_all(body, '{p}'), lambda c: {_SQUEEZED}), lambda c: length(c) >= 40)"
_DIMS = "m AS (SELECT doc_id, " + ", ".join(f"{_CLAIMS_OF(a)} AS s{k}, {_CLAIMS_OF(z)} AS r{k}" for k, (a, z) in enumerate(DIMENSIONS.values())) + " FROM (SELECT doc_id, left(text, CAST(floor(length(text) * 0.85) AS INT)) AS body FROM documents WHERE text IS NOT NULL AND text <> ''))"
_FIRST = lambda xs: f"list_slice(list_filter({xs}, lambda x, i: list_position({xs}, x) = i), 1, 3)"
_PART = lambda k, n: f"chr(10) || '### {n}' || chr(10) || chr(10) || CASE WHEN len(s{k}) > 0 THEN '- ' || array_to_string({_FIRST(f's{k}')}, chr(10) || '- ') WHEN len(r{k}) > 0 THEN '- ' || array_to_string({_FIRST(f'r{k}')}, ' (relaxed)' || chr(10) || '- ') || ' (relaxed)' ELSE '(not found)' END || chr(10)"


@query(f"""WITH {_DIMS}, x AS (SELECT doc_id, text, source, CASE WHEN doc_id % 3 > 0 THEN '10.1/' || doc_id END AS found, CASE WHEN doc_id % 4 > 0 THEN '10.1/' || (doc_id - doc_id % 5) END AS declared, list_slice(regexp_extract_all(text, '[^\n.]*[0-9]+%[^\n.]*'), 1, 8) AS claims FROM documents)
SELECT doc_id, md5('# Card ' || doc_id || chr(10) || chr(10) || '> level of evidence: ' || CASE WHEN text IS NOT NULL AND text <> '' THEN 'A' WHEN source IS NOT NULL THEN 'B' ELSE 'C' END || chr(10) || chr(10) || '| field | value |' || chr(10) || '| :--- | :--- |' || chr(10) || '| DOI | `' || coalesce(found, declared, 'TODO') || '` |' || chr(10) || '| source | ' || coalesce(source, 'TODO') || ' |' || chr(10)
 || CASE WHEN found <> declared THEN chr(10) || '> conflict: `' || declared || '` was declared, `' || found || '` stands in the text' || chr(10) WHEN found IS NULL AND declared IS NOT NULL THEN chr(10) || '> declared only: no identifier in the text' || chr(10) ELSE '' END
 || chr(10) || '## Abstract' || chr(10) || chr(10) || '> ' || coalesce(nullif(left(text, 60), ''), 'TODO') || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10) || CASE WHEN len(claims) > 0 THEN array_to_string(list_transform(claims, lambda c, i: i || '. ' || {_SQUEEZED}), chr(10)) ELSE '(none)' END || chr(10) || chr(10) || '## Skeleton' || chr(10)
 || CASE WHEN s0 IS NOT NULL THEN {" || ".join(_PART(k, n) for k, n in enumerate(DIMENSIONS))} ELSE chr(10) || '(no text, no skeleton)' || chr(10) END) AS card FROM x LEFT JOIN m USING (doc_id)""")
def evidence_cards(spark, d):
    """CMP3, CMP4, STR9: a card of each document with its level of evidence, its identifiers and their conflict, and its skeleton, as a digest."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    k, said = F.col("doc_id"), F.coalesce(F.col("text") != "", F.lit(False))
    found, declared = F.when(k % 3 > 0, F.concat(F.lit("10.1/"), k.cast("string"))), F.when(k % 4 > 0, F.concat(F.lit("10.1/"), (k - k % 5).cast("string")))
    # What stands between full stops and line ends and holds a percentage.
    claims = F.slice(F.filter(F.split("text", r"[.\n]"), lambda x: x.rlike("[0-9]%")), 1, 8)
    dims = text.skeleton(docs.filter(said), "doc_id", "text", DIMENSIONS)
    cards = reports.evidence_cards(docs, "doc_id", {"source": F.col("source")}, reports.evidence_level(said, F.col("source").isNotNull()), found, declared, F.substring("text", 1, 60), claims, dims, list(DIMENSIONS))
    return cards.select("doc_id", F.md5(F.col("card").cast("binary")).alias("card"))
