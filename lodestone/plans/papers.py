"""Queries of paper metadata: identifiers, years, journals, methods and records, over documents with a title page in front."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import lexicon
from lodestone.operators import audit, links, pages, text
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


#: What stands before a document's text, by its id; an expression that both engines read.
HEAD = """CASE doc_id % 5 WHEN 0 THEN 'Available online 3 May 20' || (10 + doc_id % 15) || '. ' WHEN 1 THEN 'VOL. 12, No. 4, 20' || (10 + doc_id % 12) || ' ' WHEN 2 THEN 'Copyright by the authors, 20' || (11 + doc_id % 9) || ' ' WHEN 3 THEN 'Accepted on May 2, 20' || (12 + doc_id % 8) || ' ' ELSE 'no date here 12020 2099 ' END
 || CASE doc_id % 4 WHEN 0 THEN 'doi 10.1016/j.ast.' || doc_id || '.,; ' WHEN 1 THEN '(10.2514/' || doc_id || '-A) ' ELSE '' END || CASE doc_id % 6 WHEN 0 THEN 'chinese journal of AERONAUTICS ' WHEN 1 THEN 'Engineering Optimization, Applied Thermal Engineering ' ELSE '' END
 || CASE doc_id % 7 WHEN 0 THEN 'with KRIGING and a Differential Evolution ' WHEN 1 THEN 'by multi-fidelity models and SHAP ' ELSE '' END"""
_PAPERS = f"p AS (SELECT doc_id, {HEAD} || text AS text FROM documents WHERE text IS NOT NULL)"
#: The last rule without lookbehind, which the other engine doesn't know.
_YEAR = ", ".join(f"nullif(regexp_extract(left(text, 6000), '{r}', 1), '')" for r in lexicon.YEAR_RULES[:4]) + ", nullif(regexp_extract(left(text, 6000), '(^|[^0-9])(20[0-2][0-9])([^0-9]|$)', 2), '')"
_JOURNAL = "CASE " + " ".join(f"WHEN contains(lower(left(text, 20000)), '{j.lower()}') THEN '{j}'" for j in lexicon.JOURNALS) + " END"
_METHODS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in lexicon.METHODS.items()) + "], lambda x: x IS NOT NULL), ';')"


def papers(spark, d):
    """(doc_id, text)."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.concat(F.expr(HEAD), F.col("text")).alias("text"))


@query(rf"""WITH {_PAPERS} SELECT doc_id, regexp_replace(nullif(regexp_extract(left(text, 6000), '\b10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), ''), '[.,;]+$', '') AS doi, coalesce({_YEAR}) AS year, {_JOURNAL} AS journal, {_METHODS} AS methods FROM p""")
def paper_metadata(spark, d):
    """CMP1, CMP5, STR3, STR4, STR5, STR10: the real rules over texts that meet all of them."""
    return text.paper_hints(papers(spark, d), "doc_id", "text").withColumn("methods", F.array_join("methods", ";"))


@query(rf"""WITH {_PAPERS}, s AS (SELECT doc_id, lower(trim(regexp_replace(nullif(regexp_extract(left(text, 6000), '\b10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), ''), '[.,;]+$', ''))) AS doi FROM p), k AS (SELECT doc_id AS paper, lower(CASE WHEN doc_id % 4 = 0 THEN '10.1016/J.AST.' || doc_id ELSE '10.2514/' || doc_id || '-a)' END) AS doi FROM documents WHERE doc_id % 8 < 2)
SELECT doc_id, paper FROM s JOIN k ON s.doi = k.doi""")
def papers_by_id(spark, d):
    """JN6: texts joined to known identifiers, whatever their case and the blanks around them."""
    found = text.paper_hints(papers(spark, d), "doc_id", "text").select("doc_id", "doi")
    known = table(spark, d, "documents").filter("doc_id % 8 < 2").select(F.col("doc_id").alias("paper"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  10.1016/J.AST."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("10.2514/"), F.col("doc_id").cast("string"), F.lit("-A) "))).alias("doi"))
    return text.by_identifier(found, known, "doi").select("doc_id", "paper")


@query(rf"""WITH {_PAPERS}, y AS (SELECT doc_id, coalesce({_YEAR}) AS year FROM p), c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '1999' WHEN doc_id % 9 = 1 THEN NULL ELSE (SELECT year FROM y WHERE y.doc_id = documents.doc_id) END AS curated FROM documents WHERE text IS NOT NULL)
SELECT y.doc_id, curated, year AS found FROM c JOIN y ON c.doc_id = y.doc_id WHERE curated IS DISTINCT FROM year""")
def curated_mismatches(spark, d):
    """JN1, D1b: curated values that differ from what the texts say."""
    found = text.paper_hints(papers(spark, d), "doc_id", "text").select("doc_id", F.col("year").alias("found"))
    curated = found.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "1999").when(F.col("doc_id") % 9 != 1, F.col("found")).alias("curated"))
    return audit.mismatches(curated, found, "doc_id", "curated", "found")


@query(r"""SELECT doc_id, md5(lower(regexp_replace(strip_accents(regexp_replace(regexp_replace(text, '===== \[PAGE[^\]]*\] =====', ' ', 'g'), '-[ \t\n\r\f\x0b]+', '', 'g')), '[^A-Za-z0-9%.]', '', 'g'))) AS comparable FROM documents WHERE text IS NOT NULL""")
def accent_free(spark, d):
    """PRJ4: texts made comparable whole: compatibility forms, page marks, hyphenation, accents, then ASCII alone."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(text.comparable_english("text").cast("binary")).alias("comparable"))


@query(r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS text FROM pages),
o AS (SELECT sha256(page_id || ':' || text) AS h FROM t), f AS (SELECT left(h, 4) AS r, sha256(string_agg(h, '' ORDER BY h)) AS h FROM o GROUP BY 1), w AS (SELECT left(r, 2) AS r, sha256(string_agg(h, '' ORDER BY r)) AS h FROM f GROUP BY 1), s AS (SELECT 'src-' || left(sha256(string_agg(h, '' ORDER BY r)), 12) AS generated_at FROM w)
SELECT page_id, title, length(text) AS chars, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[^\n]{0,120}?\b\d+(?:\.\d+)?\s?%[^\n]{0,120}'), lambda x: trim(x)), lambda x: length(x) >= 12))) AS claims, generated_at FROM t, s""")
def corpus_records(spark, d):
    """CMP2: pages scanned to text, with title, length, claims and the stamp of all of them: the records of an index."""
    pages = table(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"), text.page_text(F.col("html")).alias("text"))
    claims = F.transform(F.regexp_extract_all("text", F.lit(r"[^\n]{0,120}?\b\d+(?:\.\d+)?\s?%[^\n]{0,120}"), F.lit(0)), F.trim)
    stamped = text.stamp(pages, "page_id", "text").select(F.concat(F.lit("src-"), F.substring("stamp", 1, 12)).alias("generated_at"))
    # One row of one stamp.
    return pages.crossJoin(F.broadcast(stamped)).select("page_id", "title", F.length("text").cast("long").alias("chars"), F.size(F.array_distinct(F.filter(claims, lambda c: F.length(c) >= 12))).cast("long").alias("claims"), "generated_at")


@query(f"""WITH {_PAPERS}, m AS (SELECT coalesce({_YEAR}) AS year, doc_id, unnest(string_split({_METHODS}, ';')) AS method FROM p) SELECT year, method, count(*) AS n, min(doc_id) AS first_id FROM m WHERE method <> '' AND year IS NOT NULL GROUP BY 1, 2""")
def methods_by_year(spark, d):
    """CMP5, AGG8: which methods the texts of a year name, how often and first where."""
    found = text.paper_hints(papers(spark, d), "doc_id", "text").filter("year is not null")
    return found.select("year", "doc_id", F.explode("methods").alias("method")).groupBy("year", "method").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH b AS (SELECT item_id, text AS c FROM benchmark), h AS (SELECT doc_id, item_id, d.text, length(c) AS n, position(c IN d.text) - 1 AS start FROM documents d JOIN b ON contains(d.text, c) WHERE length(c) > 0)
SELECT doc_id, item_id, min(start) AS start, CASE WHEN bool_or(regexp_matches(substring(text, greatest(start - 400, 0) + 1, least(start, 400) + n + 400), '(tion|und) ')) THEN 'criticism' ELSE 'citation' END AS kind FROM h GROUP BY 1, 2""")
def linked_mentions(spark, d):
    """CMP6, JN5, STR11, TOP3: places where a text holds another one, and whether critical words stand around them."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("c"))
    return links.linked(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "c", "(tion|und) ")


#: Statements put before a document's text, by its id.
STATED = """'In trial ' || doc_id || ' the loss fell by ' || (doc_id % 90) || '.5% against the base design of all. ' || CASE doc_id % 3 WHEN 0 THEN 'A problem of 12 dimensional spaces was solved by it. It was faster.' WHEN 1 THEN 'The gain was improved by much, and the gain was improved by much more. ' ELSE 'short 5%. ' END || chr(10) || 'The loss fell by 7 % of   all the others there.' || chr(10)"""
_CLAIM_LISTS = ", ".join(f"list_transform(regexp_extract_all(text, '(?i){p}'), lambda x: ltrim(trim(regexp_replace(x, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), ' .,;:'))" for p in lexicon.CLAIMS)


@query(f"WITH p AS (SELECT doc_id, {STATED} || text AS text FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, list_filter(list_concat({_CLAIM_LISTS}), lambda x: length(x) BETWEEN 25 AND 320) AS c FROM p) SELECT doc_id, least(40, len(list_distinct(c))) AS n_claims, c[1] AS first_claim FROM c")
def paper_claims(spark, d):
    """STR7, STR8, CMP2: the different numeric claims of each text, forty at most, and the first of them."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.concat(F.expr(STATED), F.col("text")).alias("text"))
    return text.claimed(docs, "text").select("doc_id", F.size("claims").cast("long").alias("n_claims"), F.get("claims", F.lit(0)).alias("first_claim"))


@query(r"""SELECT page_id, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?i)<meta[^>]*charset="([^"]*)"', 1) AS charset, len(regexp_extract_all(html, '(?is)<div[^>]*class="ad"[^>]*>.*?</div>')) AS ads, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS footer FROM pages""")
def page_parts(spark, d):
    """SRC2: attributes, meta tags and named parts of pages."""
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", text.attribute(html, "html", "lang").alias("lang"), text.attribute(html, "meta", "charset").alias("charset"), F.regexp_count("html", F.lit(r'(?is)<div[^>]*class="ad"[^>]*>.*?</div>')).cast("long").alias("ads"), text.part(html, "footer").alias("footer"))


#: A page with metadata in its head and blocks of abstract in its body, by its id; ~ stands for a single quote.
METAS = """replace(CASE page_id % 4 WHEN 0 THEN '<meta name="citation_title" content="Loss &amp; gain ' || page_id || '"><meta content="other" name="citation_title">' WHEN 1 THEN '<meta content=~Only ' || page_id || '~ name="citation_title">' WHEN 2 THEN '<meta name=~citation_doi~ content=~10.1000/' || page_id || '~>' ELSE '' END
 || CASE page_id % 3 WHEN 0 THEN '<meta name="citation_author" content="One, A."><meta name="citation_author" content="Two &lt;B&gt;"><meta content="Late, C." name="citation_author">' WHEN 1 THEN '<meta content="Three, D." name="citation_author"><meta content="Four, E." name="citation_author">' ELSE '' END
 || CASE page_id % 2 WHEN 0 THEN '<meta property="og:description" content=" About ' || page_id || ' ">' ELSE '' END, '~', chr(39))"""
BLOCKS = """CASE page_id % 5 WHEN 0 THEN '<div class="x abstract">First <div>inner</div> and last ' || page_id || '</div>' WHEN 1 THEN '<div class="abstract">Flat &amp; short</div> between <div class="my-abstract">second</div>' ELSE '' END"""
BUILT = f"replace(replace(html, '<head>', '<head>' || {METAS}), '<article>', '<article>' || {BLOCKS})"


def _named(name: str) -> str:
    """Name before content, or else content before name, quotes of either kind, as an expression of the other engine."""
    either = lambda p: p.replace("Q", "[\"'']")
    first, second = either(f"<meta name=Q{name}Q content=Q([^\"'']*)Q"), either(f"<meta content=Q([^\"'']*)Q name=Q{name}Q")
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN regexp_extract(html, '{p}', 1) END" for p in (first, second)) + ")"


def _plain(x: str) -> str:
    return f"replace(replace(replace(replace(replace(replace({x}, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(rf"""WITH h AS (SELECT page_id, {BUILT} AS html FROM pages), b AS (SELECT *, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS body FROM h),
t AS (SELECT *, CASE page_id % 5 WHEN 0 THEN regexp_extract(body, '(?s)<div class="x abstract">(.*?</div>.*?)</div>', 1) WHEN 1 THEN regexp_extract(body, '(?s)<div class="abstract">(.*?)</div>', 1) || ' ' || regexp_extract(body, '(?s)<div class="my-abstract">(.*?)</div>', 1) ELSE body END AS said FROM b)
SELECT page_id, {_plain(_named("citation_title"))} AS title, {_named("citation_doi")} AS doi,
 array_to_string(CASE WHEN regexp_matches(html, '<meta name="citation_author"') THEN list_transform(regexp_extract_all(html, '<meta name="citation_author" content="([^"]*)"', 1), lambda x: {_plain("x")}) ELSE regexp_extract_all(html, '<meta content="([^"]*)" name="citation_author"', 1) END, ';') AS authors,
 trim(nullif(regexp_extract(html, '<meta property="og:description" content="([^"]*)"', 1), '')) AS description, CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS blocks,
 md5(regexp_replace(regexp_replace(nfc_normalize({_plain("regexp_replace(said, '(?s)<[^>]+>', ' ', 'g')")}), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS digest FROM t""")
def page_metadata(spark, d):
    """SRC2, PRJ1: named metadata in both orders, repeated authors, abstracts to their own closing tag, references decoded, text normalised."""
    found = pages.scan(table(spark, d, "pages").withColumn("html", F.expr(BUILT)), "page_id", "html")
    return found.select("page_id", F.col("meta.citation_title").alias("title"), F.col("meta.citation_doi").alias("doi"), F.array_join("authors", ";").alias("authors"), "description", "blocks", F.md5(F.col("text").cast("binary")).alias("digest"))


#: What stands in the raw text for what the normalised one holds: a soft hyphen, and two blanks for one.
_RAW = "replace(replace(text, 'tion', 'ti' || chr(173) || 'on'), ' ', '  ')"
_BEFORE = "CAST(list_sum(list_transform(list_slice(p, 1, hit + 1), lambda x: length(x))) AS BIGINT) + hit * 7"


@query(f"WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents), s AS (SELECT doc_id, string_split(raw, 'ti' || chr(173) || 'on  ') AS p FROM r WHERE raw IS NOT NULL), h AS (SELECT doc_id, p, unnest(range(len(p) - 1)) AS hit FROM s) SELECT doc_id, hit, {_BEFORE} AS raw_start, {_BEFORE} + 7 AS raw_end FROM h")
def raw_places(spark, d):
    """PRJ1, PRJ2, STR1: hits found after normalising, told in places of the raw text."""
    raw = F.replace(F.replace(F.col("text"), F.lit("tion"), F.lit("ti­on")), F.lit(" "), F.lit("  "))
    found = pages.raw_hits(table(spark, d, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw", "tion ")
    return found.select("doc_id", F.col("hit").cast("long").alias("hit"), F.col("raw_start").cast("long").alias("raw_start"), F.col("raw_end").cast("long").alias("raw_end"))


@query(r"""WITH t AS (SELECT conv_id, turn, '===== [PAGE ' || turn || '] =====' || chr(10) || text || ' ===== [PAGE x] =====' AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, length(t) AS length, md5(replace(regexp_replace(regexp_replace(t, '===== \[PAGE [0-9]\] =====', repeat(' ', 20), 'g'), '===== \[PAGE [0-9][0-9]\] =====', repeat(' ', 21), 'g'), chr(10), ' ')) AS digest FROM t""")
def same_length_views(spark, d):
    """PRJ2: page marks and line ends become as many spaces, so that places stay."""
    turns = table(spark, d, "conversations").filter("text is not null")
    t = F.concat(F.lit("===== [PAGE "), F.col("turn").cast("string"), F.lit("] =====\n"), F.col("text"), F.lit(" ===== [PAGE x] ====="))
    view = turns.select("conv_id", "turn", text.same_length_view(t).alias("view"))
    return view.select("conv_id", "turn", F.length("view").cast("long").alias("length"), F.md5(F.col("view").cast("binary")).alias("digest"))


#: A title, the word that opens an abstract, the text, and what ends it, by a document's id.
OPENED = """CASE doc_id % 6 WHEN 0 THEN 'A title. ABSTRACT ' WHEN 1 THEN 'A title. Abstract— ' WHEN 2 THEN 'A B S T R A C T, after Abstract ' WHEN 3 THEN 'Abstract at the very start ' WHEN 4 THEN 'no such word ' ELSE 'A title. Abstract ' END || substr(text, 1, 100 + doc_id % 11 * 90) || CASE doc_id % 4 WHEN 0 THEN ' Keywords one, two ' WHEN 1 THEN chr(10) || '1. Introduction ' WHEN 2 THEN ' Index Terms ' ELSE '' END || text"""
_AT = "coalesce(" + ", ".join(f"CASE WHEN position('{n}' IN text) > 1 AND position('{n}' IN text) <= 12000 THEN substring(text, position('{n}' IN text) + {len(n)}, 2200) END" for n in lexicon.ABSTRACT_OPENS) + ")"
_CUTS = ", ".join(f"nullif(length(regexp_extract(w, '(?s)^(.{{301,}}?)(?:{e})', 1)), 0)" for e in lexicon.ABSTRACT_ENDS)


@query(rf"""WITH p AS (SELECT doc_id, {OPENED} AS text FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, {_AT} AS w FROM p), c AS (SELECT doc_id, left(w, CAST(least({_CUTS}, 1800) AS BIGINT)) AS c FROM w), s AS (SELECT *, length(c) - position(' .' IN reverse(c)) - 1 AS stop FROM c)
SELECT doc_id, coalesce(trim(regexp_replace(CASE WHEN position('. ' IN c) > 0 AND stop > 400 THEN left(c, stop + 1) ELSE c END, '[ \t\n\r\f\x0b]+', ' ', 'g')), '') AS abstract FROM s""")
def abstract_windows(spark, d):
    """PRJ9, CMP3."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.expr(OPENED).alias("text"))
    return docs.select("doc_id", text.abstract_window(F.col("text")).alias("abstract"))
