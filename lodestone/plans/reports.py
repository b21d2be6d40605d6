"""Queries of reports and examinations, over the book of plans.rules and papers put together from suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import exams, markup, reports, text
from lodestone.plans.rules import _BARE, _BLOCKS, _BOOK, _MISSING, _PROSE, CITED, CLAIM, SECTIONS, book
from lodestone.sources import files, table
from lodestone.sources.staging import shared_dir

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


#: A paper and a sheet for each supplier k, with defects by remainders; expressions that both engines read.
PAPER = """CASE WHEN k % 11 = 0 THEN 'Total 90 points' ELSE 'Total 100 points' END || chr(10) || 'Time 30 minutes' || chr(10) || '## A. Choice (2 points each, ' || CASE WHEN k % 7 = 0 THEN 8 ELSE 6 END || ' points)' || chr(10)
 || '1. one' || chr(10) || '2. two' || chr(10) || CASE WHEN k % 5 = 0 THEN '4. three' ELSE '3. three' END || chr(10) || '## B. Essays (94 points)' || chr(10) || '4. four (40 points)' || chr(10) || CASE WHEN k % 3 = 0 THEN '5. five' ELSE '5. five (54 points)' END"""
SHEET = """'## A. Choice' || chr(10) || '| 1 | a |' || chr(10) || '| 2 | b |' || chr(10) || CASE WHEN k % 4 = 0 THEN '' ELSE '| 3 | c |' || chr(10) END || '## B. Essays' || chr(10) || '### Question 4 (' || CASE WHEN k % 6 = 0 THEN 41 ELSE 40 END || ' points)' || chr(10)
 || '- first (20 points)' || chr(10) || '- second (' || CASE WHEN k % 9 = 0 THEN 25 ELSE 20 END || ' points)' || chr(10) || '### Question 5' || chr(10) || '- all of it (50 points)' || chr(10) || '- style'"""


def _papers(spark, d, body: str):
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("exam")).select("exam", F.expr(body.replace(" k %", " exam %")).alias("text"))


_EXAMS = f"""p AS (SELECT k AS exam, {PAPER} AS text FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)), a AS (SELECT k AS exam, {SHEET} AS text FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)),
pl AS (SELECT exam, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM p), al AS (SELECT exam, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM a),
ps AS (SELECT *, sum(CAST(starts_with(line, '## ') AS INT)) OVER w AS section, last_value(CASE WHEN starts_with(line, '## ') THEN line END IGNORE NULLS) OVER w AS head FROM pl WINDOW w AS (PARTITION BY exam ORDER BY n ROWS UNBOUNDED PRECEDING)),
q AS (SELECT exam, section, n, CAST(nullif(regexp_extract(line, '^([0-9]+)\\. ', 1), '') AS BIGINT) AS question, CAST(nullif(regexp_extract(line, '\\(([0-9]+) points\\)', 1), '') AS BIGINT) AS points, CAST(nullif(regexp_extract(head, '([0-9]+) points each', 1), '') AS BIGINT) AS each, CAST(nullif(regexp_extract(head, '([0-9]+) points\\)', 1), '') AS BIGINT) AS total FROM ps),
v AS (SELECT *, coalesce(points, each, CASE WHEN count(*) FILTER (WHERE points IS NULL AND each IS NULL) OVER s = 1 THEN total - coalesce(sum(points) OVER s, 0) END) AS worth, row_number() OVER (PARTITION BY exam ORDER BY n) AS k FROM q WHERE question IS NOT NULL AND section > 0 WINDOW s AS (PARTITION BY exam, section)),
am AS (SELECT exam, line, last_value(coalesce(CAST(nullif(regexp_extract(line, '^### Question ([0-9]+)', 1), '') AS BIGINT), CAST(nullif(regexp_extract(line, '^\\| ([0-9]+) \\|', 1), '') AS BIGINT), CASE WHEN starts_with(line, '## ') THEN 0 END) IGNORE NULLS) OVER (PARTITION BY exam ORDER BY n ROWS UNBOUNDED PRECEDING) AS question FROM al),
an AS (SELECT exam, question, max(CASE WHEN starts_with(line, '### ') THEN CAST(nullif(regexp_extract(line, '\\(([0-9]+) points\\)', 1), '') AS BIGINT) END) AS points, sum(CASE WHEN starts_with(line, '- ') THEN CAST(nullif(regexp_extract(line, '\\(([0-9]+) points\\)', 1), '') AS BIGINT) END) AS allotted, count(*) FILTER (WHERE starts_with(line, '- ') AND NOT regexp_matches(line, '\\([0-9]+ points\\)')) AS n_open FROM am WHERE question > 0 GROUP BY 1, 2),
sc AS (SELECT exam, section, max(each) AS each, max(total) AS total, count(*) AS n, sum(points) AS known, count(*) FILTER (WHERE points IS NULL) AS open FROM v GROUP BY 1, 2), b AS (SELECT an.exam, an.question, an.points AS stated, allotted, n_open, worth FROM an JOIN v ON an.exam = v.exam AND an.question = v.question)"""


@query(f"""WITH {_EXAMS} SELECT exam, 'S1' AS rule, h AS place FROM p, (VALUES ('Total 100 points'), ('Time 30 minutes')) AS t(h) WHERE NOT contains(text, h)
UNION ALL SELECT exam, 'S2', CAST(section AS VARCHAR) FROM sc WHERE each IS NOT NULL AND total IS NOT NULL AND each * n <> total
UNION ALL SELECT exam, 'S3', CAST(section AS VARCHAR) FROM sc WHERE each IS NULL AND (total IS NULL OR (open = 0 AND known <> total) OR (open = 1 AND total - coalesce(known, 0) <= 0) OR open > 1)
UNION ALL SELECT exam, 'S4', CAST(s AS VARCHAR) FROM (SELECT exam, sum(coalesce(total, 0)) AS s FROM sc GROUP BY 1) WHERE s <> 100 UNION ALL SELECT exam, 'S5', CAST(question AS VARCHAR) FROM v WHERE k <> question
UNION ALL SELECT v.exam, 'S6', CAST(v.question AS VARCHAR) FROM v WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.exam = v.exam AND an.question = v.question) UNION ALL SELECT an.exam, 'S6', CAST(-an.question AS VARCHAR) FROM an WHERE NOT EXISTS (SELECT 1 FROM v WHERE an.exam = v.exam AND an.question = v.question)
UNION ALL SELECT exam, 'S7', CAST(question AS VARCHAR) FROM b WHERE stated <> worth UNION ALL SELECT exam, 'S8', CAST(question AS VARCHAR) FROM b WHERE allotted > coalesce(stated, worth) OR (n_open = 0 AND allotted <> coalesce(stated, worth))""")
def exam_faults(spark, d):
    """CMP13, STR23: rules S1 to S8 over papers and answer sheets."""
    return exams.faults(_papers(spark, d, PAPER), _papers(spark, d, SHEET), "exam", "text")


#: family, severity, concept, include, exclude: what a reader may not know.
LEXICON = [("endings", "P0", "tion", "tion ", "nothing"), ("endings", "P1", "able", "able", "wh"), ("numbers", "P0", "(1)/(x)", r"\(1\)/", "nothing"), ("marks", "P1", "Limits", "Limits", "Method"), ("marks", "P0", "12%", "12%", "nothing")]
PATCHES = [("tion", "words"), ("able", "words"), ("(1)/(x)", "formulas"), ("12%", "formulas")]
_EXPLAINED, _FORMULA, _CARD, _BASELINE = "that is|of the of", r"\(式\)|%", r"\| a \| ([^|]*)", ["Limits"]
_CONCEPTS = f"""l AS (SELECT chapter, coalesce(regexp_extract(text, '{_CARD}', 1), '') AS card, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM b),
w AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY chapter ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM l), x AS ({' UNION ALL '.join(f"SELECT '{f}' AS family, '{s}' AS severity, '{c}' AS concept, * FROM w WHERE regexp_matches(line, '{i}') AND NOT regexp_matches(line, '{e}')" for f, s, c, i, e in LEXICON)}),
y AS (SELECT *, row_number() OVER (PARTITION BY chapter, concept ORDER BY n) AS k FROM x), z AS (SELECT chapter, family, concept, n AS line_no, CASE WHEN regexp_matches(near, '{_EXPLAINED}') OR contains(card, concept) OR concept = 'Limits' THEN NULL WHEN severity = 'P0' AND regexp_matches(line, '{_FORMULA}') THEN 'P0+' ELSE severity END AS severity FROM y WHERE k = 1)"""


def _bare(spark, d):
    lexicon = spark.createDataFrame(LEXICON, "family string, severity string, concept string, include string, exclude string")
    return reports.bare_concepts(book(spark, d), "chapter", "text", lexicon, _EXPLAINED, _FORMULA, _BASELINE, _CARD)


@query(f"WITH {_BOOK}, {_CONCEPTS} SELECT * FROM z")
def bare_concepts(spark, d):
    """CMP17, FLT5, WIN5, STR19."""
    return _bare(spark, d)


@query(f"""WITH {_BOOK}, {_CONCEPTS}, f AS (SELECT chapter, line_no, concept, row_number() OVER (PARTITION BY chapter ORDER BY severity <> 'P0+', line_no, concept) AS k FROM z WHERE severity IS NOT NULL), s AS (SELECT chapter, count(*) AS n_concepts, count(severity) AS n_bare, count(*) FILTER (WHERE severity = 'P0') AS p0, count(*) FILTER (WHERE severity = 'P0+') AS fatal FROM z GROUP BY 1)
SELECT s.*, round(100.0 * n_bare / n_concepts, 1) AS bare_rate, line_no AS first_line, concept AS first_break FROM s LEFT JOIN (SELECT * FROM f WHERE k = 1) f ON s.chapter = f.chapter""".replace("SELECT s.*,", "SELECT s.chapter, n_concepts, n_bare, p0, fatal,"))
def break_summary(spark, d):
    """AGG9, CMP17: the first break of each chapter and its bare concepts by severity."""
    return reports.break_summary(_bare(spark, d), "chapter")


@query(f"""WITH {_BOOK}, {_CONCEPTS}, t AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{p}')" for c, p in PATCHES)}) AS t(concept, patch)) SELECT patch, count(*) AS n, count(DISTINCT chapter) AS texts, count(*) FILTER (WHERE severity = 'P0+') AS fatal FROM z JOIN t ON z.concept = t.concept WHERE severity IS NOT NULL GROUP BY 1""")
def patch_pareto(spark, d):
    """AGG10, JN7."""
    return reports.patches(_bare(spark, d), "chapter", spark.createDataFrame(PATCHES, "concept string, patch string"))


@query(f"""WITH {_BOOK}, s AS (SELECT chapter, list_distinct(flatten(list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '(式)')), lambda x: regexp_extract_all(replace(x, '(式)', ''), '[A-Za-z][A-Za-z0-9_]{{0,7}}')))) AS f FROM b)
SELECT chapter, len(f) AS n_symbols, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(['the', 'of'], x))), ',') AS missing FROM s""")
def unlisted_symbols(spark, d):
    """STR18."""
    return reports.unlisted_symbols(book(spark, d), "chapter", "text", "(式)", ["the", "of"])


@query(f"""WITH {_BOOK}, l AS (SELECT chapter, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM b), s AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '^ *> *T') THEN 1 WHEN NOT starts_with(trim(line), '>') THEN 0 END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS inside, len(regexp_extract_all(line, '[a-z]')) AS c FROM l)
SELECT chapter, round(CAST(sum(c * inside) AS DOUBLE) / nullif(sum(c), 0), 6) AS share FROM s GROUP BY 1""")
def box_shares(spark, d):
    """STR17."""
    return reports.box_share(book(spark, d), "chapter", "text", "^ *> *T", "[a-z]")


@query(f"""WITH {_BOOK}, {_CONCEPTS}, m AS (SELECT chapter, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM b), s AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '^ *> *T') THEN 1 WHEN NOT starts_with(trim(line), '>') THEN 0 END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS inside, len(regexp_extract_all(line, '[a-z]')) AS c FROM m),
x AS (SELECT chapter, round(CAST(sum(c * inside) AS DOUBLE) / nullif(sum(c), 0), 6) AS share FROM s GROUP BY 1), o AS (SELECT chapter, len(regexp_extract_all(text, '[a-z]')) AS letters, len(regexp_extract_all(text, '\\$\\$[^$]+\\$\\$')) AS formulas, len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(')) AS images FROM b), k AS (SELECT chapter, count(*) AS concepts, count(severity) AS bare FROM z GROUP BY 1)
SELECT o.chapter, letters, formulas, images, share, coalesce(concepts, 0) AS concepts, coalesce(bare, 0) AS bare, round(1000.0 * coalesce(concepts, 0) / nullif(letters, 0), 4) AS density FROM o LEFT JOIN x ON o.chapter = x.chapter LEFT JOIN k ON o.chapter = k.chapter""".replace("y AS (SELECT *, row_number() OVER (PARTITION BY chapter, concept ORDER BY n) AS k FROM x)", "y AS (SELECT *, row_number() OVER (PARTITION BY chapter, concept ORDER BY n) AS k FROM c0)").replace(", x AS (SELECT 'endings'", ", c0 AS (SELECT 'endings'"))
def reader_report(spark, d):
    """CMP16: what a reader meets in each chapter."""
    return reports.reader_report(book(spark, d), "chapter", "text", _bare(spark, d), "^ *> *T", "[a-z]")


_TERMS = ["tion", "eau", "able", "Limits", "TODO", "zzz"]


@query(f"WITH {_BOOK} SELECT term, CAST(sum(n) AS BIGINT) AS n, min(chapter) AS first_in FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS term, chapter, len(regexp_extract_all(text, '{t}')) AS n FROM b" for t in _TERMS) + ") WHERE n > 0 GROUP BY 1 ORDER BY n DESC, term LIMIT 4")
def frequent_terms(spark, d):
    """TOP9, CMP16: the four most frequent terms."""
    return reports.term_table(book(spark, d), "chapter", "text", _TERMS, 4)


@query(rf"""WITH {_BOOK}, {_BLOCKS}, g AS (SELECT *, regexp_matches(block, '{CITED}') AS cited, len(regexp_extract_all(block, '(?m)^[ \t]*\|')) >= 2 AS tab FROM f), h AS (SELECT *, (coalesce(lag(cited) OVER w, false) OR coalesce(lead(cited) OVER w, false)) AND tab AS beside FROM g WINDOW w AS (PARTITION BY chapter ORDER BY block_no)),
u AS (SELECT chapter, count(*) AS uncited FROM h WHERE NOT in_fence AND NOT cited AND NOT beside AND regexp_matches(block, '{CLAIM}') GROUP BY 1), o AS (SELECT chapter, {_PROSE} AS n, {_MISSING.format(level='##')} AS lacks FROM b)
SELECT o.chapter, n, lacks, coalesce(uncited, 0) AS uncited, n >= 600 AND lacks = '' AND uncited IS NULL AS ok FROM o LEFT JOIN u ON o.chapter = u.chapter""")
def chapter_report(spark, d):
    """CMP15, SNK5."""
    return reports.chapter_report(book(spark, d), "chapter", "text", 600, SECTIONS, CLAIM, CITED)


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS declared, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE source END END AS verified, nullif(regexp_extract(text, '[a-z]+[0-9]*'), '') AS sniffed FROM documents),
s AS (SELECT *, CASE WHEN verified <> declared THEN 'conflict' WHEN verified IS NULL AND declared IS NOT NULL THEN 'declared only' WHEN verified IS NULL THEN 'unverified' WHEN declared IS NULL THEN 'verified only' ELSE 'agrees' END AS status FROM x)
SELECT doc_id, status, status IN ('agrees', 'verified only', 'declared only') AS declared_ok, sniffed IS NULL OR sniffed IS NOT DISTINCT FROM verified AS text_ok FROM s""")
def id_statuses(spark, d):
    """JN15: declared, verified and found identifiers, here sources."""
    k = F.col("doc_id")
    declared = F.when(k % 4 != 0, F.col("source"))
    verified = F.when(k % 3 != 0, F.when(k % 5 == 0, F.lit("other")).otherwise(F.col("source")))
    sniffed = F.nullif(F.regexp_extract("text", "[a-z]+[0-9]*", 0), F.lit(""))
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in reports.id_status(declared, verified, sniffed).items()])


@query(r"""WITH c AS (SELECT doc_id, source, lang, n_chars, list_distinct(list_transform(regexp_extract_all(text, '[^\n.]*[0-9]+%[^\n.]*'), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\x0b]+', ' ', 'g')))) AS every, list_slice(list_transform(regexp_extract_all(text, '[^\n.]*[0-9]+%[^\n.]*'), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\x0b]+', ' ', 'g'))), 1, 8) AS claims FROM documents)
SELECT doc_id, md5('# Card ' || doc_id || chr(10) || chr(10) || '| field | value |' || chr(10) || '| :--- | :--- |' || chr(10) || '| source | ' || coalesce(source, 'TODO') || ' |' || chr(10) || '| lang | ' || coalesce(lang, 'TODO') || ' |' || chr(10) || '| length | ' || coalesce(CAST(n_chars AS VARCHAR), 'TODO') || ' |' || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10) || CASE WHEN len(claims) > 0 THEN '- ' || array_to_string(claims, chr(10) || '- ') ELSE '(none)' END || chr(10)) AS card FROM c WHERE every IS NOT NULL""")
def fact_cards(spark, d):
    """CMP3, CMP4, SNK1: a card per document, as its digest."""
    docs = table(spark, d, "documents").filter("text is not null")
    # What stands between full stops and line ends and holds a percentage.
    claims = F.filter(F.split("text", r"[.\n]"), lambda x: x.rlike("[0-9]%"))
    out = reports.cards(docs, "doc_id", {"source": F.col("source"), "lang": F.col("lang"), "length": F.col("n_chars")}, claims)
    return out.select("doc_id", F.md5(F.col("card").cast("binary")).alias("card"))


_FENCED = "f AS (SELECT *, starts_with(line, '```') OR sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY chapter ORDER BY n ROWS UNBOUNDED PRECEDING) % 2 = 1 AS fence FROM l)"
_LINES = "l AS (SELECT chapter, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM b)"


@query(f"""WITH {_BOOK}, {_LINES}, {_FENCED}, h AS (SELECT *, regexp_matches(line, '^#{{1,5}} ') AND NOT fence AS head FROM f), k AS (SELECT *, 'a' || chapter || '-' || sum(CAST(head AS INT)) OVER (PARTITION BY chapter ORDER BY n ROWS UNBOUNDED PRECEDING) AS anchor FROM h),
p AS (SELECT chapter, n, CASE WHEN head THEN '<a id="' || anchor || '"></a>' || chr(10) || '#' || line ELSE line END AS line, CASE WHEN head THEN '- [' || regexp_replace(line, '^#{{1,5}} +', '') || '](#' || anchor || ')' END AS entry FROM k),
w AS (SELECT chapter, '## Contents' || chr(10) || chr(10) || coalesce(string_agg(entry, chr(10) ORDER BY n), '') || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n) AS text, count(entry) AS n_entries FROM p GROUP BY 1)
SELECT chapter, md5(text) AS digest, n_entries, len(list_filter(regexp_extract_all(text, '\\]\\(#([^)]+)\\)', 1), lambda x: NOT list_contains(regexp_extract_all(text, '<a id="([^"]+)"', 1), x))) = 0 AS ok FROM w""")
def assembled_book(spark, d):
    """CMP8, CMP9, CMP11, STR26: with contents, anchors, headings one level down, and the links checked."""
    return reports.assembled(book(spark, d), "chapter", "text").select("chapter", F.md5(F.col("text").cast("binary")).alias("digest"), "n_entries", "ok")


_UNITS, _SCAFFOLD = ["kPa", "Hz", "ms", "mm", "GB", "[mskhWJNK]", "°"], "source P|images/|[Ss]ection|token|#[0-9]"


def _numbers_sql(texts: str, key: str) -> str:
    """The same of texts (key, text), as common tables of the other engine that end in numbers."""
    kinds = {"percent": reports.NUMBER + reports.BLANKS + "%", "unit": f"{reports.NUMBER}{reports.BLANKS}(?:{'|'.join(_UNITS)})", "integer": "[0-9.．]+[%％]?"}
    each = " UNION ALL ".join(f"SELECT {key}, text, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM ({texts}) WHERE text IS NOT NULL" for k, p in kinds.items())
    return f"""x AS ({each}), y AS (SELECT *, unnest(range(len(m))) AS i FROM x), z AS (SELECT {key}, text, kind, m[i + 1] AS match, CAST(list_sum(list_transform(list_slice(g, 1, i + 1), lambda v: length(v))) AS BIGINT) + coalesce(CAST(list_sum(list_transform(list_slice(m, 1, i), lambda v: length(v))) AS BIGINT), 0) AS start FROM y),
w AS (SELECT {key}, kind, regexp_extract(match, '{reports.NUMBER}') AS number, start, start + length(match) AS "end", substring(text, greatest(start - 28, 0) + 1, start + length(match) + 28 - greatest(start - 28, 0)) AS around FROM z WHERE kind <> 'integer' OR regexp_full_match(match, '[0-9]{{2,4}}')),
numbers AS (SELECT *, kind = 'percent' OR NOT (regexp_full_match(number, '20[0-9]{{2}}') OR regexp_matches(around, '{_SCAFFOLD}')) AS judged FROM w)"""


@query(f'WITH {_numbers_sql("SELECT doc_id, text FROM documents", "doc_id")} SELECT doc_id, kind, number, start, "end", md5(around) AS around, judged FROM numbers')
def number_places(spark, d):
    """STR12, FLT6: percentages, numbers with units and integers with their places, and whether what stands around excuses them."""
    found = reports.numbers(table(spark, d, "documents"), "doc_id", "text", _UNITS, _SCAFFOLD)
    return found.select("doc_id", "kind", "number", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.col("around").cast("binary")).alias("around"), "judged")


@query(f"""WITH {_BOOK}, {_numbers_sql("SELECT chapter, text FROM b", "chapter")}, o AS (SELECT DISTINCT conv_id AS chapter, unnest(regexp_extract_all(text, '{reports.NUMBER}')) AS number FROM conversations), e AS (SELECT DISTINCT unnest(regexp_extract_all(html, '{reports.NUMBER}')) AS number FROM pages),
n AS (SELECT DISTINCT chapter, number FROM numbers WHERE judged)
SELECT n.chapter, n.number, CASE WHEN o.number IS NOT NULL THEN 'own' WHEN e.number IS NOT NULL THEN 'other' ELSE 'none' END AS tier FROM n LEFT JOIN o ON n.chapter = o.chapter AND n.number = o.number LEFT JOIN e ON n.number = e.number""")
def number_tiers(spark, d):
    """CMP14, FLT6, JN9, STR12: where a chapter's numbers come from."""
    every = lambda text: F.explode(F.regexp_extract_all(text, F.lit(reports.NUMBER), F.lit(0))).alias("number")
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("chapter"), every("text"))
    found = reports.numbers(book(spark, d), "chapter", "text", _UNITS, _SCAFFOLD)
    return reports.number_tiers(found, "chapter", own, table(spark, d, "pages").select(every("html")))


@query(f"""WITH {_BOOK} SELECT chapter, md5(replace(replace(text, '](./images/', '](../img/'), '](#s0', '](#start')) AS digest FROM b""")
def pointed_links(spark, d):
    """PRJ14."""
    return book(spark, d).select("chapter", F.md5(reports.pointed_to(F.col("text"), {"./images/": "../img/", "#s0": "#start"}).cast("binary")).alias("digest"))


@query(f"""WITH {_BOOK}, {_LINES}, {_FENCED}, h AS (SELECT chapter, n, line FROM f WHERE regexp_matches(line, '^#{{1,6}} ') AND NOT fence) SELECT chapter, n AS line_no, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS level, trim(regexp_replace(line, '^#{{1,6}} ', '')) AS title, lower(regexp_replace(trim(regexp_replace(line, '^#{{1,6}} ', '')), '[^A-Za-z0-9]+', '-', 'g')) AS anchor FROM h""")
def heading_anchors(spark, d):
    """STR15, STR26, WIN1."""
    out = markup.headings(text.fenced(text.lines(book(spark, d), "text"), ["chapter"]), ["chapter"])
    return out.select("chapter", F.col("line_no").cast("long").alias("line_no"), F.col("level").cast("long").alias("level"), "title", "anchor")


@query(f"""WITH {_BOOK}, {_LINES}, {_FENCED}, p AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY chapter ORDER BY n), '') AS before FROM f), a AS (SELECT chapter, n, CASE WHEN regexp_matches(line, '^#{{1,6}} ') AND NOT fence AND NOT starts_with(before, '<a id=') THEN '<a id="' || lower(regexp_replace(trim(regexp_replace(line, '^#{{1,6}} ', '')), '[^A-Za-z0-9]+', '-', 'g')) || '"></a>' || chr(10) || line ELSE line END AS line FROM p)
SELECT chapter, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM a GROUP BY 1""")
def anchored_lines(spark, d):
    """STR21."""
    rows = markup.anchored(text.fenced(text.lines(book(spark, d), "text"), ["chapter"]), ["chapter"])
    return text.concatenated(rows, ["chapter"], "line_no", "line").select("chapter", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {_BOOK}, {_LINES}, {_FENCED} SELECT chapter, md5(string_agg(CASE WHEN regexp_matches(line, '^#{{1,5}} ') AND NOT fence THEN '#' || line ELSE line END, chr(10) ORDER BY n)) AS digest FROM f GROUP BY 1""")
def demoted_headings(spark, d):
    """PRJ13, CMP11."""
    rows = text.demoted(text.fenced(text.lines(book(spark, d), "text"), ["chapter"]))
    return text.concatenated(rows, ["chapter"], "line_no", "line").select("chapter", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(rf"""WITH {_BOOK}, s AS (SELECT chapter, regexp_replace(regexp_replace(text, '(?s)\n*(```[^\n]*\n.*?\n```)\n*', E'\n\n\\1\n\n', 'g'), '\n{{3,}}', E'\n\n', 'g') AS t, regexp_extract(text, '(?s)# Part(.*?)##', 1) AS m FROM b) SELECT chapter, md5(regexp_replace(t, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS spaced, regexp_replace(m, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS between FROM s""")
def spaced_fences(spark, d):
    """STR22, STR20, STR25: blank lines around fences; what stands between two literals."""
    t = F.col("text")
    return book(spark, d).select("chapter", F.md5(markup.fences_apart(t).cast("binary")).alias("spaced"), markup.between(t, "# Part", "##").alias("between"))


@query(f"""WITH {_BOOK}, h AS (SELECT chapter, text, position('TODO' IN text) - 1 AS start FROM b WHERE contains(text, 'TODO')) SELECT chapter, CAST(start AS BIGINT) AS start, len(regexp_extract_all(left(text, CAST(start AS BIGINT)), '===== \\[PAGE')) AS page FROM h""")
def pages_of_places(spark, d):
    """STR2: the page on which a place stands."""
    hits = book(spark, d).filter(F.contains("text", F.lit("TODO"))).withColumn("start", (F.instr("text", F.lit("TODO")) - 1).cast("long"))
    return hits.select("chapter", "start", text.page_of(F.col("text"), F.col("start").cast("int")).cast("long").alias("page"))


@query(f"""WITH {_BOOK} SELECT chapter, len(regexp_extract_all(text, '(?m)^## ')) AS headings, md5('| ' || chapter || ' | ' || len(regexp_extract_all(text, '(?m)^## ')) || ' |') AS line FROM b""")
def report_files(spark, d):
    """SNK1, SNK2, SNK6: a report written as Markdown and JSON lines in the shared folder, and both read back."""
    import uuid

    report = book(spark, d).select("chapter", F.regexp_count("text", F.lit("(?m)^## ")).cast("long").alias("headings"))
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    reports.write_report(report, "chapter", path)
    lines = spark.read.text(f"{path}/md").select(F.md5(F.col("value").cast("binary")).alias("line"), F.regexp_extract("value", r"^\| ([0-9]+) ", 1).cast("long").alias("chapter"))
    return spark.read.schema("chapter long, headings long").json(f"{path}/json").join(lines, "chapter").select("chapter", "headings", "line")


@query("SELECT r_name AS name, 'region ' || r_regionkey AS text FROM region")
def text_files(spark, d):
    """SRC4, SRC5, SNK1: texts written under a folder per key and read back as whole files."""
    import uuid

    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    regions = table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("text"))
    files.write_texts(regions, "name", "text", path)
    found = files.text_tree(spark, path, "part-*")
    return found.select(F.url_decode(F.regexp_extract("path", "name=([^/]+)/", 1)).alias("name"), F.rtrim(F.regexp_replace("text", "\n", " ")).alias("text"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS file, CAST(n_regionkey AS INT) AS pages, CASE WHEN n_regionkey > 1 THEN '10.1/' || n_nationkey END AS doi FROM nation")
def index_files(spark, d):
    """SRC3, DM1, DM2, SNK2: an index of records written as JSON lines, put into one document, and read back by its schema."""
    import uuid

    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    records = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("file"), F.col("n_regionkey").cast("int").alias("pages"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("10.1/"), F.col("n_nationkey").cast("string"))).alias("doi"))
    files.write_index(records, "id", f"{path}/lines")
    # An index has a record per paper, not per document of a corpus.
    lines = spark.read.text(f"{path}/lines").agg(F.concat(F.lit('{"generated_at": "x", "papers": ['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    lines.coalesce(1).write.text(f"{path}/whole")
    return files.index_json(spark, f"{path}/whole").select("id", "file", "pages", "doi")
