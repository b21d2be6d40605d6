"""Queries of the rules over a marked-up book, which is put together from conversations: a chapter each, a block or more a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import rules, text
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}

_NL = "chr(10) || chr(10)"
#: What a turn becomes, as an expression that both engines read.
TURN = f"""CASE WHEN turn = 0 THEN '# Part ' || conv_id || {_NL} ELSE '' END || CASE WHEN role = 'assistant' THEN
 text || {_NL} || 'About ' || (7 * conv_id + turn) || '% of them' || CASE WHEN conv_id % 3 = 0 THEN ' [source P0' || (conv_id % 9) || ' 2]' ELSE '' END || '.' || {_NL} ||
 '![' || CASE WHEN conv_id % 4 = 0 THEN 'Flow chart ' ELSE 'Pressure ' END || (10 + turn) || CASE WHEN conv_id % 5 < 3 THEN ' P0' || (conv_id % 9) ELSE '' END || '](./images/flow_' || conv_id || '.png)'
 ELSE '## ' || CASE (conv_id + turn) % 4 WHEN 0 THEN 'Problem' WHEN 1 THEN 'Method' WHEN 2 THEN 'Result' ELSE 'Limits' END || ' ' || turn || {_NL} || text ||
 CASE WHEN turn % 4 = 2 THEN {_NL} || '```' || chr(10) || 'x = 5%' || {_NL} || 'y = 7%' || chr(10) || '```' ELSE '' END ||
 CASE conv_id % 7 WHEN 1 THEN {_NL} || '| name | value | remark |' || chr(10) || '|---|---|---|' || chr(10) || '| a | 12% |  |' || chr(10) || '| b | 3 | known |' WHEN 2 THEN ' $x$ ' || chr(92) || 'alpha'
 WHEN 3 THEN {_NL} || 'verbatim abstract' || chr(10) || '> ' || substr(replace(text, chr(10), ' '), 1, 70) || CASE WHEN conv_id % 2 = 0 THEN ' never said anywhere by anyone at all' ELSE '' END WHEN 4 THEN {_NL} || 'TODO: later'
 WHEN 5 THEN {_NL} || '(式) (1)/(x) = ' || turn ELSE ' See [it](#s' || turn || ') <a id="s' || (conv_id % 3) || '"></a>' END END"""
_BOOK = f"b AS (SELECT conv_id AS chapter, string_agg(body, {_NL} ORDER BY turn) AS text FROM (SELECT conv_id, turn, {TURN} AS body FROM conversations WHERE text IS NOT NULL) GROUP BY 1)"
_BLOCKS = r"""k AS (SELECT chapter, unnest(range(len(string_split_regex(text, '\n[ \t]*\n')))) AS block_no, unnest(string_split_regex(text, '\n[ \t]*\n')) AS block FROM b),
f AS (SELECT *, coalesce(sum(len(regexp_extract_all(block, '(?m)^```'))) OVER (PARTITION BY chapter ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 OR starts_with(block, '```') AS in_fence FROM k)"""
_BARE = "regexp_replace(text, '(?s)```.*?```', '', 'g')"
_PROSE = f"length(regexp_replace({_BARE}, '[ \\t\\n\\r\\f\\x0b]', '', 'g'))"
CITED = r"\[[^\]]{0,60}(source|P0[0-9])[^\]]{0,60}\]"
CLAIM = r"[0-9]+(\.[0-9]+)? ?%"
SECTIONS = ["Problem", "Method", "Result", "Limits"]
_MISSING = "array_to_string(list_filter(['Problem', 'Method', 'Result', 'Limits'], lambda w: NOT contains(array_to_string(regexp_extract_all(text, '(?m)^{level} +([^\\n]*)$', 1), chr(10)), w)), ',')"
_IMAGES = r"i AS (SELECT chapter, unnest(range(len(regexp_extract_all(text, '!\[([^\]]*)\]\(\./images/([^)]+)\)')))) AS image_no, unnest(regexp_extract_all(text, '!\[([^\]]*)\]\(\./images/([^)]+)\)', 1)) AS alt, unnest(regexp_extract_all(text, '!\[([^\]]*)\]\(\./images/([^)]+)\)', 2)) AS file FROM b)"


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


def book(spark: SparkSession, d: str) -> DataFrame:
    """(chapter, text)."""
    rows = table(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("chapter"), "turn", F.expr(TURN).alias("body"))
    return text.concatenated(rows, ["chapter"], "turn", "body", "\n\n")


@query(f"WITH {_BOOK} SELECT chapter, {_PROSE} AS n, {_PROSE} >= 1200 AS ok, len(regexp_extract_all(text, '(?m)^## ')) AS headings FROM b")
def chapter_lengths(spark, d):
    """A1, A2, A3: characters of prose, whether they are enough, and the number of headings."""
    n = rules.prose_length(F.col("text")).cast("long")
    return book(spark, d).select("chapter", n.alias("n"), (n >= 1200).alias("ok"), F.regexp_count("text", F.lit("(?m)^## ")).cast("long").alias("headings"))


@query(f"WITH {_BOOK} SELECT chapter, {_MISSING.format(level='##')} AS lacks FROM b")
def missing_sections(spark, d):
    """Heading words that a chapter's headings lack; words in its prose don't count."""
    return book(spark, d).select("chapter", F.array_join(rules.missing_words(rules.headings_of(F.col("text"), "##"), SECTIONS), ",").alias("lacks"))


_UNCITED = rf"""g AS (SELECT *, regexp_matches(block, '{CITED}') AS cited, len(regexp_extract_all(block, '(?m)^[ \t]*\|')) >= 2 AS tab FROM f),
h AS (SELECT *, (coalesce(lag(cited) OVER w, false) OR coalesce(lead(cited) OVER w, false)) AND tab AS beside FROM g WINDOW w AS (PARTITION BY chapter ORDER BY block_no))
SELECT chapter, block_no, left(trim(regexp_replace(block, '[ \t\n\r\f\x0b]+', ' ', 'g')), 70) AS said FROM h WHERE NOT in_fence AND NOT cited AND NOT beside AND regexp_matches(block, '{CLAIM}')"""


@query(f"WITH {_BOOK}, {_BLOCKS}, {_UNCITED}")
def uncited_claims(spark, d):
    """A5, FLT8: blocks with percentages and no source."""
    out = rules.uncited(rules.blocks(book(spark, d), "chapter", "text"), "chapter", CLAIM, CITED)
    return out.select("chapter", F.col("block_no").cast("long").alias("block_no"), "said")


@query(f"WITH {_BOOK}, {_BLOCKS}, {_UNCITED} AND NOT regexp_matches(block, '^(#|>|\\|---)|TODO|See ')")
def uncited_index_claims(spark, d):
    """As A5, but headings, quotations, pointers and open points may go without a source."""
    out = rules.uncited(rules.blocks(book(spark, d), "chapter", "text"), "chapter", CLAIM, CITED, r"^(#|>|\|---)|TODO|See ")
    return out.select("chapter", F.col("block_no").cast("long").alias("block_no"), "said")


@query(f"WITH {_BOOK}, c AS (SELECT chapter, {_PROSE} AS n, {_MISSING.format(level='##')} AS lacks, contains(text, 'TODO') AS placeholder FROM b) SELECT *, n >= 600 AND lacks = '' AND NOT placeholder AS ok FROM c")
def complete_parts(spark, d):
    """Long enough, all sections there, no placeholder."""
    return rules.complete(book(spark, d), "chapter", "text", 600, SECTIONS, "TODO").withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {_BOOK}, s AS (SELECT chapter, unnest(range(len(string_split_regex({_BARE}, '[.|\\n]')))) AS sentence_no, unnest(string_split_regex({_BARE}, '[.|\\n]')) AS s FROM b), w AS (SELECT chapter, sentence_no, s, replace(replace(s, 'the an', ''), 'sthe', '') AS bare FROM s WHERE NOT regexp_matches(s, '{CITED}'))
SELECT chapter, sentence_no, 'the' AS word FROM w WHERE contains(bare, 'the') UNION ALL SELECT chapter, sentence_no, 'ingle' FROM w WHERE contains(bare, 'ingle')""")
def unsupported_words(spark, d):
    """Banned words in sentences without a source, allowed phrases aside."""
    out = rules.unsupported_words(book(spark, d), "chapter", "text", ["the", "ingle"], ["the an", "sthe"], CITED)
    return out.select("chapter", F.col("sentence_no").cast("long").alias("sentence_no"), "word")


@query(rf"WITH {_BOOK} SELECT chapter, len(regexp_extract_all({_BARE}, '\$')) AS dollars, len(regexp_extract_all({_BARE}, '\\[A-Za-z]{{2,}}')) AS commands, len(regexp_extract_all({_BARE}, '\\begin\{{(cases|pmatrix|bmatrix|array)\}}')) AS arrays FROM b")
def formula_faults(spark, d):
    """A9."""
    return book(spark, d).select("chapter", *[c.alias(n) for n, c in rules.formula_faults(F.col("text")).items()])


@query(rf"""WITH {_BOOK}, l AS (SELECT chapter, regexp_extract_all(text, '\]\(#([^)]+)\)', 1) AS t, regexp_extract_all(text, '<a id="([^"]+)"', 1) AS ids FROM b)
SELECT chapter, len(t) AS n_links, len(list_filter(t, lambda x: NOT list_contains(ids, x))) AS n_dangling, len(list_filter(t, lambda x: regexp_matches(x, '[^\x00-\x7f]'))) AS n_foreign FROM l""")
def anchor_links(spark, d):
    """A10, C1."""
    return rules.links(book(spark, d), "chapter", "text")


@query(rf"""WITH {_BOOK}, {_IMAGES}, w AS (SELECT *, regexp_extract_all(lower(regexp_replace(regexp_replace(file, '\.[^.]*$', ''), '_(zh|en)$', '')), '[a-z]{{4,}}') AS s, regexp_extract_all(lower(alt), '[a-z]{{4,}}') AS a FROM i)
SELECT chapter, image_no, alt, file FROM w WHERE len(s) > 0 AND len(a) > 0 AND NOT list_has_any(s, a)""")
def strange_captions(spark, d):
    """C3."""
    return rules.strangers(rules.captions(book(spark, d), "chapter", "text")).withColumn("image_no", F.col("image_no").cast("long"))


@query(f"""WITH {_BOOK} SELECT chapter, len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(\\./images/')) AS images, NOT regexp_matches(text, '!\\[[^\\]]*\\]\\(\\./images/') AS none FROM b""")
def images_by_chapter(spark, d):
    """How many images each chapter has, and which have none."""
    n = F.regexp_count("text", F.lit(r"!\[[^\]]*\]\(\./images/")).cast("long")
    return book(spark, d).select("chapter", n.alias("images"), (n == 0).alias("none"))


@query(rf"""WITH {_BOOK}, {_IMAGES}, s AS (SELECT '0' || doc_id AS tag, lower(regexp_replace(regexp_replace(text, '-[ \t\n\r]+', '', 'g'), '[^A-Za-z0-9%.]', '', 'g')) AS blob FROM documents WHERE doc_id < 6),
n AS (SELECT DISTINCT chapter, image_no, nullif(regexp_extract(alt, 'P([0-9][0-9])', 1), '') AS tag, unnest(list_filter(regexp_extract_all(alt, '[0-9]+\.?[0-9]* *%|[0-9]+\.[0-9]+|[0-9]{{2,}}'), lambda x: NOT regexp_matches(x, '^(0[1-9]|1[0-9]|20)$'))) AS number FROM i),
m AS (SELECT chapter, image_no, number, CASE WHEN n.tag IS NULL THEN 'no source' WHEN blob IS NOT NULL AND NOT contains(blob, replace(number, ' ', '')) THEN 'not in source' END AS fault FROM n LEFT JOIN s ON n.tag = s.tag)
SELECT * FROM m WHERE fault IS NOT NULL""")
def caption_numbers(spark, d):
    """C6, CMP14: numbers of captions against the source they name."""
    sources = table(spark, d, "documents").filter("doc_id < 6").select(F.concat(F.lit("0"), F.col("doc_id").cast("string")).alias("tag"), text.comparable(F.col("text")).alias("blob"))
    return rules.caption_numbers(rules.captions(book(spark, d), "chapter", "text"), "chapter", sources).withColumn("image_no", F.col("image_no").cast("long"))


@query(rf"""WITH {_BOOK}, t AS (SELECT chapter, unnest(regexp_extract_all(text, 'P(0[0-9])', 1)) AS tag FROM b) SELECT chapter % 3 AS shelf, count(DISTINCT tag) AS tags, count(DISTINCT tag) = 9 AS ok FROM t GROUP BY 1""")
def tag_counts(spark, d):
    """How many different tags each shelf of chapters has, against what it should."""
    rows = book(spark, d).select((F.col("chapter") % 3).alias("shelf"), F.explode(F.regexp_extract_all("text", F.lit("P(0[0-9])"), F.lit(1))).alias("tag"))
    return rows.groupBy("shelf").agg(F.countDistinct("tag").alias("tags")).withColumn("ok", F.col("tags") == 9)


@query(r"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents), p AS (SELECT DISTINCT lower(unnest(regexp_extract_all(html, '[A-Za-z]+'))) AS w FROM pages), k AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]+')) AS id FROM benchmark WHERE text IS NOT NULL)
SELECT id, id IN (SELECT w FROM w) AS in_documents, id IN (SELECT w FROM p) AS in_pages FROM k WHERE NOT (id IN (SELECT w FROM w) AND id IN (SELECT w FROM p))""")
def unindexed_ids(spark, d):
    """Identifiers that two indexes don't both hold, whatever their case."""
    words = lambda name, c: table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))).alias("id")).distinct()
    ids = table(spark, d, "benchmark").filter("text is not null").select(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("id")).distinct()
    a, b = words("documents", "text").withColumn("a", F.lit(True)), words("pages", "html").withColumn("b", F.lit(True))
    out = ids.join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce("a", F.lit(False)).alias("in_documents"), F.coalesce("b", F.lit(False)).alias("in_pages"))
    return out.filter(~(F.col("in_documents") & F.col("in_pages")))


@query(rf"""WITH {_BOOK}, s AS (SELECT chapter, {_BARE} AS t, string_split({_BARE}, '7%') AS p FROM b), h AS (SELECT chapter, t, unnest(range(len(p) - 1)) AS k, p FROM s),
q AS (SELECT chapter, t, list_sum(list_transform(list_slice(p, 1, k + 1), lambda x: length(x))) + k * 2 AS start FROM h) SELECT chapter, CAST(min(start) AS BIGINT) AS start FROM q WHERE NOT regexp_matches(substring(t, CAST(greatest(start - 300, 0) + 1 AS BIGINT), CAST(least(start, 300) + 2 + 100 AS BIGINT)), 'source') GROUP BY 1""")
def unqualified_claims(spark, d):
    """The first place of a literal without its condition near it."""
    return rules.unqualified(book(spark, d), "chapter", "text", "7%", "source")


@query(rf"""WITH {_BOOK}, p AS (SELECT DISTINCT chapter, unnest(regexp_extract_all(text, '!\[[A-Za-z ]+([0-9]+) P([0-9]+)', 1)) AS a, unnest(regexp_extract_all(text, '!\[[A-Za-z ]+([0-9]+) P([0-9]+)', 2)) AS b FROM b), t AS (SELECT CAST(10 + i AS VARCHAR) AS a, '0' || (i % 9) AS b FROM range(40) r(i))
SELECT chapter, a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = p.a AND t.b = p.b)""")
def wrong_pairs(spark, d):
    """D7, JN6: pairs of numbers in captions that the mapping doesn't have."""
    truth = spark.range(40).select((F.col("id") + 10).cast("string").alias("a"), F.concat(F.lit("0"), (F.col("id") % 9).cast("string")).alias("b"))
    return rules.wrong_pairs(book(spark, d), "chapter", "text", r"!\[[A-Za-z ]+([0-9]+) P([0-9]+)", truth).select("chapter", "a", "b")


@query(f"""WITH {_BOOK}, l AS (SELECT chapter, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM b) SELECT * FROM l WHERE (regexp_matches(line, 'TODO|Problem') AND NOT starts_with(trim(line), '#')) OR contains(line, 'x = 5%')""")
def placeholder_lines(spark, d):
    """E1, FLT6."""
    return rules.placeholder_lines(book(spark, d), "chapter", "text", "TODO|Problem", "x = 5%").withColumn("line_no", F.col("line_no").cast("long"))


@query(f"""WITH {_BOOK} SELECT chapter, contains(text, 'verbatim') AS has_command, contains(text, 'TODO') AS has_todo, len(regexp_extract_all(text, 'TODO')) AS todos FROM b""")
def required_literals(spark, d):
    """Texts that must hold a literal, must not hold another, and how often they do."""
    return book(spark, d).select("chapter", F.contains("text", F.lit("verbatim")).alias("has_command"), F.contains("text", F.lit("TODO")).alias("has_todo"), F.regexp_count("text", F.lit("TODO")).cast("long").alias("todos"))


@query(f"""WITH {_BOOK}, e AS (SELECT chapter, len(regexp_extract_all(text, 'source P0[0-9] [0-9]')) AS spans FROM b) SELECT CASE WHEN sum(spans) > 0 THEN 'full' ELSE 'degraded' END AS mode, CAST(sum(spans) AS BIGINT) AS spans, sum(spans) >= 3 AS ok FROM e""")
def provenance_spans(spark, d):
    """At least three places of provenance if there is a corpus, else the degraded mode."""
    n = F.sum(F.regexp_count("text", F.lit("source P0[0-9] [0-9]")))
    return book(spark, d).agg(n.cast("long").alias("spans")).select(F.when(F.col("spans") > 0, "full").otherwise("degraded").alias("mode"), "spans", (F.col("spans") >= 3).alias("ok"))


_NEEDED = (("EUROPE", "region"), ("ATLANTIS", "region"), ("FRANCE", "nation"), ("LEMURIA", "nation"))


@query("SELECT name, kind FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NEEDED) + ") AS t(name, kind) WHERE NOT (kind = 'region' AND name IN (SELECT r_name FROM region)) AND NOT (kind = 'nation' AND name IN (SELECT n_name FROM nation))")
def missing_deliverables(spark, d):
    """required names that aren't there."""
    there = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")).union(table(spark, d, "nation").select("n_name", F.lit("nation")))
    return spark.createDataFrame(list(_NEEDED), "name string, kind string").join(there, ["name", "kind"], "left_anti")


@query(f"""WITH {_BOOK} SELECT chapter, md5(text) AS digest, true AS same FROM b""")
def rebuilt_identically(spark, d):
    """a chapter put together again from its own lines equals the stored one, byte for byte."""
    stored = book(spark, d).select("chapter", F.md5(F.col("text").cast("binary")).alias("digest"))
    again = text.concatenated(text.lines(book(spark, d), "text"), ["chapter"], "line_no", "line").select("chapter", F.md5(F.col("text").cast("binary")).alias("again"))
    return stored.join(again, "chapter", "left").select("chapter", "digest", (F.col("digest") == F.col("again")).alias("same"))


@query(rf"""WITH {_BOOK}, c AS (SELECT lower(regexp_replace(regexp_replace(text, '-[ \t\n\r]+', '', 'g'), '[^A-Za-z0-9%.]', '', 'g')) AS blob FROM conversations WHERE text IS NOT NULL),
q AS (SELECT chapter, unnest(range(len(regexp_extract_all(text, '(?m)^[^\n]*verbatim[^\n]*\n((>[^\n]*\n?)+)', 1)))) AS quote_no, unnest(regexp_extract_all(text, '(?m)^[^\n]*verbatim[^\n]*\n((>[^\n]*\n?)+)', 1)) AS q FROM b),
z AS (SELECT chapter, quote_no, trim(regexp_replace(regexp_replace(q, '(?m)^>', '', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS q FROM q),
s AS (SELECT chapter, quote_no, contains(q, '...') OR contains(q, '…') AS cut, unnest(range(len(string_split(replace(q, '. ', '.' || chr(1)), chr(1))))) AS sentence_no, unnest(string_split(replace(q, '. ', '.' || chr(1)), chr(1))) AS s FROM z),
k AS (SELECT *, lower(regexp_replace(regexp_replace(s, '-[ \t\n\r]+', '', 'g'), '[^A-Za-z0-9%.]', '', 'g')) AS c FROM s WHERE length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 48 OR cut)
SELECT chapter, quote_no, sentence_no, cut FROM k WHERE cut OR NOT EXISTS (SELECT 1 FROM c WHERE contains(c.blob, k.c))""")
def false_quotations(spark, d):
    """F5, STR27, STR13: what is said to be word for word and isn't."""
    corpus = table(spark, d, "conversations").filter("text is not null").select(text.comparable(F.col("text")).alias("blob"))
    out = rules.false_quotations(book(spark, d), "chapter", "text", "verbatim", corpus, 48)
    return out.select("chapter", F.col("quote_no").cast("long").alias("quote_no"), F.col("sentence_no").cast("long").alias("sentence_no"), "cut")


@query(f"""WITH {_BOOK}, l AS (SELECT chapter, unnest(range(len(string_split({_BARE}, chr(10))))) AS line_no, unnest(string_split({_BARE}, chr(10))) AS line FROM b) SELECT chapter, line_no FROM l WHERE contains(line, '(式)') AND regexp_matches(line, '\\(1\\)/\\(')""")
def garbled_formulas(spark, d):
    """R2."""
    return rules.garbled(book(spark, d), "chapter", "text", "(式)", r"\(1\)/\(").withColumn("line_no", F.col("line_no").cast("long"))


@query(rf"""WITH {_BOOK}, t AS (SELECT chapter, list_filter(string_split(regexp_extract(text, '(?m)^\| name \| value \| remark \|\n\|[-| ]+\|\n((\|[^\n]*\n?)*)', 1), chr(10)), lambda r: starts_with(r, '|')) AS r FROM b) SELECT chapter, len(r) AS n_rows, len(list_filter(r, lambda x: regexp_matches(x, '\| *\| *$'))) AS n_empty FROM t""")
def symbol_cards(spark, d):
    """Rows of a table, and those without a remark."""
    return rules.empty_cells(book(spark, d), "chapter", "text", r"\| name \| value \| remark \|")


@query(f"WITH {_BOOK} SELECT chapter FROM b WHERE position('## Method' IN text) = 0 OR (position('## Result' IN text) > 0 AND position('## Method' IN text) > position('## Result' IN text))")
def sections_out_of_order(spark, d):
    """R4."""
    return rules.out_of_order(book(spark, d), "chapter", "text", "## Method", "## Result")


_QUOTE = "the rain in the hills fell on every roof of the old town and nobody minded"
#: A chapter that breaks no rule, and for each rule what breaks it: a piece of the text and what takes its place.
CLEAN = f"""# Part 0

## Problem 1

Words enough to be read. About 7% of them [source P01 2].

## Method 2

| name | value | remark |
|---|---|---|
| a | 12% | known [source P01 2] |

## Result 3

![Flow chart 37 P01](./images/flow_1.png)

## Limits 4

verbatim abstract
> {_QUOTE}

(式) y = x

See [it](#s1) <a id="s1"></a>"""
#: The characters of the clean chapter that aren't white space.
PROSE = len("".join(CLEAN.split()))
DEFECTS = {
    "A1": ("Words enough to be read. ", ""),
    "A4": ("## Method 2", "Method 2"),
    "A5": ("About 7% of them [source P01 2].", "About 7% of them [ ]."),
    "A6": ("Words enough", "TODO: Words enough"),
    "A7": ("Words enough", "A perfect set of words, enough"),
    "A9": ("y = x", "$y = x$"),
    "A10": ("(#s1)", "(#s2)"),
    "C3": ("Flow chart", "Pressure curve"),
    "C5": ("![Flow chart 37 P01](./images/flow_1.png)", "no image"),
    "C6-tag": ("Flow chart 37 P01", "Flow chart 37"),
    "C6-source": ("chart 37 P01", "chart 38 P01"),
    "D2b": ("[source P01 2] |", "[source P09 2] |"),
    "D5": ("7% of them [source P01 2]", "7% of them, as said by nobody [P01 2]"),
    "D7": ("chart 37 P01", "chart 37 P02"),
    "D8": ("| known [source P01 2] |", "| known |"),
    "E1": ("Words enough", "placeholder words, enough"),
    "E3": ("verbatim", "literal"),
    "F5": ("nobody minded", "nobody cared at all"),
    "F5-cut": ("nobody minded", "nobody..."),
    "R1": ("See [it]", "This stands for all formulas. See [it]"),
    "R2": ("y = x", "y = (1)/(x)"),
    "R3": ("| known [source P01 2] |", "|  |"),
    "R4": ("## Method 2", "## Result 2, before ## Method 2"),
}


def broken(df: DataFrame, spark: SparkSession) -> DataFrame:
    """(rule, key) of all rules over chapters (key, text) that should be as CLEAN is."""
    t = F.col("text")
    truth = spark.createDataFrame([("37", "01"), ("38", "01")], "a string, b string")
    sources = spark.createDataFrame([("01", "12%37y")], "tag string, blob string")
    corpus = spark.createDataFrame([(f"before {_QUOTE} and after",)], "t string").select(text.comparable(F.col("t")).alias("blob"))
    images = rules.captions(df, "key", "text")
    blocks = rules.blocks(df, "key", "text")
    faults = rules.formula_faults(t)
    numbers = rules.caption_numbers(images, "key", sources)
    quotes = rules.false_quotations(df, "key", "text", "verbatim", corpus, 48)
    tags = df.select("key", F.explode(F.regexp_extract_all(t, F.lit("P(0[0-9])"), F.lit(1))).alias("tag")).groupBy("key").agg(F.countDistinct("tag").alias("n"))
    found = {
        "A1": df.filter(rules.prose_length(t) < PROSE),
        "A4": df.filter(F.size(rules.missing_words(rules.headings_of(t, "##"), SECTIONS)) > 0),
        "A5": rules.uncited(blocks, "key", CLAIM, CITED),
        "A6": rules.complete(df, "key", "text", 100, SECTIONS, "TODO").filter("placeholder"),
        "A7": rules.unsupported_words(df, "key", "text", ["perfect"], [], CITED),
        "A9": df.filter(faults["dollars"] + faults["commands"] + faults["arrays"] > 0),
        "A10": rules.links(df, "key", "text").filter("n_dangling > 0"),
        "C3": rules.strangers(images),
        "C5": df.filter(F.regexp_count(t, F.lit(rules.IMAGE)) == 0),
        "C6-tag": numbers.filter("fault = 'no source'"),
        "C6-source": numbers.filter("fault = 'not in source'"),
        "D2b": tags.filter("n <> 1"),
        "D5": rules.unqualified(df, "key", "text", "7%", "source"),
        "D7": rules.wrong_pairs(df, "key", "text", r"!\[[A-Za-z ]+([0-9]+) P([0-9]+)", truth),
        "D8": rules.uncited(blocks, "key", CLAIM, CITED, "^(#|>)"),
        "E1": rules.placeholder_lines(df, "key", "text", "placeholder", "NotImplemented"),
        "E3": df.filter(~F.contains(t, F.lit("verbatim"))),
        "F5": quotes.filter("not cut"),
        "F5-cut": quotes.filter("cut"),
        "R1": df.filter(F.contains(t, F.lit("This stands for all formulas"))),
        "R2": rules.garbled(df, "key", "text", "(式)", r"\(1\)/\("),
        "R3": rules.empty_cells(df, "key", "text", r"\| name \| value \| remark \|").filter("n_rows = 0 or n_empty > 0"),
        "R4": rules.out_of_order(df, "key", "text", "## Method", "## Result"),
    }
    parts = [x.select(F.lit(rule).alias("rule"), "key").distinct() for rule, x in found.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def rule_mutations(spark, d):
    """CMP18: every rule is broken by its defect, put into a clean chapter, and not by the clean chapter."""
    made = [("clean", CLEAN)] + [(r, CLEAN.replace(old, new)) for r, (old, new) in DEFECTS.items()]
    found = broken(spark.createDataFrame(made, "key string, text string"), spark)
    names = spark.createDataFrame([(r,) for r in DEFECTS], "rule string")
    hit = found.filter("rule = key").select("rule", F.lit(True).alias("hit"))
    wrong = found.filter("key = 'clean'").select("rule", F.lit(True).alias("wrong"))
    out = names.join(hit, "rule", "left").join(wrong, "rule", "left")
    return out.select("rule", F.coalesce("hit", F.lit(False)).alias("caught"), (~F.coalesce("wrong", F.lit(False))).alias("clean"))
