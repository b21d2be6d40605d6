"""Queries of corpus operators: normalisation, search, metadata, co-occurrence, links, assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import links, text
from lodestone.sources import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run, sql
        return run

    return add


#: Words that occur in the tables, in place of a method lexicon.
KEYWORDS = ("tion", "reed", "eau", "lich", "mente", "ou")
_WS = r"[ \t\n\r\f\x0b]"


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS squeezed, length(regexp_replace(text, '{_WS}', '', 'g')) AS bare, CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS short,
 md5(lower(regexp_replace(regexp_replace(text, '-[ \t\n\r]+', '', 'g'), '[^A-Za-z0-9%.]', '', 'g'))) AS comparable, len(regexp_extract_all(text, '[一-鿿]')) AS cjk,
 greatest(2, length(text) + len(regexp_extract_all(text, '[^\x00-\x{{2E7F}}]'))) AS width, 'P' || doc_id || '_' || lower(regexp_replace(left(text, 40), '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM documents""")
def text_projections(spark, d):
    """PRJ3-8, PRJ12, PRJ15."""
    t = F.col("text")
    digest = lambda c: F.md5(c.cast("binary"))
    return table(spark, d, "documents").select(
        "doc_id", digest(text.squeezed(t)).alias("squeezed"), text.bare_length(t).cast("long").alias("bare"), text.truncated(t).alias("short"), digest(text.comparable(t)).alias("comparable"),
        text.cjk_count(t).cast("long").alias("cjk"), text.display_width(t).cast("long").alias("width"), text.slug(F.col("doc_id"), t).alias("slug"),
    )


@query("""WITH s AS (SELECT doc_id, text, string_split_regex(text, '(?i)tion ') AS p FROM documents), h AS (SELECT doc_id, text, unnest(range(len(p) - 1)) AS hit, p FROM s),
q AS (SELECT doc_id, text, hit, CAST(list_sum(list_transform(list_slice(p, 1, hit + 1), lambda x: length(x))) AS BIGINT) + hit * 5 AS start FROM h)
SELECT doc_id, hit, start, start + 5 AS "end", substring(text, greatest(start - 180, 0) + 1, least(start, 180) + 5 + 180) AS around FROM q""")
def grep_places(spark, d):
    """STR1, JN2: every place of a literal in every whole text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return text.literal_hits(docs, "text", "tion ").select("doc_id", F.col("hit").cast("long").alias("hit"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "around")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS title,
 md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS body, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links FROM pages""")
def page_scan(spark, d):
    """SRC2."""
    p = table(spark, d, "pages")
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return p.select("page_id", text.page_title(F.col("html")).alias("title"), F.md5(text.page_text(F.col("html")).cast("binary")).alias("body"), links.cast("long").alias("n_links"))


@query(None)
def page_entities(spark, d):
    """SRC2 with character references decoded, PRJ1 and PRJ2."""
    p = table(spark, d, "pages").select("page_id", text.page_text(F.col("html")).alias("t"))
    return p.select("page_id", text.normalised(text.unescaped("t")).alias("text"), F.length(text.same_length_view("t")).alias("length"))


@query("WITH h AS (SELECT doc_id, " + ", ".join(f"contains(lower(text), '{k}') AS k{i}" for i, k in enumerate(KEYWORDS)) + " FROM documents), f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS k FROM h WHERE k{i}" for i, k in enumerate(KEYWORDS)) + """)
SELECT a.k AS a, b.k AS b, count(*) AS n FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.k < b.k GROUP BY 1, 2""")
def keyword_cooccurrence(spark, d):
    """STR10, SET4, JN4: pairs of keywords by the documents that hold both; pairs are made of each document's own short list."""
    return text.cooccurrences(table(spark, d, "documents"), "text", KEYWORDS)


_MANY = ("able", "eau", "ei", "lich", "mente", "ou", "reed", "tion", "un", "und")


@query("WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS k FROM documents WHERE contains(lower(text), '{k}')" for k in _MANY) + ") SELECT a.k AS a, b.k AS b, count(*) AS n FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.k < b.k GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 15")
def top_keyword_pairs(spark, d):
    """TOP1, JN4: the fifteen pairs of keywords that most documents hold both of."""
    return text.cooccurrences(table(spark, d, "documents"), "text", _MANY).orderBy(F.desc("n"), "a", "b").limit(15)


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y, o_orderpriority AS p FROM orders) SELECT CAST(y AS INT) AS year, string_agg(p, ',' ORDER BY p) AS ids FROM y GROUP BY 1""")
def timeline(spark, d):
    """AGG8: year to the list of its members."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority").distinct()
    return o.groupBy("year").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), ",").alias("ids"))


#: Items, and the first words of some: items of any length.
_ITEMS = "SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] FROM benchmark UNION ALL SELECT item_id + 2000000, left(text, 40) FROM benchmark"


@query(f"WITH b AS ({_ITEMS}) SELECT doc_id, item_id, min(position(b.text IN d.text)) - 1 AS start FROM documents d JOIN b ON contains(d.text, b.text) WHERE length(b.text) > 0 GROUP BY 1, 2")
def verbatim_links(spark, d):
    """JN5, STR13, TOP3, CMP6: first place of each item, of any length, that a document holds word for word."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    w = F.split("text", " ")
    two = items.select(F.col("item_id") + 1_000_000, F.concat(F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1))))
    items = items.union(two).union(items.select(F.col("item_id") + 2_000_000, F.substring("text", 1, 40)))
    return links.contained(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "text")


@query("""WITH i AS (SELECT item_id, lower(regexp_replace(regexp_replace(text, '-[ \\t\\n\\r]+', '', 'g'), '[^A-Za-z0-9%.]', '', 'g')) AS c FROM benchmark), d AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '-[ \\t\\n\\r]+', '', 'g'), '[^A-Za-z0-9%.]', '', 'g')) AS c FROM documents)
SELECT DISTINCT item_id, doc_id FROM i JOIN d ON contains(d.c, i.c) OR (length(i.c) > 120 AND contains(d.c, left(i.c, 60)) AND contains(d.c, right(i.c, 60))) WHERE length(i.c) > 0""")
def verbatim_check(spark, d):
    """STR13: items that a document holds once both are normalised, or whose first and last 60 characters it holds if there are over 120."""
    docs = table(spark, d, "documents").select("doc_id", text.comparable(F.col("text")).alias("c"))
    items = table(spark, d, "benchmark").select("item_id", text.comparable(F.col("text")).alias("c")).filter("length(c) > 0")
    part = F.explode(F.when(F.length("c") > 120, F.array(F.substring("c", 1, 60), F.substring(F.col("c"), F.length("c") - 59, F.lit(60)))).otherwise(F.array("c"))).alias("p")
    parts = items.select("item_id", part).distinct()
    met = links.contained(docs, "doc_id", "c", parts.select("p").distinct().withColumn("key", F.xxhash64("p")), "key", "p")
    found = parts.withColumn("key", F.xxhash64("p")).join(met, "key").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    # A whole item is held if its one part is, a long one if both its ends are.
    return found.join(parts.groupBy("item_id").agg(F.count("*").alias("of")), "item_id").filter("n = of").select("item_id", "doc_id")


#: Aliases of no document, and some that a document owns and isn't searched for.
_ALIASES = [(1, r"\b(apache|mit)[- ]licen[cs]e\b", 3), (2, r"\ball rights? reserved\b", None), (3, r"\b(ed|er)[- ]?tion[a-z]{2,}\b", 0), (4, r"\b(idiot|moron|worthless)\b", 5), (5, r"\b(token|secret|api[_-]?key) *=", None), (6, r"\b(keit|heit|lich)[- ]?(ver|ung)[a-z]*", 2), (7, r"[0-9]{3}-[0-9]{4}", None)]
_ALIAS_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"({a}, '{p}', {'NULL' if o is None else o})" for a, p, o in _ALIASES) + ") AS t(alias, pattern, owner) UNION ALL SELECT 1000 + item_id, '\\b' || regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+)', 1) || '[- ]+' || regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+)', 2) || '[a-z]*', NULL FROM benchmark"


@query(f"""WITH a AS ({_ALIAS_ROWS}), h AS (SELECT doc_id, alias, text, pattern, length(regexp_extract(text, '(?is)^(.*?)(?:' || pattern || ')', 1)) AS start, regexp_extract(text, '(?i)' || pattern) AS match FROM documents JOIN a ON owner IS DISTINCT FROM doc_id AND regexp_matches(text, '(?i)' || pattern))
SELECT doc_id, alias, start, start + length(match) AS "end", match, CASE WHEN regexp_matches(substring(text, greatest(start - 400, 0) + 1, start + length(match) + 400 - greatest(start - 400, 0)), '(tion|und) ') THEN 'criticism' ELSE 'citation' END AS kind FROM h""")
def alias_mentions(spark, d):
    """JN5, CMP6, TOP3: the first place where each document names an alias that isn't its own, and the kind of the mention."""
    own = spark.createDataFrame(_ALIASES, "alias long, pattern string, owner long")
    word = lambda k: F.regexp_extract("text", "([A-Za-z]+) ([A-Za-z]+)", k)
    items = table(spark, d, "benchmark").select((1000 + F.col("item_id")).cast("long").alias("alias"), F.concat(F.lit(r"\b"), word(1), F.lit("[- ]+"), word(2), F.lit("[a-z]*")).alias("pattern"), F.lit(None).cast("long").alias("owner"))
    return links.alias_mentions(table(spark, d, "documents"), "doc_id", "text", own.unionByName(items), "(tion|und) ")


@query("""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, n, line, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars, min(n) AS first_line FROM s GROUP BY 1, 2""")
def section_lengths(spark, d):
    """WIN3, CMP10: short lines taken as headings."""
    rows = text.lines(table(spark, d, "documents").select("doc_id", "text"), "text")
    s = text.sections(rows, ["doc_id"], F.length("line") < 40)
    return s.groupBy("doc_id", F.col("section").cast("long").alias("section")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.min("line_no").cast("long").alias("first_line"))


@query("""WITH l AS (SELECT conv_id, turn, role = 'user' AS mark, text FROM conversations), f AS (SELECT conv_id, turn, text, sum(CAST(mark AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) % 2 = 1 OR mark AS inside, mark FROM l)
SELECT conv_id, turn, inside, coalesce(lag(mark) OVER w, false) OR coalesce(lead(mark) OVER w, false) AS beside FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def parity_and_neighbours(spark, d):
    """WIN1, WIN2 over turns: inside between marks, and beside one."""
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.when(F.col("role") == "user", "```").otherwise("x").alias("line"))
    out = text.neighbours(text.fenced(rows, ["conv_id"]).withColumn("mark", F.col("line") == "```"), ["conv_id"], "mark")
    return out.select("conv_id", F.col("line_no").alias("turn"), F.col("in_fence").alias("inside"), "beside")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def concatenated_turns(spark, d):
    """AGG18, CMP8, CMP9, CMP11: parts joined in order."""
    return text.concatenated(table(spark, d, "conversations").filter("text is not null"), ["conv_id"], "turn", "text")


@query("""WITH k AS (SELECT doc_id, source, text FROM documents), h AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS word, doc_id, source, position('{k}' IN text) AS pos, substring(text, greatest(position('{k}' IN text) - 20, 1), 60) AS around FROM k WHERE contains(text, '{k}')" for k in KEYWORDS) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS n FROM h) SELECT word, doc_id, pos, around FROM r WHERE n = 1""")
def first_appearance(spark, d):
    """WIN4: the first document of each word, and the text around it."""
    at = lambda k: F.instr("text", F.lit(k))
    found = F.array_compact(F.array(*[F.when(at(k) > 0, F.struct(F.lit(k).alias("word"), at(k).cast("long").alias("pos"), F.substring(F.col("text"), F.greatest(at(k) - 20, F.lit(1)), F.lit(60)).alias("around"))) for k in KEYWORDS]))
    rows = table(spark, d, "documents").select("doc_id", F.explode(found).alias("f"))
    return rows.groupBy("f.word").agg(F.min_by(F.struct("doc_id", "f.pos", "f.around"), "doc_id").alias("m")).select("word", "m.doc_id", "m.pos", "m.around")


@query("""SELECT source, count(*) AS n, round(1000.0 * sum(length(text) - length(replace(text, 'the', ''))) / 3 / sum(length(text)), 4) AS density, round(avg(length(text)), 2) AS mean_chars, max(length(text)) AS longest, count(*) FILTER (WHERE length(text) > 20000) AS full_text FROM documents GROUP BY 1""")
def density_by_source(spark, d):
    """AGG11, AGG12, FLT1: occurrences per thousand characters, averages and the longest."""
    n = F.length("text")
    hits = (n - F.length(F.replace("text", F.lit("the"), F.lit("")))) / 3
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.round(1000.0 * F.sum(hits) / F.sum(n), 4).alias("density"), F.round(F.avg(n), 2).alias("mean_chars"), F.max(n).cast("long").alias("longest"), F.count_if(n > 20_000).alias("full_text"),
    )


@query("""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, trim(unnest(string_split(text, chr(10)))) AS line FROM (SELECT doc_id, left(text, 6000) AS text FROM documents)), r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, n) AS k FROM l WHERE length(line) > 25 AND length(line) < 160)
SELECT doc_id, line AS title FROM r WHERE k = 1""")
def title_hints(spark, d):
    """STR6: the longest line of fitting length in the first 6000 characters, the first on ties."""
    rows = text.lines(table(spark, d, "documents").select("doc_id", F.substring("text", 1, 6000).alias("text")), "text").withColumn("line", F.trim("line")).filter("length(line) > 25 and length(line) < 160")
    return rows.groupBy("doc_id").agg(F.max_by("line", F.struct(F.length("line"), -F.col("line_no"))).alias("title"))


@query(r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+'), ''), 'none') AS doi, coalesce(nullif(regexp_extract(text, '(19|20)[0-9][0-9]'), ''), 'none') AS year,
 CASE WHEN contains(lower(left(text, 20000)), 'license') THEN 'license' WHEN contains(lower(left(text, 20000)), 'the ') THEN 'the' ELSE 'none' END AS journal, len(regexp_extract_all(text, '[0-9]+(\.[0-9]+)?%')) AS claims FROM documents""")
def metadata_hints(spark, d):
    """STR3-5, STR7-8, CMP1: first identifier, year, name in the list's order, and numeric claims."""
    first = lambda p: F.coalesce(F.nullif(F.regexp_extract("text", p, 0), F.lit("")), F.lit("none"))
    head = F.lower(F.substring("text", 1, 20_000))
    name = F.when(F.contains(head, F.lit("license")), "license").when(F.contains(head, F.lit("the ")), "the").otherwise("none")
    claims = F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+(\.[0-9]+)?%"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", first(r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+").alias("doi"), first("(19|20)[0-9][0-9]").alias("year"), name.alias("journal"), claims.cast("long").alias("claims"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'C' WHEN n_chars > 20000 THEN 'A' WHEN quality = 1 THEN 'B-publisher' ELSE 'B-html' END AS level, n_chars = length(text) AS agrees FROM documents d LEFT JOIN labels l USING (doc_id)""")
def evidence_levels(spark, d):
    """FLT2, JN3, JN15: declared against found, and the level of evidence."""
    l = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("known"))
    level = F.when(F.col("known").isNull(), "C").when(F.col("n_chars") > 20_000, "A").when(F.col("quality") == 1, "B-publisher").otherwise("B-html")
    return table(spark, d, "documents").join(l, "doc_id", "left").select("doc_id", level.alias("level"), (F.col("n_chars") == F.length("text")).alias("agrees"))


@query("""WITH o AS (SELECT sha256(doc_id || ':' || coalesce(text, '')) AS h FROM documents), f AS (SELECT left(h, 4) AS r, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM o GROUP BY 1), t AS (SELECT left(r, 2) AS r, sha256(string_agg(h, '' ORDER BY r)) AS h, sum(n) AS n FROM f GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY r)) AS stamp, CAST(sum(n) AS BIGINT) AS n FROM t""")
def source_stamp(spark, d):
    """SRC6."""
    return text.stamp(table(spark, d, "documents"), "doc_id", "text")


@query(None)
def percent_places(spark, d):
    """DM6, STR12: numbers with their places, whole texts."""
    return text.pattern_hits(table(spark, d, "documents"), "doc_id", "text", r"\b[0-9]+(?:\.[0-9]+)?\s?%?")


@query("""WITH b AS (SELECT doc_id, text, unnest(range(len(string_split(text, '. ')))) AS pos, unnest(string_split(text, '. ')) AS s FROM documents), g AS (SELECT doc_id, s, min(pos) AS pos FROM b WHERE length(s) >= 25 AND length(s) <= 320 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM g)
SELECT doc_id, k AS rank, s AS claim FROM r WHERE k <= 3""")
def first_sentences(spark, d):
    """AGG7, TOP2, FLT3, STR14: a document's first three different sentences of fitting length."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("at", "s")).filter("length(s) between 25 and 320")
    g = docs.groupBy("doc_id", "s").agg(F.min("at").alias("at"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return g.withColumn("rank", k.cast("long")).filter("rank <= 3").select("doc_id", "rank", F.col("s").alias("claim"))


DIMENSIONS = {"problem": (r"[^.\n]*the of[^.\n]*", r"[^.\n]*the [^.\n]*"), "result": (r"[^.\n]*[0-9]+%[^.\n]*", r"[^.\n]*tion [^.\n]*")}


def _claims(pattern: str) -> str:
    return rf"list_transform(regexp_extract_all(body, '{pattern}'), lambda c: trim(regexp_replace(c, '{_WS}+', ' ', 'g')))"


_SKELETON = "WITH b AS (SELECT doc_id, left(text, CAST(floor(length(text) * 0.85) AS INT)) AS body FROM documents), m AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS dimension, list_filter({_claims(a)}, lambda c: length(c) >= 40) AS s, list_filter({_claims(z)}, lambda c: length(c) >= 40) AS r FROM b" for n, (a, z) in DIMENSIONS.items()
) + "), c AS (SELECT doc_id, dimension, len(s) > 0 AS strict, CASE WHEN len(s) > 0 THEN s ELSE r END AS t FROM m) SELECT doc_id, dimension, len(t) > 0 AS found, NOT strict AND len(t) > 0 AS relaxed, CASE WHEN len(t) > 0 THEN t[1] END AS first_claim, CAST(least(3, len(list_distinct(t))) AS BIGINT) AS n_claims FROM c"


@query(_SKELETON)
def skeletons(spark, d):
    """STR9, DM8."""
    out = text.skeleton(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", DIMENSIONS)
    return out.select("doc_id", "dimension", "found", "relaxed", F.get("claims", F.lit(0)).alias("first_claim"), F.size("claims").cast("long").alias("n_claims"))


@query("""WITH h AS (SELECT doc_id, position('Licensed under' IN text) AS p, text FROM documents WHERE contains(text, 'Licensed under')) SELECT doc_id, p - 1 AS start, CASE WHEN regexp_matches(substring(text, greatest(p - 400, 1), least(p, 401) - 1 + 14 + 400), '(idiot|stupid)') THEN 'criticism' ELSE 'citation' END AS kind FROM h""")
def mention_kinds(spark, d):
    """STR11."""
    return text.mentions(table(spark, d, "documents"), "doc_id", "text", "Licensed under", "(idiot|stupid)")


@query(None)
def paper_hints(spark, d):
    """CMP1, CMP5, STR3-5, STR8, STR10: with the patterns for papers; the driver's texts hold few of them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = text.paper_hints(docs, "doc_id", "text").withColumn("methods", F.array_join("methods", ";"))
    return out.join(text.claimed(docs, "text").select("doc_id", F.size("claims").alias("n_claims")), "doc_id")
