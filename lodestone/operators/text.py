"""Text normalisation, pattern search with exact character places, lines and sections.

Places are code points, start from 0, end exclusive. Patterns use explicit classes, so engines agree on them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import lexicon
from lodestone.sources.batches import each_text


def squeezed(text: Column) -> Column:
    """PRJ3: runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def bare_length(text: Column) -> Column:
    """PRJ6: characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"[ \t\n\r\f\x0b]", ""))


def without_fences(text: Column) -> Column:
    """PRJ5: fenced code removed."""
    return F.regexp_replace(text, "(?s)```.*?```", "")


def cjk_count(text: Column) -> Column:
    """PRJ7."""
    return F.regexp_count(text, F.lit("[一-鿿]"))


def truncated(text: Column, width: int = 200) -> Column:
    """PRJ8: longer texts end in three dots at the width."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def display_width(text: Column) -> Column:
    """PRJ15: wide characters count twice; two at least."""
    return F.greatest(F.length(text) + F.regexp_count(text, F.lit("[⺀-\U0010ffff]")), F.lit(2))


def slug(number: Column, stem: Column) -> Column:
    """PRJ12."""
    return F.concat(F.lit("P"), number.cast("string"), F.lit("_"), F.lower(F.regexp_replace(F.substring(stem, 1, 40), "[^A-Za-z0-9]+", "-")))


def comparable(text: Column) -> Column:
    """PRJ4, its ASCII part: words joined over hyphenated line ends, only letters, digits, % and dots, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"-[ \t\n\r]+", ""), "[^A-Za-z0-9%.]", ""))


_PAGE_MARK = re.compile(r"=====\s*\[PAGE[^\]]*\]\s*=====")


def comparable_form(text: str | None) -> str | None:
    """PRJ4, in its order: NFKC, page marks out, words joined over hyphens, accents off, ASCII letters, digits, % and dots in lower case."""
    if text is None:
        return None
    text = re.sub(r"-\s+", "", _PAGE_MARK.sub(" ", unicodedata.normalize("NFKC", text)))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("[^A-Za-z0-9%.]", "", text).lower()


@F.pandas_udf(T.StringType())
def comparable_english(texts: pd.Series) -> pd.Series:
    return texts.map(comparable_form, na_action="ignore")


_ESCAPE = re.compile("/u([0-9A-Fa-f]{4,6})")


def normal(text: str | None) -> str | None:
    """PRJ1, in its order: NFKC, soft hyphens and NULs dropped, /uXXXX decoded, blanks and blank lines collapsed."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text).replace("­", "").replace("\0", "")
    text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if int(m[1], 16) <= 0x10FFFF else m[0], text)
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text))


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    return texts.map(normal, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references of HTML decoded."""
    return texts.map(html.unescape, na_action="ignore")


_PAGE = re.compile(r"===== \[PAGE [0-9]+\] =====")


@F.pandas_udf(T.StringType())
def same_length_view(texts: pd.Series) -> pd.Series:
    """PRJ2: page markers become as many spaces, newlines become spaces; places stay valid."""
    return texts.map(lambda t: _PAGE.sub(lambda m: " " * len(m[0]), t).replace("\n", " "), na_action="ignore")


def literal_places(df: DataFrame, text: str, needles: list[str], context: int = 180, ignore_case: bool = False) -> DataFrame:
    """STR1: every place of each literal, from left to right without overlaps, with the text around it; one pass over each text.

    Rows keep all columns but the text and gain needle, hit (from 0), start, end and around.
    """
    flags = re.IGNORECASE | re.ASCII if ignore_case else 0
    patterns = [(n, re.compile(re.escape(n), flags)) for n in needles]

    def of(t: str | None) -> Iterator[tuple]:
        for n, p in patterns:
            for k, m in enumerate(p.finditer(t or "")):
                yield n, k, m.start(), m.end(), t[max(0, m.start() - context) : m.end() + context]

    return each_text(df, text, of, {"needle": "string", "hit": "int", "start": "int", "end": "int", "around": "string"})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with a value that is evaluated once: a lambda's variable isn't inlined."""
    return F.transform(F.array(value), body)[0]


def before_each(sizes: Column, block: int = 64) -> Column:
    """Of an array of numbers the sum before each, by sums of blocks, so that long arrays cost little more than their length."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def summed(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / block).cast("int")), lambda b: total(F.slice(xs, b * block + 1, block)))
        upto = let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, 1, b))))
        return let(upto, lambda u: F.transform(xs, lambda _, i: F.get(u, F.floor(i / block).cast("int")) + total(F.slice(xs, F.floor(i / block).cast("int") * block + 1, i % block))))

    return let(sizes, summed)


def places(text: Column, pattern: str) -> Column:
    """STR12, DM6: array<struct<start, end, match>> of a pattern's matches, from the lengths of what stands between them. The pattern matches no empty text."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        return let(before_each(both["gaps"]), lambda gaps: let(before_each(F.transform(both["found"], F.length)), lambda taken: F.transform(
            both["found"], lambda m, i: let(F.get(gaps, i) + F.get(both["gaps"], i) + F.get(taken, i), lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("match"))))))

    return let(F.struct(found.alias("found"), F.transform(between, F.length).alias("gaps")), placed)


def around(text: Column, start: Column, end: Column, reach: int) -> Column:
    """The characters within reach of a place, and those of the place."""
    low = F.greatest(start - reach, F.lit(0))
    return F.substring(text, low + 1, end + reach - low)


def literal_hits(df: DataFrame, text: str, needle: str, context: int = 180) -> DataFrame:
    """STR1: literal_places of one literal, ignoring case of ASCII letters."""
    return literal_places(df, text, [needle], context, ignore_case=True).drop("needle")


def page_of(text: Column, start: Column) -> Column:
    """STR2: the number of page markers before a place."""
    return F.regexp_count(F.substring(text, F.lit(1), start), F.lit(r"===== \[PAGE"))


def lines(df: DataFrame, text: str) -> DataFrame:
    """DM13: one row per line with line_no from 0."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def fenced(rows: DataFrame, keys: list[str]) -> DataFrame:
    """WIN1: whether a line stands inside a code fence, or is its mark."""
    mark = F.col("line").startswith("```")
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("in_fence", mark | (F.sum(mark.cast("int")).over(w) % 2 == 1))


def sections(rows: DataFrame, keys: list[str], heading: Column) -> DataFrame:
    """WIN3: lines numbered by the section they belong to, 0 before the first heading."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(heading.cast("int")).over(w))


def neighbours(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """WIN2: whether the line before or after has a flag."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    return rows.withColumn("beside", F.coalesce(F.lag(flag).over(w), F.lit(False)) | F.coalesce(F.lead(flag).over(w), F.lit(False)))


def demoted(rows: DataFrame) -> DataFrame:
    """PRJ13: headings of levels 1 to 5 outside fences go one level down."""
    heading = F.col("line").rlike("^#{1,5} ") & ~F.col("in_fence")
    return rows.withColumn("line", F.when(heading, F.concat(F.lit("#"), F.col("line"))).otherwise(F.col("line")))


def concatenated(rows: DataFrame, keys: list[str], order: str, part: str, joint: str = "\n") -> DataFrame:
    """AGG18: parts of each key joined in their order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, part)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[part]), joint).alias("text"))


def stamp(df: DataFrame, key: str, content: str) -> DataFrame:
    """SRC6: (stamp, n): SHA-256 over the rows' own digests, sorted, by range: of each four first digits, then of two, then of all.

    Repeated rows count as often as they occur; null contents count as empty. No task holds texts, or more digests
    than one range has.
    """
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "").cast("binary"), 256)
    one = df.select(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.coalesce(content, F.lit(""))).cast("binary"), 256).alias("h"))
    four = one.groupBy(F.substring("h", 1, 4).alias("r")).agg(digest("h").alias("h"), F.count("*").alias("n"))
    # Digests of ranges are ordered by their range.
    up = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), "").cast("binary"), 256)
    two = four.groupBy(F.substring("r", 1, 2).alias("q")).agg(up().alias("h"), F.sum("n").alias("n")).withColumnRenamed("q", "r")
    return two.agg(up().alias("stamp"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def page_text(markup: Column) -> Column:
    """SRC2: scripts, styles and tags stripped, space squeezed; references stay as they are."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeezed(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def page_title(markup: Column) -> Column:
    return squeezed(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1))


def attribute(markup: Column, tag: str, name: str) -> Column:
    """SRC2: an attribute of the first tag that has it, empty if none has."""
    return F.regexp_extract(markup, f'(?i)<{tag}[^>]*{name}="([^"]*)"', 1)


def part(markup: Column, tag: str) -> Column:
    """SRC2: the text of the first element of a kind."""
    return squeezed(F.regexp_replace(F.regexp_extract(markup, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"(?s)<[^>]+>", " "))


def abstract_window(text: Column, opens: tuple[str, ...] = lexicon.ABSTRACT_OPENS, ends: tuple[str, ...] = lexicon.ABSTRACT_ENDS) -> Column:
    """PRJ9: what follows the first spelling, in the list's order, that stands early enough; empty where none does.

    Of 2200 characters: up to the earliest end pattern beyond 300, 1800 at most, then up to the last full stop if
    that lies beyond 400.
    """
    at = [(F.instr(text, F.lit(name)), len(name)) for name in opens]
    window = F.coalesce(*[F.when((p > 1) & (p <= 12_000), F.substring(text, p + n, F.lit(2200))) for p, n in at])
    cuts = [F.nullif(F.length(F.regexp_extract(window, f"(?s)^(.{{301,}}?)(?:{e})", 1)), F.lit(0)) for e in ends]
    cut = F.substring(window, F.lit(1), F.least(*cuts, F.lit(1800)))
    stop = F.length(cut) - F.instr(F.reverse(cut), F.lit(" .")) - 1
    ended = F.when((F.instr(cut, F.lit(". ")) > 0) & (stop > 400), F.substring(cut, F.lit(1), stop + 1)).otherwise(cut)
    return F.coalesce(squeezed(ended), F.lit(""))


def claims_of(text: str | None, patterns: tuple[str, ...] = lexicon.CLAIMS, cores: tuple[str, ...] = lexicon.CLAIM_CORES, limit: int = 40) -> list[str]:
    """STR7, STR8: different squeezed claims of 25 to 320 characters, pattern after pattern, at most so many.

    A pattern is tried on lines that hold its core only, so texts without claims cost one quick pass.
    """
    found: dict[str, None] = {}
    for pattern, core in zip(patterns, cores, strict=True):
        if re.search(core, text or "", re.IGNORECASE):
            for line in text.split("\n"):
                if re.search(core, line, re.IGNORECASE):
                    for m in re.finditer(pattern, line, re.IGNORECASE):
                        claim = re.sub(r"\s+", " ", m[0]).strip().lstrip(" .,;:")
                        if 25 <= len(claim) <= 320:
                            found.setdefault(claim)
    return list(found)[:limit]


def claimed(df: DataFrame, text: str) -> DataFrame:
    """STR7, STR8: df's columns but the text, with the array of its claims; texts are met one at a time."""
    return each_text(df, text, lambda t: [(claims_of(t),)], {"claims": "array<string>"})


def paper_hints(df: DataFrame, key: str, text: str) -> DataFrame:
    """CMP1, STR3-5, STR10: identifier, year, journal and methods of each text; null where nothing is found."""
    head, start = F.substring(F.col(text), 1, 6000), F.lower(F.substring(F.col(text), 1, 20_000))
    found = lambda p, g: F.nullif(F.regexp_extract(head, p, g), F.lit(""))
    year = F.coalesce(*[found(p, 1) for p in lexicon.YEAR_RULES])
    journal = F.coalesce(*[F.when(F.contains(start, F.lit(j.lower())), F.lit(j)) for j in lexicon.JOURNALS])
    methods = F.array_compact(F.array(*[F.when(F.col(text).rlike(f"(?i){p}"), F.lit(name)) for name, p in lexicon.METHODS.items()]))
    return df.select(key, F.regexp_replace(found(lexicon.DOI, 0), "[.,;]+$", "").alias("doi"), year.alias("year"), journal.alias("journal"), methods.alias("methods"))


def pattern_hits(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """DM6: (id, start, end, snippet) of a Python pattern's matches, places in code points; for patterns the engine can't place."""
    compiled = re.compile(pattern)
    hits = lambda t: ((m.start(), m.end(), m[0]) for m in compiled.finditer(t or ""))
    return each_text(df.select(F.col(key).cast("long").alias("id"), text), text, hits, {"start": "int", "end": "int", "snippet": "string"})


def skeleton(df: DataFrame, key: str, text: str, dimensions: dict[str, tuple[str, str]], limit: int = 3, least: int = 40) -> DataFrame:
    """STR9, DM7, DM8, FLT4: for each dimension the first different sentences of a strict pattern, else of a relaxed one.

    The last 15 % of a text, where references stand, are not searched; matches of fewer than `least` characters
    after squeezing don't count. One row per text and dimension: (key, dimension, claims, found, relaxed).
    """
    body = F.substring(F.col(text), F.lit(1), F.floor(F.length(text) * 0.85).cast("int"))

    def claims(pattern: str) -> Column:
        # A pattern that begins with the rest of a sentence is tried at its beginning only, not at each of its characters.
        pattern = r"(?<![^.\n])" + pattern if pattern.startswith(r"[^.\n]*") else pattern
        every = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), squeezed)
        return F.slice(F.array_distinct(F.filter(every, lambda c: F.length(c) >= least)), 1, limit)

    rows = F.array(*[F.struct(F.lit(name).alias("dimension"), claims(strict).alias("strict"), claims(relaxed).alias("loose")) for name, (strict, relaxed) in dimensions.items()])
    found = df.select(key, F.inline(rows))
    return found.select(key, "dimension", F.when(F.size("strict") > 0, F.col("strict")).otherwise(F.col("loose")).alias("claims"), (F.greatest(F.size("strict"), F.size("loose")) > 0).alias("found"), ((F.size("strict") == 0) & (F.size("loose") > 0)).alias("relaxed"))


def mentions(df: DataFrame, key: str, text: str, needle: str, critical: str, reach: int = 400) -> DataFrame:
    """STR11: first place of a literal in each text, and whether a critical pattern stands within reach of it."""
    at = F.instr(text, F.lit(needle))
    near = F.substring(F.col(text), F.greatest(at - reach, F.lit(1)), F.least(at, F.lit(reach + 1)) - 1 + len(needle) + reach)
    return df.filter(at > 0).select(key, (at - 1).cast("long").alias("start"), F.when(near.rlike(critical), "criticism").otherwise("citation").alias("kind"))


def by_identifier(found: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """JN6: rows joined by an identifier, whatever its case and the blanks around it; null and empty ones meet nothing."""
    a, b = (x.withColumn(name, F.nullif(F.lower(F.trim(name)), F.lit(""))) for x in (found, known))
    return a.join(b, name)


def cooccurrences(df: DataFrame, text: str, words: tuple[str, ...]) -> DataFrame:
    """JN4, SET4: (a, b, n): how many texts hold both of two words, whatever their case; pairs are made of each text's own short list."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(k)), F.lit(k)) for k in sorted(words)]))
    own = df.select(found.alias("k"))
    pairs = own.select(F.posexplode("k").alias("i", "a"), "k").select("a", F.explode(F.slice("k", F.col("i") + 2, len(words))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
