"""Structured-text operators: line classes, anchors and tables of contents, counters, paragraphs, layout shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def line_class(line: Column) -> Column:
    """STR19: what kind of line it is."""
    return (
        F.when(line.rlike(r"^\|") | (F.regexp_count(line, F.lit(r"\|")) >= 2), "table")
        .when(line.rlike("^#{1,6} "), "heading")
        .when(line.rlike("^>"), "quote")
        .when(line.rlike(r"^(!\[|Figure|Table)"), "caption")
        .when(line.rlike(r"\$\$|[=<>]"), "formula")
        .otherwise("body")
    )


def counters(text: Column) -> dict[str, Column]:
    """STR16, STR24: formulas, images, quotes and shouted words of a text."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return {"formulas": count(r"\$\$[^$]+\$\$"), "images": count(r"!\[[^\]]*\]\("), "bars": count(r"\|"), "shouts": count("[A-Z]{2,}!!")}


def previous_filled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """WIN14: the last line before that isn't empty."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.last(F.when(F.length(F.trim("line")) > 0, F.col("line")), ignorenulls=True).over(w))


def option_split(line: Column) -> Column:
    """WIN14: the options of a line "A. x  B. y", or null where it has fewer than two."""
    parts = F.regexp_extract_all(line, F.lit(r"[A-D]\. [^ ]+"), F.lit(0))
    return F.when(F.size(parts) >= 2, parts)


def headings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """STR15, STR26: (level, title, anchor) of heading lines outside fences."""
    level = F.length(F.regexp_extract("line", "^(#{1,6}) ", 1))
    title = F.trim(F.regexp_replace("line", "^#{1,6} ", ""))
    found = rows.filter(F.col("line").rlike("^#{1,6} ") & ~F.col("in_fence"))
    return found.select(*keys, "line_no", level.alias("level"), title.alias("title"), F.lower(F.regexp_replace(title, "[^A-Za-z0-9]+", "-")).alias("anchor"))


def anchored(rows: DataFrame, keys: list[str]) -> DataFrame:
    """STR21: an anchor line goes before each heading that has none before it."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    before = F.coalesce(F.lag("line").over(w), F.lit(""))
    wanted = F.col("line").rlike("^#{1,6} ") & ~F.col("in_fence") & ~before.startswith("<a id=")
    slug = F.lower(F.regexp_replace(F.trim(F.regexp_replace("line", "^#{1,6} ", "")), "[^A-Za-z0-9]+", "-"))
    return rows.withColumn("line", F.when(wanted, F.concat(F.lit('<a id="'), slug, F.lit('"></a>\n'), F.col("line"))).otherwise(F.col("line")))


def dangling_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links to anchors that the same text doesn't have."""
    links = rows.select(*keys, F.explode(F.regexp_extract_all("line", F.lit(r"\]\(#([^)]+)\)"), F.lit(1))).alias("anchor")).distinct()
    return links.join(headings(rows, keys).select(*keys, "anchor"), [*keys, "anchor"], "left_anti")


def fences_apart(text: Column) -> Column:
    """STR22: a blank line on either side of fences, runs of blank lines collapsed."""
    spaced = F.regexp_replace(text, r"(?s)\n*(```[^\n]*\n.*?\n```)\n*", "\n\n$1\n\n")
    return stripped(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def between(text: Column, start: str, stop: str) -> Column:
    """STR20, STR25: what stands between two literals, or the empty text."""
    quoted = "(?s)\\Q" + start + "\\E(.*?)\\Q" + stop + "\\E"
    return stripped(F.regexp_extract(text, quoted, 1))


def paragraphs(df: DataFrame, text: str, least: int = 20) -> DataFrame:
    """AGG12: lines of at least so many letters: how many, and their mean length."""
    cut = df.withColumn("p_", F.filter(F.split(F.col(text), "\n"), lambda p: F.length(F.regexp_replace(p, "[^A-Za-z]", "")) >= least))
    total = F.aggregate("p_", F.lit(0), lambda s, p: s + F.length(p))
    return cut.withColumn("n_paragraphs", F.size("p_")).withColumn("mean_length", F.try_divide(total.cast("double"), F.size("p_"))).drop("p_")


def width_shares(df: DataFrame, columns: list[str], floor: float = 0.07) -> DataFrame:
    """PRJ16: each column's longest value over the sum, at least the floor, brought back to a sum of 1."""
    longest = df.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    raised = longest.select(*[F.greatest(F.col(c) / total, F.lit(floor)).alias(c) for c in columns])
    return raised.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) / sum((F.col(x) for x in columns[1:]), F.col(columns[0]))).alias("share")) for c in columns])))


def uncovered_characters(df: DataFrame, text: str, known: Column) -> DataFrame:
    """CMP20: characters that a condition on `c` doesn't cover; each text gives its own different ones."""
    chars = df.select(F.explode(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), ""))).alias("c")).filter(F.length("c") > 0)
    return chars.distinct().filter(~known)
