"""Examination papers and their answer sheets, read line by line, and the rules that both must keep (CMP13, STR23).

A paper's sections are headings "## A. title (2 points each, 10 points)"; its questions are lines "3. ... (5 points)".
An answer sheet has the same sections, with rows "| 3 | ... |" for short answers and headings "### Question 7 (5 points)"
for long ones, under which items "- ... (2 points)" allot the points. Texts without sections have no questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import text as tx


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("long")


def _sectioned(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = tx.lines(df.select(key, text), text)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("## ")
    return rows.withColumn("section", F.sum(head.cast("int")).over(w)).withColumn("head", F.last(F.when(head, F.col("line")), ignorenulls=True).over(w))


def questions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, each, total, question, points): each: points a question, total: the section's, as stated."""
    rows = _sectioned(df, key, text).withColumn("question", _number(F.col("line"), r"^([0-9]+)\. ")).filter("question is not null and section > 0")
    return rows.select(key, "section", _number(F.col("head"), r"([0-9]+) points each").alias("each"), _number(F.col("head"), r"([0-9]+) points\)").alias("total"), "line_no", "question", _number(F.col("line"), r"\(([0-9]+) points\)").alias("points"))


def answers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, question, points, allotted, n_open): points: of a long answer's heading; allotted: the sum of its items; n_open: items without points."""
    rows = _sectioned(df, key, text)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    long = _number(F.col("line"), "^### Question ([0-9]+)")
    short = _number(F.col("line"), r"^\| ([0-9]+) \|")
    asked = F.coalesce(long, short, F.when(F.col("line").startswith("## "), F.lit(0).cast("long")))
    rows = rows.withColumn("question", F.last(asked, ignorenulls=True).over(w)).filter("question > 0")
    item = F.col("line").startswith("- ")
    return rows.groupBy(key, "question").agg(
        F.max(F.when(long.isNotNull(), _number(F.col("line"), r"\(([0-9]+) points\)"))).alias("points"),
        F.sum(F.when(item, _number(F.col("line"), r"\(([0-9]+) points\)"))).alias("allotted"),
        F.count_if(item & ~F.col("line").rlike(r"\([0-9]+ points\)")).alias("n_open"),
    )


def valued(asked: DataFrame, key: str) -> DataFrame:
    """Questions with their worth: as stated, or as the section gives each, or, where one alone is open, what is left of the section."""
    w = Window.partitionBy(key, "section")
    open_ = F.count_if(F.col("points").isNull() & F.col("each").isNull()).over(w)
    left = F.col("total") - F.coalesce(F.sum("points").over(w), F.lit(0))
    return asked.withColumn("worth", F.coalesce("points", "each", F.when(open_ == 1, left)))


def faults(papers: DataFrame, sheets: DataFrame, key: str, text: str, whole: int = 100, header: tuple[str, ...] = ("Total 100 points", "Time 30 minutes")) -> DataFrame:
    """(key, rule, place): S1 header, S2 points each times questions, S3 points of a section, S4 points of the paper, S5 numbering,
    S6 questions on one side alone, S7 worth on paper and sheet, S8 allotments of a long answer."""
    asked = valued(questions(papers, key, text), key)
    answered = answers(sheets, key, text)
    rule = lambda df, name, place: df.select(key, F.lit(name).alias("rule"), place.cast("string").alias("place"))
    out = [rule(papers.filter(~F.contains(text, F.lit(h))), "S1", F.lit(h)) for h in header]
    sections = asked.groupBy(key, "section").agg(F.max("each").alias("each"), F.max("total").alias("total"), F.count("*").alias("n"), F.sum("points").alias("known"), F.count_if(F.col("points").isNull()).alias("open"))
    out.append(rule(sections.filter("each is not null and total is not null and each * n <> total"), "S2", F.col("section")))
    out.append(rule(sections.filter("each is null and (total is null or (open = 0 and known <> total) or (open = 1 and total - coalesce(known, 0) <= 0) or open > 1)"), "S3", F.col("section")))
    out.append(rule(sections.groupBy(key).agg(F.sum(F.coalesce("total", F.lit(0))).alias("sum")).filter(F.col("sum") != whole), "S4", F.col("sum")))
    order = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    out.append(rule(asked.withColumn("k", order).filter("k <> question"), "S5", F.col("question")))
    out.append(rule(asked.join(answered, [key, "question"], "left_anti"), "S6", F.col("question")))
    out.append(rule(answered.join(asked, [key, "question"], "left_anti"), "S6", -F.col("question")))
    both = answered.withColumnRenamed("points", "stated").join(asked.select(key, "question", "worth"), [key, "question"])
    out.append(rule(both.filter("stated <> worth"), "S7", F.col("question")))
    out.append(rule(both.filter("allotted > coalesce(stated, worth) or (n_open = 0 and allotted <> coalesce(stated, worth))"), "S8", F.col("question")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
