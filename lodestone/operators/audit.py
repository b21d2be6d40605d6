"""Declarative data-quality rules: each gives a DataFrame of violations; a rule passes if it has none.

Rules are held to by a mutation harness: a defect is put into one row of a copy, and the rule must then fail.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import text as tx

Rule = Callable[[dict[str, DataFrame]], DataFrame]


def violations(found: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return found.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def verdicts(tables: dict[str, DataFrame], rules: dict[str, Rule]) -> DataFrame:
    """DM11: (rule, n_violations, passed) of every rule, those without violations too."""
    found = reduce(DataFrame.unionByName, [rule(tables) for rule in rules.values()])
    names = found.sparkSession.createDataFrame([(r,) for r in sorted(rules)], "rule string")
    counted = found.groupBy("rule").agg(F.count("*").alias("n"))
    return names.join(counted, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n_violations"), F.col("n").isNull().alias("passed"))


def mutated(df: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """DM12, CMP18: a copy with one column replaced in the rows of a condition."""
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """AGG15, D2: keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JN8, JN10: keys of one side alone, with the side."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def gaps(df: DataFrame, keys: list[str], number: str, first: int = 0) -> DataFrame:
    """WIN12, S5: rows whose number isn't the next in order."""
    w = Window.partitionBy(*keys).orderBy(number)
    return df.withColumn("expected", F.row_number().over(w) - 1 + first).filter(F.col(number) != F.col("expected"))


def forbidden(df: DataFrame, key: str, text: str, needles: list[str], excuse: str, reach: int = 90) -> DataFrame:
    """D3, D4b, A7, FLT7: of each forbidden literal of a text the first place, among all, near which no excusing pattern stands."""
    places = tx.literal_places(df.select(key, text), text, needles, reach)
    return places.filter(~F.col("around").rlike(excuse)).groupBy(key, "needle").agg(F.min("start").alias("start"))


def stated_arithmetic(df: DataFrame, key: str, text: str, tolerance: float = 0.03) -> DataFrame:
    """MTH13, A8: statements a/b = c% whose stated result is off by more than the tolerance, relative to it."""
    pattern = r"([0-9]+(?:\.[0-9]+)?) ?/ ?([0-9]+(?:\.[0-9]+)?) ?[=≈] ?([0-9]+(?:\.[0-9]+)?)%"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    g = df.select(key, *[p.alias(f"p{k}") for k, p in enumerate(parts)]).select(key, F.posexplode("p0").alias("i", "a"), "p1", "p2")
    g = g.select(key, F.col("a").cast("double").alias("a"), F.get("p1", F.col("i")).cast("double").alias("b"), F.get("p2", F.col("i")).cast("double").alias("c"))
    off = F.abs(100 * F.try_divide(F.col("a"), F.col("b")) - F.col("c"))
    return g.filter(F.coalesce(off > F.greatest(tolerance * F.col("c"), F.lit(1e-9)), F.lit(True)))


_N = r"([0-9]{1,6}(?:\.[0-9]+)?)"


def wrong_sums(df: DataFrame, key: str, text: str) -> DataFrame:
    """MTH14: (key, form, said, real) of statements a + b = c (also -, ×, x), a/b ≈ c% and 1000^(1/d) ≈ c that are off.

    Tolerances: the larger of 0.5 % and 0.015; of 5 % and 0.05; 0.002. A division by zero isn't judged.
    """

    # One pass over a text for each form; the parts are read from what was found. The first numbers give nothing back (shorter ones meet a digit).
    first = _N.replace("{1,6}", "{1,6}+").replace(")?", ")?+")
    forms = {"sum": rf"{first} *([-+×x−]) *{first} *= *{_N}", "share": rf"{first} */ *{_N} *≈? *{_N} *%", "root": r"1000\^\(1/([0-9]{1,4})\) *≈ *([0-9]{1,4}\.[0-9]{2,4})"}
    every = df.select(key, *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"{n}_") for n, p in forms.items()])
    tagged = lambda n: F.transform(f"{n}_", lambda m: F.struct(F.lit(n).alias("form"), m.alias("said")))
    rows = every.select(key, F.inline(F.concat(*map(tagged, forms))))
    of = lambda n, k: F.regexp_extract("said", forms[n], k)
    number = lambda n, k: of(n, k).cast("double")
    by = lambda sum_, share, root: F.when(F.col("form") == "sum", sum_).when(F.col("form") == "share", share).otherwise(root)
    a, op, b = number("sum", 1), of("sum", 2), number("sum", 3)
    real = by(F.when(op.isin("-", "−"), a - b).when(op == "+", a + b).otherwise(a * b), 100 * F.try_divide(number("share", 1), number("share", 2)), F.pow(F.lit(1000.0), F.try_divide(F.lit(1.0), number("root", 1))))
    told = rows.select(key, "form", "said", real.alias("real"), by(number("sum", 4), number("share", 3), number("root", 2)).alias("c"))
    near = lambda share, least: F.greatest(share * F.greatest(F.lit(1.0), F.abs(F.col("c"))), F.lit(least))
    off = F.abs(F.col("real") - F.col("c")) > by(near(0.005, 0.015), near(0.05, 0.05), F.lit(0.002))
    return told.filter(off).select(key, "form", "said", "real")


def balanced_scores(items: DataFrame, keys: list[str], score: str, total: str) -> DataFrame:
    """AGG13: sums of scores against the stated total; a single missing score is inferred, more are unknown."""
    s = items.groupBy(*keys).agg(F.sum(score).alias("known"), F.count_if(F.col(score).isNull()).alias("missing"), F.max(total).alias("total"))
    inferred = F.when(F.col("missing") == 1, F.col("total") - F.col("known"))
    return s.withColumn("inferred", inferred).withColumn("balanced", F.when(F.col("missing") == 0, F.abs(F.col("known") - F.col("total")) <= 1e-6).otherwise(F.when(F.col("missing") == 1, F.col("inferred") > 0)))


def allocations(parts: DataFrame, keys: list[str], part: str, whole: str) -> DataFrame:
    """AGG14: parts may not exceed their whole, and must meet it where all parts are given."""
    s = parts.groupBy(*keys).agg(F.sum(part).alias("sum"), F.count_if(F.col(part).isNull()).alias("open"), F.max(whole).alias("whole"))
    return s.withColumn("ok", F.when(F.col("open") > 0, F.col("sum") <= F.col("whole") + 1e-6).otherwise(F.abs(F.col("sum") - F.col("whole")) <= 1e-6))


def first_concepts(rows: DataFrame, keys: list[str], lexicon: DataFrame, explained: str) -> DataFrame:
    """FLT5, WIN5, CMP17: the first line of each concept, and whether a line within three around it explains something.

    rows: keys, line_no, line; lexicon: (family, concept, include, exclude) of plain patterns, a side of stated size.
    """
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-3, 3)
    around = rows.withColumn("near", F.array_join(F.collect_list("line").over(w), "\n"))
    met = around.join(lexicon, F.expr("line rlike include and not line rlike exclude"))
    first = met.groupBy(*keys, "family", "concept").agg(F.min_by(F.struct("line_no", "near"), "line_no").alias("m"))
    return first.select(*keys, "family", "concept", F.col("m.line_no").alias("line_no"), F.col("m.near").rlike(explained).alias("explained"))


def report_json(verdict: DataFrame) -> DataFrame:
    """SNK4: one JSON text of all verdicts in the order of rules (a row per rule of a fixed registry)."""
    return verdict.agg(F.to_json(F.array_sort(F.collect_list(F.struct("rule", "n_violations", "passed")))).alias("report"))


def merge_protected(existing: DataFrame, drafted: DataFrame, key: str, text: str, mark: str = "TODO") -> DataFrame:
    """SNK3: drafts replace existing rows that still hold the mark; finished rows stay, new keys are added."""
    done = existing.filter(~F.contains(F.col(text), F.lit(mark)))
    return done.unionByName(drafted.join(done.select(key), key, "left_anti").select(*done.columns))


def mismatches(curated: DataFrame, found: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """JN1, D1b: (key, a, b) of rows where the curated value isn't the found one; null differs from any value."""
    return curated.join(found, key).filter(~F.col(a).eqNullSafe(F.col(b))).select(key, a, b)
