"""Rules over marked-up texts (key, text): citations, headings, captions, formulas, quotations. Each gives its violations.

A block is what stands between blank lines. Patterns are the caller's; explicit classes keep engines agreed on them.
Null and empty texts have no blocks and break no rule but those that ask for something to be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import text as tx

IMAGE = r"!\[([^\]]*)\]\(\./images/([^)]+)\)"


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, block, in_fence): blocks with the parity of code fences; a fence's own blocks are inside."""
    rows = df.select(key, F.posexplode(F.split(text, "\n[ \t]*\n")).alias("block_no", "block"))
    marks = F.regexp_count(F.col("block"), F.lit("(?m)^```"))
    before = F.sum(marks).over(Window.partitionBy(key).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("in_fence", (F.coalesce(before, F.lit(0)) % 2 == 1) | F.col("block").startswith("```"))


def is_table(block: Column) -> Column:
    return F.regexp_count(block, F.lit(r"(?m)^[ \t]*\|")) >= 2


def uncited(rows: DataFrame, key: str, claim: str, cited: str, excused: str | None = None) -> DataFrame:
    """FLT8, A5, D8: blocks outside fences that make a claim without a source; a table may have it in a neighbouring block."""
    w = Window.partitionBy(key).orderBy("block_no")
    has = F.col("block").rlike(cited)
    beside = F.coalesce(F.lag(has).over(w), F.lit(False)) | F.coalesce(F.lead(has).over(w), F.lit(False))
    out = rows.withColumn("cited", has).withColumn("beside", beside & is_table(F.col("block")))
    out = out.filter(~F.col("in_fence") & F.col("block").rlike(claim) & ~F.col("cited") & ~F.col("beside"))
    if excused:
        out = out.filter(~F.col("block").rlike(excused))
    return out.select(key, "block_no", F.substring(tx.squeezed(F.col("block")), 1, 70).alias("said"))


def uncited_counts(rows: DataFrame, key: str, claim: str, count: str, cited: str, debunked: str) -> DataFrame:
    """A5: uncited() of counts (1500 runs), but for blocks that say that the count is no good, and those uncited for another claim already."""
    return uncited(rows, key, count, cited, debunked).join(uncited(rows, key, claim, cited).select(key, "block_no"), [key, "block_no"], "left_anti")


def prose_length(text: Column) -> Column:
    """A1: characters that are neither white space nor in code fences."""
    return tx.bare_length(tx.without_fences(text))


def headings_of(text: Column, level: str = "#{1,6}") -> Column:
    """The titles of heading lines."""
    return F.regexp_extract_all(text, F.lit(f"(?m)^{level} +([^\n]*)$"), F.lit(1))


def missing_words(titles: Column, words: list[str]) -> Column:
    """Words that no title holds."""
    joined = F.array_join(titles, "\n")
    return F.array_compact(F.array(*[F.when(~F.contains(joined, F.lit(w)), F.lit(w)) for w in words]))


def complete(df: DataFrame, key: str, text: str, least: int, words: list[str], placeholder: str) -> DataFrame:
    """(key, n, lacks, placeholder, ok) of parts that must be long enough, have headings, and no placeholder."""
    t = F.col(text)
    rows = df.select(key, prose_length(t).alias("n"), F.array_join(missing_words(headings_of(t, "##"), words), ",").alias("lacks"), t.rlike(placeholder).alias("placeholder"))
    return rows.withColumn("ok", (F.col("n") >= least) & (F.col("lacks") == "") & ~F.col("placeholder"))


def unsupported_words(df: DataFrame, key: str, text: str, words: list[str], allowed: list[str], cited: str) -> DataFrame:
    """Sentences that hold a banned word, phrases that are allowed aside, and cite nothing; one row a word."""
    rows = df.select(key, F.posexplode(F.split(tx.without_fences(F.col(text)), "[.|\n]")).alias("sentence_no", "s"))
    bare = F.col("s")
    for phrase in allowed:
        bare = F.replace(bare, F.lit(phrase), F.lit(""))
    found = F.array_compact(F.array(*[F.when(F.contains(bare, F.lit(w)), F.lit(w)) for w in words]))
    return rows.filter(~F.col("s").rlike(cited)).select(key, "sentence_no", F.explode(found).alias("word"))


def formula_faults(text: Column) -> dict[str, Column]:
    """Dollar signs, bare commands and array environments outside fences."""
    bare = tx.without_fences(text)
    count = lambda p: F.regexp_count(bare, F.lit(p)).cast("long")
    return {"dollars": count(r"\$"), "commands": count(r"\\[A-Za-z]{2,}"), "arrays": count(r"\\begin\{(cases|pmatrix|bmatrix|array)\}")}


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_links, n_dangling, n_foreign): links to anchors, those without their anchor, and those not in ASCII."""
    to, ids = F.regexp_extract_all(text, F.lit(r"\]\(#([^)]+)\)"), F.lit(1)), F.regexp_extract_all(text, F.lit('<a id="([^"]+)"'), F.lit(1))
    lost = F.filter(to, lambda x: ~F.array_contains(ids, x))
    return df.select(key, F.size(to).cast("long").alias("n_links"), F.size(lost).cast("long").alias("n_dangling"), F.size(F.filter(to, lambda x: x.rlike(r"[^\x00-\x7f]"))).cast("long").alias("n_foreign"))


def contents_faults(df: DataFrame, key: str, text: str, contents: str, required: list[str], least: int) -> DataFrame:
    """A10: (key, n_links, dangling, lacking, foreign, ok) of the links in each text's contents (the pattern's group 1).

    dangling: links without an anchor; lacking: required anchors that no link names or that aren't there; foreign: names
    not in ASCII. Too few links, or no contents at all, fail too.
    """
    inside = F.coalesce(F.regexp_extract(text, contents, 1), F.lit(""))
    to, ids = F.regexp_extract_all(inside, F.lit(r"\]\(#([^)]+)\)"), F.lit(1)), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit('<a +id="([^"]+)"'), F.lit(1))
    rows = df.select(key, to.alias("to"), ids.alias("ids"))
    joined = lambda xs: F.array_join(xs, ",")
    lacking = F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.array_contains("to", r) | ~F.array_contains("ids", r))
    out = rows.select(key, F.size("to").cast("long").alias("n_links"), joined(F.filter("to", lambda x: ~F.array_contains("ids", x))).alias("dangling"), joined(lacking).alias("lacking"), joined(F.filter("to", lambda x: x.rlike(r"[^\x00-\x7f]"))).alias("foreign"))
    return out.withColumn("ok", (F.col("n_links") >= least) & (F.col("dangling") == "") & (F.col("lacking") == "") & (F.col("foreign") == ""))


def identities(df: DataFrame, key: str, title: Column, meta: Column, doi: Column, known: DataFrame) -> DataFrame:
    """(key, fault) where the id of a text's title, of its metadata and of its DOI's owner don't agree, or are missing.

    known: (doi, id), each DOI of one owner; case and blanks around a DOI don't count, and one that nobody owns is no fault.
    """
    same = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = df.select(key, F.nullif(title, F.lit("")).alias("title"), F.nullif(meta, F.lit("")).alias("meta"), same(doi).alias("doi"))
    owners = known.select(same(F.col("doi")).alias("doi"), F.col("id").alias("owner"))
    met = rows.join(owners, "doi", "left")
    faults = F.array_compact(F.array(F.when(F.col("title").isNull(), "no title id"), F.when(F.col("meta").isNull(), "no metadata id"), F.when(F.col("title") != F.col("meta"), "title and metadata"), F.when(F.col("owner") != F.col("meta"), "DOI and metadata")))
    return met.select(key, F.explode(faults).alias("fault"))


def captions(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per image: (key, image_no, alt, file)."""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2)).alias("file"))
    return df.select(key, F.posexplode(parts).alias("image_no", "p")).select(key, "image_no", "p.alt", "p.file")


def strangers(images: DataFrame) -> DataFrame:
    """Images whose caption and file name both have words of four letters, and none in common."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))
    stem = F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), "_(zh|en)$", "")
    return images.filter((F.size(words(stem)) > 0) & (F.size(words(F.col("alt"))) > 0) & ~F.arrays_overlap(words(stem), words(F.col("alt"))))


def caption_numbers(images: DataFrame, key: str, sources: DataFrame) -> DataFrame:
    """Numbers of captions that name no source P.., or that the source (tag, blob) doesn't hold; ids 01 to 20 aside."""
    numbers = F.filter(F.regexp_extract_all("alt", F.lit(r"[0-9]+\.?[0-9]* *%|[0-9]+\.[0-9]+|[0-9]{2,}"), F.lit(0)), lambda x: ~x.rlike("^(0[1-9]|1[0-9]|20)$"))
    tag = F.nullif(F.regexp_extract("alt", "P([0-9][0-9])", 1), F.lit(""))
    rows = images.select(key, "image_no", tag.alias("tag"), F.explode(F.array_distinct(numbers)).alias("number"))
    met = rows.join(sources, "tag", "left")
    bad = F.when(F.col("tag").isNull(), "no source").when(F.col("blob").isNotNull() & ~F.contains("blob", F.replace("number", F.lit(" "), F.lit(""))), "not in source")
    return met.withColumn("fault", bad).filter("fault is not null").select(key, "image_no", "number", "fault")


def unqualified(df: DataFrame, key: str, text: str, claim: str, condition: str, before: int = 300, after: int = 100) -> DataFrame:
    """The first place of each text where a literal stands without a condition near it."""
    hits = tx.literal_hits(df.select(key, tx.without_fences(F.col(text)).alias("body_")), "body_", claim, before)
    near = F.substring("around", F.lit(1), F.least(F.col("start"), F.lit(before)) + len(claim) + after)
    return hits.filter(~near.rlike(condition)).groupBy(key).agg(F.min("start").cast("long").alias("start"))


def wrong_pairs(df: DataFrame, key: str, text: str, pattern: str, truth: DataFrame) -> DataFrame:
    """Pairs written in texts (the pattern's groups 1 and 2) that the mapping truth (a, b) doesn't have."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    said = df.select(key, F.explode(F.array_distinct(pairs)).alias("p")).select(key, "p.a", "p.b")
    return said.join(truth, ["a", "b"], "left_anti")


def placeholder_lines(df: DataFrame, key: str, text: str, pattern: str, always: str) -> DataFrame:
    """Lines with a placeholder, comments aside, or with what is never allowed."""
    rows = tx.lines(df.select(key, text), text)
    comment = F.trim("line").startswith("#")
    return rows.filter((F.col("line").rlike(pattern) & ~comment) | F.col("line").rlike(always)).select(key, "line_no", "line")


def garbled(df: DataFrame, key: str, text: str, mark: str, pattern: str) -> DataFrame:
    """R2: lines with a mark that hold a garbled formula."""
    rows = tx.lines(df.select(key, tx.without_fences(F.col(text)).alias("body_")), "body_")
    return rows.filter(F.contains("line", F.lit(mark)) & F.col("line").rlike(pattern)).select(key, "line_no")


def empty_cells(df: DataFrame, key: str, text: str, head: str) -> DataFrame:
    """(key, n_rows, n_empty) of the table under a head line: body rows, and those whose last cell is empty."""
    rows = F.split(F.regexp_extract(text, "(?m)^" + head + r"\n\|[-| ]+\|\n((\|[^\n]*\n?)*)", 1), "\n")
    body = F.filter(rows, lambda r: r.startswith("|"))
    empty = F.filter(body, lambda r: r.rlike(r"\| *\| *$"))
    return df.select(key, F.size(body).cast("long").alias("n_rows"), F.size(empty).cast("long").alias("n_empty"))


def out_of_order(df: DataFrame, key: str, text: str, first: str, then: str) -> DataFrame:
    """Texts that lack the first literal, or have it only after the second."""
    a, b = F.instr(F.col(text), F.lit(first)), F.instr(F.col(text), F.lit(then))
    return df.filter((a == 0) | ((b > 0) & (a > b))).select(key)


def false_quotations(df: DataFrame, key: str, text: str, claim: str, corpus: DataFrame, least: int = 40) -> DataFrame:
    """sentences quoted (> lines) right under a line that claims to be word for word, which the corpus doesn't hold.

    corpus: (blob) texts; both sides are compared as tx.comparable makes them.
    Sentences of fewer letters than least aren't judged, quotations cut by dots are false.
    """
    quote = F.regexp_extract_all(text, F.lit("(?m)^[^\n]*" + claim + "[^\n]*\n((>[^\n]*\n?)+)"), F.lit(1))
    rows = df.select(key, F.posexplode(quote).alias("quote_no", "q")).withColumn("q", tx.squeezed(F.regexp_replace("q", "(?m)^>", "")))
    rows = rows.select(key, "quote_no", F.posexplode(F.split("q", r"(?<=\.) ")).alias("sentence_no", "s"), (F.contains("q", F.lit("...")) | F.contains("q", F.lit("…"))).alias("cut"))
    rows = rows.withColumn("c", tx.comparable(F.col("s"))).filter((F.length(F.regexp_replace("s", "[^A-Za-z]", "")) >= least) | F.col("cut"))
    asked = rows.filter(~F.col("cut")).select("c").distinct()
    found = held_in(asked, corpus.select(F.col("blob").alias("whole")), (least + 1) // 2)
    return rows.join(found, "c", "left_anti").select(key, "quote_no", "sentence_no", "cut")


def held_in(asked: DataFrame, known: DataFrame, gram: int) -> DataFrame:
    """Of strings (c) of at least 2 * gram - 1 characters those that a text (whole) holds.

    Wherever a text holds such a string, one of the string's first gram grams starts at a multiple of gram in the
    text. So texts give one gram in gram places and strings their first gram ones; where they meet is looked at.
    """
    at = F.explode(F.sequence(F.lit(0), F.least(F.lit(gram - 1), F.length("c") - gram)))
    grams = asked.filter(F.length("c") >= 2 * gram - 1).select("c", at.alias("at")).select("c", "at", F.substring("c", F.col("at") + 1, F.lit(gram)).alias("g"))
    texts = known.withColumn("id_", F.xxhash64("whole"))
    cut = texts.select("id_", F.explode(F.array_distinct(F.regexp_extract_all("whole", F.lit(f"(?s).{{{gram}}}"), F.lit(0)))).alias("g"))
    met = grams.join(cut, "g").select("c", "id_").distinct()
    return met.join(texts, "id_").filter(F.contains("whole", F.col("c"))).select("c").distinct()
