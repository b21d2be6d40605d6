"""Reports put together from the text operators: reader's audits, chapter reports, cards, assembled books, number audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import markup, rules
from lodestone.operators import text as tx


def bare_concepts(df: DataFrame, key: str, text: str, lexicon: DataFrame, explained: str, formula: str, baseline: list[str], card: str) -> DataFrame:
    """CMP17, STR19: the first line of each concept and its severity, null where it isn't bare.

    lexicon: (family, severity, concept, include, exclude), a side of stated size. A concept is bare unless a line
    within three around its first one explains it, the text's card (what a pattern's group 1 finds) holds it or
    readers know it. P0 on a formula line becomes P0+.
    """
    rows = tx.lines(df.select(key, F.col(text).alias("t"), F.regexp_extract(text, card, 1).alias("card")), "t")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-3, 3)
    around = rows.withColumn("near", F.array_join(F.collect_list("line").over(w), "\n"))
    met = around.join(lexicon, F.expr("line rlike include and not line rlike exclude"))
    first = met.groupBy(key, "family", "severity", "concept").agg(F.min_by(F.struct("line_no", "line", "near", "card"), "line_no").alias("m"))
    covered = F.col("m.near").rlike(explained) | F.contains("m.card", F.col("concept")) | F.col("concept").isin(baseline)
    worse = F.when((F.col("severity") == "P0") & F.col("m.line").rlike(formula), "P0+").otherwise(F.col("severity"))
    return first.select(key, "family", "concept", F.col("m.line_no").cast("long").alias("line_no"), F.when(~covered, worse).alias("severity"))


def break_summary(found: DataFrame, key: str) -> DataFrame:
    """AGG9: concepts, bare ones by severity, and the first break: the earliest fatal one, else the earliest."""
    bare = F.col("severity").isNotNull()
    fatal = F.col("severity") == "P0+"
    first = F.min(F.when(bare, F.struct((~fatal).alias("a"), "line_no", "concept")))
    s = found.groupBy(key).agg(F.count("*").alias("n_concepts"), F.count_if(bare).alias("n_bare"), F.count_if(F.col("severity") == "P0").alias("p0"), F.count_if(fatal).alias("fatal"), first.alias("f"))
    return s.select(key, "n_concepts", "n_bare", "p0", "fatal", F.round(100.0 * F.col("n_bare") / F.col("n_concepts"), 1).alias("bare_rate"), F.col("f.line_no").alias("first_line"), F.col("f.concept").alias("first_break"))


def patches(found: DataFrame, key: str, lookup: DataFrame) -> DataFrame:
    """AGG10, JN7: bare concepts by the patch that would cover them (concept, patch): how many, in how many texts, how many fatal."""
    bare = found.filter("severity is not null").join(lookup, "concept")
    return bare.groupBy("patch").agg(F.count("*").alias("n"), F.countDistinct(key).alias("texts"), F.count_if(F.col("severity") == "P0+").alias("fatal"))


def unlisted_symbols(df: DataFrame, key: str, text: str, mark: str, known: list[str]) -> DataFrame:
    """STR18: (key, n_symbols, missing): symbols on formula lines that aren't known, sorted."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(mark)))
    found = F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.replace(x, F.lit(mark), F.lit("")), F.lit("[A-Za-z][A-Za-z0-9_]{0,7}"), F.lit(0)))))
    missing = F.array_sort(F.array_except(found, F.array(*[F.lit(k) for k in known])))
    return df.select(key, F.size(found).cast("long").alias("n_symbols"), F.array_join(missing, ",").alias("missing"))


def box_share(df: DataFrame, key: str, text: str, opens: str, counted: str) -> DataFrame:
    """STR17, AGG12: the share of a text's counted characters that stand in quotation boxes whose first line matches.

    A box begins at a line that matches and ends before the first line that is no quotation.
    """
    n = lambda c: F.regexp_count(c, F.lit(counted))
    rows = tx.lines(df.select(key, text), text)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("line").rlike(opens), 1).when(~F.trim("line").startswith(">"), 0)
    inside = rows.withColumn("inside", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(0)))
    return inside.groupBy(key).agg(F.round(F.try_divide(F.sum(n(F.col("line")) * F.col("inside")).cast("double"), F.sum(n(F.col("line")))), 6).alias("share"))


def term_table(df: DataFrame, key: str, text: str, terms: list[str], limit: int) -> DataFrame:
    """TOP9, WIN4, CMP16: terms by how often they occur in all texts, the most frequent first, with the text they first occur in."""
    per = F.array(*[F.struct(F.lit(t).alias("term"), F.regexp_count(text, F.lit(t)).cast("long").alias("n")) for t in terms])
    rows = df.select(key, F.inline(per)).filter("n > 0")
    s = rows.groupBy("term").agg(F.sum("n").alias("n"), F.min(key).alias("first_in"))
    return s.orderBy(F.desc("n"), "term").limit(limit)


def reader_report(df: DataFrame, key: str, text: str, found: DataFrame, opens: str, counted: str) -> DataFrame:
    """CMP16, AGG11, STR16, STR17: per text its counted characters, formulas, images, share of boxes, concepts, bare ones and
    concepts per thousand characters; found: bare_concepts of the same texts."""
    marks = markup.counters(F.col(text))
    own = df.select(key, F.regexp_count(text, F.lit(counted)).cast("long").alias("letters"), *[marks[c].cast("long").alias(c) for c in ("formulas", "images")])
    concepts = found.groupBy(key).agg(F.count("*").alias("concepts"), F.count("severity").alias("bare"))
    out = own.join(box_share(df, key, text, opens, counted), key, "left").join(concepts, key, "left").fillna(0, ["concepts", "bare"])
    return out.withColumn("density", F.round(F.try_divide(1000.0 * F.col("concepts"), F.col("letters")), 4))


def chapter_report(df: DataFrame, key: str, text: str, least: int, sections: list[str], claim: str, cited: str) -> DataFrame:
    """CMP15: per text its length, sections it lacks, blocks without a source, and whether it passes."""
    own = df.select(key, rules.prose_length(F.col(text)).cast("long").alias("n"), F.array_join(rules.missing_words(rules.headings_of(F.col(text), "##"), sections), ",").alias("lacks"))
    open_ = rules.uncited(rules.blocks(df, key, text), key, claim, cited).groupBy(key).agg(F.count("*").alias("uncited"))
    out = own.join(open_, key, "left").withColumn("uncited", F.coalesce("uncited", F.lit(0)))
    return out.withColumn("ok", (F.col("n") >= least) & (F.col("lacks") == "") & (F.col("uncited") == 0))


def id_status(declared: Column, verified: Column, sniffed: Column) -> dict[str, Column]:
    """JN15: a declared identifier against the verified one and the one found in the text."""
    status = (
        F.when(verified.isNotNull() & declared.isNotNull() & (verified != declared), "conflict")
        .when(verified.isNull() & declared.isNotNull(), "declared only")
        .when(verified.isNull(), "unverified")
        .when(declared.isNull(), "verified only")
        .otherwise("agrees")
    )
    return {"status": status, "declared_ok": status.isin("agrees", "verified only", "declared only"), "text_ok": sniffed.isNull() | sniffed.eqNullSafe(verified)}


def cards(df: DataFrame, key: str, fields: dict[str, Column], claims: Column, limit: int = 8) -> DataFrame:
    """CMP3, CMP4: a Markdown card per row: a table of fields, TODO where one is null, then the first claims."""
    head = F.concat(F.lit("# Card "), F.col(key).cast("string"), F.lit("\n\n| field | value |\n| :--- | :--- |\n"))
    table = F.concat(*[F.concat(F.lit(f"| {name} | "), F.coalesce(c.cast("string"), F.lit("TODO")), F.lit(" |\n")) for name, c in fields.items()])
    listed = F.array_join(F.transform(F.slice(claims, 1, limit), lambda c: F.concat(F.lit("- "), tx.squeezed(c))), "\n")
    body = F.when(F.size(claims) > 0, F.concat(F.lit("\n## Claims\n\n"), listed, F.lit("\n"))).otherwise(F.lit("\n## Claims\n\n(none)\n"))
    return df.select(key, F.concat(head, table, body).alias("card"))


def evidence_level(has_text: Column, has_page: Column) -> Column:
    """CMP3: A where the text itself is at hand, B where a page about it is, else C."""
    return F.when(has_text, "A").when(has_page, "B").otherwise("C")


def evidence_cards(df: DataFrame, key: str, fields: dict[str, Column], level: Column, found: Column, declared: Column, abstract: Column, claims: Column, dimensions: DataFrame, names: list[str]) -> DataFrame:
    """CMP3, CMP4: (key, card): level of evidence, identifier with a note where two conflict, fields, abstract, numbered claims, skeleton.

    found and declared: the identifier of the text and of the files about it; the found one counts. dimensions: (key,
    dimension, claims array, relaxed) of each text, as text.skeleton() gives it, listed in the order of names; a
    dimension without claims says so, and a text without any row has no skeleton. What is null is left to do.
    """
    todo = lambda c: F.coalesce(c.cast("string"), F.lit("TODO"))
    per = dimensions.groupBy(key).agg(F.collect_list(F.struct("dimension", "claims", "relaxed")).alias("dims_"))
    rows = df.select(F.struct(*df.columns).alias("row_"), F.col(key).alias("key_"), *[x.alias(n) for n, x in (("level_", level), ("found_", found), ("declared_", declared), ("abstract_", abstract), ("claims_", claims))], *[todo(c).alias(f"field{k}_") for k, c in enumerate(fields.values())])
    rows = rows.join(per.withColumnRenamed(key, "dim_key_"), F.col("key_") == F.col("dim_key_"), "left")
    note = F.when(F.col("found_") != F.col("declared_"), F.concat(F.lit("\n> conflict: `"), F.col("declared_"), F.lit("` was declared, `"), F.col("found_"), F.lit("` stands in the text\n")))
    note = F.coalesce(note, F.when(F.col("found_").isNull() & F.col("declared_").isNotNull(), F.lit("\n> declared only: no identifier in the text\n")), F.lit(""))
    table = F.concat(*[F.concat(F.lit(f"| {name} | "), F.col(f"field{k}_"), F.lit(" |\n")) for k, name in enumerate(fields)])
    numbered = F.array_join(F.transform("claims_", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), tx.squeezed(c))), "\n")
    listed = F.when(F.size("claims_") > 0, numbered).otherwise("(none)")

    def section(name: str) -> Column:
        mine = F.element_at(F.filter("dims_", lambda d: d["dimension"] == name), 1)
        lines = F.array_join(F.transform(mine["claims"], lambda c: F.concat(F.lit("- "), tx.squeezed(c), F.when(mine["relaxed"], F.lit(" (relaxed)")).otherwise(""))), "\n")
        return F.concat(F.lit(f"\n### {name}\n\n"), F.when(F.size(mine["claims"]) > 0, lines).otherwise("(not found)"), F.lit("\n"))

    skeleton = F.when(F.col("dims_").isNotNull(), F.concat(*[section(n) for n in names])).otherwise(F.lit("\n(no text, no skeleton)\n"))
    card = F.concat(
        F.lit("# Card "), F.col("key_").cast("string"), F.lit("\n\n> level of evidence: "), F.col("level_"), F.lit("\n\n| field | value |\n| :--- | :--- |\n| DOI | `"), todo(F.coalesce("found_", "declared_")), F.lit("` |\n"), table, note,
        F.lit("\n## Abstract\n\n> "), todo(F.nullif(F.col("abstract_"), F.lit(""))), F.lit("\n\n## Claims\n\n"), listed, F.lit("\n\n## Skeleton\n"), skeleton,
    )
    return rows.select(F.col("key_").alias(key), card.alias("card"))


def assembled(df: DataFrame, key: str, text: str) -> DataFrame:
    """CMP8, CMP9, CMP11, STR26: (key, text, n_entries, ok): headings go one level down, each gets an anchor, and a table of
    contents that links to all of them goes first; ok: every link has its anchor, and no anchor stands twice.

    An anchor is the text's key and the heading's number.
    """
    rows = tx.fenced(tx.lines(df.select(key, text), text), [key])
    is_head = F.col("line").rlike("^#{1,5} ") & ~F.col("in_fence")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_head", is_head).withColumn("number", F.sum(is_head.cast("int")).over(w))
    anchor = F.concat(F.lit("a"), F.col(key).cast("string"), F.lit("-"), F.col("number").cast("string"))
    title = F.regexp_replace("line", "^#{1,5} +", "")
    line = F.when(F.col("is_head"), F.concat(F.lit('<a id="'), anchor, F.lit('"></a>\n#'), F.col("line"))).otherwise(F.col("line"))
    entry = F.when(F.col("is_head"), F.concat(F.lit("- ["), title, F.lit("](#"), anchor, F.lit(")")))
    parts = rows.select(key, "line_no", line.alias("line"), entry.alias("entry"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("x"))))), lambda x: x["x"]), "\n")
    whole = parts.groupBy(key).agg(joined("entry").alias("toc"), joined("line").alias("body"), F.count("entry").alias("n_entries"))
    out = whole.select(key, F.concat(F.lit("## Contents\n\n"), "toc", F.lit("\n\n"), "body").alias("text"), "n_entries")
    ids = F.regexp_extract_all("text", F.lit('<a id="([^"]+)"'), F.lit(1))
    single = out.select(key, (F.size(ids) == F.size(F.array_distinct(ids))).alias("single"))
    lost = rules.links(out.select(key, F.col("text")), key, "text").join(single, key).select(key, ((F.col("n_dangling") == 0) & F.col("single")).alias("ok"))
    return out.join(lost, key)


#: A number as texts state it, and the blanks that may stand before its unit.
NUMBER, BLANKS = r"[0-9]{1,4}(?:\.[0-9]+)?", r"[ \t\n\r\f\x0b]*"


def numbers(df: DataFrame, key: str, text: str, units: list[str], scaffold: str, years: str = "20[0-9]{2}", reach: int = 28) -> DataFrame:
    """STR12, FLT6: (key, kind, number, start, end, around, judged) of the numbers in each whole text.

    Kinds: percent, unit (a number before one of the units, tried in their order), integer (two to four digits that are
    no part of a longer number or percentage). A number that isn't a percentage is judged unless it is a year or a
    scaffold pattern stands within reach of it: its line may say what it likes. Null texts hold none.
    """
    t = F.col(text)
    kinds = {"percent": NUMBER + BLANKS + "%", "unit": f"{NUMBER}{BLANKS}(?:{'|'.join(units)})", "integer": "[0-9.．]+[%％]?"}
    tagged = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"))
    found = F.concat(*[F.transform(tx.places(t, p), tagged(k)) for k, p in kinds.items()])
    whole = F.filter(found, lambda m: (m["kind"] != "integer") | m["match"].rlike("^[0-9]{2,4}$"))
    rows = df.filter(t.isNotNull()).select(key, t.alias("text_"), F.explode(whole).alias("m"))
    rows = rows.select(key, "m.kind", F.regexp_extract("m.match", NUMBER, 0).alias("number"), "m.start", "m.end", tx.around(F.col("text_"), F.col("m.start"), F.col("m.end"), reach).alias("around"))
    excused = F.col("number").rlike(f"^(?:{years})$") | F.col("around").rlike(scaffold)
    return rows.withColumn("judged", (F.col("kind") == "percent") | ~excused)


def split_at(df: DataFrame, key: str, text: str, markers: list[str], least: int = 5) -> DataFrame:
    """CMP10: (key, part, first_line, last_line, text, fault) of texts cut at the first lines that begin with each marker.

    Part 0 is what stands before the first marker; a part ends before the next one's marker, the last with the text, its
    closing newline aside. Faults: a missing marker (a row without lines), one that stands before its forerunner, a part of
    fewer than least lines. Null texts have no parts.
    """
    rows = tx.lines(df.filter(F.col(text).isNotNull()).select(key, text), text)
    at = rows.groupBy(key).agg(F.max("line_no").alias("end"), F.max_by("line", "line_no").alias("last"), *[F.min(F.when(F.col("line").startswith(m), F.col("line_no"))).alias(f"m{k}") for k, m in enumerate(markers)])
    end = F.when((F.col("last") == "") & (F.col("end") > 0), F.col("end") - 1).otherwise(F.col("end"))
    n = len(markers)
    starts = F.array(F.lit(0), *[F.col(f"m{k}") for k in range(n)])
    parts = at.select(key, end.alias("end"), starts.alias("starts"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("part"))
    first = F.get("starts", F.col("part"))
    # What comes next in the text, whichever marker it is.
    after = F.array_min(F.filter("starts", lambda s: s > first))
    cut = parts.select(key, "part", first.alias("first_line"), F.coalesce(after - 1, F.col("end")).alias("last_line"), F.get("starts", F.col("part") - 1).alias("before"))
    body = rows.join(cut, key).filter(F.col("line_no").between(F.col("first_line"), F.col("last_line"))).groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    short = F.col("last_line") - F.col("first_line") + 1 < least
    fault = F.when(F.col("first_line").isNull(), "missing").when(F.col("first_line") < F.col("before"), "out of order").when(short, "short")
    return cut.join(body, [key, "part"], "left").select(key, "part", "first_line", F.when(F.col("first_line").isNotNull(), F.col("last_line")).alias("last_line"), "text", fault.alias("fault"))


def verdicts(report: DataFrame, key: str, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """SNK5: (key, check_no, line): a line [PASS] or [FAIL] with name and detail for each check (ok, detail); a null ok fails."""
    lines = [F.concat(F.when(F.coalesce(ok, F.lit(False)), "[PASS] ").otherwise("[FAIL] "), F.lit(f"{name}: "), F.coalesce(detail.cast("string"), F.lit(""))) for name, (ok, detail) in checks.items()]
    return report.select(key, F.posexplode(F.array(*lines)).alias("check_no", "line"))


def number_tiers(found: DataFrame, key: str, own: DataFrame, every: DataFrame) -> DataFrame:
    """CMP14, FLT6, JN9: (key, number, tier) of a text's different judged numbers: in its own source (key, number), in another text (number) or nowhere."""
    rows = found.filter("judged").select(key, "number").distinct()
    met = rows.join(own.select(key, "number").distinct().withColumn("own", F.lit(True)), [key, "number"], "left")
    met = met.join(every.select("number").distinct().withColumn("there", F.lit(True)), "number", "left")
    return met.select(key, "number", F.when(F.col("own"), "own").when(F.col("there"), "other").otherwise("none").alias("tier"))


def pointed_to(text: Column, links: dict[str, str]) -> Column:
    """PRJ14: links of one text rewritten to another place."""
    for old, new in links.items():
        text = F.replace(text, F.lit(f"]({old}"), F.lit(f"]({new}"))
    return text


def write_report(report: DataFrame, key: str, path: str) -> None:
    """SNK6: a report as Markdown, one table, and as JSON lines, both in the order of the key."""
    head = "| " + " | ".join(report.columns) + " |\n|" + "---|" * len(report.columns)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]), F.lit(" |"))
    spark = report.sparkSession
    body = report.select(F.col(key).alias("k"), line.alias("value"))
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/md-head")
    body.orderBy("k").select("value").write.text(f"{path}/md")
    report.orderBy(key).select(F.to_json(F.struct(*report.columns)).alias("value")).write.text(f"{path}/json")
