"""Parts by markers, contents, counts, identities, verdicts and cards on fixtures made by hand."""

from pyspark.sql import functions as F

from lodestone.operators import reports, rules


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, text string")


def test_split_at(spark):
    lines = "# title\nintro\n\n# one\na\nb\n\n# two\nc\n# one again\n"
    df = frame(spark, [("a", lines), ("b", "x\n# two\ny\n# one\nz"), ("c", None), ("d", "")])
    got = {(r.key, r.part): (r.first_line, r.last_line, r.text, r.fault) for r in reports.split_at(df, "key", "text", ["# one", "# two"], 3).collect()}
    assert got["a", 0] == (0, 2, "# title\nintro\n", None) and got["a", 1] == (3, 6, "# one\na\nb\n", None)
    # The last part goes to the end of the text, its closing newline aside.
    assert got["a", 2] == (7, 9, "# two\nc\n# one again", None)
    assert got["b", 1] == (3, 4, "# one\nz", "short") and got["b", 2] == (1, 2, "# two\ny", "out of order")
    assert got["d", 1] == got["d", 2] == (None, None, None, "missing") and not any(k == "c" for k, _ in got)
    assert "\n".join(got["a", k][2] for k in range(3)) + "\n" == lines


def test_contents(spark):
    good = '## Contents\n- [a](#x)\n- [b](#y)\n---\n<a id="x"></a>\n<a  id="y"></a>'
    rows = [("good", good), ("lost", good.replace('id="y"', 'id="z"')), ("foreign", good.replace("#y", "#ÿ").replace('"y"', '"ÿ"')), ("none", "text"), ("null", None)]
    got = {r.key: (r.n_links, r.dangling, r.lacking, r.foreign, r.ok) for r in rules.contents_faults(frame(spark, rows), "key", "text", r"(?s)## Contents\n(.*?)\n---", ["x", "y"], 2).collect()}
    assert got["good"] == (2, "", "", "", True) and got["lost"] == (2, "y", "y", "", False) and got["foreign"] == (2, "", "y", "ÿ", False)
    assert got["none"][:3] == got["null"][:3] == (0, "", "x,y")


def test_uncited_counts(spark):
    said = "took 1500 runs\n\nup 5% in 20 runs\n\n300 runs [source 1]\n\n400 runs, deleted\n\n```\n500 runs\n```\n\n| a | 600 runs |\n|---|---|\n\n[source 2]"
    rows = rules.blocks(frame(spark, [("a", said)]), "key", "text")
    assert [r.said for r in rules.uncited_counts(rows, "key", "[0-9]%", "[0-9]+ runs", r"\[source", "deleted").collect()] == ["took 1500 runs"]


def test_identities(spark):
    df = spark.createDataFrame([("a", "1", "1", " 10.1/X "), ("b", "1", "2", None), ("c", "3", "3", "10.1/x"), ("d", "", None, "10.9/z")], "key string, title string, meta string, doi string")
    known = spark.createDataFrame([("10.1/x", "1")], "doi string, id string")
    got = sorted((r.key, r.fault) for r in rules.identities(df, "key", F.col("title"), F.col("meta"), F.col("doi"), known).collect())
    assert got == [("b", "title and metadata"), ("c", "DOI and metadata"), ("d", "no metadata id"), ("d", "no title id")]


def test_repeated_anchors_stop_a_book(spark):
    rows = [("a", "# one\ntext"), ("b", '# one\n<a id="z"></a>\n<a id="z"></a>')]
    assert {r.key: r.ok for r in reports.assembled(frame(spark, rows), "key", "text").collect()} == {"a": True, "b": False}


def test_verdicts_and_cards(spark):
    df = spark.createDataFrame([("a", 5, "10.1/a", "10.1/b", ["up  5%"]), ("b", None, None, None, [])], "key string, n int, found string, declared string, claims array<string>")
    lines = [r.line for r in reports.verdicts(df.filter("key = 'a'"), "key", {"size": (F.col("n") > 3, F.col("n")), "none": (F.lit(None).cast("boolean"), F.lit("x"))}).orderBy("check_no").collect()]
    assert lines == ["[PASS] size: 5", "[FAIL] none: x"]
    dims = spark.createDataFrame([("a", "problem", ["it is hard"], True), ("a", "result", [], False)], "key string, dimension string, claims array<string>, relaxed boolean")
    got = {r.key: r.card for r in reports.evidence_cards(df, "key", {"n": F.col("n")}, reports.evidence_level(F.col("n").isNotNull(), F.lit(True)), F.col("found"), F.col("declared"), F.lit(""), F.col("claims"), dims, ["problem", "result"]).collect()}
    assert "> level of evidence: A" in got["a"] and "> conflict: `10.1/b` was declared, `10.1/a` stands in the text" in got["a"] and "1. up 5%" in got["a"]
    assert "### problem\n\n- it is hard (relaxed)\n\n### result\n\n(not found)" in got["a"]
    assert "level of evidence: B" in got["b"] and "| DOI | `TODO` |\n| n | TODO |" in got["b"] and "(none)" in got["b"] and "(no text, no skeleton)" in got["b"]
