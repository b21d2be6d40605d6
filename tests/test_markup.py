import json

from pyspark.sql import functions as F

from lodestone.operators import audit, markup, text
from lodestone.sources import files


def doc(spark, body):
    rows = text.lines(spark.createDataFrame([(1, body)], "k int, t string"), "t")
    return text.fenced(rows, ["k"])


def test_headings_anchors_and_links(spark):
    rows = doc(spark, "# One two\n```\n# not this\n```\n[a](#one-two) [b](#gone)\n<a id=\"x\"></a>\n## Three!")
    assert [(r.level, r.anchor) for r in markup.headings(rows, ["k"]).orderBy("line_no").collect()] == [(1, "one-two"), (2, "three-")]
    assert [r.anchor for r in markup.dangling_links(rows, ["k"]).collect()] == ["gone"]
    out = text.concatenated(markup.anchored(rows, ["k"]), ["k"], "line_no", "line").first().text
    assert out.startswith('<a id="one-two"></a>\n# One two\n```\n# not this') and out.count("<a id=") == 2


def test_pieces_of_text(spark):
    df = spark.createDataFrame([("a\n```x\ncode\n```\nb\n\n\n\nc", "A. yes B. no")], "t string, o string")
    r = df.select(markup.fences_apart(F.col("t")).alias("t"), markup.option_split(F.col("o")).alias("o"), markup.between(F.col("t"), "```x", "```").alias("b"), text.page_of(F.lit("x ===== [PAGE 1] ===== y ===== [PAGE 2] ===== z"), F.lit(30)).alias("p")).first()
    assert r.t == "a\n\n```x\ncode\n```\n\nb\n\nc" and r.o == ["A. yes", "B. no"] and r.b == "code" and r.p == 1


def test_scores_and_cards(spark):
    items = spark.createDataFrame([("a", 40.0, 100.0), ("a", 60.0, 100.0), ("b", 40.0, 100.0), ("b", None, 100.0), ("c", None, 10.0), ("c", None, 10.0)], "k string, v double, t double")
    got = {r.k: (r.inferred, r.balanced) for r in audit.balanced_scores(items, ["k"], "v", "t").collect()}
    assert got == {"a": (None, True), "b": (60.0, True), "c": (None, None)}
    old, new = spark.createDataFrame([(1, "TODO"), (2, "done")], "k int, t string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, t string")
    assert {r.k: r.t for r in audit.merge_protected(old, new, "k", "t").collect()} == {1: "x", 2: "done", 3: "z"}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one\ntwo")
    (tmp_path / "in" / "b.txt").write_text("no")
    (tmp_path / "index.json").write_text(json.dumps({"papers": [{"id": "01", "kind": "pdf", "chars": 5}, {"id": "02", "kind": "none", "note": "x"}]}, indent=1))
    assert [(r.name, r.text) for r in files.text_tree(spark, f"{tmp_path}/in").collect()] == [("a.md", "one\ntwo")]
    index = files.index_json(spark, f"{tmp_path}/index.json")
    assert [(r.id, r.chars, r.note, r.txt) for r in index.orderBy("id").collect()] == [("01", 5, None, None), ("02", None, "x", None)]
    files.write_index(index.select("id", "kind"), "id", f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"id":"01","kind":"pdf"}', '{"id":"02","kind":"none"}']
    files.write_texts(spark.createDataFrame([("k", "body")], "k string, t string"), "k", "t", f"{tmp_path}/texts")
    assert spark.read.text(f"{tmp_path}/texts/k=k").first().value == "body"


def test_paper_hints(spark):
    body = "Engineering Optimization, VOL. 53, NO. 7, JULY 2023\nhttps://doi.org/10.1016/j.ast.2021.106.\nAccepted 2 May 2022. Kriging and expected improvement cut the cost.\n"
    r = text.paper_hints(spark.createDataFrame([(1, body), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("k").collect()
    assert (r[0].doi, r[0].year, r[0].journal) == ("10.1016/j.ast.2021.106", "2023", "Engineering Optimization")
    assert r[0].methods == ["Kriging / Gaussian process", "Expected improvement (EI)"] and r[2].doi is None and r[2].methods == []
    claim = "The loss was reduced by 4.5% against the baseline."
    assert text.claims_of("x\n" + claim + " " + claim) == [claim, "The loss was reduced by 4."] and text.claims_of(None) == []
