"""Rules, reports and examinations on fixtures made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, cluster, exams, pareto, reports, rules, text
from lodestone.plans import reports as report_plans
from lodestone.plans import rules as rule_plans
from lodestone.sources import staging


def frame(spark, rows, schema="key string, text string"):
    return spark.createDataFrame(rows, schema)


def test_forbidden_looks_behind_an_excused_place(spark):
    far = " and more" * 20
    rows = [("a", f"stupid license{far} stupid"), ("b", "stupid license"), ("c", "so stupid"), ("d", None), ("e", "")]
    got = {(r.key, r.needle): r.start for r in audit.forbidden(frame(spark, rows), "key", "text", ["stupid", "idiot"], "license").collect()}
    assert got == {("a", "stupid"): len(f"stupid license{far} "), ("c", "stupid"): 3}


def test_method_words_ignore_case(spark):
    got = text.paper_hints(frame(spark, [("a", "We use KRIGING and a Differential Evolution."), ("b", None)]), "key", "text").collect()
    assert sorted(got[0].methods) == ["Differential evolution", "Kriging / Gaussian process"]


def test_stamp_tells_repeated_rows(spark):
    one = frame(spark, [("a", "x"), ("b", "y")])
    stamps = [text.stamp(df, "key", "text").collect()[0] for df in (one, one.union(frame(spark, [("c", "z")])), one.union(frame(spark, [("c", "z")] * 3)), one.repartition(3), frame(spark, []))]
    assert stamps[0] == stamps[3] and len({s.stamp for s in stamps}) == 4 and [s.n for s in stamps] == [2, 3, 5, 2, 0]


def test_literal_places(spark):
    rows = [("a", "Tion x tion tion"), ("b", None), ("c", "")]
    got = [(r.key, r.hit, r.start, r.end, r.around) for r in text.literal_hits(frame(spark, rows), "text", "tion ", 2).collect()]
    assert got == [("a", 0, 0, 5, "Tion x "), ("a", 1, 7, 12, "x tion ti")]


def test_each_defect_is_caught_and_the_clean_chapter_is_left_alone(spark):
    got = rule_plans.rule_mutations(spark, "").collect()
    assert len(got) == len(rule_plans.DEFECTS) and [r.rule for r in got if not (r.caught and r.clean)] == []


def test_rules_of_nulls_empties_and_empty_tables(spark):
    for rows in ([("a", None), ("b", "")], []):
        found = rule_plans.broken(frame(spark, rows), spark)
        assert {r.rule for r in found.collect()} <= {"A1", "A4", "C5", "E3", "R3", "R4"}


def test_fenced_claims_and_tables_beside_a_source(spark):
    text_ = "```\n5%\n\n6%\n```\n\nabout 7%\n\n| a | 8% |\n|---|---|\n\n[source 1]\n\n| b | 9% |\n|---|---|\n\nplain\n\n| c | 10% |\n|---|---|"
    rows = rules.blocks(frame(spark, [("a", text_)]), "key", "text")
    assert sorted(r.said for r in rules.uncited(rows, "key", rule_plans.CLAIM, rule_plans.CITED).collect()) == ["about 7%", "| c | 10% | |---|---|"]


def test_exam_rules(spark):
    expr = lambda body: F.expr(body.replace(" k %", " key %"))
    keys = spark.range(1, 100).select(F.col("id").alias("key"))
    found = exams.faults(keys.select("key", expr(report_plans.PAPER).alias("text")), keys.select("key", expr(report_plans.SHEET).alias("text")), "key", "text")
    by = {}
    for r in found.collect():
        by.setdefault(r.key, set()).add(r.rule)
    assert 1 not in by and 2 not in by
    assert {"S1"} <= by[11] and {"S2", "S4"} <= by[7] and {"S5", "S6"} <= by[5] and "S6" in by[4] and {"S7"} <= by[6] and "S8" in by[9]


def test_wrong_sums(spark):
    rows = [("a", "1 + 2 = 4, 5 - 3 = 2, 2 x 3 = 6"), ("b", "1/4 ≈ 25%, 1/4 ≈ 30%, 1/0 ≈ 3%"), ("c", "1000^(1/3) ≈ 10.00 and 1000^(1/2) ≈ 31.00"), ("d", None)]
    assert sorted((r.key, r.said) for r in audit.wrong_sums(frame(spark, rows), "key", "text").collect()) == [("a", "1 + 2 = 4"), ("b", "1/4 ≈ 30%"), ("c", "1000^(1/2) ≈ 31.00")]


def test_a_text_is_read_once_for_each_form_of_sum(spark):
    out = audit.wrong_sums(frame(spark, [("a", "1 + 2 = 4, 1234567 + 1.5 = 3 and 12/6450%")]), "key", "text")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 3
    assert sorted((r.form, r.said, r.real) for r in out.collect()) == [("share", "12/6450%", 100 * 12 / 645), ("sum", "1 + 2 = 4", 3.0), ("sum", "234567 + 1.5 = 3", 234568.5)]



def test_assembled_book(spark):
    got = reports.assembled(frame(spark, [("1", "# A\ntext\n```\n# no\n```\n## B b")]), "key", "text").collect()[0]
    assert got.text == '## Contents\n\n- [A](#a1-1)\n- [B b](#a1-2)\n\n<a id="a1-1"></a>\n## A\ntext\n```\n# no\n```\n<a id="a1-2"></a>\n### B b'
    assert got.n_entries == 2 and got.ok


def test_box_share_and_symbols(spark):
    rows = frame(spark, [("a", "ab\n> Deep cd\n> ef\ngh\n> ij"), ("b", None)])
    assert {r.key: r.share for r in reports.box_share(rows, "key", "text", "^> Deep", "[a-z]").collect()}["a"] == pytest.approx(7 / 13, abs=1e-6)
    got = reports.unlisted_symbols(frame(spark, [("a", "no x\n(f) alpha = beta_1 + x"), ("b", None)]), "key", "text", "(f)", ["x"]).collect()
    assert (got[0].n_symbols, got[0].missing) == (3, "alpha,beta_1")


def test_nearest_in_blocks(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(1000)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long")
    queries = df.filter("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    want = sorted((a, k + 1, b) for a, x in rows if a % 10 == 0 for k, (_, b) in enumerate(sorted((abs(x - y), j) for j, y in rows if j != a)[:4]))
    for limit in (1000, 7):
        assert sorted((r.query, r["rank"], r.id) for r in cluster.nearest(df, queries, 4, F.abs(F.col("v") - F.col("q")), limit).collect()) == want


def test_skyline(spark):
    rnd = random.Random(5)
    rows = [(i, *(float(rnd.randrange(9)) for _ in range(4))) for i in range(400)] + [(900, None, 0.0, 0.0, 0.0)]
    got = sorted(r.id for r in pareto.skyline(spark.createDataFrame(rows, "id long, a double, b double, c double, d double"), [F.col(c) for c in "abcd"]).collect())
    worse = lambda x, y: all(p <= q for p, q in zip(x, y)) and x != y  # noqa: E731, B905
    assert got == sorted(r[0] for r in rows[:400] if not any(worse(o[1:], r[1:]) for o in rows[:400]))
    assert pareto.skyline(spark.createDataFrame([], "a double, b double"), [F.col("a"), F.col("b")]).count() == 0


def test_scratch_goes_with_its_tables_and_results_stay(spark):
    with pytest.raises(RuntimeError), staging.scratch(spark, "t") as path:
        inner = staging.staged(spark.range(3), "a")
        assert inner.inputFiles()[0].startswith(path.replace("file:///", "file:///"))
        raise RuntimeError
    with pytest.raises(Exception):  # noqa: B017
        inner.count()
    run = staging.tidy(lambda s, d: staging.staged(s.range(5), "b").filter("id > 1"))
    assert run(spark, "").count() == 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_clusters_equal_plain_ones(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.gauss(5 * (i % 4), 0.4), rnd.gauss(3 * (i % 3), 0.4)) for i in range(300)] + [(900 + i, 2.0, 2.0) for i in range(20)] + [(950, None, 1.0), (951, 1.0, None), (952, 99.0, 99.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    whole = {i: (x, y) for i, x, y in rows if x is not None and y is not None}
    near = lambda a, eps: [b for b in whole if a in whole and (whole[a][0] - whole[b][0]) ** 2 + (whole[a][1] - whole[b][1]) ** 2 <= eps * eps]

    def reached(start, among, eps):
        seen, todo = {start}, [start]
        while todo:
            new = [b for b in near(todo.pop(), eps) if b in among and b not in seen]
            seen.update(new)
            todo += new
        return min(seen)

    got = {r.id: r.cluster for r in cluster.single_linkage(points, 0.3).collect()}
    assert got == {i: reached(i, whole, 0.3) if i in whole else i for i, _, _ in rows}
    cores = {i for i in whole if len(near(i, 0.3)) >= 6}
    names = {i: reached(i, cores, 0.3) for i in cores}
    want = {i: (i in cores, names[i] if i in cores else min([names[b] for b in near(i, 0.3) if b in cores], default=-1)) for i, _, _ in rows}
    assert {r.id: (r.is_core, r.cluster) for r in cluster.dbscan(points, 0.3, 6).collect()} == want
