"""The registry: names, columns and, on the smallest tables, agreement with SQL."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_flagship_and_rules(spark):
    assert entry.entry(spark).count() == 3
    assert all(r.passed for r in entry.queries()["audit_verdicts"](spark, DATA).collect())
    assert all(r.caught for r in entry.queries()["mutation_verdicts"](spark, DATA).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["describe_by_flag", "pareto_front_part", "dbscan_supplier", "grep_places", "section_lengths", "keyword_cooccurrence", "forbidden_words", "source_discrepancies", "uncited_claims", "exam_faults", "bare_concepts", "paper_metadata", "verbatim_links", "source_stamp", "assembled_book", "number_tiers", "front_ranks_part", "alias_mentions", "page_metadata", "raw_places", "label_discrepancies", "radial_by_brand", "improvement_choice", "evidence_cards"])
def test_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = c.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, DATA).toPandas()
    order = sorted(want.columns)
    assert sorted(got.columns) == order and len(got) == len(want)
    show = lambda df: sorted(tuple("null" if str(v) in ("nan", "<NA>", "None") else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[order].itertuples(index=False))
    assert show(got) == show(want)
