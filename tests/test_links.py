"""Items and aliases found in texts against looking for each in each."""

import random
import re

import pytest

from lodestone.operators import links


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("limit", [None, 60])
def test_contained_finds_items_of_any_length(spark, limit):
    rnd = random.Random(1)
    whole = "".join(rnd.choice("abc é😀") for _ in range(400))
    docs = [("d1", whole), ("d2", whole[100:180]), ("d3", "abc"), ("d4", None), ("d5", ""), ("d6", whole[50:90] + whole)]
    items = [(k, whole[a : a + n]) for k, (a, n) in enumerate([(0, 400), (7, 31), (9, 30), (100, 80), (101, 40), (50, 1), (60, 5), (377, 23), (20, 2), (61, 4)])] + [(90, ""), (91, None), (92, "zz"), (93, whole[60:65])]
    got = {(r.key, r.item): r.start for r in links.contained(frame(spark, docs, "key string, text string"), "key", "text", frame(spark, items, "item long, c string"), "item", "c", limit).collect()}
    assert got == {(k, i): t.find(c) for k, t in docs if t for i, c in items if c and c in t}


def test_contained_of_empty_tables(spark):
    docs, items = frame(spark, [("a", "b")], "key string, text string"), frame(spark, [(1, "b")], "item long, c string")
    assert links.contained(docs.limit(0), "key", "text", items, "item", "c").count() == links.contained(docs, "key", "text", items.limit(0), "item", "c").count() == 0


PATTERNS = [r"\b(CR[- ]?EI|calibrated and recalibrated expected improvement)\b", r"\b(Filter[- ]?GEI|generalized expected improvement)\b", r"uncertainty quantific\w+", r"\bTNO\b", r"(?:panoramic\s+)?prediction", r"\d+%", r"(ab|cd)+e?", r"x{2,}y", r"a|\d", r"[Éé]cole", r"École", r"(?=ab)a", r"b??c", r"(SHAP|S[h]ap)ley"]


@pytest.mark.parametrize("limit", [None, 3])
def test_aliases_equal_searching_each(spark, limit):
    docs = [(0, "The CR EI and filter-gei; Uncertainty QUANTIFICATION of 5% prediction"), (1, "tno TNOX xxy XXXY abcdabe École école ÉCOLE"), (2, None), (3, ""), (4, "panoramic \n prediction, Shapley shapley 7"), (5, "Kelvin K ſhap tno")]
    aliases = [(k, PATTERNS[k], k % 6 if k % 2 else None) for k in range(len(PATTERNS))] + [(99, None, None)]
    got = links.alias_links(frame(spark, docs, "id long, text string"), "id", "text", frame(spark, aliases, "alias long, pattern string, owner long"), limit).collect()
    want = {}
    for i, t in docs:
        for a, p, o in aliases:
            if t and p and o != i and (m := re.search(p, t, re.I | re.A)):
                want[i, a] = (m.start(), m.end(), m[0])
    assert {(r.id, r.alias): (r.start, r.end, r.match) for r in got} == want and len(got) == len(want)


def test_factors_stand_in_every_match():
    assert links.factors(PATTERNS[0]) == {"cr", "calibrated and recalibrated expected improvement"}
    assert links.factors(r"\bTNO\b") == {"tno"} and links.factors(r"(?:long )?word\w*") == {"word"}
    assert links.factors(r"\d+%") == {"%"} and links.factors(r"a|\d") is None and links.factors(r"(abc)?") is None
    assert links.factors(r"(ab){2}x") == {"ab"} and links.factors("É") == {"É"}


def test_kinds(spark):
    docs = frame(spark, [("a", "x" * 30 + " fails ITEM"), ("b", "ITEM" + "x" * 30 + " fails"), ("c", "no such")], "key string, text string")
    got = links.linked(docs, "key", "text", frame(spark, [(1, "ITEM")], "item long, c string"), "item", "c", "fails", 10)
    assert {(r.key, r.start, r.kind) for r in got.collect()} == {("a", 37, "criticism"), ("b", 0, "citation")}
