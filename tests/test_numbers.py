"""Places of patterns from lengths, and numbers judged by what stands around them."""

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import reports, text


def test_places_equal_finding_them(spark):
    rnd = random.Random(5)
    texts = ["", "7", "x", "12%", None] + ["".join(rnd.choice("a é😀17.%") for _ in range(n)) for n in (1, 5, 64, 65, 300, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for pattern in ("[0-9]+", "[0-9.]+%?", "a|é"):
        got = {r.id: r.p for r in df.select("id", text.places(F.col("t"), pattern).alias("p")).collect()}
        for i, t in enumerate(texts):
            if t is not None:
                assert [tuple(m) for m in got[i]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)]


def test_numbers_are_judged_by_their_window(spark):
    far = "x" * 40
    said = f"Lecture 12 says 5.5 % {far} 37 ms, 1234567 and 8 {far} in 2024 and 99 {far} 1.5.2 and 64. {far} 40％ 41"
    df = spark.createDataFrame([(1, said), (2, None), (3, "")], "id long, t string")
    rows = reports.numbers(df, "id", "t", ["ms", "km"], "Lecture|Table").collect()
    got = [(r.kind, r.number, r.judged) for r in sorted(rows, key=lambda r: (r.start, r.kind))]
    # 64. ends in a dot, so it is no integer of its own; a scaffold excuses what is near it but not a percentage.
    assert got == [("integer", "12", False), ("percent", "5.5", True), ("integer", "37", True), ("unit", "37", True), ("integer", "2024", False), ("integer", "99", True), ("integer", "41", True)]
    assert all(said[r.start : r.end].startswith(r.number) and said[max(0, r.start - 28) : r.end + 28] == r.around for r in rows)


def test_tiers(spark):
    df = spark.createDataFrame([(1, "have 12% and 34% and 56%"), (2, "have 12%")], "id long, t string")
    own, every = spark.createDataFrame([(1, "12"), (2, "34")], "id long, number string"), spark.createDataFrame([("34",), ("12",)], "number string")
    found = reports.numbers(df, "id", "t", ["ms"], "Lecture")
    assert {(r.id, r.number): r.tier for r in reports.number_tiers(found, "id", own, every).collect()} == {(1, "12"): "own", (1, "34"): "other", (1, "56"): "none", (2, "12"): "other"}
