"""Texts met one at a time, rows sent in bounded batches."""

import re

import pyarrow as pa
from pyspark.sql.types import StructType

from lodestone.operators import text
from lodestone.sources import batches


def test_rows_leave_in_batches_of_bounded_size(spark):
    sent = []

    class Frame:
        schema, columns = StructType.fromDDL("id long, t string"), ["id", "t"]

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pydict({"t": ["x " * 5000, None, "", "x"], "id": [7, 8, 9, 10]})
            sent.extend(run(iter([batch])))

    batches.each_text(Frame(), "t", lambda t: ((m.start(),) for m in re.finditer("x", t or "")), {"start": "int"})
    assert max(b.num_rows for b in sent) <= batches.ROWS and len(sent) > 2
    rows = [(r["id"], r["start"]) for b in sent for r in b.to_pylist()]
    assert rows == [(7, 2 * k) for k in range(5000)] + [(10, 0)]


def test_claims_of_each_text(spark):
    said = "The gain was improved by 12 % against the base design.\n"
    df = spark.createDataFrame([(1, said * 3), (2, None), (3, "none")], "id long, t string")
    got = {r.id: r.claims for r in text.claimed(df, "t").collect()}
    assert got == {1: text.claims_of(said), 2: [], 3: []}
