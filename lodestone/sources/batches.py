"""Arrow batches in slices, so that what Python holds at once is bounded however long texts are."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows, and bytes of text (or one row), that a slice has at most.
ROWS, BYTES = 2048, 4 << 20
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def sliced(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices; text: the number of the column of texts."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            taken = upto[at - 1] if at else 0
            end = min(at + ROWS, max(at + 1, int(np.searchsorted(upto, taken + BYTES, "right"))))
            yield batch.slice(at, end - at)
            at = end


def each_text(df: DataFrame, text: str, of: Callable[[str | None], Iterable[tuple]], fields: dict[str, str]) -> DataFrame:
    """df's columns but the text beside each of the tuples (of fields: name and type) that of(text) gives.

    Texts become Python's one at a time, and rows leave in batches of at most ROWS, however many a text gives.
    """
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructType.fromDDL(f"`{n}` {k}")[0] for n, k in fields.items())])

    def batch(b: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        at, columns = pa.array(rows, pa.int64()), zip(*found)
        return pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(1, b.num_columns)), *(pa.array(c, _KINDS[k]) for c, k in zip(columns, fields.values(), strict=True))], names=[*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 0):
            rows, found = [], []
            for k, t in enumerate(b.column(0)):
                for x in of(t.as_py()):
                    rows.append(k)
                    found.append(x)
                    if len(rows) == ROWS:
                        yield batch(b, rows, found)
                        rows, found = [], []
            if rows:
                yield batch(b, rows, found)

    return df.select(text, *kept).mapInArrow(run, schema)
