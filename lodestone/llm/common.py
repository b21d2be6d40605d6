"""What the training-data operators share: reading, staging and batch helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources import table
from lodestone.sources.staging import scratch, shared_dir, staged, tidy, unstage

__all__ = ["crc_mod", "scratch", "shared_dir", "slices", "staged", "table", "tidy", "unstage", "whole"]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, text: str | None = None, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and, of a text column, so many bytes (or one row), so that little is held at once."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        if text is not None:
            ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, taken = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, taken + size, "right"))))
            yield batch.slice(at, end - at)
            at, taken = end, int(ends[end - 1])


def whole(df: DataFrame) -> Column:
    """A row's columns as one struct whole_, so that columns added meanwhile clash with none of them."""
    return F.struct(*[df[c] for c in df.columns]).alias("whole_")
