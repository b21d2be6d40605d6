"""Scans over rows in one order, of any number: ranges side by side, and what one range tells the next.

Rows are dealt out by ranges of their order, sorted there, and written with their range and place. A window then never
reaches beyond its range; what it needs from the ranges before and after is one summary row for each range, brought
together at the driver (as many rows as there are ranges, by construction) and joined back.

keys: rows of different keys don't see each other; a key may fill many ranges, and a range hold many keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.staging import staged


def ordered(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df written in order, with range_ and place_, by which all of it is ordered."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    return staged(out.withColumn("range_", F.shiftright(row, 33)).withColumn("place_", row.bitwiseAND(F.lit((1 << 33) - 1))), "ordered")


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with the number of each row in order, from 0."""
    rows = ordered(df, order)
    sizes, before, starts = sorted((r.range_, r.n) for r in rows.groupBy("range_").agg(F.count("*").alias("n")).collect()), 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "range_ long, before_ long")
    return rows.join(F.broadcast(starts), "range_").withColumn(name, F.col("before_") + F.col("place_")).drop("range_", "place_", "before_")


def _same(keys: list[str], row: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{row}.{k}")) for k in keys], F.col(row).isNotNull())


def _joined(rows: DataFrame, told: list[tuple], fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([T.StructField("range_", T.LongType()), *fields])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(told, schema)), "range_")


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """WIN7, WIN10, WIN11: df with structs before_ and after_: columns of the row before and after of the same keys, null where there is none."""
    rows = ordered(df, [*keys, *order])
    here = F.struct(*dict.fromkeys([*keys, *columns]))
    kind = rows.select(here.alias("x")).schema["x"].dataType
    ends = sorted(rows.groupBy("range_").agg(F.min_by(here, "place_").alias("first"), F.max_by(here, "place_").alias("last")).collect(), key=lambda r: r.range_)
    told = [(r.range_, ends[k - 1].last if k else None, ends[k + 1].first if k + 1 < len(ends) else None) for k, r in enumerate(ends)]
    w = Window.partitionBy("range_").orderBy("place_")
    both = _joined(rows, told, [T.StructField("low_", kind), T.StructField("high_", kind)])
    both = both.withColumn("low_", F.coalesce(F.lag(here).over(w), "low_")).withColumn("high_", F.coalesce(F.lead(here).over(w), "high_"))
    return both.withColumn("before_", F.when(_same(keys, "low_"), F.col("low_"))).withColumn("after_", F.when(_same(keys, "high_"), F.col("high_"))).drop("low_", "high_", "range_", "place_")


def least_before(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """WIN7, NUM6: df with the least value of a column among the rows before of the same keys, null where there is none."""
    rows = ordered(df, [*keys, *order])
    key, value = F.struct(F.lit(0).alias("0_"), *keys), rows.schema[column]
    # Of each range its first key, and its last one with the least value of its rows.
    own = rows.groupBy("range_", *keys).agg(F.min("place_").alias("from_"), F.max("place_").alias("to_"), F.min(column).alias("least_"))
    tail = own.groupBy("range_").agg(F.min_by(key, "from_").alias("first"), F.max_by(key, "to_").alias("last"), F.max_by("least_", "to_").alias("least"))
    told, least, of = [], None, None
    for r in sorted(tail.collect(), key=lambda r: r.range_):
        told.append((r.range_, r.first, least if r.first == of else None))
        # A range of one key goes on with what it was told, any other begins anew.
        carried = least if r.first == r.last == of else None
        least, of = min((v for v in (carried, r.least) if v is not None), default=None), r.last
    kind = rows.select(key.alias("x")).schema["x"].dataType
    w = Window.partitionBy("range_", *keys).orderBy("place_").rowsBetween(Window.unboundedPreceding, -1)
    both = _joined(rows, told, [T.StructField("first_", kind), T.StructField("carried_", value.dataType)])
    carried = F.when(key.eqNullSafe(F.col("first_")), F.col("carried_"))
    return both.withColumn(name, F.least(F.min(column).over(w), carried)).drop("first_", "carried_", "range_", "place_")
