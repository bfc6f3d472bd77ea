"""Windows over a whole table in the order of an integer column, without gathering the table in one task.

The column is cut into buckets of 2^bits values. Each bucket is a window partition of its own; what crosses bucket borders
comes from a table with one row for each bucket (a 200-million-block volume of 2^16-block buckets has about 3,000).
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

BITS = 16
_bucket, _at, _value = "__cairn_bucket", "__cairn_border", "__cairn_value"


def _buckets(df: DataFrame, index: str, bits: int) -> DataFrame:
    return df.withColumn(_bucket, F.shiftright(F.col(index).cast("long"), bits))


def _bordered(df: DataFrame, borders: DataFrame) -> DataFrame:
    return df.join(borders, _bucket, "left")


def previous(df: DataFrame, index: str, value: str, out: str, then: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """df with `out`: value of the row before in the order of index and `then`, null in the first row."""
    order = [index, *then]
    rows = _buckets(df, index, bits)
    last = rows.groupBy(_bucket).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    borders = last.select(_bucket, F.lag("_last").over(Window.orderBy(_bucket)).alias(_at))
    within = Window.partitionBy(_bucket).orderBy(*order)
    first = F.row_number().over(within) == 1
    got = _bordered(rows, borders).withColumn(out, F.when(first, F.col(_at)).otherwise(F.lag(value).over(within)))
    return got.drop(_bucket, _at)


def following(df: DataFrame, index: str, value: str, out: str, then: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """df with `out`: value of the row after in the order of index and `then`, null in the last row."""
    order = [index, *then]
    rows = _buckets(df, index, bits)
    first = rows.groupBy(_bucket).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    borders = first.select(_bucket, F.lead("_first").over(Window.orderBy(_bucket)).alias(_at))
    backward = Window.partitionBy(_bucket).orderBy(*(F.desc(c) for c in order))
    forward = Window.partitionBy(_bucket).orderBy(*order)
    last = F.row_number().over(backward) == 1
    got = _bordered(rows, borders).withColumn(out, F.when(last, F.col(_at)).otherwise(F.lead(value).over(forward)))
    return got.drop(_bucket, _at)


def ordinal(df: DataFrame, index: str, out: str = "ordinal", then: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """df with `out`: the row's place from 0."""
    rows = _buckets(df, index, bits)
    before = Window.orderBy(_bucket).rowsBetween(Window.unboundedPreceding, -1)
    borders = rows.groupBy(_bucket).count().select(_bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(_at))
    within = Window.partitionBy(_bucket).orderBy(index, *then)
    return _bordered(rows, borders).withColumn(out, F.col(_at) + F.row_number().over(within) - 1).drop(_bucket, _at)


def sum_before(df: DataFrame, index: str, value: Column, out: str, then: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """df with `out`: the sum of value over all rows before."""
    rows = _buckets(df, index, bits).withColumn(_value, value)
    before = Window.orderBy(_bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(_bucket).agg(F.sum(_value).alias("_sum"))
    borders = sums.select(_bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(_at))
    within = Window.partitionBy(_bucket).orderBy(index, *then).rowsBetween(Window.unboundedPreceding, -1)
    got = _bordered(rows, borders).withColumn(out, F.col(_at) + F.coalesce(F.sum(_value).over(within), F.lit(0)))
    return got.drop(_bucket, _at, _value)
