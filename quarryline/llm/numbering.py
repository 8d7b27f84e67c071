"""Numbers for the rows of a table in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a column ``name``: 1, 2, 3, ... in the given order. Order by a key that splits equal rows, or they share a partition.

    Rows are range-partitioned and sorted where they are; a partition's first number is the size of
    those before it, and there are as many sizes as shuffle partitions.
    """
    part, of, shift = f"{name}_part", f"{name}_of", f"{name}_shift"
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn(part, F.shiftrightunsigned(name, _ROW_BITS)).withColumn(name, F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    sizes = placed.groupBy(F.col(part).alias(of)).agg(F.count("*").alias("n"))
    before = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift))
    out = placed.join(F.broadcast(sizes), F.col(part) == F.col(of))
    return out.select(*(c for c in df.columns), (F.col(name) + F.col(shift) + 1).alias(name))
