"""Exact medians of groups of any size.

No state holds a group's values: values are counted in ranges between the group's extremes, which tells
the range that holds the middle, and only the distinct values of that range are counted one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the first pass.
RANGES = 1 << 16


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, ``name``): the median of each group; null where it has no value. Of an even number the mean of the two in the middle."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    all_same = same[0]
    for s in same[1:]:
        all_same = all_same & s
    placed = rows.where("_v is not null").alias("r").join(ends.alias("e"), all_same)
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES), F.lit(RANGES - 1))).otherwise(0).cast("int")
    placed = placed.select(*(F.col(f"r.{k}").alias(k) for k in keys), "_v", "_n", at.alias("_at"))
    counted = placed.groupBy(*keys, "_n", "_at").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_upto", F.sum("_c").over(upto)).where(_middle("_upto", "_c", "_n"))
    inside = counted.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("_at").alias("range"), (F.col("_upto") - F.col("_c")).alias("_before"))
    fits = F.col("_at") == F.col("range")
    for i, k in enumerate(keys):
        fits = fits & F.col(k).eqNullSafe(F.col(f"k{i}"))
    # At most two ranges a group hold the middle.
    held = placed.join(inside, fits).groupBy(*keys, "_n", "_at", "_before", "_v").agg(F.count("*").alias("_c"))
    within = Window.partitionBy(*keys, "_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_upto", F.col("_before") + F.sum("_c").over(within)).where(_middle("_upto", "_c", "_n"))
    found = held.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(name))
    back = F.lit(True)
    for k in keys:
        back = back & F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}"))
    return ends.alias("e").join(found.alias("f"), back, "left").select(*(F.col(f"e.{k}").alias(k) for k in keys), F.col(f"f.{name}").alias(name))


def _middle(upto: str, count: str, n: str) -> Column:
    """Whether values ``upto`` - ``count`` + 1 to ``upto`` of ``n`` have one of the (one or two) in the middle."""
    low, high = F.floor((F.col(n) + 1) / 2), F.floor(F.col(n) / 2) + 1
    before = F.col(upto) - F.col(count)
    return ((before < low) & (F.col(upto) >= low)) | ((before < high) & (F.col(upto) >= high))
