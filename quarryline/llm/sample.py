"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A first cut by hash takes this many times the rows asked for, so that few rows are sorted.
SLACK = 1.5


def bounded_sample(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of the columns ``by`` (the same rows on every run).

    Small tables are taken whole. Of large ones a hash filter first leaves about SLACK * rows, so
    that no task sorts or sends much more than the sample.
    """
    n = df.count()
    key = F.xxhash64(*by)
    if n > rows * SLACK:
        df = df.where(key < int(-(2**63) + 2**64 * min(1.0, rows * SLACK / n)))
    return df.orderBy(key, *by).limit(rows)
