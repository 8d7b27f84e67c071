"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored


#: Links that a file of a round has at least, beyond ``_FILES`` files: rounds are many, and most links are gone after the first.
_FILE_LINKS, _FILES = 50_000, 8


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links a > b. Only minima are gathered per node, so a hub with millions of links is no problem: its minimum is summed up map-side and the join back may be split by Spark."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, both["a"] == least["u"])
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Self links are ignored; an empty link table gives an empty result. Each round is written to the
    shared folder; the loop ends when a round changes nothing, after about log of the longest path.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        files = max(_FILES, now[0] // _FILE_LINKS)
        before, edges = edges, stored(_star(_star(edges, True), False).coalesce(files), "links")
        drop(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
