"""Streaming ingestion of card records: an extension, the batch path needs none of it."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import clean_cards

CARD = "source string, ref string, title string, raw_description string, url string, tags array<string>, license string, language string, collected_at timestamp"


def ingest_cards(spark: SparkSession, source: str, target: str, once: bool = False, delay: str = "7 days", schema: str = CARD) -> StreamingQuery:
    """New JSON files of ``source`` -> clean records appended to ``target`` (Parquet), one a (source, ref).

    A record seen again within ``delay`` of event time (collected_at) is dropped; state older than that is
    forgotten, so it stays bounded. ``once`` takes what there is and ends. Progress is kept beside the target.
    """
    rows = spark.readStream.schema(schema).json(source).withWatermark("collected_at", delay).dropDuplicatesWithinWatermark(["source", "ref"])
    out = clean_cards(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-progress").outputMode("append")
    query = out.trigger(availableNow=True).start() if once else out.start()
    if once:
        query.awaitTermination()
    return query
