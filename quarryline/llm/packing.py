"""Packing into length buckets whose boundaries minimise padding.

The global histogram of lengths (at most ``max_length`` + 1 rows) goes to the driver; dynamic
programming chooses the boundaries. Inside a bucket, pieces are numbered and cut into batches whose
padded size stays within a token budget. Numbering needs no task to see a whole bucket: each bucket
is dealt to shards by hash, shards are numbered on their own and shifted by the sums of those before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import stored
from .tokens import token_counts


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """At most ``buckets`` of the distinct ``lengths`` (ascending) as upper bounds, the largest among them, such that the total padding is least."""
    m = len(lengths)
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    cost = np.full(m + 1, np.inf)  # of the first j lengths with the buckets used so far
    cost[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        new, choice = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0
        for j in range(1, m + 1):
            pad = cost[:j] + lengths[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            choice[j] = pad.argmin()
            new[j] = pad[choice[j]]
        back.append(choice)
        cost = new
    out, j = [], m
    for choice in reversed(back):
        if not j:
            break
        out.append(lengths[j - 1])
        j = choice[j]
    return np.array(out[::-1], np.int64)


@K.released
def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, data, offsets in K.blocks(batches, "t"):
        _, _, counts = K.spans(K.SPACE[data], offsets)
        yield pa.RecordBatch.from_arrays([block.column("i"), pa.array(counts.astype(np.int64))], ["doc_id", "n"])


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n) of every row: white-space separated words of the whole text, 0 for null."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_word_batches, f"doc_id {dict(rows.dtypes)['i']}, n long")


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n) of every row: tokens of the whole text with the 50k byte-level vocabulary, 0 for null."""
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), id_col, text_col).select("doc_id", F.col("n_tokens").alias("n"))


def pack(lengths: DataFrame, max_length: int = 2048, buckets: int = 16, budget: int = 32768, shard_rows: int = 200_000) -> DataFrame:
    """(doc_id, piece, start, length, bucket, padded_length, batch, slot) for (doc_id, n).

    A document longer than ``max_length`` is cut into pieces of it and a rest; one of length 0 is a
    piece of length 0, a null length counts as 0. ``batch`` is unique within a bucket and holds
    max(1, budget // padded_length) pieces, the last of a bucket fewer. Repeated ids are packed each, equal rows in any order.
    An empty table gives an empty result.
    """
    spark = lengths.sparkSession
    n = F.coalesce(F.greatest("n", F.lit(0)), F.lit(0)).cast("long")
    # Rows have a number of their own, as ids may be null or repeated; written, so that it stays the same.
    lengths = stored(lengths.select("doc_id", n.alias("n"), F.monotonically_increasing_id().alias("row")), "packing-lengths")
    pieces = lengths.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_length)))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * max_length).alias("start"), F.least(F.lit(max_length), F.col("n") - F.col("piece") * max_length).cast("long").alias("length"))
    histogram = sorted((r["length"], r["c"]) for r in pieces.groupBy("length").agg(F.count("*").alias("c")).collect())
    of, total = [], sum(c for _, c in histogram)
    if histogram:
        values, counts = (np.array(x, np.int64) for x in zip(*histogram))
        bounds = boundaries(values, counts, buckets)
        of = [(int(v), int(b), int(bounds[b])) for v, b in zip(values, np.searchsorted(bounds, values))]
    table = spark.createDataFrame(of, "len long, bucket long, padded_length long")  # max_length + 1 rows at most
    placed = pieces.join(F.broadcast(table), pieces["length"] == table["len"]).drop("len")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(max(1, -(-total // shard_rows)))))
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("bucket").alias("b"), F.col("shard").alias("s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "row"))
    placed = placed.withColumn("k", number)
    placed = placed.join(sizes, (placed["bucket"] == sizes["b"]) & (placed["shard"] == sizes["s"]))
    k, rows = F.col("shift") + F.col("k") - 1, F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), "padded_length")))
    return placed.select("doc_id", "piece", "start", "length", "bucket", "padded_length", F.floor(k / rows).alias("batch"), (k % rows).alias("slot"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all documents, lengths in tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_lengths(docs))
