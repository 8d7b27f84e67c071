"""Target-distribution importance resampling over hashed word n-grams, by word tries.

Features are all runs of one to three consecutive words, in ``buckets`` buckets by CRC-32. The log
ratio of a bucket's share in the target to its share in the corpus is its gain, the sum of a
document's gains its weight, and documents are drawn without replacement by adding Gumbel noise to
the weight and keeping the highest scores.

Each task takes its texts in blocks. The n-grams of a block are a trie whose nodes hold how often they
occur and the CRC state of their words; a child's state follows from its parent's, so no n-gram is
spelled out. Counting adds the nodes' counts to the task's bucket totals, and only totals leave the
task. Scoring gives every node the gain of its bucket and walks each document's positions down three
levels. ``buckets`` gains are all that passes through the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import tries
from .numbering import numbered
from .scratch import stored

BUCKETS, RUN = 10_000, 3
#: Letters and digits of ASCII and all bytes of other characters belong to words.
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: Bytes of text whose trie is built at once.
_BLOCK = 1 << 22


def trie(data: np.ndarray, offsets: np.ndarray, advance: tries.Advance) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Words of each document, and for each level: the node of each run, the CRC state of each node, runs of each document."""
    data = K.LOWER[data]
    is_word = _WORD[data]
    starts, ends, counts = K.spans(is_word, offsets)
    word, distinct = tries.numbered_words(data, is_word, starts, ends)
    added = np.array([zlib.crc32(b" " + w) for w in distinct], np.uint32)
    length = np.array([len(w) + 1 for w in distinct], np.int64)
    levels = [(word, np.array([zlib.crc32(w) for w in distinct], np.uint32), counts)]
    at = word  # the node that starts at each word; garbage where a run does not fit
    for k in range(2, RUN + 1):
        first, _ = K.runs(counts, k)
        node, parent, last = tries.nodes(at[first], word[first + k - 1], max(1, len(distinct)))
        levels.append((node, advance(levels[-1][1][parent], length[last]) ^ added[last], np.maximum(counts - k + 1, 0)))
        at = np.zeros(len(word), np.int64)
        at[first] = node
    return counts, levels


def _count_batches(buckets: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, advance = np.zeros(buckets, np.int64), tries.Advance()
        for _, data, offsets in K.blocks(batches, "t", _BLOCK, 1 << 16):
            for node, state, _ in trie(data, offsets, advance)[1]:
                np.add.at(total, state % buckets, np.bincount(node, minlength=len(state)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    return run


def bucket_totals(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n), at most ``buckets`` rows: how many features of all texts are in each bucket that has any."""
    rows = docs.select(F.col(text_col).alias("t")).where("t is not null")
    return rows.mapInArrow(_count_batches(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket: s and t its features in the corpus and the target, S and T all of theirs."""
    both = bucket_totals(docs, text_col, buckets).withColumn("of", F.lit(0)).unionAll(bucket_totals(target, target_text_col, buckets).withColumn("of", F.lit(1)))
    n = np.zeros((2, buckets))
    for r in both.collect():  # 2 x buckets rows at most
        n[r["of"], r["bucket"]] = r["n"]
    s, t = n.tolist()
    big_s, big_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((y + 1) * big_s / ((x + 1) * big_t))) for x, y in zip(s, t)], np.int64)


def _weigh_batches(shared):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, advance = shared.value, tries.Advance()
        for block, data, offsets in K.blocks(batches, "t", _BLOCK, 1 << 16):
            words, levels = trie(data, offsets, advance)
            weight, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for node, state, counts in levels:
                so_far = np.concatenate([[0], np.cumsum(gain[state % len(gain)][node])])
                ends = np.cumsum(counts)
                weight += so_far[ends] - so_far[ends - counts]
                n += counts
            own = [c for c in block.schema.names if c != "t"]
            yield pa.RecordBatch.from_arrays([*map(block.column, own), pa.array(words), pa.array(n), pa.array(weight)], [*own, "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x, n_words, n_features, weight) of every row, x the hash of its text; null texts have no words."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("x"), t.alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    return rows.mapInArrow(_weigh_batches(shared), f"doc_id {dict(rows.dtypes)['doc_id']}, x long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of ``seed:id`` (a null id is the empty string)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """The rows of :func:`weights` with score and rank: of the N rows with ``least_words`` words or more, the floor(percent N / 100) of highest score are drawn.

    Ties go to the smaller id (null last); rows that repeat an id and its text are drawn each, in any order. Ranks count from 1, rows that are not drawn have none.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "importance")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    order = [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("x"), F.col("row")]
    placed = numbered(scored, order, "place")
    return placed.withColumn("rank", F.when(enough & (F.col("place") <= drawn), F.col("place"))).drop("place", "row")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they are; see :func:`draw`."""
    gain = gains(docs, target, text_col, target_text_col, buckets)
    won = draw(weights(docs, gain, id_col, text_col), percent, least_words, seed).where(F.col("rank").isNotNull())
    won = won.groupBy(F.col("doc_id").alias("di"), F.col("x").alias("dx")).agg(F.count("*").alias("copies"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = rows.join(won, F.col(i).eqNullSafe(F.col("di")) & (F.xxhash64(F.coalesce(F.col(t), F.lit(""))) == F.col("dx")))
    # Of rows that repeat id and text as many stay as were drawn.
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("di", "dx").orderBy(F.lit(0)))).where(F.col("copy") <= F.col("copies"))
    return rows.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Query: 5 % of the documents, drawn towards the benchmark's texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return draw(weights(docs, gains(docs, target))).select("doc_id", "n_features", "weight", "score", "rank")
