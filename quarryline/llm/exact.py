"""Exact duplicates with a heavy-hitter split, in DataFrame and SQL functions only.

Texts are equal when they are identical without white space. Only their SHA-256, length and id take
part; no text is shuffled. Three steps:

1. Frequent digests. A Misra-Gries summary of all rows (Spark's ``approx_top_k``, the counters of which
   are purged by their median) is filled in every task, merged in groups of tasks and then once more.
   With ``tracked`` counters no share over 7 / 2**ceil(log2(tracked / 0.75)) of the rows escapes it:
   0.05 % for 10,000. Its items are candidates; there are ``tracked`` at most, whatever the input.
2. Heavy groups. Candidates are broadcast, and one map-side aggregate verifies them: by the whole
   digest, with exact counts, it finds the row of each that stays. Those winners are broadcast in turn
   (``tracked`` rows at most, but for digests that share 64 bits), and every row of a heavy group learns in its own task what becomes of it.
3. The others, each group of which is a small share of the rows, are dealt out by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: What does not count when texts are compared, as a class of Java's and RE2's regular expressions.
SPACES = "[\\x20\\x09-\\x0D]"
#: Groups of tasks whose summaries are merged before all are.
_MERGES = 64


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def frequent(digests: DataFrame, column: str, tracked: int = 10_000) -> DataFrame:
    """(item), ``tracked`` rows at most: values of a long column among which all frequent ones are, by a Misra-Gries summary. Null is no item."""
    of_task = digests.select(column, F.pmod(F.spark_partition_id(), F.lit(_MERGES)).alias("task"))
    some = of_task.groupBy("task").agg(F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("summary"))
    # By a key, as a partition without a summary cannot be merged, and no rows give no item.
    all_ = some.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    return all_.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {tracked})")).alias("found")).select("found.item")


def _stays(first: Column) -> Column:
    """Of rows with a text in common, that with the most characters in its original, then the smallest id (null last), then the smallest hash of the original, then the first written."""
    return F.min(first)


def _order() -> Column:
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "x", "row")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 10_000) -> DataFrame:
    """One row per input row: doc_id, x (hash of its text as it is), keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts and those of white space alone are one group. Of equal
    texts the longest in characters stays, then that of the smallest id (a null id is the largest);
    rows that repeat id and text as well stay once. ``keep_id`` is null if the row that stays has a null
    id. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n"), F.xxhash64(text).alias("x"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    # Written once, so that a row has one number however often it is read.
    told = stored(told.withColumn("digest", F.xxhash64("sha")), "digests")
    candidates = frequent(told, "digest", tracked).withColumnRenamed("item", "candidate")
    heavy = told.join(F.broadcast(candidates), F.col("digest") == F.col("candidate")).groupBy(F.col("sha").alias("hot")).agg(_stays(_order()).alias("first"), F.count("*").alias("size"))
    heavy = stored(heavy, "heavy-digests")
    split = told.join(F.broadcast(heavy), F.col("sha") == F.col("hot"), "left")
    own = ["doc_id", "x", "sha", "row"]
    here = split.where(F.col("hot").isNotNull()).select(*own, "first", F.col("size").alias("group_size"))
    group = Window.partitionBy("sha")
    rest = split.where(F.col("hot").isNull()).select(*own, "n").select(*own, _stays(_order()).over(group).alias("first"), F.count("*").over(group).alias("group_size"))
    return here.unionAll(rest).select("doc_id", "x", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are, one of each group of equal texts."""
    gone = decisions(docs, id_col, text_col, tracked).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("x").alias("keep_x"), "text_sha256")
    text = F.col(f"d.`{text_col}`")
    rows = docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.keep_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("g.keep_x")))
    # Only rows that repeat id and text are still several.
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = rows.select(*(F.col(f"d.`{c}`").alias(n) for c, n in zip(docs.columns, names)), F.col("g.text_sha256").alias("of")).dropDuplicates(["of"])
    return rows.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: all documents, texts compared without white space."""
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH told AS (
  SELECT doc_id, coalesce(text, '') AS original, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
placed AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM told WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, original))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM placed
"""
