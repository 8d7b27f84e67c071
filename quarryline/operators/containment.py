"""Containment join: which texts hold which phrases, as joins on a rare piece of each phrase.

A phrase that lies in a text has all its words but the first and the last as whole words of the text, one
after the other (words are what single spaces part). So every run of ``RUN`` inner words is a key that the
text must have too, and the phrase is joined by the key that the fewest texts have. Phrases of one or two inner
words are keyed by those. A phrase of two words lies around a space of the text, and is keyed by the last
characters before and the first after it, ``GAP`` at most; phrases of one word by their runs of characters. Candidates
are verified on the whole texts. Nothing is held by the driver or by a task but rows, and a bounded set of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inner words of a key; characters of the keys of phrases without inner words.
RUN, CHARACTERS = 3, 3
#: Characters on either side of the space in the key of a phrase of two words.
GAP = 5
#: Keys of phrases that are broadcast, so that only keys that some phrase has leave a text's task; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _runs(words: Column, n: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` of the first ``n`` elements."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.lit(size), F.slice(words, i, size)))).otherwise(F.array().cast("array<long>"))


def _pieces(text: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` characters."""
    n = F.length(text)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.lit(-size), F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<long>"))


def _gap_kind(a: Column | int, b: Column | int) -> Column | int:
    """The kind of keys with ``a`` characters before the space and ``b`` after it."""
    return 100 + 10 * a + b


def _gaps(words: Column, n: Column, kinds: list[int]) -> Column:
    """Keys of the gaps between the first ``n`` words, of some kinds."""

    def at(i: Column) -> Column:
        u, v = F.element_at(words, i), F.element_at(words, i + 1)
        each = ((kind, kind // 10 % 10, kind % 10) for kind in kinds)
        return F.array(*(F.when((F.length(u) >= a) & (F.length(v) >= b), F.xxhash64(F.lit(kind), F.substring(u, -a, a), F.substring(v, 1, b))) for kind, a, b in each))

    return F.when(n >= 2, F.array_compact(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: at(i.cast("int")))))).otherwise(F.array().cast("array<long>"))


def _phrase_keys(phrases: DataFrame) -> DataFrame:
    """(phrase_id, p, kind, key): every key of a phrase; kind is the size of its runs, negative for characters, :func:`_gap_kind` for a gap."""
    words = F.split("p", " ")
    left, right = F.least(F.length(words[0]), F.lit(GAP)), F.least(F.length(F.try_element_at(words, F.lit(2))), F.lit(GAP))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    df = phrases.withColumn("inner", F.when(F.size(words) > 2, inner).otherwise(F.array().cast("array<string>"))).withColumn("m", F.size("inner"))
    kind = F.when(F.col("m") > 0, F.least("m", F.lit(RUN))).when((F.size(words) == 2) & (left > 0) & (right > 0), _gap_kind(left, right)).otherwise(-F.least(F.length("p"), F.lit(CHARACTERS)))
    df = df.withColumn("kind", kind)
    gap = F.array(F.xxhash64(F.col("kind"), F.expr("right(split(p, ' ')[0], kind div 10 % 10)"), F.expr("left(try_element_at(split(p, ' '), 2), kind % 10)")))
    keys = F.coalesce(F.when(F.col("kind") > 100, gap), *(F.when(F.col("kind") == n, _runs(F.col("inner"), F.col("m"), n)) for n in range(1, RUN + 1)), *(F.when(F.col("kind") == -n, _pieces(F.col("p"), n)) for n in range(1, CHARACTERS + 1)))
    return df.select("phrase_id", "p", "kind", F.explode(F.array_distinct(keys)).alias("key"))


def contains_join(docs: DataFrame, phrases: DataFrame, doc_id: str = "doc_id", text: str = "text", phrase_id: str = "item_id", phrase: str = "text") -> DataFrame:
    """(doc_id, phrase_id) of every document and phrase it contains. Null and empty phrases are in no document; repeated rows count each."""
    asked = phrases.select(F.col(phrase_id).cast("long").alias("phrase_id"), F.col(phrase).alias("p")).where("length(p) > 0")
    keys = _phrase_keys(asked)
    counts = {r["kind"]: r["count"] for r in keys.groupBy("kind").count().collect()}  # RUN + CHARACTERS + GAP * GAP at most
    kinds, gaps = sorted(n for n in counts if n < 100), sorted(n for n in counts if n > 100)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("t is not null")
    held = rows.select("doc_id", F.xxhash64("t").alias("x"), "t", F.split("t", " ").alias("ws")).withColumn("nw", F.size("ws"))
    own = F.concat(F.array().cast("array<long>"), *(_runs(F.col("ws"), F.col("nw"), n) if n > 0 else _pieces(F.col("t"), -n) for n in kinds), *([_gaps(F.col("ws"), F.col("nw"), gaps)] if gaps else []))
    # Of a text's keys only those that some phrase has go on.
    spread = held.select("doc_id", "x", F.explode_outer(F.array_distinct(own)).alias("key")).where("key is not null")
    wanted = keys.select("key").distinct()
    spread = spread.join(F.broadcast(wanted) if sum(counts.values()) <= BROADCAST_KEYS else wanted, "key", "left_semi").distinct()
    frequency = spread.groupBy("key").agg(F.count("*").alias("df"))
    rarest = keys.join(frequency, "key", "left").groupBy("phrase_id", "p").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("best")).where("best.df > 0")
    candidates = spread.join(rarest.select("phrase_id", "p", F.col("best.key").alias("key")), "key").select(F.col("doc_id").alias("d"), F.col("x").alias("dx"), "phrase_id", "p")
    found = rows.join(candidates, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("t") == F.col("dx"))).where(F.contains("t", F.col("p")))
    return found.select("doc_id", "phrase_id")
