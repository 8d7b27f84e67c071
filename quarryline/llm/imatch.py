"""I-Match document fingerprints with randomised lexicons, in DataFrame functions only.

A document keeps its distinct terms whose document frequency lies in a band (an inverse document
frequency neither low nor high), sorts them and hashes them: once over the whole band, and once over
each of several random sub-lexicons. Sub-lexicons of several densities make likeness gradual for
short and long documents: it is the share of hashes that agree, of those with a term on either side.

The lexicon's size has a bound: frequencies of all terms add up to the documents' distinct terms, so at
most (mean distinct terms) / (lowest share) terms are in the band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Random sub-lexicons: (how many, each term is in with probability 2**-bits). One more has the whole band.
DENSITIES = ((8, 2), (8, 4), (16, 6), (28, 8))
HASHES = 1 + sum(n for n, _ in DENSITIES)
#: XXH64 with Spark's seed of an array without elements.
EMPTY = 42
#: The lexicon is broadcast up to this many rows (24 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 2_000_000
#: Kinds of terms in one list, in the two lowest bits: a document's own, its edited text's, the next document's.
OWN, EDITED, NEXT = 0, 1, 2


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text (runs of letters and digits, lower case); the two lowest bits are free."""
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.shiftleft(F.shiftrightunsigned(F.xxhash64(w), 2), 2)))


def membership(term: Column) -> Column:
    """Bits of the sub-lexicons that have a term; bit 0 is the whole band."""
    bits, k = F.lit(1).cast("long"), 1
    for n, width in DENSITIES:
        for _ in range(n):
            bits = bits + F.when(F.xxhash64(term, F.lit(k)).bitwiseAND(F.lit((1 << width) - 1)) == 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
            k += 1
    return bits


def lexicon(rows: DataFrame, low: float, high: float) -> DataFrame:
    """(term, member) for all terms in at least ``low`` and at most ``high`` of the documents (at least 2 documents; ``high`` counts from 20 documents on), and the mark 0, which every document has."""
    n = rows.count()
    # The outer form: from the inner one Spark infers a filter on the array and takes every text apart twice.
    df = rows.select(F.explode_outer(terms(F.col("t"))).alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(20, high * n)) & (F.col("term") != 0))
    mark = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("term"), F.lit(0).cast("long").alias("member"))
    return stored(band.select("term", membership(F.col("term")).alias("member")).unionAll(mark), "lexicon")


def of_kind(list_: Column, kind: int) -> Column:
    """The sorted terms of one kind, without the mark."""
    return F.sort_array(F.filter(list_, lambda x: (x["term"].bitwiseAND(F.lit(3)) == kind) & (x["member"] > 0)))


def _groups() -> list[tuple[int, list[int]]]:
    """Sub-lexicons of one density: the mask of their bits, and the bits."""
    out, k = [], 1
    for n, _ in DENSITIES:
        bits = list(range(k, k + n))
        out.append((sum(1 << b for b in bits), bits))
        k += n
    return out


def by_density(own: str) -> list[Column]:
    """The terms that are in any sub-lexicon of each density, as columns: few for the sparse ones, which are the most."""
    within = lambda mask: F.filter(own, lambda x: x["member"].bitwiseAND(F.lit(mask)) != 0)
    return [within(mask).alias(f"{own}{g}") for g, (mask, _) in enumerate(_groups())]


def hashes(own: str, rest: Column) -> Column:
    """The hashes of a column of sorted terms and its :func:`by_density`, one for each sub-lexicon. ``rest`` stands in for the first where no term is in the band."""
    plain = lambda c: F.xxhash64(F.transform(c, lambda x: F.shiftrightunsigned(x["term"], 2)))
    of = lambda c, k: plain(F.filter(c, lambda x: x["member"].bitwiseAND(F.lit(1 << k)) != 0))
    return F.array(F.when(F.size(own) == 0, rest).otherwise(plain(own)), *(of(f"{own}{g}", k) for g, (_, bits) in enumerate(_groups()) for k in bits))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that are not empty on both sides."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(None)).otherwise((x == y).cast("int")))
    known = F.filter(both, lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)


def text_of(h: Column) -> Column:
    """Eight hexadecimal digits of each hash."""
    return F.array_join(F.transform(h, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most ``key``, by binary search."""
    if not splits:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(splits).bit_length()))]
    table = F.array(*map(F.lit, splits)).cast("array<long>")
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= key, at + s).otherwise(at))


def with_next(rows: DataFrame, bucket_rows: int = 1000) -> DataFrame:
    """(b, s, h, i, t, next, last, head) for (i, t): every row with the text of the next in descending order of i (then ascending hash of the text, null ids last; after the last row: the first).

    Rows are dealt by quantiles of i, so no task sees more than a bucket; only the first text of each
    bucket is handed to the bucket before. ``last``: the next text came that way.
    """
    rows = rows.select("i", "t", F.coalesce("i", F.lit(-(2**63))).alias("s"), F.xxhash64("t").alias("h"))
    n = rows.count()
    parts = min(10_000, -(-n // bucket_rows))
    splits = []
    if parts > 1:
        asked = F.percentile_approx("s", F.array(*(F.lit(k / parts) for k in range(1, parts))), 10 * parts)
        splits = sorted(set(rows.agg(asked.alias("q")).first()["q"]))
    rows = rows.withColumn("b", _bucket(F.col("s"), splits))
    own = Window.partitionBy("b").orderBy(F.col("s").desc(), "h")
    rows_ = rows.withColumn("next", F.lead("t").over(own))
    top = rows.groupBy(F.col("b").alias("tb")).agg(F.max("s").alias("top"))
    seen = Window.orderBy(F.col("tb").desc())
    # As many rows as buckets: which bucket comes before each, the last before the first.
    tops = top.select("tb", "top", F.coalesce(F.lag("tb").over(seen), F.min("tb").over(Window.partitionBy())).alias("before"))
    heads = rows.join(F.broadcast(tops), (F.col("b") == F.col("tb")) & (F.col("s") == F.col("top"))).groupBy("before").agg(F.min(F.struct("h", "t"))["t"].alias("head"))
    joined = rows_.join(heads, rows_["b"] == heads["before"], "left")
    return joined.select("b", "s", "h", "i", "t", F.coalesce("next", "head", F.lit("")).alias("next"), F.col("next").isNull().alias("last"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.001, high: float = 0.1) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. The edited text has the last half of its code points replaced by the
    first of the next document, see :func:`with_next`. A text without terms in the band is told by
    all its terms, one without terms by its text. A single document is its own next. Repeated rows
    stay; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = lexicon(rows, low, high)
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    base = with_next(rows).select("b", "s", "h", "i", n.cast("long").alias("n"), "t", edited.alias("e"), "next", "last")
    lists = base.select("b", "s", "h", "i", "n", "last", F.sha2(F.col("e").cast("binary"), 256).alias("sha"), "t", "e", F.when(F.col("last"), F.col("next")).alias("x"), terms(F.col("t")).alias("ta"), terms(F.col("e")).alias("te"), terms(F.coalesce(F.when(F.col("last"), F.col("next")), F.lit(""))).alias("tx"))
    rest = lambda own, text: F.when(F.size(own) > 0, F.xxhash64(F.sort_array(own))).otherwise(F.xxhash64(F.coalesce(text, F.lit(""))))
    tagged = lambda own, kind: F.transform(own, lambda x: x + kind)
    lists = lists.select("b", "s", "h", F.struct("i", "n", "sha", "last", rest(F.col("ta"), F.col("t")).alias("ra"), rest(F.col("te"), F.col("e")).alias("re"), rest(F.col("tx"), F.col("x")).alias("rx")).alias("about"), F.concat(F.array(F.lit(0).cast("long")), tagged(F.col("ta"), OWN), tagged(F.col("te"), EDITED), tagged(F.col("tx"), NEXT)).alias("terms"))
    # Rows that repeat a document and its text are told apart before their terms are gathered.
    lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.col("s").desc(), "h")))
    each = lists.select("b", "s", "h", "r", "about", F.explode("terms").alias("term"))
    table = words.select(F.col("term").alias("word"), "member")
    table = F.broadcast(table) if words.count() <= BROADCAST_ROWS else table
    found = each.join(table, F.shiftleft(F.shiftrightunsigned(F.col("term"), 2), 2) == F.col("word"))
    lists = found.groupBy("b", "s", "h", "r").agg(F.first("about").alias("about"), F.collect_list(F.struct("term", "member")).alias("list"))
    lists = lists.select("b", "r", "about.*", of_kind(F.col("list"), OWN).alias("ta"), of_kind(F.col("list"), EDITED).alias("te"), of_kind(F.col("list"), NEXT).alias("tx"))
    lists = lists.select("*", *by_density("ta"), *by_density("te"), *by_density("tx"))
    told = lists.select("b", "r", "i", "n", "sha", hashes("ta", F.col("ra")).alias("own"), hashes("te", F.col("re")).alias("edited"), F.when(F.col("last"), hashes("tx", F.col("rx"))).alias("head"))
    told = told.withColumn("next", F.coalesce("head", F.lead("own").over(Window.partitionBy("b").orderBy("r"))))
    return told.select(
        F.col("i").alias("doc_id"), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op2_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: all documents and their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
