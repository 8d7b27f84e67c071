"""Collocations by Apriori passes: frequent phrases level by level, scored by their weakest cut.

A pass over the texts counts the k-grams of one level, and emits one only where both (k-1)-grams it
consists of are frequent. A k-gram is the pair of the codes of those two; its own code is a hash of the
pair, and a word's is one of language and word. What a pass must know of the level before is which codes
are frequent: that goes out as a bit table of ``FILTER_BITS`` bits at most, so its size has a bound however many
there are. A code that only looks frequent costs a row that the exact counts drop again.

The level tables hold every frequent phrase with the frequencies of all its beginnings and ends, which
come from the tables of the level before by joins on the two codes. So cuts are scored, and phrases
spelled out, without another pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import kernels as K
from . import tries
from .scratch import stored

#: Bytes that end a piece of text, and those that are in no word.
_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~_BREAK & ~np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
UND = "und"
#: Bits of a filter: ``_PER_CODE`` for each frequent code, rounded up to a power of two, from ``_LEAST_BITS`` to 2**28 (32 MB).
FILTER_BITS, _LEAST_BITS, _PER_CODE = 1 << 28, 1 << 16, 16
#: Bytes of text that are counted at once.
_BLOCK = 1 << 22
#: A language's phrases are ranked in so many parts first.
_PARTS = 64
#: Files of the frequent words.
_FILES = 8
U = np.uint64


def pair_codes(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Codes of pairs of codes, as Spark's ``xxhash64(p, q)`` gives them."""

    def step(x: np.ndarray, seed) -> np.ndarray:
        h = seed + K._P5 + U(8)
        h = K._rotl(h ^ K._lane(U(0), x), 27) * K._P1 + K._P4
        h = (h ^ (h >> U(33))) * K._P2
        h = (h ^ (h >> U(29))) * K._P3
        return h ^ (h >> U(32))

    with np.errstate(over="ignore"):
        return step(q.view(U), step(p.view(U), U(42))).view(np.int64)


def _words(block: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
    """Number of each word of the block among its distinct (language, word), whether the next one follows in its piece, those languages and words, and their codes."""
    data = K.LOWER[data]
    is_word = _WORD[data]
    starts, ends, counts = K.spans(is_word, offsets)
    word, distinct = tries.numbered_words(data, is_word, starts, ends)
    lang = block.column("l").dictionary_encode()
    names = lang.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(counts)), counts)
    piece = np.concatenate([[0], np.cumsum(_BREAK[data], dtype=np.int64)])[starts]
    follows = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    number, of_lang, of_word = tries.nodes(np.asarray(lang.indices).astype(np.int64)[doc], word, max(1, len(distinct)))
    lengths = np.array([len(w) for w in distinct], np.int64)
    buffer = np.frombuffer(b"".join(distinct), np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    codes = np.empty(len(of_lang), np.int64)
    for k, name in enumerate(names):
        raw = np.frombuffer(name.encode(), np.uint8)
        seed = int(K.xxh64(raw, np.array([0]), np.array([len(raw)]))[0])
        own = np.flatnonzero(of_lang == k)
        codes[own] = K.xxh64(buffer, at[of_word[own]], lengths[of_word[own]], seed).view(np.int64)
    return number, follows, [names[k] for k in of_lang], [distinct[k] for k in of_word], codes


def _has(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes.view(U) & U(64 * len(bits) - 1)
    return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) != 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, data, offsets in K.blocks(batches, "t", _BLOCK, 1 << 16):
        number, _, langs, words, codes = _words(block, data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(codes), pa.array(np.bincount(number, minlength=len(codes)).astype(np.int64))], ["lang", "phrase", "code", "n"])


def _count_pairs(filters):
    """Counts of the (p, q) of one level more than there are filters."""

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filters.value
        for block, data, offsets in K.blocks(batches, "t", _BLOCK, 1 << 16):
            number, follows, _, _, codes = _words(block, data, offsets)
            # Where a frequent phrase of the level starts, which it is, and whether the next word follows.
            at, node = np.arange(len(number)), number
            for level, table in enumerate(bits):
                keep = _has(table, codes)[node]
                at, node = at[keep], node[keep]
                both = np.flatnonzero(at[1:] == at[:-1] + 1)
                if not level:
                    both = both[follows[at[both]]]
                node, p, q = tries.nodes(node[both], node[both + 1], max(1, len(codes)))
                at, p, q = at[both], codes[p], codes[q]
                codes = pair_codes(p, q)
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(np.bincount(node, minlength=len(codes)).astype(np.int64))], ["p", "q", "n"])

    return run


def bit_table(level: DataFrame) -> np.ndarray:
    """The codes of a level as a table of bits, 32 MB at most, made by the executors."""
    n = level.count()
    size = _LEAST_BITS
    while size < min(_PER_CODE * n, FILTER_BITS):
        size *= 2
    at = F.col("code").bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(code & 63 as int))")
    words = level.groupBy(F.shiftrightunsigned(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
    return out.view(U)


def _distinct_codes(level: DataFrame) -> DataFrame:
    n, codes = level.agg(F.count("*"), F.count_distinct("code")).first()
    if n != codes:
        raise ValueError("two frequent phrases have one 64-bit code")
    return level


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most_words: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """The tables of frequent phrases of 1 to ``most_words`` words, and (lang, total): all word occurrences of a language.

    A table has lang, phrase, last (its last word), code, f, and f of its beginnings (``heads``) and ends
    (``tails``) of 1, 2, ... words; from two words on also the codes p and q of the phrase without its last
    and its first word.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UND)).alias("l"), F.col(text_col).alias("t")).where("t is not null")
    # All words, rare ones too, are read twice and never again: they stay on the executors' disks. What is written are the totals and the frequent ones, in few files.
    words = rows.mapInArrow(K.released(_count_words), "lang string, phrase string, code long, n long").groupBy("lang", "phrase", "code").agg(F.sum("n").alias("f")).persist(StorageLevel.DISK_ONLY)
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("total")), "word-totals")
    none = F.array().cast("array<long>")
    found = [_distinct_codes(stored(words.where(F.col("f") >= least).select("lang", "phrase", F.col("phrase").alias("last"), "code", "f", none.alias("heads"), none.alias("tails")).coalesce(_FILES), "phrases-1"))]
    words.unpersist()
    filters: list[np.ndarray] = []
    for k in range(2, most_words + 1):
        filters.append(bit_table(found[-1]))
        pairs = rows.mapInArrow(_count_pairs(spark.sparkContext.broadcast(filters)), "p long, q long, n long").groupBy("p", "q").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        head = found[-1].select(F.col("code").alias("p"), "lang", F.col("phrase").alias("start"), "heads", F.col("f").alias("head"))
        tail = found[-1].select(F.col("code").alias("q"), "last", "tails", F.col("f").alias("tail"))
        joined = pairs.join(head, "p").join(tail, "q")
        joined = joined.select("lang", F.concat("start", F.lit(" "), "last").alias("phrase"), "last", F.xxhash64("p", "q").alias("code"), "f", F.concat("heads", F.array("head")).alias("heads"), F.concat("tails", F.array("tail")).alias("tails"), "p", "q")
        found.append(_distinct_codes(stored(joined, f"phrases-{k}")))
    return found, totals


def weakest_cut(words: int) -> Column:
    """(score, k, l, r) of the cut of a phrase of so many words whose floor(1000 a n / (l r)) is lowest, of the first such cut. Products are decimals of 38 digits."""
    cuts = []
    for k in range(1, words):
        l, r = F.element_at("heads", k), F.element_at("tails", words - k)
        score = F.expr(f"cast(1000 * f as decimal(20, 0)) * cast(total as decimal(18, 0)) div (cast(element_at(heads, {k}) as decimal(19, 0)) * cast(element_at(tails, {words - k}) as decimal(18, 0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most_words: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, by score, then frequency, then the phrase itself.

    Phrases have 2 to ``most_words`` words, ``least`` occurrences or more, and are part of no longer one that
    occurs as often. Null texts have no words, a null language is ``und``; repeated rows count each; other
    columns are ignored. Texts without words and empty tables give no rows.
    """
    found, totals = levels(docs, text_col, lang_col, least, most_words)
    out = None
    for words in range(2, most_words + 1):
        level = found[words - 1]
        if words < most_words:
            # A longer phrase occurs as often at most; if one does, so does one with a single word more.
            more = found[words]
            more = more.select(F.col("p").alias("within"), F.col("f").alias("as_often")).unionAll(more.select("q", "f")).distinct()
            level = level.join(more, (F.col("code") == F.col("within")) & (F.col("f") == F.col("as_often")), "left_anti")
        level = level.join(totals.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).select("lang", "phrase", F.col("f").alias("a"), F.col("total").alias("n"), weakest_cut(words).alias("cut"))
        out = level if out is None else out.unionAll(level)
    out = out.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))).orderBy(*order)
    best = out.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """Query: the 2,000 best phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _ascii_lower(column: str) -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"translate({column}, '{upper}', '{upper.lower()}')"


ORACLE_SQL = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_ascii_lower("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM texts),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM pieces, (VALUES (1), (2), (3), (4), (5)) AS lengths(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM f WHERE f >= 100),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM frequent WHERE k >= 2),
parts AS (
  SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM candidates, (VALUES (2), (3), (4)) AS shorter(m) WHERE m < k),
kept AS (
  SELECT * FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 100 * c.a)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, total.n,
         (1000::HUGEINT * c.a * total.n) // (l.f::HUGEINT * r.f) AS score
  FROM kept c JOIN total USING (lang), (VALUES (1), (2), (3), (4)) AS places(cut),
       frequent l, frequent r
  WHERE cut < c.k AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.ws[1:cut], ' ') AND r.phrase = array_to_string(c.ws[cut + 1:c.k], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
