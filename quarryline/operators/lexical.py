"""BM25 over a corpus table, for a batch of queries at once.

An index is two tables: postings (token, doc_id, tf, dl) and, of one row, the number of documents
with a token and their mean length. A batch of queries needs no index: documents are reduced to its tokens and scored
in their tasks (``lexical_scan``), so no posting is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import text as T
from ..functions import vocabulary as V
from . import lexical_scan

K1, B = 1.5, 0.75
TITLE_WEIGHT, KEYWORD_WEIGHT = 3, 2
#: Rows of (query, token), equal queries counted once, up to which a batch is broadcast; more are joined by shuffle.
BROADCAST_TOKENS = 200_000


def keyword_texts(keywords: Column) -> Column:
    """lower-cased keywords without blanks and platform tags."""
    clean = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
    return F.filter(clean, lambda k: (k != "") & ~T.starts_with_any(k, V.KEYWORD_PREFIXES))


def document_tokens(title: Column, keywords: Column, description: Column) -> Column:
    """Title tokens three times, keyword tokens twice, description tokens once."""
    key_tokens = T.tokens(F.array_join(keyword_texts(keywords), " "))
    return F.concat(F.flatten(F.array_repeat(T.tokens(title), TITLE_WEIGHT)), F.flatten(F.array_repeat(key_tokens, KEYWORD_WEIGHT)), T.tokens(description))


@dataclass
class Index:
    """R2. ``postings``: token, doc_id, tf, dl; ``frequencies``: token, df, idf; ``stats``: one row n, avgdl."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def lengths(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """A3: one row n, avgdl over the documents that have a token."""
    size = F.size(tokens)
    return docs.where(size > 0).agg(F.count("*").alias("n"), F.avg(size).alias("avgdl"))


def _exploded(docs: DataFrame, id_col: str, tokens: Column, size: Column | None = None) -> DataFrame:
    """doc_id, dl, token. The length is a column before the explosion: after it, every row would drag its document's whole array along.

    The outer form gives documents without tokens a null token. From the inner form Spark infers a filter on the
    array and pushes it to the scan, where all texts would be taken apart once more.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.size(tokens) if size is None else size).cast("long").alias("dl"), tokens.alias("_t"))
    return rows.select("doc_id", "dl", F.explode_outer("_t").alias("token"))


def build_index(docs: DataFrame, id_col: str = "doc_id", tokens: str = "tokens") -> Index:
    """A1-A3, R2 from a table with an array of tokens; term frequencies are summed map-side before the shuffle."""
    rows = _exploded(docs, id_col, F.col(tokens)).where(F.col("token").isNotNull())
    postings = rows.groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf")).select("token", "doc_id", "tf", "dl")
    stats = lengths(docs, tokens)
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    frequencies = df.crossJoin(F.broadcast(stats)).select("token", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    return Index(postings, frequencies, stats)


def score_columns(tf: Column, dl: Column, avgdl: Column, weight: Column, n: Column, df: Column, k1: float = K1, b: float = B) -> Column:
    return weight * idf(n, df) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))


def top_k(rows: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Rank 1..k within a query by score, ties by id. Spark limits each partition before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def search(queries: DataFrame, docs: DataFrame, k: int = 5, tokens: str = "tokens", id_col: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank) for weighted query tokens (query_id, token, qf)."""
    return search_settings(queries, docs, k, [(k1, b)], tokens, id_col).drop("setting")


def search_settings(queries: DataFrame, docs: DataFrame, k: int, settings: list[tuple[float, float]], tokens: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """:func:`search` under several (k1, b) by one scan: (query_id, doc_id, score, rank, setting), setting is the number of the pair.

    Equal queries are answered once. Rows that share an id are one document, which a scan cannot know: they, and
    ids that are no whole numbers, go the way of :func:`scores`.
    """
    if not scannable(queries, docs, id_col):
        each = [top_k(scores(queries, docs, tokens, id_col, *s), k).withColumn("setting", F.lit(i).cast("long")) for i, s in enumerate(settings)]
        return reduce(DataFrame.unionByName, each)
    distinct, members = merged_queries(queries)
    rows, asked, size = _encoded(distinct, docs, tokens, id_col)
    w = Window.partitionBy("setting", "query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    best = lexical_scan.run(asked, rows, size, k, tuple(settings)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = _taken(best.withColumn("rank", F.col("rank").cast("long")), rows)
    return best.withColumnRenamed("query_id", "of").join(members, "of").select("query_id", F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "score", "rank", "setting")


def _taken(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` (a few rows a query) evaluated and held, so that the documents it came from can go."""
    found = found.persist()
    found.count()
    rows.unpersist()
    return found


def scannable(queries: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether each row is a document of its own, ids are whole numbers, and the queries' tokens can go out."""
    whole = ("tinyint", "smallint", "int", "bigint")
    if dict(queries.dtypes)["query_id"] not in whole or dict(docs.dtypes)[id_col] not in whole:
        return False
    if queries.where("query_id is null").limit(1).count():
        return False
    if queries.select("token").distinct().limit(lexical_scan.SCAN_TOKENS + 1).count() > lexical_scan.SCAN_TOKENS:
        return False
    n, ids = docs.select(id_col).agg(F.count("*"), F.count_distinct(id_col)).first()
    return n == ids


def _encoded(distinct: DataFrame, docs: DataFrame, tokens: str, id_col: str, own: Column | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The documents by numbers of the queries' tokens, kept on the executors' disks; the queries, a row each, by weights (query_id, ts, ws, avgdl); and how many tokens there are."""
    spark = docs.sparkSession
    vocabulary = distinct.select("token").where("token <> ''").distinct().toArrow().column(0).to_pylist()
    taken = docs.select(F.col(id_col).cast("long").alias("d"), F.col(tokens).alias("t"), F.coalesce(F.lit(True) if own is None else own, F.lit(False)).alias("own"))
    rows = lexical_scan.encoded(vocabulary, taken).persist(StorageLevel.DISK_ONLY)
    n, avgdl = rows.where("dl > 0").agg(F.count("*"), F.avg("dl")).first()
    df = rows.select(F.explode("ts").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    numbers = spark.createDataFrame(list(enumerate(vocabulary)), "number int, token string").join(df, "number")
    one = F.struct("number", (F.col("qf") * idf(F.lit(n), F.col("df"))).cast("double").alias("w"))
    asked = distinct.join(numbers, "token").groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return rows, asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("a.number").alias("ts"), F.col("a.w").alias("ws"), F.lit(avgdl).alias("avgdl")), max(1, len(vocabulary))


def search_source(queries: DataFrame, docs: DataFrame, own: Column, k: int, tokens: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, score, lo, hi): the k best of the documents that are ``own``, by score between lowest and highest of all candidates (six places), ties to the smaller id, and those ends. One pass finds the ends, another the documents."""
    distinct, members = merged_queries(queries)
    rows, asked, size = _encoded(distinct, docs, tokens, id_col, own)
    ends = lexical_scan.run(asked, rows, size, 0, ((K1, B),)).groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    held = ends.collect()
    found = lexical_scan.run(asked, rows, size, k, ((K1, B),), True, {r["query_id"]: (r["lo"], r["hi"]) for r in held})
    # What is ranked is the normalised score; those of all partitions are cut once more.
    found = _taken(top_k(found, k).drop("rank"), rows)
    table = docs.sparkSession.createDataFrame([tuple(r) for r in held], "of long, lo double, hi double")
    return found.withColumnRenamed("query_id", "of").join(table, "of").join(members, "of").select("query_id", F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "score", "lo", "hi")


def scores(queries: DataFrame, docs: DataFrame, tokens: str = "tokens", id_col: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """A4: (query_id, doc_id, score) of every document that has a token of the query.

    Documents are scanned once: each gives its matching tokens and a blank one that stands for itself, so
    that the number of documents and their mean length come from the same shuffled rows. (The sums
    below name every column on purpose: equal plans let Spark reuse that exchange.) Scores are
    rounded to six places before ranking, so that the order does not hang on addition order.
    """
    vocabulary = queries.select("token").distinct()
    # Rows of the queries, which are at least as many as their tokens.
    small = queries.count() <= BROADCAST_TOKENS
    hint = F.broadcast if small else (lambda d: d)
    blank = docs.sparkSession.range(1).select(F.lit("").alias("token"))
    rows = _exploded(docs, id_col, F.concat(F.array(F.lit("")), F.col(tokens)), F.size(tokens))
    matched = rows.join(hint(vocabulary.unionAll(blank)), "token", "left_semi").groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))
    is_doc = (F.col("token") == "") & (F.col("dl") > 0)
    stats = matched.agg(F.sum(F.when(is_doc, F.col("tf"))).alias("n"), F.avg(F.when(is_doc & (F.col("tf") > 0), F.col("dl"))).alias("avgdl"))
    df = matched.groupBy("token").agg(F.sum(F.when((F.col("tf") > 0) & (F.col("dl") >= 0), 1)).alias("df"))
    weighted = queries.withColumn("token", F.expr("nullif(token, '')")).join(df, "token").crossJoin(F.broadcast(stats))
    hits = matched.join(hint(weighted), "token")
    points = F.round(F.sum(score_columns(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("qf"), F.col("n"), F.col("df"), k1, b)), 6)
    return hits.groupBy("query_id", "doc_id").agg(points.alias("score"))


def merged_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal queries as one: their weighted tokens (query_id, token, qf), and (of, query_id): which query stands for which."""
    whole = queries.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "qf"))).alias("all"))
    first = whole.groupBy("all").agg(F.min("query_id").alias("of"), F.collect_list("query_id").alias("ids"))
    distinct = first.select(F.col("of").alias("query_id"), F.explode("all").alias("t")).select("query_id", "t.token", "t.qf")
    return distinct, first.select("of", F.explode("ids").alias("query_id"))


def grouped_by_token(weighted: DataFrame) -> DataFrame:
    """(token, avgdl, wanted) from (token, query_id, weight, avgdl): each token once, with the queries that have it."""
    return weighted.groupBy("token").agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("query_id", "weight")).alias("wanted"))


def search_index(queries: DataFrame, index: Index, k: int = 5) -> DataFrame:
    """R3, J3, A4 over the tables of an index: only the postings of the queries' tokens are read on. Equal queries are answered once, and each token meets its postings once for all queries that have it."""
    distinct, members = merged_queries(queries)
    best = top_k(index_scores(distinct, index), k)
    return best.withColumnRenamed("query_id", "of").join(members, "of").select("query_id", "doc_id", "score", "rank")


def index_scores(distinct: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, score) of every document that has a token of the query."""
    known = distinct.join(index.frequencies.drop("idf"), "token").crossJoin(F.broadcast(index.stats))
    wanted = grouped_by_token(known.select("token", "query_id", (F.col("qf") * idf(F.col("n"), F.col("df"))).alias("weight"), "avgdl"))
    small = distinct.count() <= BROADCAST_TOKENS
    hits = index.postings.join(F.broadcast(wanted) if small else wanted, "token")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    each = hits.select("doc_id", part.alias("part"), F.explode("wanted").alias("q"))
    points = F.round(F.sum(F.col("q.weight") * F.col("part")), 6)
    return each.groupBy(F.col("q.query_id").alias("query_id"), "doc_id").agg(points.alias("score"))


def meaningful(token: Column) -> Column:
    """F6."""
    return (F.length(token) >= 2) & ~token.isin(V.STOPWORDS) & ~token.isin(V.LEXICAL_NOISE)


def weighted_query_tokens(plans: DataFrame) -> DataFrame:
    """Q10: (query_id, token, qf) from query plans; a query left without tokens keeps all of two letters and more."""
    concept = F.when(F.col("detected_language") == "tr", 3).otherwise(2)
    tag = lambda column, w: F.transform(column, lambda t: F.struct(t.alias("token"), F.lit(w).cast("long").alias("w") if isinstance(w, int) else w.cast("long").alias("w")))
    raw = T.tokens(F.col("original_query"))
    all_ = F.filter(F.concat(tag(raw, 1), tag(F.col("raw_focus_terms"), 2), tag(F.col("concept_terms"), concept), tag(F.col("domain_terms"), 1)), lambda x: meaningful(x["token"]))
    fallback = F.filter(tag(raw, 1), lambda x: F.length(x["token"]) >= 2)
    rows = plans.select("query_id", all_.alias("a"), fallback.alias("f")).select("query_id", F.explode(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("f"))).alias("x"))
    return rows.groupBy("query_id", F.col("x.token").alias("token")).agg(F.sum("x.w").alias("qf"))


def document_frequencies(docs: DataFrame, token_set: str = "token_set", of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Df over the distinct tokens of all fields, and the number of all documents (empty ones too). With ``of`` (token) only of those tokens, a batch's, which are broadcast."""
    rows = docs.select(F.explode_outer(token_set).alias("token")).where(F.col("token").isNotNull())
    if of is not None:
        rows = rows.join(F.broadcast(of.select("token").distinct()), "token", "left_semi")
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    return df, docs.agg(F.count("*").alias("total"))


def token_idf(df: Column, total: Column) -> Column:
    """Unseen tokens count most."""
    return F.when(F.coalesce(df, F.lit(0)) <= 0, F.ln(1 + total)).otherwise(idf(total, df))
