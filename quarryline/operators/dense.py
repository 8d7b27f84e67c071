"""Dense retrieval: exact inner-product search and fusion of query variants and aspects.

The queries of a batch are a matrix, broadcast in blocks of bounded size. Each partition of the corpus
multiplies its vectors in Arrow batches and keeps its own k best a query, so the shuffle carries
(queries x k) rows a partition, whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from .lexical import top_k

#: Query vectors in one broadcast: with 1,024 dimensions 32 MB.
BLOCK = 8192
#: Scores that a task holds at once (8 bytes each, and some copies).
SCORES = 1 << 18
AVG_WEIGHT, MIN_WEIGHT, HIT_BONUS, MISS_PENALTY, ASPECT_THRESHOLD = 0.20, 0.08, 0.035, 0.03, 0.18


def inner_product(a: Column, b: Column) -> Column:
    """X20 as an expression; sums in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of each query of a partition. Scores are taken ``SCORES`` at a time, a few queries against a few documents, so a task holds those and the k best a query, however many queries there are."""
    best_s, best_d = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    rows = max(1, SCORES // (1024 + k))
    seen = 0
    for b in batches:
        for a in range(0, b.num_rows, 1024):
            part = b.slice(a, 1024)
            v = part.column("v")
            good = np.asarray(v.is_valid())
            if not good.any():
                continue
            flat = np.asarray(v.flatten()).astype(np.float64).reshape(int(good.sum()), -1).T
            docs = np.asarray(part.column("d"))[good]
            seen += len(docs)
            for q in range(0, len(ids), rows):
                s = np.round(matrix[q : q + rows] @ flat, 6)
                hs, hd = best_s[q : q + rows], best_d[q : q + rows]
                # Only queries with a document that reaches their k-th best are sorted.
                hit = np.flatnonzero((s >= hs[:, -1:]).any(axis=1))
                if len(hit):
                    s = np.concatenate([hs[hit], s[hit]], axis=1)
                    d = np.concatenate([hd[hit], np.broadcast_to(docs, (len(hit), len(docs)))], axis=1)
                    order = np.lexsort((d, -s), axis=1)[:, :k]
                    hs[hit], hd[hit] = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
    n = min(k, seen)
    step = max(1, (1 << 16) // max(1, n))
    for q in range(0, len(ids) if n else 0, step):
        s, d = best_s[q : q + step, :n], best_d[q : q + step, :n]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q : q + step], n)), pa.array(d.ravel()), pa.array(s.ravel())], ["query_id", "doc_id", "score"])


def knn(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "embedding", doc_id: str = "doc_id", doc_vector: str = "embedding") -> DataFrame:
    """The k nearest documents of each query by inner product, exact; (query_id, doc_id, score, rank).

    Scores are rounded to six places, ties go to the smaller id. Rows without a vector match nothing.
    Queries come in blocks of at most BLOCK vectors (fewer for k over 1,000), one scan of the corpus each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(doc_vector).alias("v"))
    out, ids, vectors = None, [], []

    def scan():
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(vectors, np.float64)))
        return rows.mapInArrow(lambda b: _best(b, *shared.value, k), "query_id long, doc_id long, score double")

    for r in queries.select(F.col(query_id).cast("long").alias("i"), F.col(query_vector).alias("v")).where("v is not null").toLocalIterator():
        ids.append(r["i"])
        vectors.append(r["v"])
        if len(ids) * k >= BLOCK * 1000 or len(ids) == BLOCK:
            part = scan()
            out, ids, vectors = part if out is None else out.unionAll(part), [], []
    if ids or out is None:
        part = scan() if ids else rows.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
        out = part if out is None else out.unionAll(part)
    return top_k(out, k)


def knn_sql(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """J1 with scores by the expression: :func:`knn` finds the rows by blocks of vectors, what it finds is scored and ranked once more, so the expression runs on k pairs a query and not on all."""
    found = knn(queries, docs, k).select("query_id", "doc_id")
    pairs = found.join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("qv")), "query_id").join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").alias("dv")), "doc_id")
    return top_k(pairs.select("query_id", "doc_id", F.round(inner_product(F.col("qv"), F.col("dv")), 6).alias("score")), k)


def variant_score(best: Column, weight: Column, hits: Column) -> Column:
    """R5."""
    return best + 0.015 * weight + 0.01 * F.greatest(hits - 1, F.lit(0))


def fused_score(base: Column, n: Column, avg: Column, least: Column, hits: Column) -> Column:
    """With two aspects and more, coverage of several counts."""
    more = base + AVG_WEIGHT * avg + MIN_WEIGHT * least + HIT_BONUS * F.greatest(hits - 1, F.lit(0)) - MISS_PENALTY * F.greatest(n - hits, F.lit(0))
    return F.when(n < 2, base).otherwise(more)


def fuse(variant_hits: DataFrame, aspect_hits: DataFrame, aspects: DataFrame) -> DataFrame:
    """One row (query_id, doc_id) from hits of variants (query_id, doc_id, score, weight) and of aspects (query_id, doc_id, aspect, score).

    ``aspects``: query_id, n_aspects. Missing aspect scores are 0, so average and minimum follow from
    sums over the hits there are: no pivot.
    """
    none = F.lit(None).cast("double")
    rows = variant_hits.select("query_id", "doc_id", (F.col("score") * F.col("weight")).alias("s"), "weight", F.lit(None).cast("string").alias("aspect"), none.alias("a"))
    per = aspect_hits.groupBy("query_id", "doc_id", "aspect").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("a"))
    rows = rows.unionByName(per.select("query_id", "doc_id", none.alias("s"), none.alias("weight"), "aspect", "a"))
    g = rows.groupBy("query_id", "doc_id").agg(
        F.coalesce(F.max("s"), F.lit(0.0)).alias("max_score"), F.count("s").alias("variant_hits"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight_hits"),
        F.coalesce(F.sum("a"), F.lit(0.0)).alias("_sum"), F.count("a").alias("_seen"), F.min("a").alias("_min"), F.count_if(F.col("a") >= ASPECT_THRESHOLD).alias("aspect_hits"),
    )
    g = g.join(aspects, "query_id", "left").withColumn("n_aspects", F.coalesce("n_aspects", F.lit(0)).cast("long"))
    n = F.col("n_aspects")
    some = lambda x: F.when(n > 0, x).otherwise(0.0)
    g = g.withColumns({
        "aspect_avg": some(F.try_divide("_sum", n)),
        "aspect_min": some(F.when(F.col("_seen") < n, 0.0).otherwise(F.col("_min"))),
        "aspect_coverage": some(F.try_divide("aspect_hits", n)),
    })
    base = variant_score(F.col("max_score"), F.col("weight_hits"), F.col("variant_hits"))
    score = F.round(fused_score(base, n, F.col("aspect_avg"), F.col("aspect_min"), F.col("aspect_hits")), 6)
    return g.withColumn("score", score).drop("_sum", "_seen", "_min")


def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """M1: a text -> vector function from a loader that runs once a worker process; vectors come out at unit length."""

    @pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            v = np.asarray(model(texts.fillna("").tolist()), np.float32)
            yield pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    return encode


def hashing_encoder(dimensions: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic encoder without a model: signed hashing of words; for tests and where no model is installed."""

    def load():
        from zlib import crc32

        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = crc32(w.encode())
                    out[i, h % dimensions] += 1 if h >> 31 else -1
            return out

        return model

    return load
