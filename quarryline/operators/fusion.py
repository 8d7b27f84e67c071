"""Score normalisation and fusion of rankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexical
from .lexical import top_k

TR_PRIMARY, TR_AUX, TR_AUX_ONLY, TR_BOTH = 0.72, 0.58, 0.62, 0.03
STRONG, WEAK, CE_STRONG, CE_WEAK = 0.62, 0.50, 0.0, -3.5
SEMANTIC_WEIGHT, HYBRID_QUALITY, SEMANTIC_QUALITY = 0.6, 0.08, 0.12


def depth(k: int, limit: int, n: int) -> int:
    """Candidates to take for k results."""
    return max(k, min(limit, n))


def min_max(score: Column, by: str = "query_id") -> Column:
    """To [0, 1] within a query's candidates; 1 where all are equal."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / F.when(hi != lo, hi - lo))


def outer(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Full outer join of two ranked lists on query and document, each with its score and its normalised score (null where it lacks the document)."""
    a, b = (d.select("query_id", "doc_id", F.col("score").alias(f"{n}_score")).withColumn(f"{n}_norm", min_max(F.col(f"{n}_score"))) for d, n in zip((left, right), names))
    return a.join(b, ["query_id", "doc_id"], "full_outer")


def quality_adjusted(score: Column, weight: float) -> Column:
    """Penalty and bonus of the document's quality, already in its columns."""
    return score - weight * F.coalesce("score_penalty", F.lit(0.0)) + weight * F.coalesce("score_bonus", F.lit(0.0))


def cross_profile(primary: DataFrame, auxiliary: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, support) of two encoders' lists; documents of both gain, those of the auxiliary alone count less."""
    j = outer(primary, auxiliary, ("p", "a"))
    p, a = F.col("p_norm").isNotNull(), F.col("a_norm").isNotNull()
    score = (
        F.coalesce(TR_PRIMARY * F.col("p_norm"), F.lit(0.0))
        + F.coalesce(F.when(p, TR_AUX).otherwise(TR_AUX * TR_AUX_ONLY) * F.col("a_norm"), F.lit(0.0))
        + F.when(p & a, TR_BOTH).otherwise(0.0)
    )
    return j.select("query_id", "doc_id", F.round(score, 6).alias("score"), (p.cast("long") + a.cast("long")).alias("support"))


def hybrid(semantic: DataFrame, lexical: DataFrame, quality: DataFrame | None, k: int, semantic_weight: float = SEMANTIC_WEIGHT, quality_weight: float = HYBRID_QUALITY) -> DataFrame:
    """R11 before reranking: weighted sum of normalised scores, adjusted by ``quality`` (doc_id, score_penalty, score_bonus) where given; ranked."""
    w = max(0.0, min(1.0, semantic_weight))
    j = outer(semantic, lexical, ("semantic", "bm25"))
    score = w * F.coalesce("semantic_norm", F.lit(0.0)) + (1 - w) * F.coalesce("bm25_norm", F.lit(0.0))
    if quality is not None:
        j = j.join(quality, "doc_id", "left")
        score = quality_adjusted(score, quality_weight)
    return top_k(j.withColumn("score", F.round(score, 6)).select("query_id", "doc_id", "semantic_score", "bm25_score", "score"), k)


def confidence(best: Column, cross_best: Column | None = None) -> Column:
    """R17."""
    ce = F.lit(None).cast("double") if cross_best is None else cross_best
    strong = (best >= STRONG) & (ce.isNull() | (ce >= CE_STRONG))
    weak = (best < WEAK) | F.coalesce(ce <= CE_WEAK, F.lit(False))
    return F.when(strong, F.lit("strong")).when(weak, F.lit("weak")).otherwise(F.lit("moderate"))


def annotate(ranked: DataFrame, k: int) -> DataFrame:
    """Confidence of each query from its best score and weak matches, then the first k."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = ranked.withColumn("query_confidence", confidence(best))
    rows = rows.withColumn("weak_match", (F.col("score") < WEAK) & (F.col("query_confidence") != "strong"))
    return top_k(rows.drop("rank"), k)


def post_filter(ranked: DataFrame, docs: DataFrame, source: str, k: int) -> DataFrame:
    """ranked over all sources, then those of one source, first k. Filtering before would change normalised scores."""
    rows = ranked.drop("rank") if source == "all" else ranked.drop("rank").join(docs.where(F.col("source") == source).select("doc_id"), "doc_id", "left_semi")
    return top_k(rows, k)


def source_top(scored: DataFrame, docs: DataFrame, source: str, k: int, normalise: bool = False) -> DataFrame:
    """Of all candidates (query_id, doc_id, score) the k best of one source, with query_confidence from the best of all sources.

    Normalised scores and confidence depend on every candidate: minimum and maximum are aggregates
    of all of them, taken map-side, so that no list of the whole corpus is ranked; what is ranked is of the source.
    """
    ends = scored.groupBy(F.col("query_id").alias("of")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    own = scored.join(docs.where(F.col("source") == source).select("doc_id"), "doc_id", "left_semi") if source != "all" else scored
    rows = own.join(ends, F.col("query_id") == F.col("of"))
    unit = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / F.when(F.col("hi") != F.col("lo"), F.col("hi") - F.col("lo")))
    out = rows.select("query_id", "doc_id", F.round(unit, 6).alias("score") if normalise else F.col("score"), confidence(F.col("hi")).alias("query_confidence"))
    return top_k(out, k)


def source_search(queries: DataFrame, docs: DataFrame, source: str, k: int) -> DataFrame:
    """:func:`source_top` with normalised scores, for weighted query tokens and documents (doc_id, source, tokens): candidates are scored, and cut, where they lie."""
    if not lexical.scannable(queries, docs):
        return source_top(lexical.scores(queries, docs), docs, source, k, normalise=True)
    own = F.lit(True) if source == "all" else F.col("source") == source
    found = lexical.search_source(queries, docs, own, k)
    return top_k(found.select("query_id", "doc_id", "score", confidence(F.col("hi")).alias("query_confidence")), k)
