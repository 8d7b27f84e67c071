"""Feature-based reranking of candidates, all queries in one select.

Candidates (query_id, doc_id, score) are joined with what is known of a document and of a query once
each; features, penalties and the final score are columns. Two windows normalise within a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions import vocabulary as V
from .fusion import CE_STRONG, CE_WEAK, WEAK, confidence, min_max
from .lexical import top_k
from .planner import out_of_distribution, query_labels

NO_ANCHOR, PARTIAL_ANCHOR, PRIMARY_BONUS, SECONDARY_BONUS, LOW_INFO_ANCHOR = 0.55, 0.20, 0.22, 0.08, 0.20
CE_WEIGHT, CE_OOD_WEIGHT, CE_ABSTAIN, CE_ABSTAIN_WEIGHT = 0.34, 0.72, 0.05, 0.20


def families(domains: Column) -> Column:
    """Domain labels to their families, distinct."""
    table = F.create_map(*(F.lit(x) for kv in V.DOMAIN_FAMILIES.items() for x in kv))
    clean = F.filter(F.transform(domains, lambda d: F.lower(F.trim(d))), lambda d: d != "")
    return F.array_distinct(F.transform(clean, lambda d: F.coalesce(F.try_element_at(table, d), d)))


def domain_alignment(query: Column, doc: Column) -> Column:
    """Share of the query's families that the document has."""
    q, d = families(query), families(doc)
    return F.when(F.size(d) > 0, T.overlap(q, d)).otherwise(F.lit(0.0))


def phrase_bonus(intent: Column, text: Column) -> Column:
    """1 if an intent of two words and more stands in the normalised text."""
    return F.when((F.size(F.split(intent, " ")) >= 2) & F.contains(text, intent), 1.0).otherwise(0.0)


def _texts(docs: DataFrame) -> dict[str, list[Column]]:
    """The texts whose tokens are the sets of :func:`document_features`, of the columns that there are."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    many = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ") if c in docs.columns else F.lit("")
    return {"d_title": [text("title")], "d_summary": [text("semantic_summary"), text("semantic_text")], "d_keywords": [many("keywords"), many("metadata_terms")], "d_description": [text("description")]}


def all_tokens(docs: DataFrame) -> Column:
    """``d_all`` of :func:`document_features` alone, which needs no quality columns."""
    return F.array_distinct(F.flatten(F.array(*(T.tokens(t) for ts in _texts(docs).values() for t in ts))))


def document_features(docs: DataFrame) -> DataFrame:
    """What reranking needs of a document, computed once: token sets of its fields and its quality columns.

    ``docs``: doc_id, title, description, keywords, and where there are such semantic_summary,
    semantic_text, metadata_terms, inferred_*; after quality.adjustment.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    many = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in docs.columns else F.array().cast("array<string>")
    sets = lambda *parts: F.array_distinct(F.flatten(F.array(*(T.tokens(p) for p in parts))))
    out = docs.select(
        "doc_id", *(sets(*ts).alias(name) for name, ts in _texts(docs).items()), T.normalize(F.concat_ws(" ", text("title"), text("semantic_summary"), text("description"))).alias("d_text"),
        many("inferred_domains").alias("d_domains"), many("inferred_use_cases").alias("d_uses"), many("inferred_modalities").alias("d_modes"), "all_flags", "severity", "deemphasized", "score_penalty", "score_bonus",
    )
    return out.withColumn("d_all", F.array_distinct(F.concat("d_title", "d_summary", "d_keywords", "d_description")))


def query_features(plans: DataFrame, anchors: DataFrame) -> DataFrame:
    """What reranking needs of a query plan: focus, concepts, labels, intent, anchors."""
    focus = F.array_distinct(F.concat("raw_focus_terms", "concept_terms"))
    intent = T.normalize(F.when(F.col("intent_body") != "", F.col("intent_body")).otherwise(F.col("original_query")))
    return plans.select(
        "query_id", focus.alias("q_focus"), F.when(F.size("concept_terms") > 0, F.col("concept_terms")).otherwise(focus).alias("q_concepts"), F.col("domains").alias("q_domains"), intent.alias("q_intent"),
        query_labels(F.col("focus_terms"), F.col("normalized_query"), V.USE_CASE_HINTS).alias("q_uses"), query_labels(F.col("focus_terms"), F.col("normalized_query"), V.MODALITY_HINTS).alias("q_modes"), out_of_distribution().alias("query_is_ood"),
    ).join(anchors, "query_id")


def anchor_signal(primary: Column, secondary: Column, toks: Column) -> Column:
    """struct(has_primary, matched_primary, missing_primary, matched_secondary, penalty, bonus)."""
    p, s = F.array_sort(F.array_intersect(primary, toks)), F.array_sort(F.array_intersect(secondary, toks))
    none = (F.size(primary) == 0) & (F.size(secondary) == 0)
    penalty = F.when((F.size(primary) > 0) & (F.size(p) == 0), F.when(F.size(s) > 0, PARTIAL_ANCHOR).otherwise(NO_ANCHOR)).otherwise(0.0)
    bonus = F.coalesce(PRIMARY_BONUS * F.try_divide(F.size(p), F.size(primary)), F.lit(0.0)) + F.coalesce(SECONDARY_BONUS * F.try_divide(F.size(s), F.size(secondary)), F.lit(0.0))
    return F.struct(((F.size(p) > 0) | none).alias("has_primary"), p.alias("matched_primary"), F.array_sort(F.array_except(primary, toks)).alias("missing_primary"), s.alias("matched_secondary"), penalty.alias("penalty"), bonus.alias("bonus"))


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int, base_weight: float = 0.52, quality_weight: float = 0.55, cross: str | None = None, cross_weight: float = CE_WEIGHT) -> DataFrame:
    """R14 with R14a-R14e: candidates with rerank_score, its features, weak_match and confidence; the first k of each query.

    ``docs`` from :func:`document_features`, ``queries`` from :func:`query_features`. ``cross`` names a
    column of raw cross-encoder scores; it is blended in by a weight that grows for queries no rule
    matched and shrinks where the encoder abstains.
    """
    c = F.col
    rows = candidates.join(docs, "doc_id").join(queries, "query_id")
    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = rows.withColumns({
        "base_component": min_max(c("score")), "_best": best, "title_focus": T.overlap(c("q_focus"), c("d_title")), "summary_concept": T.overlap(c("q_concepts"), c("d_summary")),
        "keyword_concept": T.overlap(c("q_concepts"), c("d_keywords")), "description_concept": T.overlap(c("q_concepts"), c("d_description")), "domain_match": domain_alignment(c("q_domains"), c("d_domains")),
        "use_case_match": T.overlap(c("q_uses"), c("d_uses")), "modality_match": T.overlap(c("q_modes"), c("d_modes")), "intent_phrase": phrase_bonus(c("q_intent"), c("d_text")), "_anchor": anchor_signal(c("primary"), c("secondary"), c("d_all")),
    })
    rows = rows.withColumn("effective_title_focus", F.when(c("deemphasized"), c("title_focus") * 0.2).otherwise(c("title_focus")))
    rows = rows.withColumn("raw_context_support", F.greatest("effective_title_focus", "keyword_concept", "description_concept"))
    unsupported = c("raw_context_support") == 0.0
    rows = rows.withColumn("effective_domain_match", F.when((c("domain_match") > 0) & unsupported, c("domain_match") * 0.35).otherwise(c("domain_match")))
    features = (
        0.30 * c("effective_domain_match") + 0.20 * c("effective_title_focus") + 0.18 * c("summary_concept") + 0.12 * c("keyword_concept")
        + 0.08 * c("description_concept") + 0.06 * c("use_case_match") + 0.03 * c("modality_match") + 0.03 * c("intent_phrase")
    )
    title_only = (c("effective_title_focus") > 0) & (c("summary_concept") <= 0.2) & (c("description_concept") <= 0.05) & (c("keyword_concept") == 0)
    inferred_only = (c("summary_concept") > 0) & unsupported & (c("domain_match") > 0)
    low_info = F.arrays_overlap("all_flags", T.strings(["low_information", "keyword_only", "metadata_heavy", "empty"]))
    lost = (F.size("primary") > 0) & ~c("_anchor.has_primary")
    rows = rows.withColumns({
        "feature_score": features,
        "context_penalty": F.when(title_only, F.when(c("deemphasized"), 0.13).otherwise(0.08)).otherwise(0.0) + F.when(inferred_only, 0.12).otherwise(0.0),
        "anchor_penalty": c("_anchor.penalty") + F.when(low_info & lost, LOW_INFO_ANCHOR).otherwise(0.0), "anchor_bonus": c("_anchor.bonus"),
        "quality_penalty": quality_weight * c("score_penalty") + F.when((c("raw_context_support") <= 0.1) & (c("severity") != "info"), 0.015).otherwise(0.0), "quality_bonus": quality_weight * c("score_bonus"),
    })
    heuristic = base_weight * c("base_component") + (1 - base_weight) * c("feature_score") - c("context_penalty") - c("anchor_penalty") + c("anchor_bonus") - c("quality_penalty") + c("quality_bonus")
    rows = rows.withColumn("heuristic_rerank_score", F.round(heuristic, 6))
    weak = (c("score") < WEAK) | lost
    if cross is None:
        rows = rows.withColumns({"rerank_score": c("heuristic_rerank_score"), "query_confidence": confidence(c("_best")), "weak_match": weak})
    else:
        top = F.max(cross).over(Window.partitionBy("query_id"))
        rows = rows.withColumns({"_top": top, "_norm": min_max(c(cross))})
        w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c("query_is_ood"), F.greatest(F.lit(cross_weight), F.lit(CE_OOD_WEIGHT))).otherwise(F.lit(cross_weight))))
        w = F.when(c("_top") < CE_ABSTAIN, F.least(w, F.lit(CE_ABSTAIN_WEIGHT))).otherwise(w)
        strong = F.coalesce(c(cross) >= CE_STRONG, F.lit(False))
        rows = rows.withColumn("cross_encoder_weight", w)
        rows = rows.withColumns({
            "rerank_score": F.round((1 - c("cross_encoder_weight")) * c("heuristic_rerank_score") + c("cross_encoder_weight") * F.coalesce("_norm", F.lit(0.0)), 6), "query_confidence": confidence(c("_best"), c("_top")),
            "weak_match": F.coalesce(c(cross) <= CE_WEAK, F.lit(False)) | ((c("score") < WEAK) & ~strong) | lost,
        }).drop("_top", "_norm")
    keep = [n for n in rows.columns if not n.startswith(("d_", "q_", "_")) and n not in ("primary", "secondary", "all_flags", "score_penalty", "score_bonus", "rank")]
    return top_k(rows.select(*keep, c("_anchor.matched_primary").alias("matched_primary"), c("_anchor.missing_primary").alias("missing_primary")), k, score="rerank_score")


def scorer_udf(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16):
    """A (query, text) -> raw score function from a loader that runs once a worker process. A loader or model that fails gives nulls, and is not tried again in that process."""

    @pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # the ranking goes on without it, as for an absent model
            model = None
        for q, d in batches:
            pairs = list(zip(q.fillna(""), d.fillna("")))
            out: list[float | None] = []
            for a in range(0, len(pairs), batch):
                try:
                    out += list(model(pairs[a : a + batch])) if model else [None] * len(pairs[a : a + batch])
                except Exception:
                    out += [None] * len(pairs[a : a + batch])
            yield pd.Series(out, dtype="float64")

    return score
