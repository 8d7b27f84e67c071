"""Training sets for a retriever: splits, pairs, mined and backfilled negatives, clue-based triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NEGATIVES, POSITIVES, DEPTH = 3, 2, 40
METHOD_WEIGHT = {"semantic": 4.0, "hybrid": 3.0, "bm25": 1.5}
LOW_FLAGS = ["keyword_only", "low_information", "short_description", "too_short", "empty", "metadata_heavy"]


def split(key: Column) -> Column:
    """G1: ``dev`` for one key in seven by hash, else ``train``."""
    n = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 7
    return F.when(n < 1, F.lit("dev")).otherwise(F.lit("train"))


def pool(rankings: dict[str, DataFrame], depth: int = DEPTH) -> DataFrame:
    """(query_id, doc_id, methods, rank_score): candidates of several rankers, weighted sum of inverse ranks."""
    rows = None
    for method, r in rankings.items():
        one = r.where(F.col("rank") <= depth).select("query_id", "doc_id", F.lit(method).alias("method"), (F.lit(METHOD_WEIGHT.get(method, 1.5)) / F.col("rank")).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.round(F.sum("s"), 6).alias("rank_score"))


def _both(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def hardness(rank_score: Column) -> Column:
    """Over columns q_domains, p_domains, p_uses, p_modes (query and positive) and domains, uses, modes (candidate)."""
    c = F.col
    return F.round(rank_score + 0.8 * _both(c("q_domains"), c("domains")) + 1.2 * _both(c("p_domains"), c("domains")) + 0.7 * _both(c("p_uses"), c("uses")) + 0.4 * _both(c("p_modes"), c("modes")), 6)


def backfill_score() -> Column:
    """G5."""
    c = F.col
    return F.round(0.8 * _both(c("q_domains"), c("domains")) + 1.0 * _both(c("p_domains"), c("domains")) + 0.6 * _both(c("p_uses"), c("uses")) + 0.4 * _both(c("p_modes"), c("modes")), 6)


def pairs(judgments: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each query text and relevant document, the smallest query id stays."""
    rows = judgments.join(docs.select("doc_id", "title", "source"), "doc_id")
    w = Window.partitionBy("query", "doc_id").orderBy("query_id")
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.withColumn("split", split(F.col("query_id").cast("string"))).withColumnsRenamed({"doc_id": "positive_id", "title": "positive_title", "source": "positive_source"})


def triplets(judgments: DataFrame, candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """K negatives for each relevant document: the hardest mined ones first, then neighbours by labels.

    ``docs``: doc_id, domains, uses, modes; ``queries``: query_id, q_domains; ``candidates`` from :func:`pool`.
    What is scored depends on the query and the labels of the relevant document alone, so negatives are chosen once for each
    class of those and joined to its documents. Backfill compares labels, which are few: of each label set a query
    needs its 2 * k smallest ids that are not relevant, and a class only the label sets of highest score that have so many.
    """
    relevant = judgments.select("query_id", "doc_id").distinct()
    labels = F.struct("domains", "uses", "modes").alias("labels")
    about = relevant.join(queries, "query_id").join(docs.select("doc_id", labels, F.col("domains").alias("p_domains"), F.col("uses").alias("p_uses"), F.col("modes").alias("p_modes")), "doc_id")
    kind = F.struct("query_id", "q_domains", "p_domains", "p_uses", "p_modes").alias("kind")
    p = about.select(kind, "query_id", F.col("doc_id").alias("positive_id"))
    kinds = p.select("kind").distinct().select("kind", "kind.*")
    mined = candidates.join(relevant, ["query_id", "doc_id"], "left_anti").join(docs, "doc_id")
    mined = kinds.join(mined, "query_id").select("kind", F.col("doc_id").alias("negative_id"), hardness(F.col("rank_score")).alias("negative_hardness"), F.lit("retrieval_confusion").alias("negative_strategy"), F.array_join("methods", ",").alias("mined_from"), F.lit(0).alias("_p"))

    counts = about.groupBy("query_id", "labels").agg(F.count_distinct("doc_id").alias("r"))
    deepest = counts.agg(F.coalesce(F.max("r"), F.lit(0))).first()[0] + 2 * k
    numbered = docs.select("doc_id", labels).withColumn("n", F.row_number().over(Window.partitionBy("labels").orderBy("doc_id"))).where(F.col("n") <= deepest)
    sets = docs.select(labels).distinct()
    wanted = kinds.select("query_id").distinct().crossJoin(F.broadcast(sets)).join(counts, ["query_id", "labels"], "left")
    wanted = wanted.select("query_id", "labels", F.explode(F.sequence(F.lit(1), (F.coalesce("r", F.lit(0)) + 2 * k).cast("int"))).alias("n"))
    free = wanted.join(numbered, ["labels", "n"]).join(relevant, ["query_id", "doc_id"], "left_anti")
    free = free.withColumn("m", F.row_number().over(Window.partitionBy("query_id", "labels").orderBy("n"))).where(F.col("m") <= 2 * k)
    free = free.groupBy("query_id", "labels").agg(F.collect_list("doc_id").alias("ids")).select("query_id", "labels.*", "ids")
    back = kinds.join(free, "query_id").select("kind", "ids", backfill_score().alias("s")).where("s > 0")
    # Label sets under others that have enough are not needed.
    above = Window.partitionBy("kind").orderBy(F.col("s").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.sum(F.size("ids")).over(above) - F.sum(F.size("ids")).over(Window.partitionBy("kind", "s"))
    back = back.withColumn("_above", enough).where(F.col("_above") < 2 * k).select("kind", F.explode("ids").alias("negative_id"), F.col("s").alias("negative_hardness"))
    back = back.select("kind", "negative_id", "negative_hardness", F.lit("domain_neighbor_backfill").alias("negative_strategy"), F.lit("").alias("mined_from"), F.lit(1).alias("_p"))
    every = mined.unionByName(back)
    one = Window.partitionBy("kind", "negative_id").orderBy("_p")
    every = every.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    top = Window.partitionBy("kind").orderBy("_p", F.col("negative_hardness").desc(), "negative_id")
    chosen = every.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n", "_p")
    out = p.join(chosen, "kind").drop("kind")
    return out.withColumn("split", split(F.col("query_id").cast("string")))


def analyze(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """Clue and label hits of every document for every query spec, and its positive score.

    ``docs``: doc_id, match_text (T.keep_words), domains, uses, modes, flags; ``specs``: query_id and the
    arrays core, positive, negative (cleaned), expected_domains, expected_uses, expected_modes; few rows.
    """
    rows = docs.crossJoin(F.broadcast(specs))
    hits = lambda c: F.filter(c, lambda x: F.contains("match_text", x))
    rows = rows.withColumns({"core_hits": F.size(hits("core")), "positive_hits": F.size(hits("positive")), "negative_hits": F.size(hits("negative"))})
    rows = rows.withColumns({f"{n}_hits": F.size(F.array_intersect(F.col(c), F.col(f"expected_{c}"))) for n, c in (("domain", "domains"), ("use", "uses"), ("mode", "modes"))})
    c = F.col
    score = 4.0 * c("core_hits") + 1.2 * F.greatest(c("positive_hits") - c("core_hits"), F.lit(0)) + 1.4 * c("domain_hits") + 1.0 * c("use_hits") + 0.8 * c("mode_hits") - 2.6 * c("negative_hits") - 1.0 * F.size(F.array_intersect("flags", T.strings(LOW_FLAGS)))
    return rows.withColumn("positive_score", F.round(score, 6)).drop("core", "positive", "negative")


def is_strong() -> Column:
    """G8."""
    c = F.col
    return (c("negative_hits") == 0) & ((c("positive_score") >= 6) | (c("core_hits") >= 2) | ((c("core_hits") >= 1) & (c("mode_hits") >= 1) & ((c("domain_hits") >= 1) | (c("use_hits") >= 1))))


def selection_quality() -> Column:
    """G8."""
    c = F.col
    weak = (c("negative_hits") == 0) & (c("positive_score") >= 2.5) & ((c("core_hits") > 0) | (c("positive_hits") >= 2))
    return F.when(is_strong(), F.lit("strong")).when(weak, F.lit("weak")).otherwise(F.lit("fallback"))


def positives(analyzed: DataFrame, k: int = POSITIVES) -> DataFrame:
    """The first k by class, strength and hits; one of ``fallback`` quality only where it is the first."""
    c = F.col
    primary = (c("core_hits") > 0) | (c("positive_hits") >= 2)
    rows = analyzed.where((c("negative_hits") == 0) & (primary | (c("positive_score") > 0)))
    labels = c("domain_hits") + c("use_hits") + c("mode_hits")
    strong = F.when(primary, is_strong().cast("int")).otherwise(0)
    core = F.when(primary, c("core_hits")).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(primary.desc(), strong.desc(), c("positive_score").desc(), core.desc(), c("positive_hits").desc(), labels.desc(), "doc_id")
    rows = rows.withColumns({"selection": selection_quality(), "_n": F.row_number().over(order)}).where((c("selection") != "fallback") | (c("_n") == 1))
    again = Window.partitionBy("query_id").orderBy("_n")
    return rows.withColumn("_m", F.row_number().over(again)).where(c("_m") <= k).drop("_n", "_m")


def matching_text(*parts: Column) -> Column:
    """Several fields as one text, cleaned for clue matching."""
    return T.keep_words(F.concat_ws(" ", *parts))


def training_text(*parts: Column, most: int = 1600) -> Column:
    """The first field that is not blank, cut."""
    return F.substring(F.coalesce(*(F.when(F.trim(p) != "", F.trim(p)) for p in parts), F.lit("")), 1, most)


def corpus(docs: DataFrame) -> DataFrame:
    """What training keeps of a document: ids, title, source, labels, text."""
    keep = [c for c in ("doc_id", "ref", "title", "source", "inferred_domains", "inferred_use_cases", "inferred_modalities") if c in docs.columns]
    text = [F.col(c) for c in ("semantic_text", "text", "description", "semantic_summary", "title") if c in docs.columns]
    return docs.select(*keep, training_text(*text).alias("text"))


def english(judgments: DataFrame) -> DataFrame:
    """judgments in English."""
    return judgments.where(F.lower(F.trim("language")) == "en")


def rank_score(rank: Column, depth: int = DEPTH) -> Column:
    """1 at the first rank, falling in a line."""
    return F.when(rank <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (rank - 1) / depth))


def negatives(analyzed: DataFrame, results: DataFrame, chosen: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """The hardest results that are no strong positives: near by rank, with negative clues or missing aspects; with a reason."""
    c = F.col
    rows = results.select("query_id", "doc_id", "rank", "score").join(analyzed, ["query_id", "doc_id"]).join(chosen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    wrong = sum((((F.size(f"expected_{n}") > 0) & (c(h) == 0)).cast("int") for n, h in (("domains", "domain_hits"), ("uses", "use_hits"), ("modes", "mode_hits"))), F.lit(0))
    partial = (c("positive_hits") > 0) | (c("domain_hits") > 0) | (c("use_hits") > 0) | (c("mode_hits") > 0)
    rows = rows.withColumns({"wrong_aspects": wrong, "_partial": partial}).where((c("_partial") | (c("negative_hits") > 0)) & ~is_strong())
    hard = 1.7 * rank_score(c("rank")) + 1.1 * c("score") + 1.3 * c("negative_hits") + 0.7 * c("positive_hits") + 0.8 * c("wrong_aspects")
    reason = F.concat_ws(",", F.when(c("negative_hits") > 0, "negative_clue_match"), F.when(c("_partial"), "partial_semantic_overlap"), F.when(c("wrong_aspects") > 0, "missing_query_aspects"))
    rows = rows.withColumns({"hardness": F.round(hard, 6), "reason": F.when(reason == "", F.lit("semantic_neighbor")).otherwise(reason)})
    w = Window.partitionBy("query_id").orderBy(c("hardness").desc(), c("negative_hits").desc(), c("positive_hits").desc(), "doc_id")
    return rows.withColumn("_n", F.row_number().over(w)).where(c("_n") <= k).drop("_n", "_partial")


def triples(chosen: DataFrame, against: DataFrame) -> DataFrame:
    """Every chosen positive with every chosen negative of its query."""
    p = chosen.select("query_id", F.col("doc_id").alias("positive_id"), F.col("selection").alias("positive_selection_quality"))
    n = against.select("query_id", F.col("doc_id").alias("negative_id"), F.col("reason").alias("negative_reason"), F.col("rank").alias("negative_rank_hint"), F.col("hardness").alias("negative_hardness"))
    return p.join(n, "query_id")


def examples(rows: DataFrame, docs: DataFrame, which: str = "train") -> DataFrame:
    """Triplets of a split with the texts of both documents."""
    a = docs.select(F.col("doc_id").alias("positive_id"), F.col("text").alias("positive_text"))
    b = docs.select(F.col("doc_id").alias("negative_id"), F.col("text").alias("negative_text"))
    return rows.where(F.col("split") == which).join(a, "positive_id").join(b, "negative_id")
