"""A search engine over a corpus: tables built once, batches of queries answered by three methods."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import vocabulary as V
from . import dense, evaluate, fusion, index_store, lexical, planner, profiles, records, rerank

METHODS = ("semantic", "bm25", "hybrid")
SOURCES = ("all", "kaggle", "huggingface")


@dataclass(frozen=True)
class Options:
    """What a search may switch."""

    rerank: bool = True
    rerank_depth: int = 40
    quality: bool = True
    cross_profile: bool = True
    semantic_weight: float = fusion.SEMANTIC_WEIGHT
    candidates: int = 100


def check_request(query: str, method: str, source: str, k: object, sources: tuple[str, ...] = SOURCES) -> int:
    """F8: a request's parts; raises ValueError, returns the number of results (1 to 20, 5 by default)."""
    if not (query or "").strip():
        raise ValueError("the query is blank")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if source not in sources:
        raise ValueError(f"source must be one of {sources}")
    try:
        return max(1, min(20, int(k if k is not None else 5)))
    except (TypeError, ValueError):
        return 5


@dataclass
class Engine:
    """``docs`` (doc_id and the columns of a normalised document) and vectors by profile (doc_id, embedding).

    Token sets, qualities, postings and document frequencies are computed once and kept; call
    :meth:`save` to keep them beyond the session and :meth:`load` to open what was saved, or
    :meth:`warm` (E13) before timing. With a ``stored`` index no posting is computed, nor with
    ``tokens`` (doc_id, tokens), which BM25 scans once a batch. ``settle`` writes a table and reads it
    back: :meth:`compare` so cuts the plans of what its methods share, which are long; without it they are cached.
    """

    docs: DataFrame
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    encoders: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = field(default_factory=dict)
    rules: V.Rules = field(default_factory=lambda: V.DEFAULT_RULES)
    stored: index_store.StoredIndex | None = None
    tokens: DataFrame | None = None
    settle: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        self.held: list[DataFrame] = []  # of batches; released by close()
        self.warmed, self.number = False, None
        #: Results that the methods of one batch share: BM25's, and the second encoder's nearest documents.
        self.hits: DataFrame | None = None
        self.other: DataFrame | None = None
        d = Q.adjustment(Q.flags(self.docs, "description", "keywords", "quality_flags"))
        self.known = d.persist()
        self.features = rerank.document_features(d).persist()
        self.index = None
        if self.stored is None and self.tokens is None:
            self.index = lexical.build_index(self._tokens())
            self.index.postings = self.index.postings.persist()
            self.index.stats = self.index.stats.persist()
            self.index.frequencies = self.index.frequencies.persist()
        self.frequencies, self.total = lexical.document_frequencies(self.features.withColumnRenamed("d_all", "token_set"))
        self.frequencies, self.total = self.frequencies.persist(), self.total.persist()

    def _tokens(self) -> DataFrame:
        return self.docs.select("doc_id", lexical.document_tokens(F.col("title"), F.col("keywords"), F.col("description")).alias("tokens"))

    def _kept(self) -> list[DataFrame]:
        own = [self.index.postings, self.index.frequencies, self.index.stats] if self.index else []
        return [self.known, self.features, *own, self.frequencies, self.total]

    def warm(self) -> None:
        for t in self._kept():
            t.count()
        self.warmed = True

    def size(self) -> int:
        """All documents, counted once; no text is read for it."""
        if self.number is None:
            self.number = self.docs.count()
        return self.number

    def close(self) -> None:
        for t in [*self._kept(), *self.held]:
            t.unpersist()
        self.held.clear()

    def save(self, root: str, profile: str | None = None) -> dict[str, str]:
        """K6, K7: the documents, the vectors and the lexical index of a profile below ``root``; an index that is there gets the new documents only."""
        at, spark = profiles.paths(root, profile), self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(at["documents"])
        if index_store.exists(spark, at["index"]):
            index_store.append(self._tokens(), at["index"])
        else:
            index_store.build(self._tokens(), at["index"])
        key = profiles.get(profile).key
        if key in self.vectors:
            self.vectors[key].write.mode("overwrite").parquet(at["vectors"])
        return at

    @classmethod
    def load(cls, spark: SparkSession, root: str, profile: str | None = None, encoders: dict | None = None, rules: V.Rules = V.DEFAULT_RULES) -> Engine:
        """An engine over what :meth:`save` wrote; its postings are read as queries ask for them."""
        at, key = profiles.paths(root, profile), profiles.get(profile).key
        vectors = {key: spark.read.parquet(at["vectors"])} if index_store.path_exists(spark, at["vectors"]) else {}
        return cls(spark.read.parquet(at["documents"]), vectors, encoders or {}, rules, index_store.StoredIndex.open(spark, at["index"]))

    def _keep(self, made: DataFrame) -> DataFrame:
        """What several methods of a batch read: written where there is a place for it, or cached."""
        if self.settle is not None:
            return self.settle(made)
        self.held.append(made.persist())
        return made

    def plan(self, queries: DataFrame) -> DataFrame:
        """Q9, kept: pass it to several searches of the same queries."""
        plans = planner.plan(queries, self.rules).persist()
        self.held.append(plans)
        return plans

    def bm25(self, plans: DataFrame, k: int) -> DataFrame:
        if self.hits is not None:
            return self.hits.where(F.col("rank") <= k)
        words = lexical.weighted_query_tokens(plans)
        if self.tokens is not None:
            return lexical.search(words, self.tokens, k)
        return self.stored.search(words, k) if self.stored else lexical.search_index(words, self.index, k)

    def nearest(self, plans: DataFrame, k: int, profile: str) -> DataFrame:
        """(query_id, part, weight, doc_id, score, rank): the k nearest documents of every variant (with its weight), and of every aspect where there are two and more; one scan of the vectors."""
        encode = dense.encoder_udf(self.encoders[profile])
        rows = plans.select("query_id", F.posexplode("semantic_variants").alias("n", "v")).select("query_id", F.concat(F.lit("v"), F.col("n").cast("string")).alias("part"), F.col("v.text").alias("text"), F.col("v.weight").alias("weight"))
        many = plans.where(F.size("semantic_aspects") >= 2)
        rows = rows.unionByName(many.select("query_id", F.posexplode("semantic_aspects").alias("n", "a")).select("query_id", F.concat(F.lit("a"), F.col("n").cast("string")).alias("part"), F.col("a.text").alias("text"), F.lit(None).cast("double").alias("weight")))
        rows = rows.withColumn("probe", F.xxhash64("query_id", "part"))
        rows = rows.withColumn("embedding", encode(profiles.query_text(F.col("text"), profile))).persist()
        self.held.append(rows)
        near = dense.knn(rows, self.vectors[profile], k, query_id="probe").withColumnRenamed("query_id", "probe")
        return near.join(rows.select("probe", "query_id", "part", "weight"), "probe").select("query_id", "part", "weight", "doc_id", "score", "rank")

    def stage_one(self, plans: DataFrame, k: int, profile: str, near: DataFrame | None = None) -> DataFrame:
        """Every variant and aspect is a search of its own; fused. ``near``: what :meth:`nearest` found for these plans to this depth or deeper."""
        hits = self.nearest(plans, k, profile) if near is None else near.where(F.col("rank") <= k)
        counts = plans.where(F.size("semantic_aspects") >= 2).select("query_id", F.size("semantic_aspects").cast("long").alias("n_aspects"))
        return dense.fuse(hits.where("weight is not null"), hits.where("weight is null").withColumnRenamed("part", "aspect"), counts)

    def semantic(self, plans: DataFrame, k: int, profile: str = profiles.DEFAULT, options: Options = Options(), near: DataFrame | None = None) -> DataFrame:
        """Stage one, for Turkish queries fused with a second encoder where there is one, quality, and reranking."""
        n = self.size()
        depth = fusion.depth(k, options.rerank_depth, n) if options.rerank else k
        ranked = self.stage_one(plans, depth, profile, near).select("query_id", "doc_id", "score")
        other = profiles.auxiliary(profile)
        if options.cross_profile and other in self.vectors and other in self.encoders:
            tr = plans.where("detected_language = 'tr'")
            both = fusion.cross_profile(ranked.join(tr.select("query_id"), "query_id", "left_semi"), self.stage_one(tr, depth, other, self.other)).select("query_id", "doc_id", "score")
            ranked = ranked.join(tr.select("query_id"), "query_id", "left_anti").unionByName(both)
        if options.quality:
            ranked = ranked.join(self.known.select("doc_id", "score_penalty", "score_bonus"), "doc_id").withColumn("score", F.round(fusion.quality_adjusted(F.col("score"), fusion.SEMANTIC_QUALITY), 6)).select("query_id", "doc_id", "score")
        if not options.rerank:
            return fusion.annotate(ranked, k)
        return self._rerank(plans, lexical.top_k(ranked, depth), k, 0.52, 0.18 if options.quality else 0.0)

    def hybrid(self, plans: DataFrame, k: int, profile: str = profiles.DEFAULT, options: Options = Options(), near: DataFrame | None = None) -> DataFrame:
        """R11."""
        n = self.size()
        depth = fusion.depth(k, options.candidates, n)
        s = self.semantic(plans, depth, profile, Options(rerank=False, quality=options.quality, cross_profile=options.cross_profile), near)
        quality = self.known.select("doc_id", "score_penalty", "score_bonus") if options.quality else None
        limit = fusion.depth(k, options.rerank_depth, n) if options.rerank else k
        ranked = fusion.hybrid(s, self.bm25(plans, depth), quality, limit, options.semantic_weight)
        return self._rerank(plans, ranked.select("query_id", "doc_id", "score"), k, 0.68, 0.12 if options.quality else 0.0) if options.rerank else ranked

    def _rerank(self, plans: DataFrame, ranked: DataFrame, k: int, base: float, quality: float) -> DataFrame:
        features = rerank.query_features(plans, planner.anchors(plans, self.frequencies, self.total))
        return rerank.rerank(ranked, self.features, features, k, base, quality)

    def search(self, queries: DataFrame, method: str, k: int = 5, source: str = "all", profile: str = profiles.DEFAULT, options: Options = Options(), plans: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
        """Results of one method for (query_id, query), or for their ``plans`` where those are there already. With a source, the whole corpus is ranked first and filtered after, as normalised scores depend on all candidates; BM25 scores do not, and are cut within the source."""
        plans = self.plan(queries) if plans is None else plans
        if method == "bm25" and source != "all" and self.index is not None:
            return fusion.source_top(lexical.index_scores(lexical.weighted_query_tokens(plans), self.index), self.docs, source, k)
        depth = k if source == "all" else self.size()
        ranked = self.bm25(plans, depth) if method == "bm25" else self.semantic(plans, depth, profile, options, near) if method == "semantic" else self.hybrid(plans, depth, profile, options, near)
        if "rerank_score" in ranked.columns:
            ranked = ranked.withColumn("score", F.col("rerank_score"))
        return fusion.post_filter(ranked, self.docs, source, k) if source != "all" else ranked

    def _within(self, found: DataFrame, plans: DataFrame) -> Engine:
        """This engine for a batch that can find the documents ``found`` (doc_id): quality and features of those alone, document frequencies of the batch's words alone. A warm engine has them of all."""
        own = copy.copy(self)
        if self.warmed:
            return own
        docs = self.docs.join(found.distinct(), "doc_id", "left_semi")
        own.features = self._keep(rerank.document_features(Q.adjustment(Q.flags(docs, "description", "keywords", "quality_flags"))))
        own.known = own.features
        words = plans.select(F.explode(planner.anchor_candidates(F.col("raw_focus_terms"), F.col("concept_terms"))).alias("token"))
        own.frequencies, own.total = lexical.document_frequencies(self.docs.select(rerank.all_tokens(self.docs).alias("token_set")), of=words)
        own.frequencies, own.total = self._keep(own.frequencies), self._keep(own.total)
        return own

    def compare(self, queries: DataFrame, k: int = 5, source: str = "all", profile: str = profiles.DEFAULT, options: Options = Options()) -> DataFrame:
        """All three methods side by side: method, query_id, doc_id, rank, score. Semantic and hybrid search take their candidates from one scan of the vectors, BM25 and hybrid search from one of the texts, to the deeper one's depth."""
        plans, n = self._keep(planner.plan(queries, self.rules)), self.size()
        depth = n if source != "all" else max(fusion.depth(k, options.candidates, n), fusion.depth(k, options.rerank_depth, n))
        near, hits = self._keep(self.nearest(plans, depth, profile)), self._keep(self.bm25(plans, depth))
        found, other = [near, hits], profiles.auxiliary(profile)
        second = None
        if options.cross_profile and other in self.vectors and other in self.encoders:
            second = self._keep(self.nearest(plans.where("detected_language = 'tr'"), depth, other))
            found.append(second)
        own = self._within(evaluate.union_all([r.select("doc_id") for r in found]), plans)
        own.hits, own.other = hits, second
        rows = [own.search(queries, m, k, source, profile, options, plans, near).select(F.lit(m).alias("method"), "query_id", "doc_id", "rank", "score") for m in METHODS]
        return evaluate.union_all(rows)

    def evaluate(self, judgments: DataFrame, k: int = 5, methods: tuple[str, ...] = METHODS, profile: str = profiles.DEFAULT) -> DataFrame:
        """Metrics of every judged query and method. ``judgments``: query_id, query, doc_id, one row a relevant document.

        Results are taken to the depth of the largest set of relevant documents. All queries of a method
        run as one batch; latency_ms is the batch's time a query, with the tables warm (E13).
        """
        import time

        queries = judgments.select("query_id", "query").distinct().persist()
        self.held.append(queries)
        n, deepest = queries.count(), judgments.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        parts, plans = [], self.plan(queries)
        for m in methods:
            began = time.perf_counter()
            r = self.search(queries, m, max(k, deepest), profile=profile, plans=plans).select(F.lit(m).alias("method"), F.lit(profile).alias("profile"), "query_id", "doc_id", "rank").persist()
            self.held.append(r)
            r.count()
            parts.append((r, 1000 * (time.perf_counter() - began) / max(n, 1)))
        out = evaluate.metrics(evaluate.union_all([r for r, _ in parts]), judgments.select("query_id", "doc_id"), k, ("profile", "method", "query_id"))
        took = F.create_map(*(F.lit(x) for m, (_, ms) in zip(methods, parts) for x in (m, round(ms, 3))))
        return out.withColumn("latency_ms", took[F.col("method")])

    def probe(self, probes: DataFrame, k: int = 3, methods: tuple[str, ...] = METHODS, profile: str = profiles.DEFAULT) -> DataFrame:
        """Probes (probe_id, query, expected) under every method: combo, probe_id, rank, label (title and reference), weak_match; for :func:`evaluate.probes`."""
        queries = probes.select(F.col("probe_id").alias("query_id"), "query")
        names = self.docs.select("doc_id", F.concat_ws(" ", "title", "ref").alias("label"))
        rows, plans = [], self.plan(queries)
        for m in methods:
            r = self.search(queries, m, k, profile=profile, plans=plans)
            weak = F.col("weak_match") if "weak_match" in r.columns else F.lit(False)
            rows.append(r.join(names, "doc_id").select(F.concat(F.lit(f"{profile}/"), F.lit(m)).alias("combo"), F.col("query_id").alias("probe_id"), "rank", "label", weak.alias("weak_match")))
        return evaluate.union_all(rows)

    def results(self, ranked: DataFrame) -> DataFrame:
        """Ranked rows with their documents' columns."""
        return ranked.join(self.docs.select("doc_id", records.rank_key(F.col("ref"), F.col("source"), F.col("title")).alias("key"), "ref", "title", "source", "description", "keywords"), "doc_id")


def recommendation(summary: DataFrame, style: str, metric: str = "mean_ndcg_at_k") -> DataFrame:
    """The method with the best metric for a query style of a summary (query_style, method, metric)."""
    return evaluate.best_by(summary.where(F.col("query_style") == style), ["query_style"], "method", metric)


def model_effect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two profiles' results of the same queries: shared documents, documents of one only, change of rank."""
    a, b = (d.select("query_id", "doc_id", F.col("rank").alias(n)) for d, n in ((left, "left_rank"), (right, "right_rank")))
    j = a.join(b, ["query_id", "doc_id"], "full_outer")
    return j.groupBy("query_id").agg(
        F.count_if(F.col("left_rank").isNotNull() & F.col("right_rank").isNotNull()).alias("shared"), F.count_if(F.col("right_rank").isNull()).alias("left_only"), F.count_if(F.col("left_rank").isNull()).alias("right_only"),
        F.round(F.avg(F.col("right_rank") - F.col("left_rank")), 6).alias("mean_rank_change"),
    )


def quality_payload(ranked: DataFrame, known: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Bucket of each query's first result and the benchmark's row of that bucket (length_bucket, ...)."""
    first = ranked.where("rank = 1").select("query_id", "doc_id")
    return first.join(known.select("doc_id", "length_bucket", "term_bucket", "severity"), "doc_id").join(benchmark, "length_bucket", "left")


def topic_insight(rows: DataFrame, field: str, metric: str) -> DataFrame:
    """C11: the topics with the largest and the smallest mean of a metric; ties to the smaller name."""
    means = rows.groupBy(field).agg(F.round(F.avg(metric), 6).alias("mean"), F.count("*").alias("n"))
    best = means.agg(F.max_by(field, F.struct("mean", field)).alias("best"), F.min_by(field, F.struct("mean", field)).alias("worst"))
    return best


def topic_sizes(rows: DataFrame, field: str, key: str) -> DataFrame:
    """Distinct keys of each topic, ordered by (count, name) in two columns of the extremes."""
    n = rows.groupBy(field).agg(F.count_distinct(key).alias("n"))
    return n.agg(F.min_by(field, F.struct("n", field)).alias("smallest"), F.max_by(field, F.struct("n", field)).alias("largest"))
