"""Queries of retrieval, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import dense, engine, fusion, index_store, lexical, records, rerank, vector_index
from ..operators import planner as P
from . import frames
from .sql import CORPUS, NEAREST, RANKED, lit, ranked, toks
from .text_queries import QUALITY_CTE


def index_stats(spark, sf):
    i = lexical.build_index(frames.tokenised(spark, sf))
    return i.frequencies.select("token", "df", F.round("idf", 6).alias("idf"))


INDEX = f"""WITH {RANKED} SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN st"""


def postings(spark, sf):
    i = lexical.build_index(frames.tokenised(spark, sf))
    return i.postings.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("top_tf"), F.max("dl").alias("dl"))


POSTINGS = f"WITH {RANKED} SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, max(tf) AS top_tf, max(dl) AS dl FROM tf GROUP BY doc_id"


def bm25_search(spark, sf):
    return frames.bm25(spark, sf, 5)


BM25 = f"WITH {RANKED}, {ranked(5)} SELECT query_id, doc_id, score, rank FROM r"


def bm25_index_search(spark, sf):
    """The same search over the stored index, with blocks skipped."""
    return frames.stored_index(spark, sf).search(frames.bm25_queries(spark, sf), 5)


def index_blocks(spark, sf):
    """Blocks of each query's tokens, and how many of them the search opens."""
    return frames.stored_index(spark, sf).blocks_read(frames.bm25_queries(spark, sf), 5)


def index_append(spark, sf):
    """An index of a third of the documents, the rest added in two steps (the second offers known ones again), made one segment, and searched."""
    at, t = frames.folder(spark, "grown-index"), frames.tokenised(spark, sf)
    index_store.build(t.where("doc_id % 3 = 0"), at)
    index_store.append(t.where("doc_id % 3 = 1"), at)
    index_store.append(t.where("doc_id % 3 > 0"), at)
    grown = index_store.StoredIndex.open(spark, at)
    assert len(grown.segments) == 3
    index_store.compact(spark, at)
    return index_store.StoredIndex.open(spark, at).search(frames.bm25_queries(spark, sf), 5)


def field_bm25(spark, sf):
    """Parts as documents with weighted fields, benchmark words replaced by part words: names of ids divisible by 50 are queries."""
    p = frames.table(spark, sf, "part")
    d = p.select(F.col("p_partkey").alias("doc_id"), lexical.document_tokens(F.col("p_name"), F.array("p_brand"), F.col("p_type")).alias("tokens"))
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.array_distinct(T.tokens(F.concat_ws(" ", "p_name", "p_type")))).alias("token"), F.lit(1).cast("long").alias("qf"))
    return lexical.search(q, d, 5)


FIELD = f"""
WITH t AS (SELECT p_partkey AS doc_id, flatten([{toks('p_name')}, {toks('p_name')}, {toks('p_name')}, {toks('p_brand')}, {toks('p_brand')}, {toks('p_type')}]) AS tk FROM part),
st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM t WHERE len(tk) > 0),
tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS token FROM t) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT p_partkey AS query_id, unnest(list_distinct({toks("concat_ws(' ', p_name, p_type)")})) AS token FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token) CROSS JOIN st GROUP BY query_id, doc_id),
{ranked(5)} SELECT query_id, doc_id, score, rank FROM r"""


def knn(spark, sf):
    return frames.nearest(spark, sf, 5)


KNN = f"WITH {NEAREST}, {ranked(5, 'n')} SELECT query_id, doc_id, score, rank FROM r"


def knn_expression(spark, sf):
    e = frames.table(spark, sf, "embeddings")
    return dense.knn_sql(e.where(frames.PROBED).select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), 5)


def _variants(spark, sf):
    """Of the vectors with ids divisible by 50, number 3q is a query's first variant, 3q+1 its second (weight 0.8), 3q and 3q+2 its aspects."""
    e = frames.table(spark, sf, "embeddings").select("vec_id", "embedding")
    near = dense.knn(e.where(frames.PROBED), e, 40, query_id="vec_id", doc_id="vec_id")
    q, r = F.floor(F.col("query_id") / 150).cast("long"), F.floor(F.col("query_id") / 50) % 3
    v = near.where(r < 2).select(q.alias("query_id"), "doc_id", "score", F.when(r == 0, 1.0).otherwise(0.8).alias("weight"))
    a = near.where(r != 1).select(q.alias("query_id"), "doc_id", F.when(r == 0, "x").otherwise("y").alias("aspect"), "score")
    n = e.where(frames.PROBED).select(F.floor(F.col("vec_id") / 150).cast("long").alias("query_id"), F.lit(2).cast("long").alias("n_aspects")).distinct()
    return dense.fuse(v, a, n)


def variant_fusion(spark, sf):
    out = lexical.top_k(_variants(spark, sf), 10)
    six = lambda c: F.round(c, 6).alias(c)
    return out.select("query_id", "doc_id", "score", "rank", six("max_score"), six("weight_hits"), "variant_hits", "aspect_hits", F.round("aspect_avg", 9).alias("aspect_avg"), six("aspect_min"), six("aspect_coverage"))


FUSED = f"""
n AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
{ranked(40, 'n', 'g0')}, h AS (SELECT query_id // 50 AS query_id, doc_id, score, rank FROM g0),
v AS (SELECT query_id // 3 AS query_id, doc_id, max(score * CASE WHEN query_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS mx, count(*) AS hits, sum(CASE WHEN query_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS w FROM h WHERE query_id % 3 < 2 GROUP BY ALL),
a AS (SELECT query_id // 3 AS query_id, doc_id, max(CASE WHEN query_id % 3 = 0 THEN greatest(score, 0.0::DOUBLE) END) AS x, max(CASE WHEN query_id % 3 = 2 THEN greatest(score, 0.0::DOUBLE) END) AS y FROM h WHERE query_id % 3 <> 1 GROUP BY ALL),
f AS (SELECT query_id, doc_id, coalesce(mx, 0.0::DOUBLE) AS mx, coalesce(hits, 0) AS hits, coalesce(w, 0.0::DOUBLE) AS w, coalesce(x, 0.0::DOUBLE) AS x, coalesce(y, 0.0::DOUBLE) AS y FROM v FULL OUTER JOIN a USING (query_id, doc_id)),
g AS (SELECT *, (x + y) / 2 AS av, least(x, y) AS mi, (x >= 0.18)::INT + (y >= 0.18)::INT AS ah FROM f),
s AS (SELECT *, round(mx + 0.015::DOUBLE * w + 0.01::DOUBLE * greatest(hits - 1, 0) + 0.2::DOUBLE * av + 0.08::DOUBLE * mi + 0.035::DOUBLE * greatest(ah - 1, 0) - 0.03::DOUBLE * greatest(2 - ah, 0), 6) AS score FROM g)"""
FUSION = f"""
WITH {FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, rank, round(mx, 6) AS max_score, round(w, 6) AS weight_hits, hits AS variant_hits, CAST(ah AS BIGINT) AS aspect_hits, round(av, 9) AS aspect_avg, round(mi, 6) AS aspect_min, round(ah / 2, 6) AS aspect_coverage FROM r WHERE rank <= 10"""


def cross_profile(spark, sf):
    """Two encoders: the vectors, and their first 32 dimensions."""
    e = frames.table(spark, sf, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 32).alias("half"))
    p = dense.knn(e.where(frames.PROBED), e, 20, query_id="vec_id", doc_id="vec_id")
    a = dense.knn(e.where(frames.PROBED), e, 20, "vec_id", "half", "vec_id", "half")
    return lexical.top_k(fusion.cross_profile(p, a), 10)


def _mm(name: str, source: str, out: str) -> str:
    return f"{out} AS (SELECT query_id, doc_id, score AS {name}_score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS {name}_norm FROM {source} WINDOW w AS (PARTITION BY query_id))"


CROSS = f"""
WITH {NEAREST}, h AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
{ranked(20, 'n', 'p')}, {ranked(20, 'h', 'a')}, {_mm('p', 'p', 'pn')}, {_mm('a', 'a', 'an')},
s AS (SELECT query_id, doc_id, round(coalesce(0.72::DOUBLE * p_norm, 0) + coalesce(CASE WHEN p_norm IS NOT NULL THEN 0.58::DOUBLE ELSE 0.58::DOUBLE * 0.62::DOUBLE END * a_norm, 0) + CASE WHEN p_norm IS NOT NULL AND a_norm IS NOT NULL THEN 0.03::DOUBLE ELSE 0 END, 6) AS score,
  CAST((p_norm IS NOT NULL)::INT + (a_norm IS NOT NULL)::INT AS BIGINT) AS support FROM pn FULL OUTER JOIN an USING (query_id, doc_id))
SELECT query_id, doc_id, score, support, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


def confidence(spark, sf):
    r = fusion.annotate(frames.nearest(spark, sf, 20), 5)
    return r.select("query_id", "doc_id", "score", "rank", "query_confidence", "weak_match")


CONFIDENCE = f"""
WITH {NEAREST}, {ranked(20, 'n')}, c AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r), d AS (SELECT *, CASE WHEN best >= 0.62 THEN 'strong' WHEN best < 0.5 THEN 'weak' ELSE 'moderate' END AS query_confidence FROM c)
SELECT query_id, doc_id, score, rank, query_confidence, score < 0.5 AND query_confidence <> 'strong' AS weak_match FROM d WHERE rank <= 5"""


def _semantic(spark, sf):
    """Vectors stand for documents of the same id."""
    return frames.nearest(spark, sf, 100)


def hybrid(spark, sf):
    q = frames.described(spark, sf).select("doc_id", "score_penalty", "score_bonus")
    return fusion.hybrid(_semantic(spark, sf), frames.bm25(spark, sf, 100), q, 10)


HYBRID_CTE = f"""{RANKED}, {NEAREST}, {ranked(100, 'n', 'sr')}, {ranked(100, 's', 'br')}, {_mm('semantic', 'sr', 'sn')}, {_mm('bm25', 'br', 'bn')}, {QUALITY_CTE},
h AS (SELECT query_id, doc_id, semantic_score, bm25_score, round(0.6::DOUBLE * coalesce(semantic_norm, 0) + (1 - 0.6::DOUBLE) * coalesce(bm25_norm, 0) - 0.08::DOUBLE * coalesce(round(p::DOUBLE, 4), 0) + 0.08::DOUBLE * coalesce(round(bo::DOUBLE, 4), 0), 6) AS score
  FROM sn FULL OUTER JOIN bn USING (query_id, doc_id) LEFT JOIN qf USING (doc_id))"""
HYBRID = f"WITH {HYBRID_CTE} SELECT query_id, doc_id, semantic_score, bm25_score, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 10"


def quality_adjusted(spark, sf):
    r = _semantic(spark, sf).drop("rank").join(frames.described(spark, sf).select("doc_id", "score_penalty", "score_bonus"), "doc_id")
    r = r.withColumn("adjusted", F.round(fusion.quality_adjusted(F.col("score"), fusion.SEMANTIC_QUALITY), 6)).select("query_id", "doc_id", "score", "adjusted")
    return lexical.top_k(r, 10, score="adjusted")


ADJUSTED = f"""
WITH {NEAREST}, {ranked(100, 'n', 'sr')}, {QUALITY_CTE}, a AS (SELECT query_id, doc_id, score, round(score - 0.12::DOUBLE * round(p::DOUBLE, 4) + 0.12::DOUBLE * round(bo::DOUBLE, 4), 6) AS adjusted FROM sr JOIN qf USING (doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, doc_id) AS rank FROM a) WHERE rank <= 10"""


def source_filter(spark, sf):
    """All documents with a token of the query are candidates, at any size of the corpus."""
    docs = frames.spread(frames.table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "source", T.tokens(F.col("text")).alias("tokens"))
    return fusion.source_search(frames.bm25_queries(spark, sf), docs, "src3", 5)


SOURCE = f"""WITH {RANKED}, e AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM s GROUP BY query_id),
u AS (SELECT query_id, doc_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS score, CASE WHEN hi >= 0.62 THEN 'strong' WHEN hi < 0.5 THEN 'weak' ELSE 'moderate' END AS query_confidence
  FROM s JOIN e USING (query_id) JOIN documents USING (doc_id) WHERE source = 'src3')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u) WHERE rank <= 5"""


def _vector_index(spark, sf):
    at = frames.folder(spark, "vector-index")
    e = frames.table(spark, sf, "embeddings")
    vector_index.build(e, at, "vec_id")
    return vector_index.VectorIndex.open(spark, at), e.where(frames.PROBED).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_cells(spark, sf):
    """Exact search over cells, those skipped that cannot hold a result."""
    index, probes = _vector_index(spark, sf)
    return index.search(probes, 5)


def vector_recall(spark, sf):
    """The share of the exact ten nearest that three fifths of the cells hold."""
    index, probes = _vector_index(spark, sf)
    cells = spark.read.parquet(f"{index.root}/cells").count()
    return vector_index.recall(index.search(probes, 10, probes=-(-cells * 3 // 5)), frames.nearest(spark, sf, 10))


def min_max(spark, sf):
    r = frames.bm25(spark, sf, 10)
    return r.select("query_id", "doc_id", F.round(fusion.min_max(F.col("score")), 6).alias("norm"))


MIN_MAX = f"WITH {RANKED}, {ranked(10)}, {_mm('x', 'r', 'm')} SELECT query_id, doc_id, round(x_norm, 6) AS norm FROM m"


def _plans(spark, sf):
    """Benchmark items as queries: their first eight tokens are the focus, the first three the concepts."""
    b = frames.table(spark, sf, "benchmark")
    t = T.tokens(F.col("text"))
    none = F.array().cast("array<string>")
    return b.select(
        F.col("item_id").alias("query_id"), F.array_join(F.slice(t, 1, 2), " ").alias("intent_body"), F.col("text").alias("original_query"), T.normalize(F.col("text")).alias("normalized_query"), F.slice(t, 1, 8).alias("raw_focus_terms"),
        F.slice(t, 1, 3).alias("concept_terms"), F.slice(t, 1, 8).alias("focus_terms"), F.array(F.lit("nlp_text")).alias("domains"), none.alias("semantic_aspects"),
    )


def anchors(spark, sf):
    c = frames.corpus(spark, sf).select("doc_id", records.token_set(F.col("title"), F.col("description"), F.array_join("keywords", " ")).alias("token_set"))
    df, total = lexical.document_frequencies(c)
    a = P.anchors(_plans(spark, sf), df, total)
    return a.select("query_id", F.array_join("primary", ",").alias("primary_anchors"), F.array_join("secondary", ",").alias("secondary_anchors"))


ANCHOR_CTE = f"""
ts AS (SELECT doc_id, list_distinct(flatten([{toks('title')}, {toks('description')}, {toks("array_to_string(keywords, ' ')")}])) AS tk FROM c),
ad AS (SELECT token, count(*) AS df FROM (SELECT unnest(tk) AS token FROM ts) GROUP BY token), tn AS (SELECT count(*) AS total FROM ts),
ac AS (SELECT DISTINCT item_id AS query_id, token FROM (SELECT item_id, unnest(({toks('text')})[1:8]) AS token FROM benchmark) WHERE length(token) >= 3 AND NOT list_contains({lit(V.STOPWORDS)}, token) AND NOT list_contains({lit(V.ANCHOR_NOISE)}, token)),
aw AS (SELECT query_id, token, CASE WHEN coalesce(df, 0) <= 0 THEN ln(1 + total) ELSE ln(1 + (total - df + 0.5) / (df + 0.5)) END AS w FROM ac LEFT JOIN ad USING (token) CROSS JOIN tn),
am AS (SELECT query_id, token, w >= greatest(max(w) OVER (PARTITION BY query_id) - 0.6, 0) AS p FROM aw),
an AS (SELECT item_id AS query_id, list_sort(coalesce(list(token) FILTER (WHERE p), [])) AS pr, list_sort(coalesce(list(token) FILTER (WHERE NOT p), [])) AS se FROM benchmark LEFT JOIN am ON item_id = query_id GROUP BY item_id)"""
ANCHORS = f"WITH {CORPUS}, {ANCHOR_CTE} SELECT query_id, array_to_string(pr, ',') AS primary_anchors, array_to_string(se, ',') AS secondary_anchors FROM an"


def _asked_words(plans):
    """(token) of all words that can be anchors."""
    return plans.select(F.explode(P.anchor_candidates(F.col("raw_focus_terms"), F.col("concept_terms"))).alias("token"))


def reranked(spark, sf):
    """Features are made of the candidates alone; of all documents only how many have the queries' words."""
    sets = frames.corpus(spark, sf).select(records.token_set(F.col("title"), F.col("description"), F.array_join("keywords", " ")).alias("token_set"))
    plans = _plans(spark, sf)
    q = rerank.query_features(plans, P.anchors(plans, *lexical.document_frequencies(sets, of=_asked_words(plans))))
    found = frames.bm25(spark, sf, 40)
    c = frames.described(spark, sf, found)
    out = rerank.rerank(found.withColumn("score", F.round(fusion.min_max(F.col("score")), 6)), rerank.document_features(c), q, 5, quality_weight=0.18)
    return out.select("query_id", "doc_id", "rank", F.round("rerank_score", 3).alias("rerank_score"), F.round("feature_score", 6).alias("feature_score"), F.round("anchor_bonus", 6).alias("anchor_bonus"), "anchor_penalty", "weak_match", "query_confidence")


def _ov(q: str, d: str) -> str:
    return f"CASE WHEN len({q}) > 0 THEN len(list_intersect(list_distinct({q}), {d})) / len(list_distinct({q})) ELSE 0.0 END"


_JOINED = "array_to_string(" + toks("concat_ws(' ', title, description)") + ", ' ')"
RERANK = f"""
WITH {RANKED}, {ranked(40, 's', 'r0')}, {_mm('x', 'r0', 'm0')}, r AS (SELECT query_id, doc_id, round(x_norm, 6) AS score FROM m0), {QUALITY_CTE}, {ANCHOR_CTE},
pl AS (SELECT item_id AS query_id, list_distinct(({toks('text')})[1:8]) AS focus, list_distinct(({toks('text')})[1:3]) AS con, array_to_string(({toks('text')})[1:2], ' ') AS intent FROM benchmark),
ft AS (SELECT r.query_id, r.doc_id, r.score, de, u, severity, round(p::DOUBLE, 4) AS qp, round(bo::DOUBLE, 4) AS qb, pr, se, tk,
  CASE WHEN max(r.score) OVER w = min(r.score) OVER w THEN 1.0 ELSE (r.score - min(r.score) OVER w) / (max(r.score) OVER w - min(r.score) OVER w) END AS base, max(r.score) OVER w AS best,
  {_ov('focus', toks('title'))} AS tf0, {_ov('con', toks("array_to_string(keywords, ' ')"))} AS kc, {_ov('con', toks('description'))} AS dc,
  CASE WHEN len(string_split(intent, ' ')) >= 2 AND contains({_JOINED}, intent) THEN 1.0 ELSE 0.0 END AS ip
  FROM r JOIN qf USING (doc_id) JOIN ts USING (doc_id) JOIN an USING (query_id) JOIN pl USING (query_id) WINDOW w AS (PARTITION BY r.query_id)),
fu AS (SELECT *, CASE WHEN de THEN tf0 * 0.2::DOUBLE ELSE tf0 END AS et, list_intersect(pr, tk) AS mp, list_intersect(se, tk) AS ms FROM ft),
fv AS (SELECT *, greatest(et, kc, dc) AS sup, 0.20::DOUBLE * et + 0.12::DOUBLE * kc + 0.08::DOUBLE * dc + 0.03::DOUBLE * ip AS fs,
  CASE WHEN et > 0 AND dc <= 0.05 AND kc = 0 THEN CASE WHEN de THEN 0.13::DOUBLE ELSE 0.08::DOUBLE END ELSE 0 END AS cp,
  CASE WHEN len(pr) > 0 AND len(mp) = 0 THEN CASE WHEN len(ms) > 0 THEN 0.20::DOUBLE ELSE 0.55::DOUBLE END + CASE WHEN list_has_any(u, ['low_information', 'keyword_only', 'metadata_heavy', 'empty']) THEN 0.20::DOUBLE ELSE 0 END ELSE 0.0 END AS ap,
  coalesce(0.22::DOUBLE * len(mp) / nullif(len(pr), 0), 0) + coalesce(0.08::DOUBLE * len(ms) / nullif(len(se), 0), 0) AS ab FROM fu),
fw AS (SELECT *, round(0.52::DOUBLE * base + (1 - 0.52::DOUBLE) * fs - cp - ap + ab - (0.18::DOUBLE * qp + CASE WHEN sup <= 0.1 AND severity <> 'info' THEN 0.015::DOUBLE ELSE 0 END) + 0.18::DOUBLE * qb, 6) AS rs FROM fv)
SELECT query_id, doc_id, rank, round(rs, 3) AS rerank_score, round(fs, 6) AS feature_score, round(ab, 6) AS anchor_bonus, ap::DOUBLE AS anchor_penalty, score < 0.5 OR (len(pr) > 0 AND len(mp) = 0) AS weak_match,
  CASE WHEN best >= 0.62 THEN 'strong' WHEN best < 0.5 THEN 'weak' ELSE 'moderate' END AS query_confidence
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, doc_id) AS rank FROM fw) WHERE rank <= 5"""


def _overlap_scorer():
    return lambda pairs: [len(set(q.lower().split()) & set(d.lower().split())) - 3.0 for q, d in pairs]


def cross_encoder(spark, sf):
    """A scorer of shared words stands in for a model."""
    score = rerank.scorer_udf(lambda: _overlap_scorer())
    plans = _plans(spark, sf)
    sets = frames.corpus(spark, sf).select(records.token_set(F.col("title"), F.col("description")).alias("token_set"))
    q = rerank.query_features(plans, P.anchors(plans, *lexical.document_frequencies(sets, of=_asked_words(plans))))
    found = frames.bm25(spark, sf, 40)
    c = frames.described(spark, sf, found)
    cand = found.join(plans.select("query_id", "original_query"), "query_id").join(c.select("doc_id", F.substring(T.squeeze(F.col("description")), 1, 3200).alias("text")), "doc_id")
    cand = cand.withColumn("raw", score("original_query", "text")).select("query_id", "doc_id", "score", "raw")
    out = rerank.rerank(cand, rerank.document_features(c), q, 5, cross="raw")
    return out.select("query_id", "doc_id", "rank", "rerank_score", "heuristic_rerank_score", "raw", "cross_encoder_weight", "weak_match")


def encoded(spark, sf):
    """Texts to vectors with the hashing encoder, benchmark items against documents."""
    enc = dense.encoder_udf(dense.hashing_encoder(64))
    d = frames.spread(frames.table(spark, sf, "documents")).select("doc_id", enc("text").alias("embedding"))
    b = frames.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), enc(F.concat(F.lit("query: "), F.col("text"))).alias("embedding"))
    return dense.knn(b, d, 5)


def compared(spark, sf):
    """Benchmark items by all three methods of an engine, which share one scan of the vectors and one of the texts; quality and features are made of the candidates alone. Texts are encoded by hashing."""
    load = dense.hashing_encoder(64)
    docs = frames.corpus(spark, sf).select("doc_id", F.concat(F.lit("ref"), F.col("doc_id").cast("string")).alias("ref"), "source", "title", "description", "keywords", frames.raw_flags(F.col("description")).alias("quality_flags"))
    vectors = docs.select("doc_id", dense.encoder_udf(load)("description").alias("embedding")).persist()
    e = engine.Engine(docs, {"minilm": vectors}, {"minilm": load}, tokens=frames.tokenised(spark, sf), settle=lambda df: frames.settled(df, "compared"))
    asked = frames.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return e.compare(asked, 5, profile="minilm")


def domain_families(spark, sf):
    d = frames.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("hydrology"), F.lit("Finance_Markets"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("hydrology_water"))).otherwise(F.array().cast("array<string>")).alias("a"))
    return d.select("doc_id", F.array_join(F.array_sort(rerank.families(F.col("a"))), ",").alias("families"), F.round(rerank.domain_alignment(F.col("a"), F.array(F.lit("hydrology_water"))), 6).alias("alignment"))


FAMILIES = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'finance,water' WHEN doc_id % 3 = 1 THEN 'water' ELSE '' END AS families, CASE WHEN doc_id % 3 = 0 THEN 0.5 WHEN doc_id % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS alignment FROM documents"

QUERIES = {
    "r2_a1_a3_index_frequencies": (index_stats, INDEX),
    "a1_a3_postings": (postings, POSTINGS),
    "r3_bm25_search": (bm25_search, BM25),
    "r3_bm25_stored_index": (bm25_index_search, BM25),
    "r2_k7_index_blocks": (index_blocks, None),
    "c1_s11_index_append": (index_append, BM25),
    "r1_r3_field_weighted_bm25": (field_bm25, FIELD),
    "j1_x20_t2_knn": (knn, KNN),
    "j1_x20_knn_expression": (knn_expression, KNN),
    "r4_r6_j7_a5_a7_variant_fusion": (variant_fusion, FUSION),
    "r7_j5_cross_profile": (cross_profile, CROSS),
    "r9_r17_w3_confidence": (confidence, CONFIDENCE),
    "r11_j4_a8_hybrid": (hybrid, HYBRID),
    "r8_w1_quality_adjusted": (quality_adjusted, ADJUSTED),
    "k6_s13_vector_cells": (vector_cells, KNN),
    "k6_vector_recall": (vector_recall, None),
    "f3_t3_source_filter": (source_filter, SOURCE),
    "a8_min_max": (min_max, MIN_MAX),
    "q12_r12_r21_anchors": (anchors, ANCHORS),
    "r13_r16_r14_rerank": (reranked, RERANK),
    "r15_domain_families": (domain_families, FAMILIES),
    "r18_r19_r14d_cross_encoder": (cross_encoder, None),
    "m1_x19_encoded_knn": (encoded, None),
    "c2_r10_r22_compare": (compared, None),
}
