"""Queries of metrics, summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as Q
from ..operators import evaluate, lexical
from ..operators import quantiles as Z
from . import frames
from .sql import JUDGED, NEAREST, RANKED, ranked
from .text_queries import QUALITY_CTE

METHODS = ("bm25", "flat")
#: The second method: term frequency counts for little, length for much.
FLAT_K1, FLAT_B = 0.2, 1.0


def _results(spark, sf, k: int):
    """Two methods over one scan's tokens: BM25 as it is, and with other parameters (``flat``)."""
    queries, docs = frames.bm25_queries(spark, sf), frames.tokenised(spark, sf)
    found = lexical.search_settings(queries, docs, k, [(lexical.K1, lexical.B), (FLAT_K1, FLAT_B)])
    # Metrics read the results several times; they are k rows a query and method.
    return frames.settled(found.withColumn("method", F.element_at(F.array(*map(F.lit, METHODS)), F.col("setting").cast("int") + 1)).drop("setting"), "results")


_FLAT = f"""s2 AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {1 + FLAT_K1}::DOUBLE / (tf + {FLAT_K1}::DOUBLE * ({1 - FLAT_B}::DOUBLE + {FLAT_B}::DOUBLE * dl / avgdl)))), 6) AS score
      FROM q JOIN tf USING (token) JOIN df USING (token) CROSS JOIN st GROUP BY query_id, doc_id)"""
RESULTS = f"""{RANKED}, {_FLAT}, {ranked(40)}, {ranked(40, 's2', 'r2')}, {JUDGED},
x AS (SELECT 'bm25' AS method, query_id, doc_id, rank FROM r UNION ALL SELECT 'flat', query_id, doc_id, rank FROM r2),
sz AS (SELECT query_id, count(*) AS n FROM j GROUP BY query_id), fr AS (SELECT query_id, n, method FROM sz CROSS JOIN (SELECT DISTINCT method FROM x)),
hx AS (SELECT x.*, (j.doc_id IS NOT NULL)::INT AS rel, n FROM x LEFT JOIN j USING (query_id, doc_id) JOIN sz USING (query_id)),
hy AS (SELECT *, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) OVER (PARTITION BY method, query_id ORDER BY rank) AS run FROM hx),
g AS (SELECT method, query_id, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hits, max(CASE WHEN rank = 1 AND rel = 1 THEN 1.0 ELSE 0.0 END) AS p1, min(CASE WHEN rel = 1 THEN rank END) AS fr, sum(CASE WHEN rank <= 5 AND rel = 1 THEN run / rank ELSE 0 END) AS ap,
  count(*) FILTER (WHERE rank <= n AND rel = 1) AS rr, sum(CASE WHEN rank <= 5 AND rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hy GROUP BY method, query_id),
m AS (SELECT fr.method, fr.query_id, fr.n AS relevant_count, CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST(g.fr AS BIGINT) AS first_relevant_rank, round(coalesce(p1, 0)::DOUBLE, 6) AS precision_at_1, round(coalesce(hits, 0) / 5.0::DOUBLE, 6) AS precision_at_k,
  round(coalesce(hits, 0) / fr.n::DOUBLE, 6) AS recall_at_k, CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_at_k, round(coalesce(1 / g.fr::DOUBLE, 0), 6) AS mrr, round(coalesce(ap, 0)::DOUBLE / least(fr.n, 5), 6) AS ap_at_k,
  round(coalesce(rr, 0) / fr.n::DOUBLE, 6) AS r_precision, round(coalesce(dcg, 0)::DOUBLE / list_sum(list_transform(range(1, least(fr.n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_k
  FROM fr LEFT JOIN g ON fr.method = g.method AND fr.query_id = g.query_id)"""


def _metrics(spark, sf):
    return evaluate.metrics(_results(spark, sf, 40), frames.settled(frames.judgments(spark, sf), "judgments"), 5, ("method", "query_id"))


def metrics(spark, sf):
    return _metrics(spark, sf)


METRICS = f"WITH {RESULTS} SELECT * FROM m"


def summary(spark, sf):
    return evaluate.summarize(_metrics(spark, sf), ["method"])


_MEANS = ", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in evaluate.METRICS)
SUMMARY = f"""WITH {RESULTS} SELECT method, count(*) AS queries, count(*) FILTER (WHERE hit_rate_at_k > 0) AS queries_with_hit, count(*) FILTER (WHERE precision_at_1 > 0) AS queries_top1_hit, {_MEANS},
round(avg(first_relevant_rank), 6) AS mean_first_relevant_rank, round(median(first_relevant_rank), 6) AS median_first_relevant_rank FROM m GROUP BY method"""


def by_field(spark, sf):
    m = _metrics(spark, sf).withColumn("size", F.when(F.col("relevant_count") > 1, "several").otherwise("one")).withColumn("parity", F.when(F.col("query_id") % 3 == 0, "").when(F.col("query_id") % 3 == 1, "odd").otherwise("even"))
    return evaluate.summarize_fields(m, ["method"], ["size", "parity"], "mrr")


BY_FIELD = f"""WITH {RESULTS}, f AS (SELECT method, mrr, CASE WHEN relevant_count > 1 THEN 'several' ELSE 'one' END AS size, CASE WHEN query_id % 3 = 1 THEN 'odd' WHEN query_id % 3 = 2 THEN 'even' END AS parity FROM m)
SELECT method, 'all' AS field, NULL AS value, count(*) AS queries, round(avg(mrr), 6) AS mean FROM f GROUP BY method UNION ALL
SELECT method, 'size', size, count(*), round(avg(mrr), 6) FROM f GROUP BY method, size UNION ALL SELECT method, 'parity', parity, count(*), round(avg(mrr), 6) FROM f WHERE parity IS NOT NULL GROUP BY method, parity"""


def pairwise(spark, sf):
    return evaluate.pairwise(_metrics(spark, sf), "method")


_LONG = " UNION ALL ".join(f"SELECT method, query_id, '{m}' AS metric, {m} AS v FROM m" for m in evaluate.METRICS)
PAIRWISE = f"""WITH {RESULTS}, l AS ({_LONG}) SELECT a.method AS left_system, b.method AS right_system, a.metric, count(*) FILTER (WHERE a.v - b.v > 1e-12) AS left_wins, count(*) FILTER (WHERE a.v - b.v < -1e-12) AS right_wins,
count(*) FILTER (WHERE abs(a.v - b.v) <= 1e-12) AS ties, round(avg(a.v - b.v), 6) AS mean_delta, (SELECT count(DISTINCT query_id) FROM m) AS queries FROM l a JOIN l b ON a.query_id = b.query_id AND a.metric = b.metric AND a.method < b.method GROUP BY ALL"""


def quantiles(spark, sf):
    return evaluate.nearest_rank(frames.table(spark, sf, "orders"), "o_totalprice", [0.0, 0.33, 0.5, 0.66, 1.0])


QUANTILES = """WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL)
SELECT """ + ", ".join(f"max(v) FILTER (WHERE k = round_even((n - 1) * {r}, 0)) AS q{round(r * 100)}" for r in (0.0, 0.33, 0.5, 0.66, 1.0)) + " FROM s"  # fmt: skip


def exposure(spark, sf):
    d = frames.described(spark, sf).select("doc_id", "length_bucket")
    return evaluate.exposure(_results(spark, sf, 40), frames.judgments(spark, sf), d, "length_bucket", 5)


EXPOSURE = f"""WITH {RESULTS}, {QUALITY_CTE}, e AS (SELECT mm.method, j.query_id, j.doc_id, lb, rank FROM j JOIN qf USING (doc_id) CROSS JOIN (SELECT DISTINCT method FROM x) mm LEFT JOIN (SELECT * FROM x WHERE rank <= 5) y ON y.method = mm.method AND y.query_id = j.query_id AND y.doc_id = j.doc_id)
SELECT method, lb AS length_bucket, count(*) AS pairs, count(DISTINCT doc_id) AS documents, round(avg((rank IS NOT NULL)::INT), 6) AS hit_rate, round(avg((coalesce(rank, 0) = 1)::INT), 6) AS top1_rate,
round(avg(rank), 6) AS mean_rank_when_hit, round(median(rank), 6) AS median_rank_when_hit FROM e GROUP BY method, lb"""


def padded(spark, sf):
    q = frames.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    r = frames.bm25(spark, sf, 10).where("score > 12").select("query_id", "rank", "doc_id", "score")
    return evaluate.padded(r, q, 10)


PADDED = f"WITH {RANKED}, {ranked(10)} SELECT query_id, p.rank, doc_id, score FROM (SELECT item_id AS query_id, unnest(range(1, 11)) AS rank FROM benchmark) p LEFT JOIN (SELECT * FROM r WHERE score > 12) y USING (query_id, rank)"


def probes(spark, sf):
    """Vectors as probes: the expected text is the query's label, every fourth of them expects nothing."""
    e = frames.table(spark, sf, "embeddings")
    r = frames.nearest(spark, sf, 3).where("doc_id <> query_id or query_id % 100 = 0").join(e.select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("topic "), F.col("label").cast("string")).alias("label")), "doc_id")
    r = r.select(F.when(F.col("query_id") % 150 == 0, "first").otherwise("second").alias("combo"), F.col("query_id").alias("probe_id"), "rank", "label", (F.col("score") < 0.5).alias("weak_match"))
    p = e.where(frames.PROBED).select(F.col("vec_id").alias("probe_id"), F.when(F.col("vec_id") % 200 == 150, "weak").otherwise(F.concat(F.lit("Topic "), F.col("label").cast("string"))).alias("expected"))
    return evaluate.probes(r, p)


PROBES = f"""WITH {NEAREST}, {ranked(3, 'n')}, y AS (SELECT CASE WHEN query_id % 150 = 0 THEN 'first' ELSE 'second' END AS combo, query_id, rank, score < 0.5 AS weak, 'topic ' || e.label AS label, CASE WHEN query_id % 200 = 150 THEN 'weak' ELSE 'topic ' || o.label END AS expected
  FROM r JOIN embeddings e ON e.vec_id = doc_id JOIN embeddings o ON o.vec_id = query_id WHERE doc_id <> query_id OR query_id % 100 = 0),
z AS (SELECT combo, query_id, expected, max(CASE WHEN rank = 1 THEN (rank <= 3 AND contains(label, expected))::INT END) AS p1, max(CASE WHEN rank <= 3 THEN contains(label, expected)::INT END) AS p3, max(CASE WHEN rank = 1 THEN weak::INT END) AS w FROM y GROUP BY ALL)
SELECT combo, count(*) FILTER (WHERE expected <> 'weak') AS in_corpus, round_even(coalesce(avg(p1) FILTER (WHERE expected <> 'weak'), 0), 3) AS p_at_1, round_even(coalesce(avg(p3) FILTER (WHERE expected <> 'weak'), 0), 3) AS p_at_3,
round_even(coalesce(avg(w) FILTER (WHERE expected = 'weak'), 0), 3) AS weak_recall FROM z GROUP BY combo"""


def best_method(spark, sf):
    m = _metrics(spark, sf).withColumn("size", F.when(F.col("relevant_count") > 1, "several").otherwise("one"))
    s = m.groupBy("size", "method").agg(F.round(F.avg("ndcg_at_k"), 6).alias("ndcg"))
    return evaluate.best_by(s, ["size"], "method", "ndcg")


BEST = f"""WITH {RESULTS}, b AS (SELECT CASE WHEN relevant_count > 1 THEN 'several' ELSE 'one' END AS size, method, round(avg(ndcg_at_k), 6) AS ndcg FROM m GROUP BY 1, 2)
SELECT size, method, ndcg FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY ndcg DESC, method) AS k FROM b) WHERE k = 1"""


def event_summary(spark, sf):
    """The summary shapes at the scale of events: type is the method, user the query. Medians take no group into one task."""
    e = frames.table(spark, sf, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))
    middle = Z.medians(e, ["event_type"], "value").withColumn("median", F.round("median", 6))
    return sums.alias("s").join(middle.alias("m"), F.col("s.event_type").eqNullSafe(F.col("m.event_type"))).select("s.*", "m.median")


EVENTS = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(median(value), 6) AS median, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type"


def retriever_dev(spark, sf):
    """Over the list of k only, all queries and by group: vectors, relevant is the same label."""
    e = frames.table(spark, sf, "embeddings").select("vec_id", "label")
    r = frames.nearest(spark, sf, 11).where("doc_id <> query_id")
    r = r.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    q = r.groupBy("query_id", "label").agg(F.max((F.col("dl") == F.col("label")).cast("int")).alias("hit"), F.coalesce(1 / F.min(F.when(F.col("dl") == F.col("label"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    return q.groupingSets([[], [F.col("label")]], "label").agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


DEV = f"""WITH {NEAREST}, {ranked(11, 'n')}, y AS (SELECT r.query_id, o.label, max((e.label = o.label)::INT) AS hit, coalesce(1 / min(CASE WHEN e.label = o.label THEN rank END)::DOUBLE, 0) AS rr FROM r JOIN embeddings e ON e.vec_id = doc_id JOIN embeddings o ON o.vec_id = query_id WHERE doc_id <> query_id GROUP BY ALL)
SELECT label, count(*) AS queries, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM y GROUP BY GROUPING SETS ((), (label))"""

def overview(spark, sf):
    j = frames.judgments(spark, sf).join(frames.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return evaluate.overview(j, ["lang", "source"])


OVERVIEW = f"""WITH {JUDGED}, f AS (SELECT query_id, lang, source, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM j JOIN documents USING (doc_id))
SELECT 'lang' AS field, lang AS value, count(*) AS queries FROM f WHERE n = 1 GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM f WHERE n = 1 GROUP BY source"""


def row_for(spark, sf):
    return evaluate.row_for(summary(spark, sf), method="bm25")


QUERIES = {
    "c3_a16_a18_overview": (overview, OVERVIEW),
    "j19_row_lookup": (row_for, f"SELECT * FROM ({SUMMARY}) WHERE method = 'bm25'"),
    "e1_e9_w2_metrics": (metrics, METRICS),
    "a9_summary": (summary, SUMMARY),
    "a10_summary_by_field": (by_field, BY_FIELD),
    "a11_j11_pairwise": (pairwise, PAIRWISE),
    "a14_nearest_rank_quantiles": (quantiles, QUANTILES),
    "j10_a13_exposure": (exposure, EXPOSURE),
    "w5_e14_padded_export": (padded, PADDED),
    "a21_probes": (probes, PROBES),
    "a19_c4_best_method": (best_method, BEST),
    "a9_s6_event_summary": (event_summary, EVENTS),
    "e10_a20_retriever_dev": (retriever_dev, DEV),
}
