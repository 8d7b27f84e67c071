"""Queries of training-set construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, training
from . import frames
from .sql import JUDGED, NEAREST, RANKED, ranked


def splits(spark, sf):
    d = frames.table(spark, sf, "documents")
    return d.select("doc_id", training.split(F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("split"))


SPLITS = "SELECT doc_id, CASE WHEN CAST(concat('0x', substr(md5('q' || doc_id), 1, 8)) AS BIGINT) % 7 < 1 THEN 'dev' ELSE 'train' END AS split FROM documents"


def _judged(spark, sf):
    j = frames.judgments(spark, sf)
    return j.join(frames.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")


def pairs(spark, sf):
    d = frames.corpus(spark, sf)
    p = training.pairs(_judged(spark, sf), d)
    return p.select("query_id", F.md5("query").alias("query_md5"), "positive_id", "positive_title", "positive_source", "split")


PAIRS = rf"""
WITH {JUDGED}, p AS (SELECT j.query_id, b.text AS query, j.doc_id, row_number() OVER (PARTITION BY b.text, j.doc_id ORDER BY j.query_id) AS n FROM j JOIN benchmark b ON b.item_id = j.query_id)
SELECT query_id, md5(query) AS query_md5, p.doc_id AS positive_id, array_to_string((regexp_extract_all(d.text, '\S+'))[1:6], ' ') AS positive_title, source AS positive_source, CASE WHEN CAST(concat('0x', substr(md5(CAST(query_id AS VARCHAR)), 1, 8)) AS BIGINT) % 7 < 1 THEN 'dev' ELSE 'train' END AS split
FROM p JOIN documents d USING (doc_id) WHERE n = 1"""


def _label_docs(spark, sf):
    """Labels of documents from their language and source."""
    d = frames.table(spark, sf, "documents")
    return d.select("doc_id", F.array("lang").alias("domains"), F.array("source").alias("uses"), F.array(F.when(F.col("doc_id") % 2 == 0, "text").otherwise("image")).alias("modes"))


#: Results of each method that candidates are mined from.
DEPTH = 40


def pool(spark, sf):
    return training.pool({"bm25": frames.bm25(spark, sf, DEPTH), "semantic": frames.nearest(spark, sf, DEPTH)}).select("query_id", "doc_id", F.array_join("methods", ",").alias("methods"), "rank_score")


_POOL = f"""{RANKED}, {ranked(DEPTH)}, {NEAREST}, {ranked(DEPTH, 'n', 'k')}, pl AS (SELECT query_id, doc_id, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, round(sum(w / rank), 6) AS rank_score
FROM (SELECT query_id, doc_id, rank, 'bm25' AS method, 1.5::DOUBLE AS w FROM r UNION ALL SELECT query_id, doc_id, rank, 'semantic', 4.0::DOUBLE FROM k) GROUP BY query_id, doc_id)"""
POOL = f"WITH {_POOL} SELECT * FROM pl"


def triplets(spark, sf):
    q = frames.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.when(F.col("item_id") % 2 == 0, "fr").otherwise("en")).alias("q_domains"))
    p = training.pool({"bm25": frames.bm25(spark, sf, DEPTH), "semantic": frames.nearest(spark, sf, DEPTH)})
    # Read several times: the texts are searched for the items once.
    t = training.triplets(frames.settled(frames.judgments(spark, sf), "judgments"), p, _label_docs(spark, sf), q)
    return t.select("query_id", "positive_id", "negative_id", "negative_hardness", "negative_strategy", "mined_from", "split")


_HARD = "0.8::DOUBLE * (lang = qd)::INT + {a} * (lang = p_lang)::INT + {b} * (source = p_source)::INT + 0.4::DOUBLE * (doc_id % 2 = positive_id % 2)::INT"
TRIPLETS = f"""
WITH {_POOL}, {JUDGED}, po AS (SELECT j.query_id, j.doc_id AS positive_id, lang AS p_lang, source AS p_source, CASE WHEN j.query_id % 2 = 0 THEN 'fr' ELSE 'en' END AS qd FROM j JOIN documents USING (doc_id)),
mi AS (SELECT po.query_id, positive_id, d.doc_id AS negative_id, round(rank_score + {_HARD.format(a='1.2::DOUBLE', b='0.7::DOUBLE')}, 6) AS negative_hardness, 'retrieval_confusion' AS negative_strategy, methods AS mined_from, 0 AS p FROM po JOIN pl USING (query_id) JOIN documents d USING (doc_id) WHERE (po.query_id, d.doc_id) NOT IN (SELECT query_id, doc_id FROM j)),
ba AS (SELECT po.query_id, positive_id, d.doc_id AS negative_id, round({_HARD.format(a='1.0::DOUBLE', b='0.6::DOUBLE')}, 6) AS negative_hardness, 'domain_neighbor_backfill' AS negative_strategy, '' AS mined_from, 1 AS p FROM po CROSS JOIN documents d WHERE (po.query_id, d.doc_id) NOT IN (SELECT query_id, doc_id FROM j)),
al AS (SELECT *, row_number() OVER (PARTITION BY query_id, positive_id, negative_id ORDER BY p) AS one FROM (SELECT * FROM mi UNION ALL SELECT * FROM ba WHERE negative_hardness > 0)),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id, positive_id ORDER BY p, negative_hardness DESC, negative_id) AS k FROM al WHERE one = 1)
SELECT query_id, positive_id, negative_id, negative_hardness, negative_strategy, mined_from, CASE WHEN CAST(concat('0x', substr(md5(CAST(query_id AS VARCHAR)), 1, 8)) AS BIGINT) % 7 < 1 THEN 'dev' ELSE 'train' END AS split FROM tp WHERE k <= 3"""


def _specs(spark):
    rows = [(0, ["that"], ["that", "with", "tion"], ["worthless"], ["en"], ["src1"], ["text"]), (50, ["que"], ["que", "une"], ["idiot"], ["fr"], [], ["image"]), (100, ["der", "und"], ["der", "und", "mit"], ["trash"], ["de"], ["src2", "src3"], [])]
    return spark.createDataFrame(rows, "query_id long, core array<string>, positive array<string>, negative array<string>, expected_domains array<string>, expected_uses array<string>, expected_modes array<string>")


def _analyzed(spark, sf):
    from ..functions import text as T

    d = frames.table(spark, sf, "documents").select("doc_id", T.keep_words(F.col("text")).alias("match_text"), F.array_compact(F.array(F.when(F.length("text") < 80, "short_description"))).alias("flags"))
    return training.analyze(d.join(_label_docs(spark, sf), "doc_id"), _specs(spark))


def analyzed(spark, sf):
    return _analyzed(spark, sf).select("query_id", "doc_id", *(F.col(c).cast("long").alias(c) for c in ("core_hits", "positive_hits", "negative_hits", "domain_hits", "use_hits", "mode_hits")), "positive_score", training.selection_quality().alias("selection"))


_M = r"trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_SPEC = """sp AS (SELECT * FROM (VALUES (0, ['that'], ['that', 'with', 'tion'], ['worthless'], ['en'], ['src1'], ['text']), (50, ['que'], ['que', 'une'], ['idiot'], ['fr'], []::VARCHAR[], ['image']), (100, ['der', 'und'], ['der', 'und', 'mit'], ['trash'], ['de'], ['src2', 'src3'], []::VARCHAR[])) v(query_id, core, positive, negative, ed, eu, em))"""
_ANALYZED = f"""{_SPEC}, dm AS (SELECT doc_id, lang, source, {_M} AS t, length(text) < 80 AS short, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'image' END AS mode FROM documents),
an AS (SELECT query_id, doc_id, ed, eu, em, short, len(list_filter(core, lambda x: contains(t, x))) AS core_hits, len(list_filter(positive, lambda x: contains(t, x))) AS positive_hits, len(list_filter(negative, lambda x: contains(t, x))) AS negative_hits,
  list_contains(ed, lang)::BIGINT AS domain_hits, list_contains(eu, source)::BIGINT AS use_hits, list_contains(em, mode)::BIGINT AS mode_hits FROM dm CROSS JOIN sp),
ay AS (SELECT *, round(4.0::DOUBLE * core_hits + 1.2::DOUBLE * greatest(positive_hits - core_hits, 0) + 1.4::DOUBLE * domain_hits + use_hits + 0.8::DOUBLE * mode_hits - 2.6::DOUBLE * negative_hits - short::INT, 6) AS positive_score FROM an),
az AS (SELECT *, negative_hits = 0 AND (positive_score >= 6 OR core_hits >= 2 OR (core_hits >= 1 AND mode_hits >= 1 AND (domain_hits >= 1 OR use_hits >= 1))) AS strong FROM ay),
aa AS (SELECT *, CASE WHEN strong THEN 'strong' WHEN negative_hits = 0 AND positive_score >= 2.5 AND (core_hits > 0 OR positive_hits >= 2) THEN 'weak' ELSE 'fallback' END AS selection FROM az)"""
ANALYZED = f"WITH {_ANALYZED} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, core_hits, positive_hits, negative_hits, domain_hits, use_hits, mode_hits, positive_score, selection FROM aa"


def positives(spark, sf):
    return training.positives(_analyzed(spark, sf)).select("query_id", "doc_id", "positive_score", "selection")


_CHOSEN = """ch AS (SELECT query_id, doc_id, positive_score, selection FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prim DESC, CASE WHEN prim THEN strong::INT ELSE 0 END DESC, positive_score DESC, CASE WHEN prim THEN core_hits ELSE 0 END DESC, positive_hits DESC,
  domain_hits + use_hits + mode_hits DESC, doc_id) AS n FROM (SELECT *, core_hits > 0 OR positive_hits >= 2 AS prim FROM aa) WHERE negative_hits = 0 AND (prim OR positive_score > 0)) WHERE selection <> 'fallback' OR n = 1) WHERE m <= 2)"""
POSITIVES = f"WITH {_ANALYZED}, {_CHOSEN} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, positive_score, selection FROM ch"


def triples(spark, sf):
    a = _analyzed(spark, sf)
    p = training.positives(a)
    return training.triples(p, training.negatives(a, frames.nearest(spark, sf, 40), p))


TRIPLES = f"""
WITH {_ANALYZED}, {_CHOSEN}, {NEAREST}, {ranked(40, 'n', 'k')},
ng AS (SELECT k.query_id, k.doc_id, k.rank, k.score, negative_hits, positive_hits, positive_hits > 0 OR domain_hits > 0 OR use_hits > 0 OR mode_hits > 0 AS part, (len(ed) > 0 AND domain_hits = 0)::INT + (len(eu) > 0 AND use_hits = 0)::INT + (len(em) > 0 AND mode_hits = 0)::INT AS wrong FROM k JOIN aa USING (query_id, doc_id)
  WHERE NOT strong AND (k.query_id, k.doc_id) NOT IN (SELECT query_id, doc_id FROM ch)),
nh AS (SELECT *, round(1.7::DOUBLE * greatest(0, 1 - (rank - 1) / 40.0::DOUBLE) + 1.1::DOUBLE * score + 1.3::DOUBLE * negative_hits + 0.7::DOUBLE * positive_hits + 0.8::DOUBLE * wrong, 6) AS hardness,
  concat_ws(',', CASE WHEN negative_hits > 0 THEN 'negative_clue_match' END, CASE WHEN part THEN 'partial_semantic_overlap' END, CASE WHEN wrong > 0 THEN 'missing_query_aspects' END) AS reason FROM ng WHERE part OR negative_hits > 0),
ni AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hardness DESC, negative_hits DESC, positive_hits DESC, doc_id) AS n FROM nh)
SELECT ch.query_id::BIGINT AS query_id, ch.doc_id AS positive_id, selection AS positive_selection_quality, ni.doc_id AS negative_id, CASE WHEN reason = '' THEN 'semantic_neighbor' ELSE reason END AS negative_reason, rank AS negative_rank_hint, hardness AS negative_hardness FROM ch JOIN ni ON ch.query_id = ni.query_id WHERE n <= 3"""


def examples(spark, sf):
    d = frames.table(spark, sf, "documents")
    e = training.examples(triplets(spark, sf), d)
    return e.select("query_id", "positive_id", "negative_id", F.md5("positive_text").alias("positive_md5"), F.md5("negative_text").alias("negative_md5"))


EXAMPLES = f"SELECT query_id, positive_id, negative_id, md5(a.text) AS positive_md5, md5(b.text) AS negative_md5 FROM ({TRIPLETS}) t JOIN documents a ON a.doc_id = positive_id JOIN documents b ON b.doc_id = negative_id WHERE split = 'train'"

def training_corpus(spark, sf):
    d = frames.corpus(spark, sf).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("description")))
    return training.corpus(d.drop("description")).select("doc_id", "title", "source", F.md5("text").alias("text_md5"))


_TITLE = r"array_to_string((regexp_extract_all(text, '\S+'))[1:6], ' ')"
CORPUS_SQL = f"SELECT doc_id, {_TITLE} AS title, source, md5(substr(CASE WHEN doc_id % 3 = 0 THEN {_TITLE} ELSE trim(text) END, 1, 1600)) AS text_md5 FROM documents"

QUERIES = {
    "p11_x17_t8_training_corpus": (training_corpus, CORPUS_SQL),
    "g1_hash_split": (splits, SPLITS),
    "g6_j8_pairs": (pairs, PAIRS),
    "g2_j6_candidate_pool": (pool, POOL),
    "g3_g5_j15_t6_triplets": (triplets, TRIPLETS),
    "g7_g8_j12_x18_u8_analyze": (analyzed, ANALYZED),
    "g9_t4_t5_positives": (positives, POSITIVES),
    "g10_g11_j13_triples": (triples, TRIPLES),
    "j14_f5_training_examples": (examples, EXAMPLES),
}
