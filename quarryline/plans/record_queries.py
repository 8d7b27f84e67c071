"""Queries of record shaping, merging, set operations and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import containment, evaluate, lexical, records
from . import frames
from .sql import JUDGED, lit, toks, words


def _raw(spark, sf):
    """Documents as raw records: references, addresses and tags missing here and there."""
    d = frames.table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i, F.when(i % 3 > 0, F.concat(F.lit("r/"), i.cast("string"))).alias("source_id"), F.when(i % 5 > 0, F.concat(F.lit(" Title "), i.cast("string"), F.lit(" "))).alias("title"), F.when(i % 7 > 0, F.lit("  ")).otherwise(F.col("text")).alias("description"),
        F.when(i % 2 == 0, F.col("text")).alias("text"), F.when(i % 4 == 0, F.lit("http://x.example/y")).alias("url"), F.when(i % 6 == 0, F.upper("lang")).alias("language"),
        F.array(F.concat(F.lit("language:"), F.col("lang"), F.lit(",xx")), F.lit(" "), F.concat(F.lit("license:"), F.col("source")), F.lit("Topic"), F.lit("task_categories:a, b")).alias("tags"),
    )


def fields(spark, sf):
    r = _raw(spark, sf)
    k = records.pick_keywords(r)
    r = r.withColumns({"k": k, "ref": records.pick_ref(r, F.lit("huggingface"))})
    out = r.select(
        "doc_id", F.md5(records.pick_text(r)).alias("text_md5"), "ref", records.pick_url(r, F.lit("huggingface"), F.col("ref"), {"huggingface": "https://hub.example/"}).alias("url"), F.array_join("k", "|").alias("keywords"),
        records.pick_language(F.col("language"), F.col("k")).alias("language"), records.pick_license(F.lit(None).cast("string"), F.col("k")).alias("license"), F.array_join(records.metadata_terms(F.col("k")), "|").alias("terms"),
    )
    return out.where(F.col("text_md5").isNotNull())


FIELDS = """
WITH a AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN text WHEN doc_id % 2 = 0 THEN text END AS t, CASE WHEN doc_id % 3 > 0 THEN 'r/' || doc_id WHEN doc_id % 5 > 0 THEN 'huggingface:Title ' || doc_id END AS ref FROM documents)
SELECT doc_id, md5(trim(t)) AS text_md5, ref, CASE WHEN doc_id % 4 = 0 THEN 'http://x.example/y' ELSE 'https://hub.example/' || ref END AS url, concat_ws('|', 'language:' || lang || ',xx', 'license:' || source, 'Topic', 'task_categories:a, b') AS keywords,
CASE WHEN doc_id % 6 = 0 THEN lang ELSE lang || ',xx' END AS language, source AS license, concat_ws('|', lang, 'xx', 'license:' || source, 'topic', 'a', 'b') AS terms FROM a WHERE t IS NOT NULL"""


def _named(spark, sf):
    c = frames.table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = frames.table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c, s


def merge(spark, sf):
    c, s = _named(spark, sf)
    return records.merge([s, c], ["key"], ["id"])


MERGE = """
WITH u AS (SELECT 'supplier' AS source, s_nationkey AS key, s_suppkey AS id, s_name AS name, 0 AS p FROM supplier UNION ALL SELECT 'customer', c_nationkey, c_custkey, c_name, 1 FROM customer)
SELECT source, key, id, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, id) AS n FROM u) WHERE n = 1"""


def merge_report(spark, sf):
    c, s = _named(spark, sf)
    return records.merge_report({"supplier": s, "customer": c}, records.merge([s, c], ["key"], ["id"]))


REPORT = """
WITH m AS (SELECT source FROM (SELECT source, row_number() OVER (PARTITION BY key ORDER BY p, id) AS n FROM (SELECT 'supplier' AS source, s_nationkey AS key, s_suppkey AS id, 0 AS p FROM supplier UNION ALL SELECT 'customer', c_nationkey, c_custkey, 1 FROM customer)) WHERE n = 1),
i AS (SELECT 'supplier' AS source, count(*) AS input FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer)
SELECT source, input, (SELECT count(*) FROM m WHERE m.source = i.source) AS written, input - (SELECT count(*) FROM m WHERE m.source = i.source) AS skipped FROM i"""


def union_all(spark, sf):
    c, s = _named(spark, sf)
    return evaluate.union_all([c, s.drop("name").withColumn("extra", F.lit(1).cast("long"))])


UNION = "SELECT 'customer' AS source, c_nationkey AS key, c_custkey AS id, c_name AS name, NULL::BIGINT AS extra FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_suppkey, NULL, 1 FROM supplier"


def incremental(spark, sf):
    o = frames.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    have = frames.table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("key"))
    return records.new_rows(o, have, ["key"])


INCREMENTAL = "SELECT o_orderkey AS key, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)"


def missing_refs(spark, sf):
    ev = frames.table(spark, sf, "events").select(F.col("user_id").alias("key"))
    return records.validate_references(ev, frames.table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).where("key % 2 = 0"), "key", fail=False)


MISSING = "SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)"


def first_seen(spark, sf):
    e = frames.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return records.first_by_key(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


FIRST = "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1"


def text_fields(spark, sf):
    """Cards whose text lies in one field or another; blank ones and raw markup do not count before cleaned text."""
    d = frames.table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 6).alias("k"))
    given = lambda n: F.when(F.col("k") <= n, F.concat(F.lit(f"{n} "), F.col("text"))).otherwise(F.lit("  "))
    d = d.select("doc_id", *(given(n).alias(f) for n, f in enumerate(records.TEXT_FIELDS)))
    return d.select("doc_id", F.md5(records.pick_text(d)).alias("text_md5"))


TEXT_FIELD = "SELECT doc_id, md5(trim((doc_id % 6) || ' ' || text)) AS text_md5 FROM documents"


def arrays(spark, sf):
    c = frames.corpus(spark, sf)
    a, b = T.tokens(F.col("title")), T.tokens(F.col("description"))
    return c.select("doc_id", F.array_join(F.array_distinct(a), " ").alias("distinct_"), F.size(F.array_intersect(a, b)).cast("long").alias("common"), F.round(T.overlap(a, b), 6).alias("ratio"), F.size(F.array_except(a, b)).cast("long").alias("left_only"), F.size(F.array_union(a, b)).cast("long").alias("all_"))


ARRAYS = f"""
WITH x AS (SELECT doc_id, {toks("array_to_string((" + words('text') + ")[1:6], ' ')")} AS a, {toks('text')} AS b FROM documents),
y AS (SELECT doc_id, a, b, list_distinct(a) AS da, list_distinct(b) AS db FROM x)
SELECT doc_id, array_to_string(list_filter(a, lambda t, i: list_position(a, t) = i), ' ') AS distinct_, CAST(len(list_intersect(da, db)) AS BIGINT) AS common, CASE WHEN len(da) > 0 THEN round(len(list_intersect(da, db)) / len(da), 6) ELSE 0.0 END AS ratio,
CAST(len(da) - len(list_intersect(da, db)) AS BIGINT) AS left_only, CAST(len(da) + len(db) - len(list_intersect(da, db)) AS BIGINT) AS all_ FROM y"""


def containment_join(spark, sf):
    return frames.judgments(spark, sf)


def value_counts(spark, sf):
    d = frames.corpus(spark, sf)
    return records.value_counts(d, "keywords")


VALUES = "SELECT v AS value, count(*) AS n FROM (SELECT unnest([lang, source]) AS v FROM documents) GROUP BY v"


def groups(spark, sf):
    g = records.grouped(frames.judgments(spark, sf), "query_id", "doc_id")
    return g.select("query_id", F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("docs"))


GROUPS = f"WITH {JUDGED} SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM j GROUP BY query_id"


def semi_anti(spark, sf):
    j = frames.judgments(spark, sf).select("doc_id").distinct()
    d = frames.table(spark, sf, "documents")
    a = d.join(j, "doc_id", "left_semi").select(F.lit("relevant").alias("kind"), "source")
    b = d.join(j, "doc_id", "left_anti").select(F.lit("other").alias("kind"), "source")
    return a.unionAll(b).groupBy("kind", "source").agg(F.count("*").alias("n"))


SEMI = f"WITH {JUDGED} SELECT CASE WHEN doc_id IN (SELECT doc_id FROM j) THEN 'relevant' ELSE 'other' END AS kind, source, count(*) AS n FROM documents GROUP BY ALL"


def display_keys(spark, sf):
    r = frames.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("ref"), "source", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("title"))
    r = records.defaults(r, {"benchmark": "unknown", "title": ""})
    return r.select("doc_id", records.rank_key(F.col("ref"), F.col("source"), F.col("title")).alias("key"), "benchmark")


KEYS = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE source || ':' || CASE WHEN doc_id % 3 > 0 THEN lang ELSE '' END END AS key, 'unknown' AS benchmark FROM documents"


def rerank_texts(spark, sf):
    d = frames.table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    return d.select("doc_id", F.md5(records.rerank_text(none, F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.lit(" "), none, F.concat(F.col("lang"), F.lit("  x")))).alias("md5"))


RERANK_TEXT = r"SELECT doc_id, md5(substr(CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE lang || ' x' END, 1, 3200)) AS md5 FROM documents"

QUERIES = {
    "p1_text_fields": (text_fields, TEXT_FIELD),
    "p1_p7_record_fields": (fields, FIELDS),
    "u2_w6_merge_distinct": (merge, MERGE),
    "u2_merge_report": (merge_report, REPORT),
    "u1_u3_k3_union_all": (union_all, UNION),
    "s11_incremental_anti_join": (incremental, INCREMENTAL),
    "f7_validate_references": (missing_refs, MISSING),
    "w6_a18_first_by_key": (first_seen, FIRST),
    "u4_u9_array_sets": (arrays, ARRAYS),
    "j17_containment_join": (containment_join, f"WITH {JUDGED} SELECT query_id, doc_id FROM j"),
    "a15_value_counts": (value_counts, VALUES),
    "a17_grouped_values": (groups, GROUPS),
    "j9_semi_anti": (semi_anti, SEMI),
    "p13_p14_display_keys": (display_keys, KEYS),
    "x15_x16_rerank_text": (rerank_texts, RERANK_TEXT),
}
