"""Queries of query planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import lexical
from ..operators import planner as P
from ..operators import rule_tables as R
from . import frames
from .sql import lit, norm, toks


def _conversations(spark, sf):
    """First user turns as queries, with phrases around them so that every pattern occurs."""
    c = frames.table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("query_id"), "turn", F.col("text").alias("t"))
    k = F.col("query_id") % 6
    lead = F.when(k == 0, "I am looking for ").when(k == 1, "find me ").when(k == 2, "Bana ").when(k == 3, "I want ").otherwise("")
    return c.select("query_id", "turn", F.concat(lead, F.col("t"), F.when(k == 5, " yağmur").otherwise("")).alias("query"))


_C = "c AS (SELECT conv_id AS query_id, turn, CASE conv_id % 6 WHEN 0 THEN 'I am looking for ' WHEN 1 THEN 'find me ' WHEN 2 THEN 'Bana ' WHEN 3 THEN 'I want ' ELSE '' END || text || CASE WHEN conv_id % 6 = 5 THEN ' yağmur' ELSE '' END AS query FROM conversations WHERE role = 'user')"


def language(spark, sf):
    c = _conversations(spark, sf)
    return c.select("query_id", "turn", P.detect_language(F.col("query"), T.normalize(F.col("query"))).alias("detected_language"))


LANGUAGE = f"WITH {_C} SELECT query_id, turn, CASE WHEN regexp_matches(query, '[{V.TURKISH_FROM}]') OR list_has_any({toks('query')}, {lit(V.TURKISH_MARKERS)}) THEN 'tr' ELSE 'en' END AS detected_language FROM c"


def leading(spark, sf):
    c = _conversations(spark, sf)
    return c.select("query_id", "turn", P.strip_leading(T.normalize(F.col("query"))).alias("body"))


LEADING = rf"""
WITH {_C}, n AS (SELECT query_id, turn, {norm('query')} AS q FROM c),
t AS (SELECT *, trim(regexp_replace(q, '{P.LEADING[0]}', '')) AS a, trim(regexp_replace(q, '{P.LEADING[1]}', '')) AS b, trim(regexp_replace(q, '{P.LEADING[2]}', '')) AS d, trim(regexp_replace(q, '{P.LEADING[3]}', '')) AS e FROM n)
SELECT query_id, turn, CASE WHEN a <> q THEN a WHEN b <> q THEN b WHEN d <> q THEN d WHEN e <> q THEN e ELSE q END AS body FROM t"""


def focus(spark, sf):
    c = _conversations(spark, sf)
    return c.select("query_id", "turn", F.array_join(P.focus_terms(F.col("query")), " ").alias("focus"))


FOCUS = f"""
WITH {_C}, k AS (SELECT query_id, turn, unnest({toks('query')}) AS token, generate_subscripts({toks('query')}, 1) AS i FROM c),
v AS (SELECT *, list_filter({lit(V.TURKISH_SUFFIXES)}, lambda s: ends_with(token, s) AND length(token) - length(s) >= 3)[1] AS suffix FROM k),
e AS (SELECT *, CASE WHEN suffix IS NOT NULL THEN left(token, length(token) - length(suffix)) END AS a,
  CASE WHEN list_contains({lit(V.PLURAL_KEEP)}, token) THEN NULL
       WHEN ends_with(token, 'ies') AND length(token) >= 5 AND substr(token, length(token) - 3, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(token, length(token) - 3) || 'y'
       WHEN ends_with(token, 'ing') AND length(token) >= 7 THEN left(token, length(token) - 3)
       WHEN ends_with(token, 'ed') AND length(token) >= 6 THEN left(token, length(token) - 2)
       WHEN ends_with(token, 's') AND length(token) >= 5 AND NOT (ends_with(token, 'ss') OR ends_with(token, 'us') OR ends_with(token, 'is') OR ends_with(token, 'ies')) THEN left(token, length(token) - 1) END AS b FROM v),
u AS (SELECT query_id, turn, i * 10 AS o, token AS t FROM e UNION ALL SELECT query_id, turn, i * 10 + 1, a FROM e WHERE a IS NOT NULL UNION ALL SELECT query_id, turn, i * 10 + 2, b FROM e WHERE b IS NOT NULL),
f AS (SELECT query_id, turn, t, min(o) AS o FROM u WHERE (length(t) > 2 OR list_contains({lit(V.SHORT_KEEP)}, t)) AND NOT list_contains({lit(V.STOPWORDS)}, t) GROUP BY ALL),
g AS (SELECT query_id, turn, string_agg(t, ' ' ORDER BY o) AS focus FROM f GROUP BY ALL)
SELECT c.query_id, c.turn, coalesce(focus, '') AS focus FROM c LEFT JOIN g ON c.query_id = g.query_id AND c.turn = g.turn"""


def weighted_tokens(spark, sf):
    b = frames.table(spark, sf, "benchmark")
    t = T.tokens(F.col("text"))
    plans = b.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("original_query"), F.slice(t, 1, 6).alias("raw_focus_terms"), F.slice(t, 1, 2).alias("concept_terms"), F.slice(t, 3, 1).alias("domain_terms"),
        F.when(F.col("item_id") % 2 == 0, "tr").otherwise("en").alias("detected_language"),
    )
    return lexical.weighted_query_tokens(plans)


WEIGHTED = f"""
WITH t AS (SELECT item_id AS query_id, {toks('text')} AS k FROM benchmark),
u AS (SELECT query_id, unnest(k) AS token, 1 AS w FROM t UNION ALL SELECT query_id, unnest(k[1:6]), 2 FROM t UNION ALL SELECT query_id, unnest(k[1:2]), CASE WHEN query_id % 2 = 0 THEN 3 ELSE 2 END FROM t UNION ALL SELECT query_id, unnest(k[3:3]), 1 FROM t),
m AS (SELECT * FROM u WHERE length(token) >= 2 AND NOT list_contains({lit(V.STOPWORDS)}, token) AND NOT list_contains({lit(V.LEXICAL_NOISE)}, token)),
f AS (SELECT query_id, unnest(k) AS token, 1 AS w FROM t WHERE query_id NOT IN (SELECT query_id FROM m))
SELECT query_id, token, CAST(sum(w) AS BIGINT) AS qf FROM (SELECT * FROM m UNION ALL SELECT * FROM f WHERE length(token) >= 2) GROUP BY query_id, token"""


def _join(c: str):
    return F.array_join(c, "|").alias(c)


def _asked(spark, sf):
    """All user turns as queries, ids of their own."""
    return _conversations(spark, sf).select((F.col("query_id") * 1_000_000 + F.col("turn")).alias("query_id"), "query")


def plans(spark, sf):
    p = P.plan(_asked(spark, sf))
    aspects = F.array_join(F.transform("semantic_aspects", lambda a: F.concat_ws("=", a["key"], a["text"])), "|").alias("semantic_aspects")
    variants = F.array_join(F.transform("semantic_variants", lambda v: F.concat_ws("=", v["weight"].cast("string"), v["text"])), "|").alias("semantic_variants")
    names = ["raw_focus_terms", "concept_phrases", "concept_terms", "domains", "domain_terms", "task_terms", "focus_terms"]
    return p.select("query_id", "original_query", "normalized_query", "detected_language", "intent_body", *map(_join, names), "lexical_query", "concise_intent", aspects, variants, "has_multi_aspect_intent", "is_sentence_query", P.too_generic(F.col("raw_focus_terms"), F.col("concept_terms")).alias("too_generic"), P.out_of_distribution().alias("is_ood"))


def ablated(spark, sf):
    """Plans without rules."""
    p = P.plan(_asked(spark, sf), V.DEFAULT_RULES.without())
    return p.select("query_id", _join("raw_focus_terms"), _join("concept_terms"), P.out_of_distribution().alias("is_ood"))


def labels(spark, sf):
    p = P.plan(_asked(spark, sf))
    return p.select("query_id", *(F.array_join(P.query_labels(F.col("focus_terms"), F.col("normalized_query"), h), ",").alias(n) for n, h in (("use_cases", V.USE_CASE_HINTS), ("modalities", V.MODALITY_HINTS))))


def search(spark, sf):
    """The planned user turns against all documents by words, weights from the plan."""
    # Planning is dear and the search reads its queries several times: plans are made once, in many tasks.
    p = P.plan(frames.spread(_asked(spark, sf)))
    return lexical.search(frames.settled(lexical.weighted_query_tokens(p), "planned-tokens"), frames.tokenised(spark, sf), 5)


def _rule_tables(spark, sf):
    """Rules from the conversations: the first two words of every third conversation's turns as phrases, the third and fifth of every fourth's as combinations, long words of answers as tokens."""
    c = frames.table(spark, sf, "conversations").select("conv_id", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("at"), "role", T.tokens(F.col("text")).alias("k"))
    user = c.where("role = 'user'")
    # A rule's place is its first turn's.
    first = lambda df: df.groupBy(df.columns[1]).agg(F.min("at").alias("rule"))
    p = first(user.where((F.col("conv_id") % 3 == 0) & (F.size("k") >= 2)).select("at", F.concat_ws(" ", F.col("k")[0], F.col("k")[1]).alias("phrase")))
    size = F.length("phrase")
    p = p.select("rule", "phrase", F.concat(F.lit("d"), size % 4).alias("domain"), F.array("phrase", F.lit("known phrase")).alias("terms"), F.array(F.concat(F.lit("task"), size % 3)).alias("tasks"))
    m = first(user.where((F.col("conv_id") % 4 == 1) & (F.size("k") >= 5)).select("at", F.concat_ws(" ", F.col("k")[2], F.col("k")[4]).alias("pair")))
    m = m.select("rule", F.split("pair", " ").alias("tokens"), F.concat(F.lit("d"), F.length("pair") % 5).alias("domain"), F.array("pair").alias("terms"), F.array(F.lit("combined")).alias("tasks"))
    t = c.where("role <> 'user'").select(F.explode("k").alias("token")).where("length(token) >= 6").distinct()
    t = t.select("token", F.when(F.length("token") % 3 > 0, F.concat(F.lit("d"), F.length("token") % 6)).alias("domain"), F.array(F.concat("token", F.lit(" records"))).alias("terms"))
    # Read several times each: texts are taken apart once.
    return R.RuleTables(frames.settled(p, "rule-phrases"), frames.settled(m, "rule-combos"), frames.settled(t, "rule-tokens"))


def _ruled(spark, sf):
    q = _conversations(spark, sf).select((F.col("query_id") * 1_000_000 + F.col("turn")).alias("query_id"), "query")
    return frames.settled(q.select("query_id", T.normalize(F.col("query")).alias("normalized_query"), F.array_distinct(T.tokens(F.col("query"))).alias("raw_focus_terms")), "ruled")


def rule_concepts(spark, sf):
    """Concepts of all user turns from rule tables; words of a turn are its focus terms."""
    out = R.concepts(_ruled(spark, sf), _rule_tables(spark, sf))
    return out.select("query_id", *map(_join, ["concept_phrases", "concept_terms", "domains", "task_terms"]))


RULES = f"""
WITH {_C}, k AS (SELECT conv_id, conv_id * 1000000 + turn AS first_at, role, {toks('text')} AS k FROM conversations),
ph AS (SELECT min(first_at) AS rule, k[1] || ' ' || k[2] AS phrase FROM k WHERE role = 'user' AND conv_id % 3 = 0 AND len(k) >= 2 GROUP BY phrase),
co AS (SELECT min(first_at) AS rule, k[3] || ' ' || k[5] AS pair FROM k WHERE role = 'user' AND conv_id % 4 = 1 AND len(k) >= 5 GROUP BY pair),
tk AS (SELECT DISTINCT token FROM (SELECT unnest(k) AS token FROM k WHERE role <> 'user') WHERE length(token) >= 6),
q AS (SELECT query_id * 1000000 + turn AS query_id, {norm('query')} AS nq, {toks('query')} AS ws FROM c),
f AS (SELECT query_id, token, min(i) AS i FROM (SELECT query_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM q) GROUP BY ALL),
held AS (
  SELECT query_id, 0 AS kind, rule AS place, 2 AS points, 'd' || length(phrase) % 4 AS domain, [phrase, 'known phrase'] AS terms, ['task' || length(phrase) % 3] AS tasks FROM q JOIN ph ON contains(nq, phrase)
  UNION ALL
  SELECT query_id, 1, rule, 2, 'd' || length(pair) % 5, [pair], ['combined'] FROM co JOIN q ON list_has_all(ws, string_split(pair, ' '))
  UNION ALL
  SELECT query_id, 2, i, 1, CASE WHEN length(token) % 3 > 0 THEN 'd' || length(token) % 6 END, [token || ' records'], []::VARCHAR[] FROM f JOIN tk USING (token)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, place) AS o FROM held),
te AS (SELECT query_id, kind, o, unnest(terms) AS term, generate_subscripts(terms, 1) AS j FROM h),
cp AS (SELECT query_id, string_agg(term, '|' ORDER BY o, j) AS concept_phrases FROM (SELECT query_id, term, min((o, j)) AS m, m[1] AS o, m[2] AS j FROM te WHERE kind < 2 GROUP BY query_id, term) GROUP BY query_id),
tw AS (SELECT query_id, o, j, unnest({toks('term')}) AS w, generate_subscripts({toks('term')}, 1) AS l FROM te),
ct AS (SELECT query_id, string_agg(w, '|' ORDER BY m) AS concept_terms FROM (SELECT query_id, w, min((o, j, l)) AS m FROM tw WHERE NOT list_contains({lit(V.STOPWORDS)}, w) GROUP BY query_id, w) GROUP BY query_id),
dp AS (SELECT query_id, domain, sum(points) AS p, min(o) AS o FROM h WHERE domain IS NOT NULL GROUP BY ALL),
dm AS (SELECT query_id, string_agg(domain, '|' ORDER BY p DESC, o) AS domains FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, o) AS r FROM dp) WHERE r <= 3 GROUP BY query_id),
tt AS (SELECT query_id, string_agg(task, '|' ORDER BY o) AS task_terms FROM (SELECT query_id, task, min(o) AS o FROM (SELECT query_id, o, unnest(tasks) AS task FROM h WHERE kind < 2) GROUP BY query_id, task) GROUP BY query_id)
SELECT q.query_id, coalesce(concept_phrases, '') AS concept_phrases, coalesce(concept_terms, '') AS concept_terms, coalesce(domains, '') AS domains, coalesce(task_terms, '') AS task_terms
FROM q LEFT JOIN cp USING (query_id) LEFT JOIN ct USING (query_id) LEFT JOIN dm USING (query_id) LEFT JOIN tt USING (query_id)"""


def rule_ablation(spark, sf):
    """How many domains, terms and tasks each turn has with and without rules, one row a configuration."""
    q, tables = _ruled(spark, sf), _rule_tables(spark, sf)
    rows = [R.concepts(q, t).select(F.lit(n).alias("rules"), "query_id", *(F.size(c).cast("long").alias(c) for c in ("domains", "concept_terms", "task_terms"))) for n, t in (("all", tables), ("none", tables.without()))]
    both = rows[0].unionByName(rows[1])
    return both.groupBy("rules").agg(F.count("*").alias("queries"), *(F.sum(c).alias(c) for c in ("domains", "concept_terms", "task_terms")), F.count_if((F.col("domains") == 0) & (F.col("concept_terms") == 0)).alias("out_of_distribution"))


_COUNT = lambda c: f"CAST(sum(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, '|')) END) AS BIGINT) AS {c}"
RULE_ABLATION = f"""WITH r AS ({RULES})
SELECT 'all' AS rules, count(*) AS queries, {_COUNT('domains')}, {_COUNT('concept_terms')}, {_COUNT('task_terms')}, count(*) FILTER (WHERE domains = '' AND concept_terms = '') AS out_of_distribution FROM r
UNION ALL SELECT 'none', count(*), 0, 0, 0, count(*) FROM r"""

QUERIES = {
    "q1_detect_language": (language, LANGUAGE),
    "q2_strip_leading_intent": (leading, LEADING),
    "q4_x4_focus_terms": (focus, FOCUS),
    "q10_f6_weighted_query_tokens": (weighted_tokens, WEIGHTED),
    "q3_q9_query_plan": (plans, None),
    "e16_rule_ablation": (ablated, None),
    "q11_query_labels": (labels, None),
    "q9_r3_planned_search": (search, None),
    "j16_j18_q5_rule_tables": (rule_concepts, RULES),
    "e16_c6_rule_ablation": (rule_ablation, RULE_ABLATION),
}
