"""Queries of text, quality and label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import quality as Q
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import evaluate, lexical, records
from . import frames
from .sql import CORPUS, count_of, first_words, fold, lit, norm, terms, toks, words


def tokenize(spark, sf):
    d = frames.spread(frames.table(spark, sf, "documents").select("doc_id", "text"))
    t = T.tokens(F.col("text"))
    return d.select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normalized_md5"), F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first_token"))


TOKENIZE = f"SELECT doc_id, md5({norm('text')}) AS normalized_md5, len({toks('text')}) AS n_tokens, len(list_distinct({toks('text')})) AS n_distinct, coalesce(({toks('text')})[1], '') AS first_token FROM documents"


def _sample_tokens(spark, sf):
    b = frames.table(spark, sf, "benchmark").select(T.tokens(F.col("text")).alias("t"))
    p = frames.table(spark, sf, "part").select(T.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    return b.unionAll(p).select(F.explode("t").alias("token")).distinct()


def variants(spark, sf):
    return _sample_tokens(spark, sf).select("token", F.array_join(T.token_variants(F.col("token")), "|").alias("variants"))


VARIANTS = f"""
WITH k AS (SELECT DISTINCT unnest(t) AS token FROM (SELECT {toks('text')} AS t FROM benchmark UNION ALL SELECT {toks("concat_ws(' ', p_name, p_type)")} FROM part)),
v AS (SELECT token, list_filter({lit(V.TURKISH_SUFFIXES)}, lambda s: ends_with(token, s) AND length(token) - length(s) >= 3)[1] AS suffix FROM k),
e AS (SELECT token, CASE WHEN suffix IS NOT NULL THEN left(token, length(token) - length(suffix)) END AS a,
  CASE WHEN list_contains({lit(V.PLURAL_KEEP)}, token) THEN NULL
       WHEN ends_with(token, 'ies') AND length(token) >= 5 AND substr(token, length(token) - 3, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(token, length(token) - 3) || 'y'
       WHEN ends_with(token, 'ing') AND length(token) >= 7 THEN left(token, length(token) - 3)
       WHEN ends_with(token, 'ed') AND length(token) >= 6 THEN left(token, length(token) - 2)
       WHEN ends_with(token, 's') AND length(token) >= 5 AND NOT (ends_with(token, 'ss') OR ends_with(token, 'us') OR ends_with(token, 'is') OR ends_with(token, 'ies')) THEN left(token, length(token) - 1) END AS b FROM v)
SELECT token, concat_ws('|', token, CASE WHEN a <> token THEN a END, CASE WHEN b <> token AND b IS DISTINCT FROM a THEN b END) AS variants FROM e"""


def card_clean(spark, sf):
    p = frames.spread(frames.table(spark, sf, "pages").select("page_id", "html"))
    c = p.select("page_id", T.card_clean(F.col("html")).alias("c"))
    return c.select("page_id", F.md5("c.text").alias("text_md5"), F.length("c.text").cast("long").alias("n_chars"), F.array_join("c.notes", ",").alias("notes"), F.array_join("c.flags", ",").alias("flags"))


_NOISE = "^(" + "|".join(V.CARD_NOISE_PREFIXES) + ")"
CARD = rf"""
WITH a AS (SELECT page_id, html AS t, regexp_replace(html, '(?s)^---.*?---\s*', '') AS f FROM pages),
b AS (SELECT *, regexp_replace(f, '(?s)```.*?```', ' ', 'g') AS k FROM a),
c AS (SELECT *, CASE WHEN contains(k, '<') AND contains(k, '>') THEN regexp_replace(k, '<[^>]+>', ' ', 'g') ELSE k END AS h FROM b),
d AS (SELECT *, list_filter(list_transform(regexp_split_to_array(h, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM c),
e AS (SELECT *, list_filter(l, lambda x: NOT regexp_matches(lower(x), '{_NOISE}')) AS o FROM d),
f AS (SELECT *, array_to_string(o, ' ') AS g FROM e),
i AS (SELECT *, regexp_replace(g, 'https?://\S+|www\.\S+', ' <URL> ', 'g') AS m FROM f),
n AS (SELECT *, trim(regexp_replace(m, '\s+', ' ', 'g')) AS z FROM i)
SELECT page_id, md5(z) AS text_md5, length(z) AS n_chars,
  concat_ws(',', 'nfkc', CASE WHEN f <> t THEN 'remove_yaml_frontmatter' END, CASE WHEN contains(f, '```') THEN 'strip_codeblock' END, CASE WHEN h <> k THEN 'strip_html' END,
    CASE WHEN len(l) > len(o) THEN 'remove_noise_lines:' || (len(l) - len(o)) END, CASE WHEN m <> g THEN 'mask_url' END, 'ws_norm') AS notes,
  CASE WHEN length(z) < 80 THEN 'too_short' ELSE '' END AS flags FROM n"""


def listing_clean(spark, sf):
    c = frames.corpus(spark, sf).select("doc_id", "title", F.col("title").alias("subtitle"), "description", "keywords")
    r = records.clean_listing(c)
    return r.select("doc_id", F.md5("text").alias("text_md5"), F.array_join("cleaning_notes", ",").alias("notes"), F.array_join("quality_flags", ",").alias("flags"), "description_len_chars", "description_len_words")


def _squeezed(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '!\[([^\]]*)\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '<[^>]+>', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, 'https?://\S+|www\.\S+', ' <URL> ', 'g'), '\s+', ' ', 'g'))"


LISTING = rf"""
WITH {CORPUS}, a AS (SELECT doc_id, {_squeezed('title')} AS t, {_squeezed('description')} AS d, array_to_string(keywords, ', ') AS k FROM c),
b AS (SELECT doc_id, CASE WHEN t = '' THEN 'Untitled Dataset' ELSE t END AS title, trim(concat_ws(' ', nullif(t, ''), nullif(d, ''), 'Keywords: ' || nullif(k, ''))) AS x,
  concat_ws(',', CASE WHEN t <> '' THEN 'subtitle' END, CASE WHEN d <> '' THEN 'description' END, CASE WHEN k <> '' THEN 'keywords' END) AS notes FROM a)
SELECT doc_id, md5(title || '. ' || x) AS text_md5, notes,
  concat_ws(',', CASE WHEN NOT contains(notes, 'description') THEN 'no_long_description' END, CASE WHEN notes = 'keywords' THEN 'keyword_only' END, CASE WHEN length(x) < 80 THEN 'short_description' END) AS flags,
  length(x) AS description_len_chars, len({words('x')}) AS description_len_words FROM b WHERE x <> '' AND length(title || '. ' || x) >= 20"""


def counts(spark, sf):
    d = frames.spread(frames.table(spark, sf, "documents").select("doc_id", "text"))
    t = F.col("text")
    return d.select("doc_id", F.length(t).cast("long").alias("chars"), T.word_count(t).alias("words"), T.count_of(t, ":").alias("colons"), T.count_of(t, "- ").alias("dashes"), F.md5(T.truncate_words(t, 60)).alias("start_md5"), F.size(T.content_terms(t)).cast("long").alias("terms"))


COUNTS = f"SELECT doc_id, length(text) AS chars, len({words('text')}) AS words, CAST({count_of('text', ':')} AS BIGINT) AS colons, CAST({count_of('text', '- ')} AS BIGINT) AS dashes, md5({first_words('text', 60)}) AS start_md5, {terms('text')} AS terms FROM documents"


def report_style(spark, sf):
    d = frames.spread(frames.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", Q.report_style(F.col("text")).alias("style"))


STYLE = rf"""
WITH a AS (SELECT doc_id, trim(text) AS t, {toks('trim(text)')} AS k FROM documents),
b AS (SELECT doc_id, t, k, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: len({toks('s')}) >= 4)) AS sentences,
  len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND regexp_matches(trim(x), '^\s*(#|[-*]|\d+\.)'))) + len(regexp_extract_all(lower(t), '\b[a-z_]+:[a-z0-9_./-]+\b')) + CASE WHEN starts_with(t, '---') THEN 2 ELSE 0 END
  + CASE WHEN {count_of('t', '##')} + {count_of('t', '###')} + {count_of('t', '---')} + {count_of('t', '`')} >= 3 THEN 1 ELSE 0 END AS structure,
  len(list_filter(k, lambda x: list_contains({lit(V.STOPWORDS)}, x))) / greatest(len(k), 1) AS stop FROM a)
SELECT doc_id, CASE WHEN len(k) = 0 THEN 'mixed_structured' WHEN structure >= 3 AND sentences <= 1 AND stop < 0.22 THEN 'metadata_heavy'
  WHEN sentences >= 2 AND stop >= 0.22 AND structure <= 1 THEN 'narrative' ELSE 'mixed_structured' END AS style FROM b"""


def quality(spark, sf):
    d = frames.described(spark, sf)
    return d.select(
        "doc_id", "word_count", "term_count", "style", "length_bucket", "term_bucket", F.array_join("all_flags", ",").alias("all_flags"), "severity", F.array_join(Q.risk_flags(F.col("all_flags")), ",").alias("risk_flags"),
        "deemphasized", Q.note().alias("note"), "score_penalty", "score_bonus", "quality_confidence",
    )


def _style_sql(more: str = "") -> str:
    marks = f"({count_of('description', '- ')} + {count_of('lower(description)', 'keywords:')} + {count_of('lower(description)', 'use cases:')} + {count_of('lower(description)', 'columns:')}{more})"
    colons = count_of("description", ":")
    return f"CASE WHEN w <= 40 AND (len(keywords) >= 3 OR {colons} >= 3) THEN 'metadata_heavy' WHEN {marks} >= 2 OR {colons} >= 4 THEN 'mixed_structured' WHEN w >= 80 THEN 'narrative' WHEN len(keywords) > 0 THEN 'mixed_structured' ELSE 'narrative' END"


def _quality_cte(more: str = "") -> str:
    return f"""{CORPUS},
qa AS (SELECT *, len({words('description')}) AS w, {terms('description')} AS n, CASE WHEN length(description) < 80 THEN ['short_description'] ELSE []::VARCHAR[] END AS raw FROM c),
qb AS (SELECT *, CASE WHEN description <> '' THEN {_style_sql(more)} END AS style, CASE WHEN w = 0 THEN NULL WHEN w <= 20 THEN 'short' WHEN w <= 52 THEN 'medium' ELSE 'long' END AS lb,
  CASE WHEN n = 0 AND description = '' THEN NULL WHEN n <= 10 THEN 'term_sparse' WHEN n <= 28 THEN 'term_moderate' ELSE 'term_rich' END AS tb FROM qa),
qc AS (SELECT *, list_distinct(list_concat(raw, list_filter([CASE WHEN trim(description) = '' THEN 'empty' END, CASE WHEN lb = 'short' AND len(raw) = 0 THEN 'short_context' END, CASE WHEN style = 'metadata_heavy' THEN 'metadata_heavy' END,
  CASE WHEN tb = 'term_sparse' THEN 'term_sparse' END, CASE WHEN style = 'metadata_heavy' AND (lb = 'short' OR tb = 'term_sparse') THEN 'low_information' END], lambda x: x IS NOT NULL))) AS u FROM qb),
qd AS (SELECT *, list_filter({lit([*V.FLAG_PENALTIES])}, lambda f: list_contains(u, f)) AS all_, list_filter({lit(V.RISKY_FLAGS)}, lambda f: list_contains(u, f)) AS risk FROM qc),
qe AS (SELECT *, CASE WHEN list_has_any(u, ['empty', 'keyword_only', 'low_information']) THEN 'risk' WHEN len(u) > 0 THEN 'warning' ELSE 'info' END AS severity,
  len(risk) > 0 OR (w BETWEEN 1 AND 12) OR coalesce(w BETWEEN 1 AND 24 AND style = 'mixed_structured' AND tb = 'term_sparse', false) AS de FROM qd),
qf AS (SELECT *, least(0.18, coalesce(list_sum(list_transform(u, lambda f: CASE f {' '.join(f"WHEN '{k}' THEN {v}" for k, v in V.FLAG_PENALTIES.items())} ELSE 0.0 END)), 0.0)::DOUBLE + CASE WHEN de THEN 0.03 ELSE 0.0 END) AS p,
  CASE WHEN severity = 'info' AND style = 'narrative' THEN 0.008 ELSE 0.0 END + CASE WHEN severity = 'info' AND tb = 'term_rich' THEN 0.006 ELSE 0.0 END AS bo FROM qe)"""


QUALITY_CTE = _quality_cte()
_ORDERED_FLAGS = lit(["short_description", "empty", "short_context", "metadata_heavy", "term_sparse", "low_information"])
QUALITY = f"""
WITH {QUALITY_CTE}
SELECT doc_id, w AS word_count, n AS term_count, style, lb AS length_bucket, tb AS term_bucket, array_to_string(list_filter({_ORDERED_FLAGS}, lambda f: list_contains(u, f)), ',') AS all_flags, severity,
  array_to_string(list_filter({_ORDERED_FLAGS}, lambda f: list_contains(risk, f)), ',') AS risk_flags, de AS deemphasized,
  CASE WHEN NOT de THEN '' ELSE 'Limited semantic evidence: ' || CASE WHEN list_contains(risk, 'empty') THEN 'description is empty' WHEN list_has_any(risk, ['keyword_only', 'metadata_heavy']) THEN 'description is mostly keywords or metadata'
    WHEN list_has_any(risk, ['low_information', 'term_sparse']) THEN 'description has limited semantic detail' WHEN list_has_any(risk, ['too_short', 'short_description']) OR w <= 24 THEN 'description is very short'
    ELSE 'description provides weak semantic evidence' END || '; title terms are de-emphasized.' END AS note,
  round(p::DOUBLE, 4) AS score_penalty, round(bo::DOUBLE, 4) AS score_bonus, round(greatest(0, least(1, 1 - p + bo))::DOUBLE, 4) AS quality_confidence FROM qf"""


def web_quality(spark, sf):
    c = frames.corpus(spark, sf).withColumn("quality_flags", frames.raw_flags(F.col("description")))
    d = Q.flags(c, "description", "keywords", "quality_flags", web=True).withColumn("f", Q.flag_severity(F.col("all_flags")))
    return d.select("doc_id", "style", F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["flag"], x["severity"])), ",").alias("flags"), "severity")


WEB = f"""
WITH {_quality_cte(f" + {count_of('description', '•')}")}
SELECT doc_id, style, array_to_string(list_transform(list_filter({_ORDERED_FLAGS}, lambda f: list_contains(u, f)), lambda f: f || ':' || CASE f {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.FLAG_SEVERITY.items())} ELSE 'info' END), ',') AS flags, severity FROM qf"""


def doc_features(spark, sf):
    d = frames.described(spark, sf).select("length_bucket", "term_bucket", Q.report_style(F.col("description")).alias("style"))
    return evaluate.distribution(d, ["length_bucket", "term_bucket", "style"])


FEATURES = f"""
WITH {QUALITY_CTE}, y AS ({STYLE}), z AS (SELECT lb, tb, y.style AS st FROM qf JOIN y USING (doc_id)),
l AS (SELECT 'length_bucket' AS feature, lb AS bucket FROM z UNION ALL SELECT 'term_bucket', tb FROM z UNION ALL SELECT 'style', st FROM z)
SELECT feature, bucket, count(*) AS documents, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) AS share FROM l GROUP BY feature, bucket"""


def low_information(spark, sf):
    d = frames.spread(frames.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", Q.low_information(F.col("text"), frames.raw_flags(F.col("text"))).alias("low"))


_T, _L = "trim(text)", "lower(trim(text))"
LOW = f"""
WITH a AS (SELECT doc_id, {_T} AS t, {_L} AS l, length(text) < 80 AS short, len({words(_T)}) AS w, {count_of(_T, ':')} AS c, {count_of(_T, '- ')} + {count_of(_L, 'keywords:')} + {count_of(_L, 'tags:')} AS b,
  {' + '.join(count_of(_L, m) for m in V.STRUCTURE_MARKERS)} AS m FROM documents)
SELECT doc_id, t = '' OR short OR (w <= 20 AND (starts_with(l, 'keywords:') OR c >= 3)) OR (starts_with(l, '---') AND w <= 60) OR m >= 2 OR (w <= 60 AND (c >= 4 OR b >= 3)) OR (w <= 40 AND b >= 4) AS low FROM a"""


def _label_text(spark, sf):
    """Documents whose texts have words of the rules: parts and orders named by them."""
    names = [*V.DOMAIN_RULES.items()]
    sentence = F.lit("")
    for k, (_, (phrases, toks_)) in enumerate(names):
        sentence = F.when(F.col("doc_id") % 11 == k, F.lit(f"{phrases.split('|')[0]} {toks_.split()[k % 5]} forecast table")).otherwise(sentence)
    return frames.corpus(spark, sf).withColumn("description", F.concat_ws(" ", sentence, F.col("description")))


def label_rules(spark, sf):
    d = _label_text(spark, sf)
    text = T.normalize(F.concat_ws(" ", "title", "description"))
    d = d.select("doc_id", text.alias("t")).withColumn("k", F.array_distinct(F.split("t", " ")))
    args = (F.col("t"), F.col("k"), F.lit(1))
    return d.select("doc_id", *(F.array_join(f(*args), ",").alias(n) for n, f in (("domains", L.domains), ("use_cases", L.use_cases), ("modalities", L.modalities))))


def _labels_sql() -> str:
    cases = " ".join(f"WHEN doc_id % 11 = {k} THEN '{p.split('|')[0]} {t.split()[k % 5]} forecast table'" for k, (_, (p, t)) in enumerate(V.DOMAIN_RULES.items()))
    rule = lambda kind, k, label, score: f"{{'kind': '{kind}', 'ord': {k}, 'label': '{label}', 'score': {score}}}"
    has = lambda w: f"CASE WHEN list_contains(k, '{w}') THEN 1 ELSE 0 END"
    inn = lambda p, other="0": f"CASE WHEN contains(t, '{p}') THEN 2 ELSE {other} END"
    rows = [rule("d", k, label, " + ".join([*(inn(p) for p in ps.split("|")), *(has(w) for w in ws.split())])) for k, (label, (ps, ws)) in enumerate(V.DOMAIN_RULES.items())]
    rows += [rule("u", k, label, " + ".join(inn(p, " + ".join(has(w) for w in p.split())) if " " in p else has(p) for p in ps.split("|"))) for k, (label, ps) in enumerate(V.USE_CASE_RULES.items())]
    rows += [rule("m", k, label, " + ".join(inn(p) if " " in p else has(p) for p in ps.split("|"))) for k, (label, ps) in enumerate(V.MODALITY_RULES.items())]
    text = f"concat_ws(' ', CASE {cases} ELSE '' END, description)"
    pick = lambda kind, most: f"coalesce(string_agg(CASE WHEN kind = '{kind}' AND n <= {most} THEN label END, ',' ORDER BY n), '')"
    return f"""
WITH {CORPUS}, a AS (SELECT doc_id, {norm(f"concat_ws(' ', title, {text})")} AS t FROM c), b AS (SELECT doc_id, t, string_split(t, ' ') AS k FROM a),
s AS (SELECT doc_id, unnest([{', '.join(rows)}]) AS x FROM b),
p AS (SELECT doc_id, x.kind AS kind, x.label AS label, row_number() OVER (PARTITION BY doc_id, x.kind ORDER BY x.score DESC, x.ord) AS n FROM s WHERE x.score > 0)
SELECT b.doc_id, {pick('d', 3)} AS domains, {pick('u', 4)} AS use_cases, {pick('m', 3)} AS modalities FROM b LEFT JOIN p ON b.doc_id = p.doc_id GROUP BY b.doc_id"""


def semantic_texts(spark, sf):
    r = records.normalised(frames.corpus(spark, sf).select(F.col("doc_id").cast("string").alias("ref"), "source", "title", "description", "keywords", F.col("lang").alias("language")), "unknown")
    return r.select(F.col("ref").cast("long").alias("doc_id"), F.md5("semantic_summary").alias("summary_md5"), F.md5("semantic_text").alias("text_md5"), F.length("semantic_text").cast("long").alias("n_chars"), "language_hint", "semantic_quality_note")


def keyword_tokens(spark, sf):
    p = frames.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.array("p_brand", F.concat(F.lit("format:"), F.col("p_type"))).alias("keywords"), F.col("p_type").alias("description"))
    return p.select("doc_id", F.array_join(lexical.document_tokens(F.col("title"), F.col("keywords"), F.col("description")), " ").alias("bag"))


_BAG = [toks("p_name")] * 3 + [toks("p_brand")] * 2 + [toks("p_type")]
KEYWORD_TOKENS = f"SELECT p_partkey AS doc_id, array_to_string(flatten([{', '.join(_BAG)}]), ' ') AS bag FROM part"


def encoding(spark, sf):
    d = frames.spread(frames.table(spark, sf, "documents").select("doc_id", "text"))
    spoiled = F.concat(F.lit("Ã‚it "), F.col("text"), F.lit("Ã¢â‚¬Â¦ Ã¢â‚¬â€œ end"))
    return d.select("doc_id", T.fix_encoding(spoiled).alias("fixed"))


ENCODING = "SELECT doc_id, 'it ' || text || '... - end' AS fixed FROM documents"


def fold_text(spark, sf):
    d = frames.spread(frames.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5(T.ascii_fold(F.col("text"))).alias("folded_md5"), F.md5(T.keep_words(F.col("text"))).alias("kept_md5"))


FOLD = rf"SELECT doc_id, md5({fold('text')}) AS folded_md5, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS kept_md5 FROM documents"

def web_terms(spark, sf):
    d = frames.spread(frames.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", T.web_terms(F.col("text")).alias("terms"), T.web_language(F.col("text")).alias("language"))


WEB_TERMS = rf"""SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9a-zA-ZçğıöşüÇĞİÖŞÜ]{{3,}}'), lambda t: lower(t)), lambda t: NOT list_contains({lit(V.WEB_STOPWORDS)}, t)))) AS terms,
CASE WHEN regexp_matches(lower(text), '[{V.WEB_TURKISH_LETTERS}]') OR list_has_any(regexp_extract_all(translate(lower(text), ',.', '  '), '\S+'), {lit(V.WEB_TURKISH_MARKERS)}) THEN 'tr' ELSE 'en' END AS language FROM documents"""

QUERIES = {
    "x22_q1b_web_terms": (web_terms, WEB_TERMS),
    "x1_x5_fold_text": (fold_text, FOLD),
    "x2_x3_tokenize": (tokenize, TOKENIZE),
    "x4_token_variants": (variants, VARIANTS),
    "x6_y2_card_clean": (card_clean, CARD),
    "x7_x10_y1_f1_f2_listing_clean": (listing_clean, LISTING),
    "x8_fix_encoding": (encoding, ENCODING),
    "x11_x12_x21_x25_text_counts": (counts, COUNTS),
    "x26_y5c_report_style": (report_style, STYLE),
    "y3_y10_quality_signal": (quality, QUALITY),
    "y5b_y12_web_quality_flags": (web_quality, WEB),
    "y11_low_information": (low_information, LOW),
    "y13_a12_w4_feature_distribution": (doc_features, FEATURES),
    "l1_l4_a22_label_rules": (label_rules, _labels_sql()),
    "l5_l8_p9_semantic_text": (semantic_texts, None),
    "r1_f9_document_tokens": (keyword_tokens, KEYWORD_TOKENS),
}
