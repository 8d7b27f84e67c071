"""Query plans from free text, for a table of queries at once.

A plan is a chain of columns: normalised text, language, intent, focus terms, concepts from rules,
aspects and weighted variants. Rules are constants of the plan, evaluated inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

# --- Fixed values: what is stripped from a query, in this order -------------------------------------
LEADING = [r"^(i am|i m|im)\s+(looking for|searching for)\s+", r"^(i need|i want)\s+", r"^(can you find|find me|show me)\s+", r"^(bana|ben)\s+"]
VERB = r"^(?:to\s+)?(?:find|study|research|search|analyze|analyse|explore|examine|investigate|predict|detect|classify)\s+"
ABOUT = [
    r"\bdatasets?\s+(?:about|for|with|containing|that contain|that contains)\s+(.+)",
    r"^(?:about|for|with)\s+(.+)",
    r"\bveri(?:\s+seti|leri)?\s+(?:hakkinda|icin|ile ilgili)\s+(.+)",
    r"^(?:hakkinda|icin|ile ilgili)\s+(.+)",
]
TAILS = ["that can be used for", "that include", "that includes", "prepared for", "kullanilabilecek", "iceren", "ile ilgili"]
DATASET_WORDS = r"\b(veri setleri|veri seti|datasets?|datasetler|dataseti|veriler|verisi|veri|data)\b"
DANGLING = r"^(?:about|for|with|on|of|in|into|over|regarding|around|the|a|an)\s+"
PREFIX_DROP = ["dataset", "datasets", "data", "veri", "veriler", "verisi"]
# --- End of fixed values ----------------------------------------------------------------------------


def _none() -> Column:
    return F.array().cast("array<string>")


def detect_language(query: Column, normalized: Column) -> Column:
    """Q1: ``tr`` by a Turkish letter or a marker word, else ``en``."""
    marked = F.arrays_overlap(T.tokens(normalized), T.strings(V.TURKISH_MARKERS))
    return F.when(query.rlike(f"[{V.TURKISH_FROM}]") | marked, F.lit("tr")).otherwise(F.lit("en"))


def strip_leading(normalized: Column) -> Column:
    """Q2: the first pattern that changes the text is taken off."""
    tried = [F.trim(F.regexp_replace(normalized, p, "")) for p in LEADING]
    return F.coalesce(*(F.when(t != normalized, t) for t in tried), normalized)


def intent_body(df: DataFrame, normalized: str) -> DataFrame:
    """Q3: ``df`` with intent_body: what the query is about."""
    df = df.withColumn("_b", strip_leading(F.col(normalized)))
    df = df.withColumn("_b", F.regexp_replace(F.regexp_replace("_b", VERB, ""), r"^how\s+", ""))
    found = F.col("_b")
    for p in reversed(ABOUT):
        head = r"^()" + p[1:] if p.startswith("^") else r"^(.*?)" + p
        before = F.filter(T.tokens(F.regexp_extract("_b", head, 1)), lambda t: ~t.isin(V.STOPWORDS) & ~t.isin(PREFIX_DROP))
        found = F.when(F.col("_b").rlike(p), F.concat_ws(" ", before, F.trim(F.regexp_extract("_b", head, 2)))).otherwise(found)
    df = df.withColumn("_b", found)
    body = F.col("_b")
    for t in TAILS:
        body = F.trim(F.regexp_replace(body, rf"\b{t}\b", " "))
    body = F.trim(F.regexp_replace(body, DATASET_WORDS, " "))
    body = F.regexp_replace(F.regexp_replace(body, DANGLING, ""), DANGLING, "")
    return df.withColumn("intent_body", F.trim(F.regexp_replace(body, r"\s+", " "))).drop("_b")


def focus_terms(text: Column) -> Column:
    """Q4: variants of the tokens, without stopwords and short ones, distinct."""
    variants = F.flatten(F.transform(T.tokens(text), T.token_variants))
    return F.array_distinct(F.filter(variants, lambda t: ((F.length(t) > 2) | t.isin(V.SHORT_KEEP)) & ~t.isin(V.STOPWORDS)))


def _lists(rules: list[tuple[Column, list[str]]]) -> Column:
    """Concatenated constants of the rules that hold, in rule order."""
    return F.concat(_none(), *(F.when(hit, T.strings(values)).otherwise(_none()) for hit, values in rules if values)) if rules else _none()


def concepts(df: DataFrame, rules: V.Rules) -> DataFrame:
    """``df`` (normalized_query, raw_focus_terms) with concept_phrases, concept_terms, domains, task_terms. Domains by points, ties first seen."""
    q, focus = F.col("normalized_query"), F.col("raw_focus_terms")
    held = [(F.contains(q, F.lit(p)), d, t, k) for p, d, t, k in rules.phrases] + [(F.size(F.array_except(T.strings(ts), focus)) == 0, d, t, k) for ts, d, t, k in rules.combos]
    first = _lists([(h, t) for h, _, t, _ in held])
    token_terms = F.create_map(*(x for t, _, terms in rules.tokens for x in (F.lit(t), T.strings(terms)))) if rules.tokens else None
    token_domain = F.create_map(*(F.lit(x) for t, d, _ in rules.tokens if d for x in (t, d))) if any(d for _, d, _ in rules.tokens) else None
    more = F.flatten(F.transform(focus, lambda t: F.coalesce(F.try_element_at(token_terms, t), _none()))) if token_terms is not None else _none()
    point = lambda d, n: F.struct(d.alias("d"), F.lit(n).alias("n"))
    nothing = F.array().cast("array<struct<d:string,n:int>>")
    points = F.concat(nothing, *(F.when(h, F.array(point(F.lit(d), 2))).otherwise(nothing) for h, d, _, _ in held if d))
    if token_domain is not None:
        points = F.concat(points, F.filter(F.transform(focus, lambda t: point(F.try_element_at(token_domain, t), 1)), lambda x: x["d"].isNotNull()))
    df = df.withColumns({"_first": first, "_more": more, "_points": points, "task_terms": F.array_distinct(_lists([(h, k) for h, _, _, k in held]))})
    names = F.array_distinct(F.transform("_points", lambda x: x["d"]))
    total = lambda d: F.aggregate(F.filter("_points", lambda x: x["d"] == d), F.lit(0), lambda s, x: s + x["n"])
    ordered = F.array_sort(F.transform(names, lambda d, i: F.struct((-total(d)).alias("neg"), i.alias("ord"), d.alias("d"))))
    df = df.withColumn("domains", F.transform(F.slice(ordered, 1, 3), lambda x: x["d"]))
    terms = F.flatten(F.transform(F.concat("_first", "_more"), T.tokens))
    return df.withColumns({"concept_phrases": F.array_distinct("_first"), "concept_terms": F.array_distinct(F.filter(terms, lambda t: ~t.isin(V.STOPWORDS)))}).drop("_first", "_more", "_points")


def aspects(df: DataFrame, rules: V.Rules) -> DataFrame:
    """Q6, Q7: ``df`` with semantic_aspects: at most four of the aspect groups that the query's terms evoke; under two, domain, task and concept stand in."""
    kind = "array<struct<key:string,text:string,kind:string>>"
    spaced = lambda c: F.array_join(c, " ")
    evidence = F.concat_ws(" ", "intent_body", spaced("raw_focus_terms"), spaced("concept_phrases"), spaced("concept_terms"), F.replace(spaced("domains"), F.lit("_"), F.lit(" ")), spaced("task_terms"))
    df = df.withColumn("_e", T.normalize(evidence)).withColumn("_t", F.split("_e", " "))
    groups = []
    for key, what, match, terms in rules.aspects:
        hit = F.lit(False)
        for m in match:
            hit = hit | (F.contains("_e", F.lit(m)) if " " in m else F.array_contains("_t", m))
        own = T.strings(terms)
        if what == "task":
            own = F.concat("task_terms", own)
        else:
            evoked = F.filter("concept_phrases", lambda p: F.exists(T.strings(match), lambda m: F.contains(T.normalize(p), m)))
            own = F.concat(evoked, own)
        text = F.array_join(F.slice(F.array_distinct(own), 1, 5), " ")
        groups.append(F.when(hit, F.struct(F.lit(key).alias("key"), text.alias("text"), F.lit(what).alias("kind"))))
    df = df.withColumn("_g", F.array_compact(F.array(*groups)).cast(kind) if groups else F.array().cast(kind))
    stand_in = lambda key, c: F.when(c != "", F.struct(F.lit(key).alias("key"), c.alias("text"), F.lit("fallback").alias("kind")))
    extra = F.array_compact(F.array(
        stand_in("domain_focus", F.replace(spaced(F.slice("domains", 1, 2)), F.lit("_"), F.lit(" "))), stand_in("task_focus", spaced(F.slice("task_terms", 1, 3))), stand_in("concept_focus", spaced(F.slice("concept_phrases", 1, 4))),
    )).cast(kind)
    return df.withColumn("semantic_aspects", F.slice(F.array_distinct(F.when(F.size("_g") < 2, F.concat("_g", extra)).otherwise(F.col("_g"))), 1, 4)).drop("_e", "_t", "_g")


def variants(df: DataFrame) -> DataFrame:
    """Q8: ``df`` with semantic_variants: paraphrases with weights; equal texts keep the larger weight. Long queries count less than their intent, Turkish concepts more."""
    spaced = lambda *parts: F.trim(F.concat_ws(" ", *(F.when(p != "", p) for p in parts)))
    body = F.when(F.col("intent_body") != "", F.col("intent_body")).otherwise(F.col("original_query"))
    tasks = F.array_distinct(F.flatten(F.transform("task_terms", T.tokens)))
    df = df.withColumns({
        "_raw": F.array_join(F.slice(F.array_distinct(F.filter(T.tokens(body), lambda t: ~t.isin(V.STOPWORDS))), 1, 8), " "), "_phrase": F.array_join(F.slice("concept_phrases", 1, 4), " "),
        "_concept": F.array_join(F.slice("concept_terms", 1, 10), " "), "_domain": F.replace(F.array_join(F.slice("domains", 1, 2), " "), F.lit("_"), F.lit(" ")), "_task": F.array_join(F.slice(tasks, 1, 6), " "),
        "_tr": F.col("detected_language") == "tr", "_known": F.size("concept_terms") > 0, "_long": F.size(T.tokens(F.col("original_query"))) >= 15,
    })
    c, tr, known, long = F.col, F.col("_tr"), F.col("_known"), F.col("_long")
    pick = lambda cond, a, b: F.when(cond, F.lit(a)).otherwise(F.lit(b))
    original = pick(tr & known, 0.85, 1.0) * pick(long, 0.55, 1.0)
    intent = F.greatest(pick(known, 1.05, 1.0), pick(long, 1.35, 0.0))
    concept, task, domain = pick(tr, 1.45, 1.25), pick(c("_task") != "", 1.35, 1.0), pick(tr, 1.35, 1.15)
    bridge, combined = pick(tr & known, 1.25, 1.05), pick(tr & known, 1.5, 1.3)
    named = F.when(c("_phrase") != "", c("_phrase")).otherwise(c("_concept"))
    prefixed = lambda p, x: F.when(x != "", F.concat(F.lit(p), x)).otherwise(F.lit(""))
    any_ = (c("_domain") != "") | (c("_task") != "") | (c("_concept") != "") | (c("_phrase") != "")
    full = F.trim(F.concat(c("_domain"), F.lit(" dataset "), c("_task"), F.lit(" "), named))
    pair = lambda a, b: F.trim(F.concat(a, F.lit(" "), b))
    every = [
        (F.trim("original_query"), original), (c("intent_body"), intent), (c("_raw"), F.lit(1.0)), (c("_phrase"), concept), (c("_concept"), concept), (c("_task"), task), (spaced(c("intent_body"), c("_phrase"), c("_task")), combined),
        (pair(c("_raw"), c("_concept")), bridge), (pair(c("_phrase"), c("_task")), F.greatest(bridge, task)), (pair(c("intent_body"), c("_task")), F.greatest(intent, task)), (prefixed("dataset for ", c("_raw")), F.lit(1.0)),
        (prefixed("dataset for ", c("_task")), task), (prefixed("dataset about ", named), concept), (F.when(any_, full).otherwise(F.lit("")), domain),
    ]
    df = df.withColumn("_v", F.filter(F.array(*(F.struct(t.alias("text"), w.cast("double").alias("weight")) for t, w in every)), lambda x: x["text"] != ""))
    best = lambda t: F.round(F.array_max(F.transform(F.filter("_v", lambda x: x["text"] == t), lambda x: x["weight"])), 6)
    df = df.withColumn("semantic_variants", F.transform(F.array_distinct(F.transform("_v", lambda x: x["text"])), lambda t: F.struct(t.alias("text"), best(t).alias("weight"))))
    return df.drop("_raw", "_phrase", "_concept", "_domain", "_task", "_tr", "_known", "_long", "_v")


def plan(queries: DataFrame, rules: V.Rules = V.DEFAULT_RULES, query: str = "query") -> DataFrame:
    """Q9: ``queries`` (query_id, query) with every column of a query plan."""
    df = queries.withColumn("original_query", F.trim(F.coalesce(query, F.lit(""))))
    df = df.withColumn("normalized_query", T.normalize(F.col("original_query")))
    df = df.withColumn("detected_language", detect_language(F.col("original_query"), F.col("normalized_query")))
    df = intent_body(df, "normalized_query")
    df = df.withColumn("raw_focus_terms", focus_terms(F.when(F.col("intent_body") != "", F.col("intent_body")).otherwise(F.col("normalized_query"))))
    df = concepts(df, rules)
    plain = lambda c: F.array_distinct(F.filter(F.flatten(F.transform(c, T.tokens)), lambda t: ~t.isin(V.STOPWORDS)))
    df = df.withColumns({"domain_terms": plain(F.transform("domains", lambda d: F.replace(d, F.lit("_"), F.lit(" ")))), "_tasks": plain(F.col("task_terms"))})
    df = df.withColumn("focus_terms", F.array_distinct(F.concat("raw_focus_terms", "concept_terms", "_tasks")))
    short = F.when(F.size("concept_terms") > 0, F.col("concept_terms")).when(F.size("raw_focus_terms") > 0, F.col("raw_focus_terms")).otherwise(F.col("_tasks"))
    df = df.withColumns({
        "lexical_query": F.when(F.size("focus_terms") > 0, F.array_join("focus_terms", " ")).otherwise(F.col("normalized_query")),
        "concise_intent": F.when(F.size(short) > 0, F.array_join(F.slice(short, 1, 8), " ")).otherwise(F.col("normalized_query")),
    }).drop("_tasks")
    df = aspects(variants(df), rules)
    return df.withColumns({
        "semantic_queries": F.transform("semantic_variants", lambda v: v["text"]), "has_multi_aspect_intent": F.size("semantic_aspects") >= 2, "is_sentence_query": F.size(T.tokens(F.col("original_query"))) >= 6,
    })


def query_labels(focus: Column, normalized: Column, hints: dict[str, str]) -> Column:
    """Q11: labels one of whose hint words the query has."""
    own = F.array_distinct(F.concat(focus, T.tokens(normalized)))
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(own, T.strings(words.split())), F.lit(label)) for label, words in hints.items())))


def anchor_candidates(raw_focus: Column, concept_terms: Column) -> Column:
    """The words of a query that may be anchors."""
    return F.filter(F.array_distinct(F.concat(raw_focus, concept_terms)), lambda t: (F.length(t) >= 3) & ~t.isin(V.STOPWORDS) & ~t.isin(V.ANCHOR_NOISE))


def anchors(plans: DataFrame, df: DataFrame, total: DataFrame) -> DataFrame:
    """Q12: (query_id, primary, secondary): words within 0.6 of the rarest word's weight, and the rest; from document frequencies (token, df) and their total."""
    from .lexical import token_idf

    words = plans.select("query_id", F.explode(anchor_candidates(F.col("raw_focus_terms"), F.col("concept_terms"))).alias("token"))
    weighed = words.join(df, "token", "left").crossJoin(F.broadcast(total)).select("query_id", "token", token_idf(F.col("df"), F.col("total")).alias("w"))
    top = weighed.groupBy(F.col("query_id").alias("q")).agg(F.max("w").alias("top"))
    marked = weighed.join(top, F.col("query_id") == F.col("q")).withColumn("p", F.col("w") >= F.greatest(F.col("top") - 0.6, F.lit(0.0)))
    per = marked.groupBy("query_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("p") == want, F.col("token")))).alias(n) for n, want in (("primary", True), ("secondary", False))))
    return plans.select("query_id").join(per, "query_id", "left").select("query_id", *(F.coalesce(n, _none()).alias(n) for n in ("primary", "secondary")))


def too_generic(raw_focus: Column, concept_terms: Column) -> Column:
    """Q13: nothing is left to search for."""
    return F.size(anchor_candidates(raw_focus, concept_terms)) == 0


def out_of_distribution() -> Column:
    """Q14: no rule matched the query."""
    return (F.size("domains") == 0) & (F.size("concept_terms") == 0) & (F.size("semantic_aspects") == 0)
