"""Topic, task and modality labels from rule tables, and the texts built from them.

Rules are few and constant, so they become expressions: one struct (score, order, label) per rule,
filtered and sorted in place. No join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import quality as Q
from . import text as T
from . import vocabulary as V


def _best(scored: list[tuple[str, Column]], most: int, least: Column, limit_first: bool) -> Column:
    """Labels by score descending, ties in rule order."""
    rows = F.array(*(F.struct((-s).alias("neg"), F.lit(k).alias("ord"), F.lit(label).alias("label")) for k, (label, s) in enumerate(scored)))
    hit = F.array_sort(F.filter(rows, lambda r: r["neg"] < 0))
    enough = lambda a: F.filter(a, lambda r: -r["neg"] >= least)
    kept = enough(F.slice(hit, 1, most)) if limit_first else F.slice(enough(hit), 1, most)
    return F.transform(kept, lambda r: r["label"])


def domains(text: Column, toks: Column, least: Column, rules: dict = V.DOMAIN_RULES) -> Column:
    """L1, L2: at most three domains of a normalised text."""
    scored = []
    for label, (phrases, words) in rules.items():
        two = sum((F.when(F.contains(text, F.lit(p)), 2).otherwise(0) for p in phrases.split("|")), F.lit(0))
        scored.append((label, two + F.size(F.array_intersect(toks, T.strings(words.split())))))
    return _best(scored, 3, least, False)


def use_cases(text: Column, toks: Column, least: Column, rules: dict = V.USE_CASE_RULES) -> Column:
    """L3: at most four use cases, cut before the threshold. A pattern of several words that the text lacks counts its words."""
    scored = []
    for label, patterns in rules.items():
        total = F.lit(0)
        for p in patterns.split("|"):
            single = sum((F.when(F.array_contains(toks, w), 1).otherwise(0) for w in p.split()), F.lit(0))
            total = total + (F.when(F.contains(text, F.lit(p)), 2).otherwise(single) if " " in p else single)
        scored.append((label, total))
    return _best(scored, 4, least, True)


def modalities(text: Column, toks: Column, least: Column, rules: dict = V.MODALITY_RULES) -> Column:
    """L4: at most three modalities, cut before the threshold."""
    scored = [(label, sum((F.when(F.contains(text, F.lit(p)), 2).otherwise(0) if " " in p else F.when(F.array_contains(toks, p), 1).otherwise(0) for p in patterns.split("|")), F.lit(0))) for label, patterns in rules.items()]
    return _best(scored, 3, least, True)


def with_labels(df, title: str, description: str, keywords: str, metadata: str):
    """``df`` (after quality.flags) with inferred_domains, inferred_use_cases, inferred_modalities. A de-emphasised title is left out and two points are needed."""
    title_off = Q.deemphasize()
    text = F.concat_ws(" ", F.when(~title_off, F.expr(f"nullif({title}, '')")), F.expr(f"nullif({description}, '')"), F.array_join(keywords, " "), F.array_join(metadata, " "))
    df = df.withColumn("_text", T.normalize(text)).withColumn("_least", F.when(title_off, 2).otherwise(1))
    df = df.withColumn("_toks", F.array_distinct(F.split("_text", " ")))
    args = (F.col("_text"), F.col("_toks"), F.col("_least"))
    return df.withColumns({"inferred_domains": domains(*args), "inferred_use_cases": use_cases(*args), "inferred_modalities": modalities(*args)}).drop("_text", "_least", "_toks")


def label_text(labels: Column) -> Column:
    """X14."""
    return F.transform(labels, lambda x: F.replace(x, F.lit("_"), F.lit(" ")))


def _part(name: str, values: Column, sep: str = ", ") -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(name), F.array_join(values, sep)))


def semantic_summary(title: Column, description: Column, keywords: Column, domains_: Column, uses: Column, modes: Column, language: Column, note: Column) -> Column:
    """Labelled parts joined by bars; the title only where no quality note stands."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    topical = F.slice(F.filter(keywords, lambda k: ~F.contains(k, F.lit(":"))), 1, 8)
    return F.concat_ws(
        " | ",
        F.when(F.coalesce(note, F.lit("")) == "", F.concat(F.lit("title: "), some(F.trim(title)))),
        F.concat(F.lit("quality: "), some(note)),
        _part("domains: ", label_text(domains_)),
        _part("use cases: ", label_text(uses)),
        _part("modalities: ", label_text(modes)),
        F.concat(F.lit("language: "), some(language)),
        _part("keywords: ", topical),
        F.concat(F.lit("summary: "), some(T.truncate_words(description, 60))),
    )


def topic_terms(values: Column, most: int) -> Column:
    """Terms that name a topic, those with a colon last, distinct."""
    clean = T.strip_list(values)
    good = F.filter(clean, lambda v: ~F.lower(v).isin(V.LOW_SIGNAL_TOPICS))
    plain = F.filter(good, lambda v: ~F.contains(v, F.lit(":")))
    other = F.filter(good, lambda v: F.contains(v, F.lit(":")) & ~T.starts_with_any(F.lower(v), V.TOPIC_PREFIXES))
    return F.slice(F.array_distinct(F.concat(plain, other)), 1, most)


def semantic_text(title: Column, description: Column, keywords: Column, metadata: Column, domains_: Column, uses: Column, modes: Column, language: Column, flags: Column, note: Column, summary: Column) -> Column:
    """The lines that an encoder reads."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    low = Q.low_information(description, flags)
    excerpt = T.truncate_words(description, 90)
    fragment = T.truncate_words(T.summary_fragment(summary), 80)
    said = F.when(~low & (excerpt != ""), excerpt).when((fragment != "") & ~Q.low_information(fragment, flags), fragment)
    keys, extra = topic_terms(keywords, 10), topic_terms(metadata, 8)
    topics = F.array_distinct(F.concat(label_text(domains_), F.slice(topic_terms(F.concat(keywords, metadata), 10), 1, 6)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Dataset title: "), some(F.trim(title))),
        F.concat(F.lit("Dataset description: "), said),
        _part("Main topics: ", topics),
        _part("Task/use case: ", label_text(uses)),
        _part("Data modality: ", F.array_compact(F.array(F.when(F.size(modes) > 0, F.array_join(label_text(modes), ", ")), F.concat(F.lit("language: "), some(language)))), " | "),
        F.coalesce(_part("Keywords: ", keys), _part("Keywords: ", extra)),
        F.when(low, _part("Supporting metadata: ", F.slice(F.array_except(extra, keys), 1, 6))),
        F.concat(F.lit("Semantic quality: "), some(note)),
        F.when(low, _part("Description quality: ", F.array_distinct(flags))),
    )
