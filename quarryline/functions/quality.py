"""Description quality: flags, buckets, styles, score adjustments.

All functions take Columns of one document and return Columns, so that quality is computed once per
document, not once per query and candidate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import vocabulary as V


def has(flags: Column, *names: str) -> Column:
    return F.arrays_overlap(flags, T.strings(list(names)))


def listing_flags(description: Column, notes: Column) -> Column:
    """Flags at ingestion of a catalogue listing."""
    return F.array_compact(
        F.array(
            F.when(~F.array_contains(notes, "description"), F.lit("no_long_description")),
            F.when(notes == T.strings(["keywords"]), F.lit("keyword_only")),
            F.when(F.length(description) < 80, F.lit("short_description")),
        )
    )


def card_flags(old: Column, new: Column) -> Column:
    """Y2: both sets of flags, sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), new)))


def length_bucket(n: Column, short: int = 20, medium: int = 52) -> Column:
    """Y3."""
    return F.when(n <= short, F.lit("short")).when(n <= medium, F.lit("medium")).otherwise(F.lit("long"))


def term_bucket(n: Column, sparse: int = 10, moderate: int = 28) -> Column:
    """Y4."""
    return F.when(n <= sparse, F.lit("term_sparse")).when(n <= moderate, F.lit("term_moderate")).otherwise(F.lit("term_rich"))


def style(description: Column, keywords: Column, n_words: Column, bullets_too: bool = False) -> Column:
    """Y5; ``bullets_too`` counts the bullet sign as well."""
    low, colons = F.lower(description), T.count_of(description, ":")
    marks = T.count_of(description, "- ") + T.count_of(low, "keywords:") + T.count_of(low, "use cases:") + T.count_of(low, "columns:")
    marks = marks + T.count_of(description, "•") if bullets_too else marks
    n_keys = F.size(F.coalesce(keywords, F.array().cast("array<string>")))
    return (
        F.when((n_words <= 40) & ((n_keys >= 3) | (colons >= 3)), F.lit("metadata_heavy"))
        .when((marks >= 2) | (colons >= 4), F.lit("mixed_structured"))
        .when(n_words >= 80, F.lit("narrative"))
        .when(n_keys > 0, F.lit("mixed_structured"))
        .otherwise(F.lit("narrative"))
    )


def report_style(description: Column) -> Column:
    """The report's classifier, from sentences, structure lines, tags and the share of stopwords."""
    t = F.trim(F.coalesce(description, F.lit("")))
    toks = T.tokens(t)
    lines = F.filter(F.transform(F.split(t, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    sentences = F.size(F.filter(F.split(t, "[.!?]+"), lambda s: F.size(T.tokens(s)) >= 4))
    structure = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(#|[-*]|\d+\.)"))) + F.regexp_count(F.lower(t), F.lit(r"\b[a-z_]+:[a-z0-9_./-]+\b"))
    marks = T.count_of(t, "##") + T.count_of(t, "###") + T.count_of(t, "---") + T.count_of(t, "`")
    structure = structure + F.when(F.startswith(t, F.lit("---")), 2).otherwise(0) + F.when(marks >= 3, 1).otherwise(0)
    stop = F.size(F.filter(toks, lambda x: x.isin(V.STOPWORDS))) / F.greatest(F.size(toks), F.lit(1))
    return (
        F.when(F.size(toks) == 0, F.lit("mixed_structured"))
        .when((structure >= 3) & (sentences <= 1) & (stop < 0.22), F.lit("metadata_heavy"))
        .when((sentences >= 2) & (stop >= 0.22) & (structure <= 1), F.lit("narrative"))
        .otherwise(F.lit("mixed_structured"))
    )


def flags(df, description: str, keywords: str, raw: str, n_words: str | None = None, web: bool = False):
    """Y6 (``web``: Y12's variant): ``df`` with word_count, term_count, style, length_bucket, term_bucket, raw_flags, inferred_flags, all_flags, severity."""
    d, k = F.coalesce(F.col(description), F.lit("")), F.col(keywords)
    counted = T.word_count(d)
    df = df.withColumns({
        "word_count": F.coalesce(F.expr(f"nullif({n_words}, 0)").cast("long"), counted) if n_words else counted,
        "term_count": F.size(T.content_terms(d)).cast("long"),
        "raw_flags": F.array_distinct(T.strip_list(F.col(raw))),
    })
    n, terms = F.col("word_count"), F.col("term_count")
    df = df.withColumns({
        "style": F.when(d != "", style(d, k, n, web)),
        "length_bucket": F.when(n != 0, length_bucket(n)),
        "term_bucket": F.when((terms != 0) | (d != ""), term_bucket(terms)),
    })
    heavy, sparse = F.coalesce(F.col("style") == "metadata_heavy", F.lit(False)), F.coalesce(F.col("term_bucket") == "term_sparse", F.lit(False))
    short = F.coalesce(F.col("length_bucket") == "short", F.lit(False))
    low = ((has(F.col("raw_flags"), "keyword_only") | heavy) & short) | (heavy & sparse)
    inferred = F.array_compact(
        F.array(
            F.when(F.trim(d) == "", F.lit("empty")),
            F.when(short & ~has(F.col("raw_flags"), "short_description", "too_short"), F.lit("short_context")),
            F.when(heavy, F.lit("metadata_heavy")),
            F.when(sparse, F.lit("term_sparse")),
            F.when(low, F.lit("low_information")),
        )
    )
    df = df.withColumn("inferred_flags", inferred)
    df = df.withColumn("all_flags", F.array_distinct(F.concat("raw_flags", "inferred_flags")))
    worst = F.when(has(F.col("all_flags"), "empty", "keyword_only", "low_information"), F.lit("risk")).when(F.size("all_flags") > 0, F.lit("warning")).otherwise(F.lit("info"))
    return df.withColumn("severity", worst)


def risk_flags(all_flags: Column) -> Column:
    """Y7."""
    return F.array_intersect(all_flags, T.strings(V.RISKY_FLAGS))


def deemphasize() -> Column:
    """Y8, over the columns of :func:`flags`."""
    n = F.col("word_count")
    mixed = F.coalesce((F.col("style") == "mixed_structured") & (F.col("term_bucket") == "term_sparse"), F.lit(False))
    return (F.size(risk_flags(F.col("all_flags"))) > 0) | n.between(1, 12) | (n.between(1, 24) & mixed)


def note() -> Column:
    """Y9, over the columns of :func:`flags`."""
    f = risk_flags(F.col("all_flags"))
    reason = (
        F.when(has(f, "empty"), "description is empty")
        .when(has(f, "keyword_only", "metadata_heavy"), "description is mostly keywords or metadata")
        .when(has(f, "low_information", "term_sparse"), "description has limited semantic detail")
        .when(has(f, "too_short", "short_description") | (F.col("word_count") <= 24), "description is very short")
        .otherwise("description provides weak semantic evidence")
    )
    return F.when(deemphasize(), F.concat(F.lit("Limited semantic evidence: "), reason, F.lit("; title terms are de-emphasized."))).otherwise(F.lit(""))


def adjustment(df):
    """``df`` (after :func:`flags`) with deemphasized, score_penalty, score_bonus, quality_confidence."""
    table = F.create_map(*(x for k, v in V.FLAG_PENALTIES.items() for x in (F.lit(k), F.lit(v))))
    total = F.aggregate("all_flags", F.lit(0.0), lambda s, f: s + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    info = F.col("severity") == "info"
    df = df.withColumn("deemphasized", deemphasize())
    df = df.withColumns({
        "_penalty": F.least(F.lit(0.18), total + F.when(F.col("deemphasized"), 0.03).otherwise(0.0)),
        "_bonus": F.when(info & (F.col("style") == "narrative"), 0.008).otherwise(0.0) + F.when(info & (F.col("term_bucket") == "term_rich"), 0.006).otherwise(0.0),
    })
    return df.withColumns({
        "score_penalty": F.bround("_penalty", 4),
        "score_bonus": F.bround("_bonus", 4),
        "quality_confidence": F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("_penalty") + F.col("_bonus"))), 4),
    }).drop("_penalty", "_bonus")


def low_information(description: Column, quality_flags: Column) -> Column:
    """The description says little."""
    t = F.trim(F.coalesce(description, F.lit("")))
    low, n, colons = F.lower(t), T.word_count(t), T.count_of(t, ":")
    bullets = T.count_of(t, "- ") + T.count_of(low, "keywords:") + T.count_of(low, "tags:")
    markers = sum((T.count_of(low, m) for m in V.STRUCTURE_MARKERS), F.lit(0))
    return (
        (t == "")
        | has(quality_flags, *V.LOW_DESCRIPTION_FLAGS)
        | ((n <= 20) & (F.startswith(low, F.lit("keywords:")) | (colons >= 3)))
        | (F.startswith(low, F.lit("---")) & (n <= 60))
        | (markers >= 2)
        | ((n <= 60) & ((colons >= 4) | (bullets >= 3)))
        | ((n <= 40) & (bullets >= 4))
    )


def flag_severity(all_flags: Column) -> Column:
    """struct(flag, severity) of each flag and the worst of them."""
    table = F.create_map(*(F.lit(x) for kv in V.FLAG_SEVERITY.items() for x in kv))
    return F.transform(all_flags, lambda f: F.struct(f.alias("flag"), F.coalesce(F.try_element_at(table, f), F.lit("info")).alias("severity")))
