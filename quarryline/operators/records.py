"""Catalogue records: shaping, normalising, merging, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import quality as Q
from ..functions import text as T

#: A record's text fields, cleaned ones first.
TEXT_FIELDS = ("clean_description_basic", "clean_description", "description", "text", "raw_description", "body")
MIN_CHARS = 20


def some(c: Column) -> Column:
    """Trimmed, null if blank."""
    t = F.trim(c)
    return F.when(t != "", t)


def field(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or null of its type where the table lacks it: sources differ in their fields."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def pick_text(df: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """First field that is not blank."""
    return F.coalesce(*(some(field(df, f)) for f in fields))


def pick_ref(df: DataFrame, source: Column) -> Column:
    """source_id, ref, id, name, else source:title."""
    title = some(field(df, "title"))
    return F.coalesce(*(some(field(df, f)) for f in ("source_id", "ref", "id", "name")), F.concat(source, F.lit(":"), title))


def pick_url(df: DataFrame, source: Column, ref: Column, bases: dict[str, str]) -> Column:
    """The given address, else one derived from the source's base."""
    derived = F.lit(None).cast("string")
    for name, base in bases.items():
        derived = F.when((source == name) & ref.isNotNull(), F.concat(F.lit(base), ref)).otherwise(derived)
    return F.coalesce(some(field(df, "url")), derived)


def pick_keywords(df: DataFrame) -> Column:
    """``keywords`` before ``tags``; an array stands even if empty, a string is split at commas."""
    out = F.array().cast("array<string>")
    for name in ("tags", "keywords"):
        if name not in df.columns:
            continue
        c = F.col(name)
        if dict(df.dtypes)[name].startswith("array"):
            out = F.when(c.isNotNull(), T.strip_list(c.cast("array<string>"))).otherwise(out)
        else:
            out = F.when(some(c).isNotNull(), T.strip_list(F.split(c, ","))).otherwise(out)
    return out


def pick_language(language: Column, keywords: Column) -> Column:
    """P5: the field, else the first ``language:`` tag, lower case; empty without either."""
    tag = F.get(F.filter(keywords, lambda k: k.rlike("(?i)^language:.+")), F.lit(0))
    return F.lower(F.coalesce(some(language), F.trim(F.regexp_extract(tag, "(?i)^language:(.+)$", 1)), F.lit("")))


def pick_license(license_: Column, keywords: Column) -> Column:
    """The field, else the first ``license:`` tag."""
    tag = F.get(F.filter(keywords, lambda k: F.startswith(k, F.lit("license:"))), F.lit(0))
    return F.coalesce(some(license_), F.trim(F.substr(tag, F.lit(9))), F.lit(""))


def first_license(licenses: Column) -> Column:
    """P6 for listings: the name of the first of an array of structs."""
    return F.coalesce(F.get(licenses, F.lit(0))["name"], F.lit(""))


def metadata_terms(keywords: Column) -> Column:
    """Lower-cased tags; language, task and modality tags give their comma-separated values; first seen stay."""
    pattern = "(?i)^(language|task_categories|modality):(.+)$"
    each = F.transform(keywords, lambda k: F.when(F.lower(k).rlike(pattern), F.split(F.regexp_extract(F.lower(k), pattern, 2), ",")).otherwise(F.array(F.lower(k))))
    return F.array_distinct(T.strip_list(F.flatten(each)))


def listing_records(files: DataFrame) -> DataFrame:
    """Raw listing rows (info struct, path) -> flat records; rows without reference or title are dropped."""
    i = F.col("info")
    ref = F.concat_ws("/", some(i["ownerUser"]), some(i["datasetSlug"]))
    rows = files.select(
        F.lit("kaggle").alias("source"), ref.alias("ref"), some(i["title"]).alias("title"), F.coalesce(some(i["subtitle"]), F.lit("")).alias("subtitle"), F.coalesce(some(i["description"]), F.lit("")).alias("description"),
        T.strip_list(i["keywords"]).alias("keywords"), first_license(i["licenses"]).alias("license"), F.concat(F.lit("https://www.kaggle.com/datasets/"), ref).alias("url"), F.col("path").alias("metadata_path"),
    )
    return rows.where((F.col("ref") != "") & F.col("title").isNotNull())


def clean_listing(rows: DataFrame, entities: bool = True) -> DataFrame:
    """Cleaned listing records with description, notes and flags; those without a description or under MIN_CHARS are dropped."""
    rows = rows.withColumns({
        "title": F.coalesce(some(T.listing_clean(F.col("title"), entities)), F.lit("Untitled Dataset")),
        "_sub": T.listing_clean(F.col("subtitle"), entities),
        "_text": T.listing_clean(F.col("description"), entities),
        "_keys": T.join_keywords(F.col("keywords"), entities),
    })
    rows = rows.withColumn("_d", T.description(F.col("_sub"), F.col("_text"), F.col("_keys")))
    rows = rows.select(*(c for c in rows.columns if c not in ("description", "_d", "text")), F.col("_d.text").alias("description"), F.col("_d.notes").alias("cleaning_notes"))
    # The filters look at cleaned texts. Pushed down they would clean every text twice; a filter on a row number stays where it is.
    rows = rows.withColumns({"text": F.concat(F.col("title"), F.lit(". "), F.col("description")), "_row": F.monotonically_increasing_id()})
    rows = rows.where((F.col("_row") >= 0) & (F.col("description") != "") & (F.length("text") >= MIN_CHARS)).drop("_row")
    return rows.withColumns({
        "quality_flags": Q.listing_flags(F.col("description"), F.col("cleaning_notes")),
        "description_len_chars": F.length("description").cast("long"),
        "description_len_words": T.word_count(F.col("description")),
    }).drop("_sub", "_text", "_keys")


def clean_cards(rows: DataFrame, text: str = "raw_description", unicode: bool = True) -> DataFrame:
    """Card records with clean text, notes, flags and lengths."""
    rows = rows.withColumn("_c", T.card_clean(F.col(text), unicode))
    return rows.withColumns({
        "clean_description_basic": F.col("_c.text"), "cleaning_notes": F.col("_c.notes"), "quality_flags": Q.card_flags(field(rows, "quality_flags", "array<string>"), F.col("_c.flags")),
        "description_len_chars": F.length("_c.text").cast("long"), "description_len_words": T.word_count(F.col("_c.text")),
    }).drop("_c")


def normalised(df: DataFrame, source_hint: str, bases: dict[str, str] | None = None) -> DataFrame:
    """Raw or clean records of one source -> documents with quality note, labels, summary and semantic text; rows without text are dropped (F1)."""
    source = F.lower(F.coalesce(some(field(df, "source")), F.lit(source_hint)))
    keys = pick_keywords(df)
    rows = df.withColumns({"_source": source, "_keys": keys})
    rows = rows.select(
        F.col("_source").alias("source"), pick_ref(df, source).alias("ref"), F.coalesce(some(field(df, "title")), F.lit("Untitled Dataset")).alias("title"), pick_text(df).alias("description"),
        pick_url(df, source, pick_ref(df, source), bases or {}).alias("url"), F.col("_keys").alias("keywords"), pick_language(field(df, "language"), F.col("_keys")).alias("language_hint"),
        metadata_terms(F.col("_keys")).alias("metadata_terms"), pick_license(field(df, "license"), F.col("_keys")).alias("license"),
        F.coalesce(field(df, "quality_flags", "array<string>"), F.array().cast("array<string>")).alias("quality_flags"),
        field(df, "description_len_chars", "long").alias("_chars"), field(df, "description_len_words", "long").alias("_words"),
    ).where(F.col("description").isNotNull())
    rows = Q.flags(rows, "description", "keywords", "quality_flags", "_words").withColumn("semantic_quality_note", Q.note())
    rows = L.with_labels(rows, "title", "description", "keywords", "metadata_terms")
    c = F.col
    rows = rows.withColumn("semantic_summary", L.semantic_summary(c("title"), c("description"), c("keywords"), c("inferred_domains"), c("inferred_use_cases"), c("inferred_modalities"), c("language_hint"), c("semantic_quality_note")))
    rows = rows.withColumn("semantic_text", L.semantic_text(c("title"), c("description"), c("keywords"), c("metadata_terms"), c("inferred_domains"), c("inferred_use_cases"), c("inferred_modalities"), c("language_hint"), c("quality_flags"), c("semantic_quality_note"), c("semantic_summary")))
    return rows.select(
        "source", "ref", "title", "description", F.trim(F.concat(c("title"), F.lit(". "), c("description"))).alias("text"), "semantic_summary", "semantic_quality_note", "url", "keywords", "language_hint", "metadata_terms",
        "inferred_domains", "inferred_use_cases", "inferred_modalities", "license", "quality_flags",
        F.coalesce(F.expr("nullif(_chars, 0)"), F.length("description")).cast("long").alias("description_len_chars"), F.coalesce(F.expr("nullif(_words, 0)"), c("word_count")).cast("long").alias("description_len_words"), "semantic_text",
    )


def rank_key(ref: Column, source: Column, title: Column) -> Column:
    """P14."""
    return F.coalesce(F.expr("cast(null as string)") if ref is None else some(ref), F.concat(F.coalesce(source, F.lit("unknown")), F.lit(":"), F.coalesce(title, F.lit(""))))


def rerank_text(semantic_text: Column, description: Column, text: Column, summary: Column, title: Column, most: int = 3200) -> Column:
    """The first field that is not blank, white space collapsed, cut."""
    return F.substring(F.coalesce(*(some(T.squeeze(c)) for c in (semantic_text, description, text, summary)), T.squeeze(title), F.lit("")), 1, most)


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order (dropDuplicates has none)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of sources in priority order, one row a key; within a source the first in ``order``."""
    tagged = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_by_key(out, keys, [F.col("_p"), *map(F.col, order)]).drop("_p")


def merge_report(sources: dict[str, DataFrame], merged: DataFrame, column: str = "source") -> DataFrame:
    """U2's counts: input, written and skipped rows of each source."""
    counts = None
    for name, s in sources.items():
        one = s.agg(F.lit(name).alias(column), F.count("*").alias("input"))
        counts = one if counts is None else counts.unionAll(one)
    kept = merged.groupBy(column).agg(F.count("*").alias("written"))
    return counts.join(kept, column, "left").select(column, "input", F.coalesce("written", F.lit(0)).alias("written")).withColumn("skipped", F.col("input") - F.col("written"))


def new_rows(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def validate_references(refs: DataFrame, known: DataFrame, column: str, fail: bool = True) -> DataFrame:
    """references without a target, all of them; with ``fail`` a non-empty result raises."""
    missing = refs.select(column).where(F.col(column).isNotNull()).distinct().join(known.select(column).distinct(), column, "left_anti")
    if fail:
        some_ = [r[0] for r in missing.orderBy(column).limit(20).collect()]
        if some_:
            raise ValueError(f"references without a target, for example {some_}")
    return missing


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value; arrays count each element."""
    c = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    return df.select(c.alias("value")).select(F.col("value").cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def defaults(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Constants where a column is missing or null."""
    return df.withColumns({k: F.coalesce(field(df, k), F.lit(v)) for k, v in values.items()})


def grouped(df: DataFrame, key: str, column: str) -> DataFrame:
    """Sorted distinct values of a key; for keys with few rows, such as a query's relevant documents."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias(column))


def token_set(*parts: Column) -> Column:
    """Distinct tokens of several texts."""
    return F.array_distinct(F.flatten(F.array(*(T.tokens(p) for p in parts))))


DOCUMENT = ["source", "ref", "title", "description", "text", "semantic_summary", "semantic_quality_note", "url", "keywords", "language_hint", "metadata_terms", "inferred_domains", "inferred_use_cases", "inferred_modalities", "license", "quality_flags", "description_len_chars", "description_len_words", "semantic_text"]


def indexed(df: DataFrame) -> DataFrame:
    """P10, K7: the columns an index keeps, null texts empty; rows without text are dropped."""
    kinds = dict(df.dtypes)
    keep = [F.coalesce(F.col(c), F.lit("") if kinds[c] == "string" else F.array().cast(kinds[c])).alias(c) if kinds[c] == "string" or kinds[c].startswith("array") else F.col(c) for c in DOCUMENT if c in kinds]
    return df.where(F.length(F.trim(F.coalesce("semantic_text", "text", F.lit("")))) > 0).select(*keep)
