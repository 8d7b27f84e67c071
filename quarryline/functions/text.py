"""Text functions: Column in, Column out, inside the JVM.

Python's ``\\s`` and ``\\w`` are Unicode, Java's are ASCII unless ``(?U)`` is given; the patterns
here say which they mean. :func:`nfkc` and :func:`unescape_html` are the two that need Python.
"""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import vocabulary as V

WORD = r"(?U)\S+"


def _decomposed(c: str) -> str:
    """What compatibility decomposition leaves of a character, marks dropped."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _folding() -> list[str]:
    """Characters beyond ASCII that lower case leaves as they are; no surrogates and no Hangul syllables, whose parts are no ASCII either."""
    return [c for c in map(chr, [*range(0x80, 0xAC00), *range(0xE000, 0x110000)]) if c.lower() == c]


@lru_cache
def _fold_table() -> tuple[str, str]:
    """Characters and what is left of each where that is one character or none; beyond the alphabets where it is ASCII."""
    kept, gone = [], []
    for c in _folding():
        if unicodedata.combining(c):
            gone.append(c)
            continue
        base = _decomposed(c)
        if len(base) == 1 and base != c and (ord(c) < 0x3100 or 0xFF00 < ord(c) < 0xFFE7 or base.isascii()):
            kept.append((c, base))
    return "".join(c for c, _ in kept) + "".join(gone), "".join(b for _, b in kept)


@lru_cache
def _several() -> tuple[str, str]:
    """Characters that leave several, ligatures, fractions, units and the like: a class of a regular expression, and pairs for ``str_to_map``."""
    found = [(c, _decomposed(c)) for c in _folding() if not unicodedata.combining(c) and len(_decomposed(c)) > 1]
    ranges: list[list[int]] = []
    for c, _ in found:
        if ranges and ranges[-1][1] == ord(c) - 1:
            ranges[-1][1] += 1
        else:
            ranges.append([ord(c), ord(c)])
    some = lambda parts: "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in parts) + "]"
    # A class of many ranges is tried range by range: ASCII and the letters of most European texts, between the first of them, are told before.
    usual = [(0, ranges[0][0] - 1), (ranges[0][1] + 1, ranges[1][0] - 1)]
    return f"(?!{some(usual)}){some(ranges)}", "\x02".join(f"{c}\x01{b}" for c, b in found)


def ascii_fold(text: Column) -> Column:
    """Trim, Turkish letters to ASCII, lower case, compatibility forms taken apart, marks dropped; null is empty. Hangul and ideographs stay and count as separators later."""
    base = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(F.translate(base, V.TURKISH_FROM, V.TURKISH_TO))
    some, pairs = _several()
    table = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))
    wide = F.array_join(F.transform(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    low = F.when(low.rlike(some), wide).otherwise(low)
    # Most texts are ASCII, which has as many bytes as characters: nothing to look up there.
    return F.when(F.octet_length(base) == F.length(base), F.lower(base)).otherwise(F.translate(low, *_fold_table()))


def normalize(text: Column) -> Column:
    """Folded, everything but letters, digits and spaces a space, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_fold(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text, repeats kept."""
    return F.regexp_extract_all(ascii_fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """X11."""
    return F.size(words(text)).cast("long")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def token_variants(token: Column) -> Column:
    """The token, without its first Turkish suffix in list order (three letters must stay), and by one English rule; distinct, in this order."""
    suffix = F.get(F.filter(strings(V.TURKISH_SUFFIXES), lambda s: F.endswith(token, s) & (F.length(token) - F.length(s) >= 3)), F.lit(0))
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    ends = lambda s: F.endswith(token, F.lit(s))
    plural = ends("s") & (n >= 5) & ~(ends("ss") | ends("us") | ends("is") | ends("ies"))
    vowel = F.substring(token, F.greatest(n - 3, F.lit(1)), F.lit(1)).isin(*"aeiou")
    english = (
        F.when(token.isin(V.PLURAL_KEEP), F.lit(None).cast("string"))
        .when(ends("ies") & (n >= 5) & ~vowel, F.concat(cut(3), F.lit("y")))
        .when(ends("ing") & (n >= 7), cut(3))
        .when(ends("ed") & (n >= 6), cut(2))
        .when(plural, cut(1))
    )
    return F.array_distinct(F.array_compact(F.array(token, cut(F.length(suffix)), english)))


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts pass through."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """HTML character references resolved, then composed by compatibility."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://(?U:\S)+|www\.(?U:\S)+", " <URL> ")


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def card_clean(text: Column, unicode: bool = True) -> Column:
    """struct(text, notes, flags) of a dataset card: front matter, code, tags and metadata lines out, addresses masked."""
    t = F.coalesce(text, F.lit(""))
    t = nfkc(t) if unicode else t
    front = F.regexp_replace(t, r"(?s)^---.*?---(?U:\s*)", "")
    code = F.regexp_replace(front, r"(?s)```.*?```", " ")
    tags = F.when(F.contains(code, F.lit("<")) & F.contains(code, F.lit(">")), F.regexp_replace(code, r"<[^>]+>", " ")).otherwise(code)
    lines = F.filter(F.transform(F.split(tags, r"\R|[\x0b\x0c\x1c-\x1e]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    noise = "^(" + "|".join(V.CARD_NOISE_PREFIXES) + ")"
    kept = F.filter(lines, lambda x: ~F.lower(x).rlike(noise))
    removed = F.size(lines) - F.size(kept)
    joined = F.array_join(kept, " ")
    masked = mask_urls(joined)
    clean = squeeze(masked)
    blank = F.trim(F.regexp_replace(t, r"(?U)\s+", "")) == ""
    notes = F.array_compact(
        F.array(
            F.lit("nfkc"),
            F.when(front != t, F.lit("remove_yaml_frontmatter")),
            F.when(F.contains(front, F.lit("```")), F.lit("strip_codeblock")),
            F.when(tags != code, F.lit("strip_html")),
            F.when(removed > 0, F.concat(F.lit("remove_noise_lines:"), removed.cast("string"))),
            F.when(masked != joined, F.lit("mask_url")),
            F.lit("ws_norm"),
        )
    )
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(blank, F.lit("")).otherwise(clean).alias("text"),
        F.when(blank, none).otherwise(notes).alias("notes"),
        F.when(blank, F.array(F.lit("empty"))).when(F.length(clean) < 80, F.array(F.lit("too_short"))).otherwise(none).alias("flags"),
    )


def fix_encoding(text: Column) -> Column:
    """Literal repairs, in order."""
    for bad, good in V.MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def listing_clean(text: Column, entities: bool = True) -> Column:
    """Entities resolved, encoding repaired, code, images, links and tags out, addresses masked."""
    t = F.coalesce(text, F.lit(""))
    t = fix_encoding(unescape_html(t) if entities else t)
    for pattern, by in ((r"(?s)```.*?```", " "), (r"!\[([^\]]*)\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<[^>]+>", " ")):
        t = F.regexp_replace(t, pattern, by)
    return squeeze(mask_urls(t))


def join_keywords(keywords: Column, entities: bool = True) -> Column:
    """Cleaned keywords joined by comma; entities need Python, so resolve them before if ``entities`` is False."""
    clean = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: listing_clean(k, False))
    joined = F.array_join(F.filter(clean, lambda k: k != ""), ", ")
    return unescape_html(joined) if entities else joined


def description(subtitle: Column, text: Column, keywords: Column) -> Column:
    """struct(text, notes) of already cleaned parts."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    parts = F.concat_ws(" ", some(subtitle), some(text), F.concat(F.lit("Keywords: "), some(keywords)))
    notes = F.array_compact(F.array(*(F.when(some(c).isNotNull(), F.lit(n)) for c, n in ((subtitle, "subtitle"), (text, "description"), (keywords, "keywords")))))
    return F.struct(F.trim(parts).alias("text"), notes.alias("notes"))


def truncate_words(text: Column, n: int) -> Column:
    """The first n words, single spaces."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def summary_fragment(text: Column) -> Column:
    """What follows the first ``summary:``, without outer spaces and bars; empty without it."""
    at = F.locate("summary:", text)
    return F.when(at > 0, F.regexp_replace(F.substring(text, at + 8, F.length(text)), r"^[ |]+|[ |]+$", "")).otherwise(F.lit(""))


def strip_list(values: Column) -> Column:
    """Trimmed, blanks dropped."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")


def content_terms(text: Column) -> Column:
    """Distinct tokens of three letters and more that are no stopwords."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(V.STOPWORDS)))


def count_of(text: Column, literal: str) -> Column:
    """Occurrences of a literal, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(text, F.lit(p))
    return out


def split_pipe(text: Column) -> Column:
    """X23."""
    return strip_list(F.split(F.coalesce(text, F.lit("")), r"\|"))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the distinct query values that the document has; 0 without query values."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, doc)) / F.size(q)).otherwise(F.lit(0.0))


def phrase_hits(text: Column, clues: Column, clean) -> Column:
    """Clues whose cleaned form the text contains, distinct in order."""
    return F.array_distinct(F.filter(clues, lambda c: (clean(c) != "") & F.contains(text, clean(c))))


def keep_words(text: Column) -> Column:
    """Lower case without marks, everything but word characters a space (underscores stay)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *_fold_table()), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def web_terms(text: Column) -> Column:
    """The web page's count of content terms: runs of three letters and digits and more, Turkish ones too, without folding."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9a-zA-ZçğıöşüÇĞİÖŞÜ]{3,}"), F.lit(0))
    return F.size(F.array_distinct(F.filter(F.transform(found, lambda t: F.lower(t)), lambda t: ~t.isin(V.WEB_STOPWORDS)))).cast("long")


def web_language(query: Column) -> Column:
    """The web page's language of a query: a Turkish letter or marker word."""
    low = F.lower(F.coalesce(query, F.lit("")))
    marked = F.arrays_overlap(words(F.translate(low, ",.", "  ")), strings(V.WEB_TURKISH_MARKERS))
    return F.when(low.rlike(f"[{V.WEB_TURKISH_LETTERS}]") | marked, F.lit("tr")).otherwise(F.lit("en"))


def utc_now() -> Column:
    """The query's time as ISO 8601 in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
