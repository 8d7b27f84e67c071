"""SQL fragments that the oracle queries share (DuckDB)."""

from __future__ import annotations

from ..functions import vocabulary as V


def lit(values) -> str:
    """A list of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def fold(x: str) -> str:
    return f"strip_accents(lower(translate(trim(coalesce({x}, '')), '{V.TURKISH_FROM}', '{V.TURKISH_TO}')))"


def toks(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[a-z0-9]+')"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({fold(x)}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"regexp_extract_all(coalesce({x}, ''), '\S+')"


def first_words(x: str, n: int) -> str:
    return f"array_to_string(({words(x)})[1:{n}], ' ')"


def count_of(x: str, s: str) -> str:
    return f"((length({x}) - length(replace({x}, '{s}', ''))) // {len(s)})"


def terms(x: str) -> str:
    """Distinct content terms, as a count."""
    return f"len(list_distinct(list_filter({toks(x)}, lambda t: length(t) >= 3 AND NOT list_contains({lit(V.STOPWORDS)}, t))))"


CORPUS = f"""c AS (SELECT doc_id, source, lang, text AS description, {first_words('text', 6)} AS title, [lang, source] AS keywords FROM documents)"""

QUERIES = f"""q AS (SELECT item_id AS query_id, token, count(*) AS qf FROM (SELECT item_id, unnest({toks('text')}) AS token FROM benchmark) GROUP BY ALL)"""

RANKED = f"""
t AS (SELECT doc_id, {toks('text')} AS tk FROM documents),
st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM t WHERE len(tk) > 0),
tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS token FROM t) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
{QUERIES},
s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
      FROM q JOIN tf USING (token) JOIN df USING (token) CROSS JOIN st GROUP BY query_id, doc_id)"""


def ranked(k: int, source: str = "s", name: str = "r") -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k})"


JUDGED = "j AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"

#: Query vectors: ids divisible by 50, against all.
NEAREST = """n AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"""
