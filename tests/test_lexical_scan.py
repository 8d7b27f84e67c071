"""BM25 by scans against the way by shuffled postings."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import fusion, lexical, lexical_scan


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["é", ""]
    docs = [(d, "ab"[d % 2], [rng.choice(words[:-1]) for _ in range(rng.randrange(0, 30))]) for d in range(150)]
    docs += [(d, "b", ["w1", "w2", "w3"]) for d in range(400, 300, -1)] + [(900, "a", None), (901, None, ["w1"])]
    queries = [(q, t, rng.randrange(1, 4)) for q in range(30) for t in sorted({rng.choice([*words, "nowhere"]) for _ in range(rng.randrange(1, 6))})]
    queries += [(q + 100, t, n) for q, t, n in queries if q < 5] + [(50, "w1", 0), (50, "w2", -1), (51, "nowhere", 1)]
    return spark.createDataFrame(queries, "query_id long, token string, qf long").persist(), spark.createDataFrame(docs, "doc_id long, source string, tokens array<string>").persist()


def collected(df, *columns):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_scan_gives_what_postings_give(tables, monkeypatch):
    queries, docs = tables
    settings = [(1.5, 0.75), (0.2, 1.0)]
    want = lexical.top_k(lexical.scores(queries, docs), 7), lexical.top_k(lexical.scores(queries, docs, k1=0.2, b=1.0), 7)
    columns = ("query_id", "rank", "doc_id", "score")
    for documents, tokens in ((256, 4096), (3, 2)):
        monkeypatch.setattr(lexical_scan, "_DOCUMENTS", documents)
        monkeypatch.setattr(lexical_scan, "_TOKENS", tokens)
        monkeypatch.setattr(lexical_scan, "SCAN_RESULTS", 50 * tokens)
        got = lexical.search_settings(queries, docs, 7, settings)
        for i, w in enumerate(want):
            assert collected(got.where(F.col("setting") == i), *columns) == collected(w, *columns)
    assert lexical.search(queries, docs.limit(0)).collect() == [] and lexical.search(queries.limit(0), docs).collect() == []


def test_postings_are_not_shuffled(tables):
    queries, docs = tables
    plan = lexical.search(queries, docs, 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "explode(tokens" not in plan
    twice = docs.unionAll(docs.where("doc_id < 20"))  # rows of one id are one document
    assert not lexical.scannable(queries, twice)
    assert collected(lexical.search(queries, twice, 3), "query_id", "rank", "doc_id", "score") == collected(lexical.top_k(lexical.scores(queries, twice), 3), "query_id", "rank", "doc_id", "score")


def test_source_search(tables):
    queries, docs = tables
    for source in ("b", "all", "nowhere"):
        columns = ("query_id", "rank", "doc_id", "score", "query_confidence")
        want = fusion.source_top(lexical.scores(queries, docs), docs, source, 4, normalise=True)
        assert collected(fusion.source_search(queries, docs, source, 4), *columns) == collected(want, *columns)
