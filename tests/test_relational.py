"""Medians, containment, vector cells and source filters against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import vocabulary as V
from quarryline.operators import containment, dense, fusion, planner, quantiles, rule_tables, vector_index


def test_medians(spark, monkeypatch):
    rng = random.Random(2)
    groups = {"odd": [rng.random() for _ in range(501)], "even": [rng.gauss(0, 1e6) for _ in range(400)], "same": [3.5] * 60, "one": [7.0], "two": [1.0, 2.0], "none": [None, None], None: [5.0, None, 6.0], "skew": [0.0] * 300 + [1e12, 5.0, 6.0], "ties": [1.0] * 50 + [2.0] * 50}
    rows = [(k, v, 0) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, n int")
    want = {k: statistics.median([v for v in vs if v is not None]) if any(v is not None for v in vs) else None for k, vs in groups.items()}
    for ranges in (1, 4, 1 << 16):
        monkeypatch.setattr(quantiles, "RANGES", ranges)
        assert {r["g"]: r["median"] for r in quantiles.medians(df, ["g"], "v").collect()} == want
    assert quantiles.medians(df.limit(0), ["g"], "v").collect() == []


def test_containment(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["", "é", "a.b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", " ", "w1 w2 w3" * 2000, "x"]
    phrases = [None, "", " ", "  ", "x", "é", "w1", "1 w", "w1 w2", "1 w2 w", "w1 w2 w3w1 w2", "nothing of it", "w3 w4 w5 w6 w7 w8"]
    phrases += [t[a : a + n] for t in texts if t and len(t) > 30 for a, n in [(rng.randrange(len(t) - 20), rng.randrange(1, 20)) for _ in range(3)]]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "w1 w2")], "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string")
    got = sorted(tuple(r) for r in containment.contains_join(docs, asked).where("doc_id is not null").collect())
    own = [*enumerate(texts), (0, texts[0])]
    assert got == sorted((d, i) for d, t in own for i, p in enumerate(phrases) if p and t is not None and p in t)
    assert containment.contains_join(docs, asked.limit(0)).collect() == [] and containment.contains_join(docs.limit(0), asked).collect() == []
    plan = containment.contains_join(docs, asked)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    v = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))).astype(float)
    v[100:120] = v[100]  # equal vectors
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None)], "doc_id long, embedding array<float>").persist()


def test_vector_cells(spark, vectors, tmp_path):
    vector_index.build(vectors, f"file://{tmp_path}/cells", cells=20)
    index = vector_index.VectorIndex.open(spark, f"file://{tmp_path}/cells")
    asked = vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "score").collect())
    for k in (1, 10, 2000):
        assert rows(index.search(asked, k)) == rows(dense.knn(asked, vectors, k))
    few = vector_index.recall(index.search(asked, 10, probes=4), dense.knn(asked, vectors, 10)).first()
    assert few["queries"] == 18 and few["expected"] == 180 and few["recall"] >= 0.9
    kept = spark.read.parquet(f"{tmp_path}/cells/cells")
    assert kept.agg(F.sum("n")).first()[0] == 900


def test_vector_cells_of_nothing(spark, vectors, tmp_path):
    vector_index.build(vectors.limit(0), f"file://{tmp_path}/none")
    assert vector_index.VectorIndex.open(spark, f"file://{tmp_path}/none").search(vectors.withColumnRenamed("doc_id", "query_id"), 3).collect() == []


def test_source_top(spark):
    rng = random.Random(6)
    scored = [(q, d, round(rng.random(), 3)) for q in range(4) for d in range(50)] + [(9, 1, 0.5), (9, 2, 0.5)]
    docs = spark.createDataFrame([(d, "ab"[d % 2]) for d in range(50)], "doc_id long, source string")
    got = fusion.source_top(spark.createDataFrame(scored, "query_id long, doc_id long, score double"), docs, "b", 3, normalise=True).collect()
    want = {}
    for q in {q for q, _, _ in scored}:
        own = [(d, s) for i, d, s in scored if i == q]
        lo, hi = min(s for _, s in own), max(s for _, s in own)
        for rank, (s, d) in enumerate(sorted((-(1.0 if hi == lo else (s - lo) / (hi - lo)), d) for d, s in own if d % 2)[:3]):
            want[q, rank + 1] = (d, round(-s, 6))
    assert {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got} == want


#: Query texts for the planner, English and Turkish.
PLANNED = [
    (1, "I am looking for a dataset about air pollution monitoring in cities"),
    (2, "deprem verisi ariyorum"),
    (3, "Find datasets for plant disease classification"),
    (4, "stock market price history prediction"),
    (5, "show me river flow records"),
    (6, "su kalitesi icin veri seti"),
    (7, "I want speech emotion recordings that can be used for classification"),
    (8, "mushroom dataset for classification"),
    (9, "customer churn"),
    (10, "How do hospital admissions change over time when it rains for many days in a row and rivers rise above their banks"),
    (11, "i want a dataset"),
    (12, ""),
]


def test_rule_tables_equal_the_planners_expressions(spark):
    plans = planner.plan(spark.createDataFrame(PLANNED, "query_id long, query string")).select("query_id", "normalized_query", "raw_focus_terms", "concept_phrases", "concept_terms", "domains", "task_terms")
    names = ["concept_phrases", "concept_terms", "domains", "task_terms"]
    tables = rule_tables.RuleTables.of(spark, V.DEFAULT_RULES)
    got = {r["query_id"]: r for r in rule_tables.concepts(plans.drop(*names), tables).collect()}
    want = {r["query_id"]: r for r in plans.collect()}
    assert got.keys() == want.keys() and any(r["domains"] for r in want.values())
    for i, r in want.items():
        assert [got[i][n] for n in names] == [r[n] for n in names], r["normalized_query"]
    none = rule_tables.concepts(plans.drop(*names), tables.without()).select(*(F.size(n) for n in names)).distinct().collect()
    assert [tuple(r) for r in none] == [(0, 0, 0, 0)]


def test_held_combos(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(9)]
    queries = {q: sorted({rng.choice(words) for _ in range(rng.randrange(0, 7))}) for q in range(60)}
    combos = {c: [rng.choice(words) for _ in range(rng.randrange(0, 4))] for c in range(40)}
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, token string")
    rules = spark.createDataFrame(list(combos.items()), "rule long, tokens array<string>")
    got = sorted(tuple(r) for r in rule_tables.held_combos(terms, rules).collect())
    assert got == sorted((q, c) for q, ts in queries.items() for c, needs in combos.items() if needs and set(needs) <= set(ts))


def test_phrases_of_two_words_have_one_key(spark):
    """Runs of three letters are in nearly every text; the ends around the space are not."""
    phrases = spark.createDataFrame([(0, "er on"), (1, "thereding tionhan"), (2, "a b")], "phrase_id long, p string")
    assert sorted(r["phrase_id"] for r in containment._phrase_keys(phrases).collect()) == [0, 1, 2]
    docs = spark.createDataFrame([(5, "under once"), (6, "under  once"), (7, "xthereding tionhany"), (8, "hereding tionhan"), (9, "a b")], "doc_id long, text string")
    got = sorted(tuple(r) for r in containment.contains_join(docs, phrases.withColumnsRenamed({"phrase_id": "item_id", "p": "text"})).collect())
    assert got == [(5, 0), (7, 1), (9, 2)]


def test_triplets_against_plain_python(spark):
    """Many relevant documents a query, few label sets, some queries with mined candidates and some without."""
    from quarryline.operators import training

    rng = random.Random(11)
    docs = {d: (rng.choice("ab"), rng.choice("xy"), rng.choice("mn")) for d in range(120)}
    judged = sorted({(q, rng.randrange(120)) for q in range(4) for _ in range(5 + 20 * q)})
    pool = {(q, d): rng.randrange(1, 9) / 4 for q in (0, 1) for d in rng.sample(range(120), 2 + 6 * q)}
    of = {q: "ab"[q % 2] for q in range(4)}
    table = spark.createDataFrame([(d, [a], [b], [c]) for d, (a, b, c) in docs.items()], "doc_id long, domains array<string>, uses array<string>, modes array<string>")
    candidates = spark.createDataFrame([(q, d, ["bm25"], s) for (q, d), s in pool.items()], "query_id long, doc_id long, methods array<string>, rank_score double")
    rows = training.triplets(spark.createDataFrame(judged, "query_id long, doc_id long"), candidates, table, spark.createDataFrame([(q, [x]) for q, x in of.items()], "query_id long, q_domains array<string>"))
    got = sorted((r["query_id"], r["positive_id"], r["negative_id"], r["negative_hardness"], r["mined_from"]) for r in rows.collect())
    want = []
    for q, p in judged:
        same = lambda d, i: docs[d][i] == docs[p][i]
        score = lambda d, a, b: 0.8 * (docs[d][0] == of[q]) + a * same(d, 0) + b * same(d, 1) + 0.4 * same(d, 2)
        mined = [(0, -round(s + score(d, 1.2, 0.7), 6), d) for (x, d), s in pool.items() if x == q and (q, d) not in judged]
        back = [(1, -round(score(d, 1.0, 0.6), 6), d) for d in docs if (q, d) not in judged and score(d, 1.0, 0.6) > 0 and d not in [m[2] for m in mined]]
        want += [(q, p, d, -s, "" if kind else "bm25") for kind, s, d in sorted(mined + back)[:3]]
    assert got == sorted(want)
    # Negatives are ranked once for a class of relevant documents, not for each of them.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(kind" in plan
