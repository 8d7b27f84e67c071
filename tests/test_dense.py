"""Nearest vectors: what a task holds does not grow with queries times documents."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarryline.operators import dense


def found(ids, matrix, v, k, size):
    batches = (pa.RecordBatch.from_arrays([pa.array(np.arange(a, min(a + size, len(v)))), pa.array(list(v[a : a + size]))], ["d", "v"]) for a in range(0, len(v), size))
    out = list(dense._best(batches, ids, matrix, k))
    return [(q, d, round(s, 6)) for b in out for q, d, s in zip(*(c.to_pylist() for c in b.columns))]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_best_of_blocks(monkeypatch, k):
    monkeypatch.setattr(dense, "SCORES", 1 << 12)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 4)).round(1)
    v[40:80] = v[40]  # equal scores go to the smaller id
    ids, matrix = np.arange(7) * 50, rng.normal(size=(7, 4))
    scores = np.round(matrix @ v.T, 6)
    want = [(int(ids[q]), int(d), round(float(scores[q, d]), 6)) for q in range(7) for d in np.lexsort((np.arange(300), -scores[q]))[:k]]
    assert found(ids, matrix, v, k, 64) == want


def test_memory_of_a_task():
    rng = np.random.default_rng(4)
    v, matrix = rng.normal(size=(8192, 8)), rng.normal(size=(2048, 8))
    tracemalloc.start()
    assert len(found(np.arange(2048), matrix, v, 2, 8192)) == 4096
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_the_expression_scores_what_is_found_only(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 8)).round(1).astype(np.float32)
    v[30:40] = v[30]
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<float>")
    queries = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    rows = dense.knn_sql(queries, docs, 5)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert key(rows) == key(dense.knn(queries, docs, 5)) and rows.count() == 20
    assert "Join Cross" not in rows._jdf.queryExecution().optimizedPlan().toString()
