"""Language, quality and toxicity: held-out figures and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import language, quality, sample, toxicity

SF = "/root/testdata/sf0.1"
ODD = [(1, None, "en"), (2, "", "en"), (3, "  123 !? ", "fr"), (4, "the and of the word", "en"), (4, "the and of the word", "en"), (None, "le la les des", "fr"), (5, "x" * 200_000, "de"), (6, "\U0001d54f 日本 e", "xx")]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_language_held_out(spark):
    docs = table(spark, "documents").select("doc_id", "lang")
    got = language.op1_language_id(spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert len(got) > 2000
    assert (got.lang_pred == got.lang).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_language_kernel_is_exact():
    """The product of presence and collapsed weights is the kernel's: with all texts as landmarks it is plain kernel ridge regression."""
    texts, labels = ["abc abd", "abd abc abe", "xyz xyy", "yyz xyz"], ["a", "a", "b", "b"]
    m = language.fit_rows(texts, labels, landmarks=4, ridge=1e-6)
    p, _ = language.presence(texts, m.classes, m.column, len(m.weights))
    k = (p @ p.T) / np.sqrt(np.outer(p.sum(1), p.sum(1)))
    y = np.where(np.array(labels)[:, None] == np.array(["a", "b"])[None, :], 1.0, -1.0)
    want = k @ np.linalg.solve(k + 0 * np.eye(4), y)
    got = (p @ m.weights) / np.sqrt(p.sum(1))[:, None]
    assert np.allclose(got, want, atol=1e-2)
    assert m.predict(["abc", "zyx xyz", "", None, "12"])[0] == ["a", "b", "und", "und", "und"]


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, a, 0.5) for i, t, a in ODD], "doc_id long, text string, lang string, score double")
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "4", "5", "6", "None"]
    assert language.fit(docs.limit(0)) is None
    assert [r["lang_pred"] for r in language.predict(docs.where("doc_id = 4"), None).collect()] == ["und", "und"]


def test_bounded_sample(spark):
    df = spark.range(10_000).withColumn("x", F.col("id") % 7)
    got = sample.bounded_sample(df, ["id"], 100).collect()
    assert len(got) == 100 and got == sample.bounded_sample(df.repartition(7), ["id"], 100).collect()
    assert sample.bounded_sample(df.limit(30), ["id"], 100).count() == 30


def test_quality_held_out(spark):
    labels = table(spark, "labels").select("doc_id", "quality")
    got = quality.op4_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.97
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    assert (got.predicted == got.quality).mean() > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, b"", 1.0) for i, t, _ in ODD], "doc_id long, text string, x binary, score double")
    labels = spark.createDataFrame([(2, 0), (4, 1), (4, 1), (5, 0), (6, None)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    got = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score(stats, quality.fit(stats, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.document_statistics(docs.limit(0)).collect() == []


def test_isotonic():
    v, p = quality.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([1.0, 0, 2, 1, 4]), np.array([2.0, 2, 2, 2, 4]))
    assert (np.diff(v) > 0).all() and (np.diff(p) > 0).all() and p[0] == 0.25 and p[-1] == 1


def test_toxicity_held_out(spark):
    labels = table(spark, "labels").select("doc_id", "toxic")
    got = toxicity.op9_toxicity(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    assert got.predicted[got.toxic == 0].mean() < 0.01
    assert got.predicted[got.toxic == 1].mean() > 0.7


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t, _ in ODD], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(4, 1), (5, 0), (99, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.random() < 0.3)
        rows.append((np.unique(np.concatenate([rng.integers(100, 4000, 30), [7] if y else []]).astype(int)), y))
    w, b = toxicity.ftrl(rows)
    assert w[7] > 1 and (w != 0).sum() < 400
    assert np.mean([(w[x].sum() + b > 0) == y for x, y in rows]) == pytest.approx(1.0)
