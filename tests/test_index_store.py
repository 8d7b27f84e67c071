"""The stored lexical index."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import dense, engine, index_store, lexical
from quarryline.plans import frames

SF = "/root/testdata/sf0.01"


def collected(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def tokens(n, seed):
    """Documents of common words; some have a passage of rare ones."""
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        words = [common[min(29, int(rng.expovariate(0.2)))] for _ in range(rng.randrange(0, 60))]
        if i % 37 == 0:
            words += [f"rare{i % 5}", f"rare{i % 5 + 1}", f"odd{i % 3}"] * rng.randrange(1, 4)
        rows.append((i, words))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [*tokens(700, 3), (9000, []), (9001, None)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").persist()


@pytest.fixture(scope="module")
def queries(spark):
    words = {1: ["rare1", "rare2", "odd1", "w1", "w2", "w3", "w0"], 2: ["w1"], 3: ["nothing"], 4: ["odd2", "w29"], 5: ["rare1", "rare2", "odd1", "w1", "w2", "w3", "w0"], 6: ["w1", "w1", "w2"]}
    rows = [(q, t, ts.count(t)) for q, ts in words.items() for t in sorted(set(ts))]
    return spark.createDataFrame(rows, "query_id long, token string, qf long")


def test_search_is_exact_and_skips_blocks(spark, corpus, queries, tmp_path):
    at = f"file://{tmp_path}/index"
    index_store.build(corpus, at)
    index = index_store.StoredIndex.open(spark, at)
    for k in (1, 5, 1000):
        assert collected(index.search(queries, k)) == collected(lexical.search(queries, corpus, k))
    read = {r["query_id"]: (r["opened"], r["blocks"]) for r in index.blocks_read(queries, 2).collect()}
    assert set(read) == {1, 2, 4, 5, 6}
    assert read[1][0] < read[1][1] / 2 and read[4][0] < read[4][1]


def test_an_index_grows_to_what_is_built_at_once(spark, corpus, queries, tmp_path):
    at = f"file://{tmp_path}/index"
    index_store.build(corpus.where("doc_id < 200"), at)
    before = index_store.StoredIndex.open(spark, at)
    index_store.append(corpus.where("doc_id >= 150 and doc_id < 500"), at)
    index_store.append(corpus.unionAll(corpus), at)
    index = index_store.StoredIndex.open(spark, at)
    want = collected(lexical.search(queries, corpus, 5))
    assert len(index.segments) == 3 and collected(index.search(queries, 5)) == want
    assert index.documents.count() == corpus.count()
    index_store.compact(spark, at)
    one = index_store.StoredIndex.open(spark, at)
    assert len(one.segments) == 1 and collected(one.search(queries, 5)) == want
    # What was opened before stays as it was.
    assert collected(before.search(queries, 5)) == collected(lexical.search(queries, corpus.where("doc_id < 200"), 5))


def test_an_empty_index(spark, corpus, queries, tmp_path):
    at = f"file://{tmp_path}/index"
    with pytest.raises(ValueError):
        index_store.StoredIndex.open(spark, at)
    index_store.build(corpus.limit(0), at)
    assert collected(index_store.StoredIndex.open(spark, at).search(queries, 5)) == []
    index_store.append(corpus, at)
    assert collected(index_store.StoredIndex.open(spark, at).search(queries, 5)) == collected(lexical.search(queries, corpus, 5))


def test_fewer_blocks_than_all_are_opened_for_the_items(spark):
    got = frames.stored_index(spark, SF).blocks_read(frames.bm25_queries(spark, SF), 5).agg(F.sum("opened"), F.sum("blocks")).first()
    assert got[0] < got[1]


def test_a_saved_engine_is_loaded(spark, tmp_path):
    rows = [(i, f"ref{i}", "kaggle", "", t, [], []) for i, t in enumerate(["river flow data", "stock prices", "river levels and river flow"])]
    docs = spark.createDataFrame(rows, "doc_id long, ref string, source string, title string, description string, keywords array<string>, quality_flags array<string>")
    load = dense.hashing_encoder(32)
    made = engine.Engine(docs, {"minilm": docs.select("doc_id", dense.encoder_udf(load)("description").alias("embedding"))}, {"minilm": load})
    made.save(f"file://{tmp_path}/engine", "minilm")
    asked = spark.createDataFrame([(1, "river flow"), (2, "stock")], "query_id long, query string")
    opened = engine.Engine.load(spark, f"file://{tmp_path}/engine", "minilm", {"minilm": load})
    assert opened.index is None
    for method in engine.METHODS:
        assert collected(opened.search(asked, method, 2, profile="minilm")) == collected(made.search(asked, method, 2, profile="minilm"))
    made.close()
    opened.close()


def test_building_and_searching_leave_no_tables_of_pairs(spark, corpus, queries, tmp_path):
    """A row for each query and window is never written, nor a posting shuffled."""
    at = f"file://{tmp_path}/index"
    index_store.build(corpus, at)
    index_store.append(corpus.selectExpr("doc_id + 100000 AS doc_id", "tokens"), at)
    index_store.compact(spark, at)
    assert len(index_store.StoredIndex.open(spark, at).search(queries, 5).collect()) > 0
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["segments", "versions"]


def test_compare_takes_only_candidates_apart(spark, tmp_path):
    """a batch's methods give what they give alone, while quality and features are made of what was found."""
    words = [f"topic{i}" for i in range(12)]
    rng = random.Random(5)
    rows = [(i, f"ref{i}", "kaggle", f"set {i}", " ".join(rng.choice(words) for _ in range(30)), [words[i % 12]], []) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, ref string, source string, title string, description string, keywords array<string>, quality_flags array<string>").persist()
    load = dense.hashing_encoder(32)
    vectors = {"minilm": docs.select("doc_id", dense.encoder_udf(load)("description").alias("embedding"))}
    asked = spark.createDataFrame([(1, "topic1 and topic2"), (2, "topic7 verisi"), (3, "nothing known")], "query_id long, query string")
    tokens = docs.select("doc_id", lexical.document_tokens(F.col("title"), F.col("keywords"), F.col("description")).alias("tokens"))
    options = engine.Options(candidates=20, rerank_depth=10)
    whole = engine.Engine(docs, vectors, {"minilm": load})
    want = {m: collected(whole.search(asked, m, 3, profile="minilm", options=options)) for m in ("bm25", "hybrid")}

    def settle(df):
        at = f"file://{tmp_path}/{settle.n}"
        settle.n += 1
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    settle.n = 0
    scans = engine.Engine(docs, vectors, {"minilm": load}, tokens=tokens, settle=settle)
    assert scans.index is None
    got = settle(scans.compare(asked, 3, profile="minilm", options=options))
    for m in want:
        assert collected(got.where(F.col("method") == m)) == want[m] != []
    few = spark.createDataFrame([(3,), (5,), (5,)], "doc_id long")
    own = scans._within(few, scans.plan(asked))
    assert {r["doc_id"] for r in own.features.collect()} == {3, 5} and own.known.count() == 2
    asked_words = {r["token"] for r in own.frequencies.collect()}
    assert asked_words and asked_words <= {"topic1", "topic2", "topic7"}
    scans.close()
    whole.close()
