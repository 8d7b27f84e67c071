"""Small hand-computed frames for functions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from quarryline.functions import labels as L
from quarryline.functions import quality as Q
from quarryline.functions import text as T
from quarryline.functions import vocabulary as V
from quarryline.operators import dense, engine, evaluate, fusion, lexical, planner, profiles, records, rerank, training
from quarryline.sources import io


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


# --- text ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""), ("  İstanbul ILIK ığüşöç ", "istanbul ilik iguşöc".translate(str.maketrans("şö", "so"))), ("Café Ünïcode", "cafe unicode"), ("ﬁne ﬂow", "fine flow"), ("ﬀ²", "ff2"),
        ("straße", "stra e"), ("a_b-c", "a b c"), ("étude", "etude"), ("ÅNGSTRÖM Ｘ１", "angstrom x1"),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, T.normalize) == want


@pytest.mark.parametrize(
    "token, want",
    [
        ("industries", ["industries", "industry"]), ("movies", ["movies", "movy"]), ("cookies", ["cookies", "cooky"]), ("zombiees", ["zombiees", "zombiee"]), ("species", ["species"]), ("running", ["running", "runn"]), ("tested", ["tested", "test"]), ("cats", ["cats"]), ("houses", ["houses", "house"]),
        ("verilerden", ["verilerden", "veri"]), ("evlerde", ["evlerde"]), ("glass", ["glass"]), ("status", ["status"]), ("depremi", ["depremi", "deprem"]), ("id", ["id"]),
    ],
)
def test_token_variants(spark, token, want):
    assert one(spark, token, T.token_variants) == want


def test_word_count_and_pieces(spark):
    assert one(spark, "", T.word_count) == 0 and one(spark, "   ", T.word_count) == 0 and one(spark, " a b\tc ", T.word_count) == 3
    assert one(spark, "x summary: | a b |", T.summary_fragment) == "a b" and one(spark, "none", T.summary_fragment) == ""
    assert one(spark, "a | | b|c ", T.split_pipe) == ["a", "b", "c"]
    assert one(spark, "::a::", lambda c: T.count_of(c, "::")) == 2


def test_card_clean(spark):
    card = "---\nlicense: mit\n---\n# Title\n```py\ncode()\n```\n<b>Bold</b> see https://x.y/z now\nLicense: none\n\n  kept line ﬁ\n"
    got = one(spark, card, T.card_clean)
    assert got["text"] == "# Title Bold see <URL> now kept line fi"
    assert got["notes"] == ["nfkc", "remove_yaml_frontmatter", "strip_codeblock", "strip_html", "remove_noise_lines:1", "mask_url", "ws_norm"]
    assert got["flags"] == ["too_short"]
    for blank in (None, "", " \n"):
        got = one(spark, blank, T.card_clean)
        assert (got["text"], got["notes"], got["flags"]) == ("", [], ["empty"])


def test_listing_clean(spark):
    assert one(spark, "a &amp; b ![i](u) [text](http://q) <i>x</i> www.z.org  Ã‚end", T.listing_clean) == "a & b text x <URL> end"
    assert one(spark, [" A ", "", "b <b>c</b>"], T.join_keywords, "array<string>") == "A , b c".replace(" ,", ",")


# --- quality and labels ---------------------------------------------------------------------------------


def signal(spark, description, keywords=(), raw=()):
    df = spark.createDataFrame([(description, list(keywords), list(raw))], "description string, keywords array<string>, quality_flags array<string>")
    return Q.adjustment(Q.flags(df, "description", "keywords", "quality_flags")).withColumn("note", Q.note()).first()


def test_quality_signal(spark):
    empty = signal(spark, "")
    assert (empty["style"], empty["length_bucket"], empty["term_bucket"], empty["all_flags"], empty["severity"], empty["score_penalty"]) == (None, None, None, ["empty"], "risk", 0.18)
    heavy = signal(spark, "a: b: c: d", ["x", "y", "z"])
    assert heavy["all_flags"] == ["short_context", "metadata_heavy", "term_sparse", "low_information"] and heavy["deemphasized"] and "mostly keywords" in heavy["note"]
    rich = signal(spark, " ".join(f"word{i}" for i in range(90)))
    assert (rich["severity"], rich["style"], rich["score_bonus"], rich["score_penalty"], rich["quality_confidence"]) == ("info", "narrative", 0.014, 0.0, 1.0)
    raw = signal(spark, "too short text", raw=["too_short", " too_short ", ""])
    assert raw["raw_flags"] == ["too_short"] and "short_context" not in raw["all_flags"]


def test_label_rules(spark):
    d = spark.createDataFrame([("stock market price history question answering time series",)], "t string").withColumn("k", F.split("t", " "))
    args = (F.col("t"), F.col("k"), F.lit(1))
    got = d.select(L.domains(*args), L.use_cases(*args), L.modalities(*args)).first()
    assert list(got[0])[:2] == ["finance_markets", "nlp_text"] and list(got[1]) == ["forecasting", "qa_generation"] and list(got[2]) == ["time_series"]


def test_topic_terms(spark):
    assert one(spark, ["en", "Health", "license:x", "a:b", " Health ", "Text", "sea"], lambda c: L.topic_terms(c, 5), "array<string>") == ["Health", "sea", "a:b"]


def test_normalised_documents(spark):
    raw = spark.createDataFrame([("r1", "Title", "rainfall data from weather stations over many years and regions of the world", ["climate", "language:en"]), ("r2", "None", "  ", ["x"])], "source_id string, title string, description string, tags array<string>")
    got = records.normalised(raw, "huggingface").collect()
    assert len(got) == 1
    r = got[0]
    assert r["ref"] == "r1" and r["language_hint"] == "en" and r["metadata_terms"] == ["climate", "en"] and r["inferred_domains"] == ["weather_climate"]
    assert r["semantic_text"].startswith("Dataset title: Title\n") and "Main topics: weather climate, climate" in r["semantic_text"]
    assert list(r.asDict()) == records.DOCUMENT


# --- metrics --------------------------------------------------------------------------------------------


def measured(spark, ranked, relevant, k):
    r = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ranked)], "query_id string, doc_id long, rank long")
    j = spark.createDataFrame([("q", d) for d in relevant], "query_id string, doc_id long")
    return evaluate.metrics(r, j, k).first()


def test_metrics_by_hand(spark):
    m = measured(spark, [9, 1, 8, 2, 7, 3], [1, 2, 3, 4], 3)
    assert m["precision_at_1"] == 0 and m["hits"] == 1 and m["first_relevant_rank"] == 2 and m["mrr"] == 0.5
    assert m["precision_at_k"] == round(1 / 3, 6) and m["recall_at_k"] == 0.25 and m["hit_rate_at_k"] == 1
    assert m["ap_at_k"] == round(0.5 / 3, 6) and m["r_precision"] == 0.5
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert m["ndcg_at_k"] == round(1 / math.log2(3) / ideal, 6)
    deep = measured(spark, [9, 8, 7, 6, 1], [1, 2, 3, 4, 5], 2)
    assert deep["mrr"] == 0.2 and deep["hit_rate_at_k"] == 0 and deep["r_precision"] == 0.2
    perfect = measured(spark, [1, 2, 3], [1, 2, 3], 5)
    assert perfect["ndcg_at_k"] == 1 and perfect["ap_at_k"] == 1 and perfect["precision_at_k"] == 0.6


def test_metrics_of_a_query_without_results(spark):
    r = spark.createDataFrame([("a", 1, 1)], "query_id string, doc_id long, rank long")
    j = spark.createDataFrame([("a", 1), ("b", 2)], "query_id string, doc_id long")
    got = {m["query_id"]: m for m in evaluate.metrics(r, j, 5).collect()}
    assert got["b"]["mrr"] == 0 and got["b"]["first_relevant_rank"] is None and got["a"]["ndcg_at_k"] == 1


def test_nearest_rank_is_half_even(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3, 3)], "v double")
    got = evaluate.nearest_rank(df, "v", [0.0, 0.1, 0.3, 0.5, 0.9, 1.0]).first()
    data = sorted([5, 1, 4, 2, 3, 3])
    assert list(got) == [float(data[int(round(5 * r))]) for r in (0.0, 0.1, 0.3, 0.5, 0.9, 1.0)]


def test_padding_and_best(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    r = spark.createDataFrame([(1, 1, "x")], "query_id long, rank long, ref string")
    got = sorted(map(tuple, evaluate.padded(r, q, 2).collect()), key=str)
    assert got == [(1, 1, "x"), (1, 2, None), (2, 1, None), (2, 2, None)]
    s = spark.createDataFrame([("a", "m1", 0.5), ("a", "m0", 0.5), ("b", "m1", 0.1)], "g string, method string, v double")
    assert sorted((r["g"], r["method"]) for r in evaluate.best_by(s, ["g"], "method", "v").collect()) == [("a", "m0"), ("b", "m1")]


# --- retrieval ------------------------------------------------------------------------------------------


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, ["c", "d"])], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (0, "zz", 1)], "query_id long, token string, qf long")
    got = {r["doc_id"]: r["score"] for r in lexical.search(q, docs, 5).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    assert got == {1: round(2 * idf(1) * part(2, 3) + idf(2) * part(1, 3), 6), 2: round(idf(2) * part(1, 1), 6)}
    again = {r["doc_id"]: r["score"] for r in lexical.search_index(q, lexical.build_index(docs), 5).collect()}
    assert again == got


def test_knn_ties_nulls_and_prefix(spark):
    docs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "doc_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    got = [(r["query_id"], r["doc_id"], r["rank"]) for r in dense.knn(q, docs, 5).orderBy("rank").collect()]
    assert got == [(7, 1, 1), (7, 3, 2), (7, 2, 3)]
    assert [(7, 1, 1), (7, 3, 2)] == [(r["query_id"], r["doc_id"], r["rank"]) for r in dense.knn(q, docs, 2).orderBy("rank").collect()]
    assert dense.knn(q.limit(0), docs, 2).collect() == []


def test_min_max(spark):
    r = spark.createDataFrame([(1, 10, 2.0), (1, 11, 4.0), (1, 12, 3.0), (2, 10, 5.0), (2, 11, 5.0), (3, 10, 0.0)], "query_id long, doc_id long, score double")
    got = {(x[0], x[1]): x[2] for x in r.select("query_id", "doc_id", fusion.min_max(F.col("score"))).collect()}
    assert got == {(1, 10): 0.0, (1, 11): 1.0, (1, 12): 0.5, (2, 10): 1.0, (2, 11): 1.0, (3, 10): 1.0}


def test_confidence(spark):
    f = lambda s, c=None: one(spark, 0, lambda _: fusion.confidence(F.lit(s), F.lit(c).cast("double")), "int")
    assert [f(0.62), f(0.61), f(0.49), f(0.7, -1.0), f(0.7, 0.0), f(0.55, -3.5)] == ["strong", "moderate", "weak", "moderate", "strong", "weak"]


def test_anchor_signal(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    f = lambda p, s, d: one(spark, 0, lambda _: rerank.anchor_signal(p, s, d), "int")
    assert f(a("x"), a("y"), a("z"))["penalty"] == 0.55 and f(a("x"), a("y"), a("y"))["penalty"] == 0.20
    both = f(a("x", "w"), a("y"), a("x", "y"))
    assert both["has_primary"] and both["bonus"] == pytest.approx(0.22 / 2 + 0.08) and both["missing_primary"] == ["w"]
    none = f(a(), a(), a("x"))
    assert none["has_primary"] and none["penalty"] == 0 and none["bonus"] == 0


def test_cross_encoder_failure_is_null(spark):
    def broken():
        raise RuntimeError("no model")

    score = rerank.scorer_udf(broken)
    assert one(spark, "q", lambda c: score(c, c)) is None


# --- planner --------------------------------------------------------------------------------------------


def planned(spark, text, rules=V.DEFAULT_RULES):
    return planner.plan(spark.createDataFrame([(1, text)], "query_id long, query string"), rules).first()


def test_intent(spark):
    for text, want in [
        ("I am looking for datasets about river flow", "river flow"), ("mushroom dataset for classification", "mushroom classification"), ("how to predict rain", "to predict rain"), ("find study of a fingerprint", "study of a fingerprint"),
        ("bana su kalitesi", "su kalitesi"), ("research on spiders", "spiders"), ("veri seti hakkinda deprem", "deprem"),
    ]:
        assert planned(spark, text)["intent_body"] == want, text


def test_plan_of_rules_given_as_json(spark):
    rules = V.Rules.from_json('{"phrases": [["moon dust", "space", ["lunar soil"], ["analysis"]]], "combos": [[["red", "planet"], "space", ["mars"], []]], "tokens": [["comet", "space", ["comet tail"]]], "aspects": [["sky", "concept", ["mars", "lunar soil"], ["planet"]]]}')
    p = planned(spark, "moon dust and comet near the red planet", rules)
    assert p["concept_phrases"] == ["lunar soil", "mars"] and p["concept_terms"] == ["lunar", "soil", "mars", "comet", "tail"] and p["domains"] == ["space"] and p["task_terms"] == ["analysis"]
    assert p["semantic_aspects"][0]["key"] == "sky" and p["semantic_aspects"][0]["text"] == "lunar soil mars planet"
    assert planned(spark, "moon dust", rules.without())["concept_terms"] == []


# --- training, records, engine ----------------------------------------------------------------------------


def test_split_is_md5(spark):
    import hashlib

    keys = [f"q{i}" for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(training.split(F.col("k"))).collect()]
    assert got == ["dev" if int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % 7 < 1 else "train" for k in keys]


def test_merge_prefers_the_first_source(spark):
    a = spark.createDataFrame([("k", 1, "a1"), ("k", 2, "a2")], "key string, n int, v string")
    b = spark.createDataFrame([("k", 0, "b0"), ("l", 5, "b5"), ("l", 4, "b4")], "key string, n int, v string")
    assert sorted(r["v"] for r in records.merge([a, b], ["key"], ["n"]).collect()) == ["a1", "b4"]


def test_validation(spark):
    known = spark.createDataFrame([("a",)], "ref string")
    with pytest.raises(ValueError):
        records.validate_references(spark.createDataFrame([("a",), ("b",)], "ref string"), known, "ref")
    assert records.validate_references(known, known, "ref").collect() == []
    assert engine.check_request(" q ", "bm25", "all", "50") == 20 and engine.check_request("q", "hybrid", "kaggle", None) == 5
    for bad in (("", "bm25", "all"), ("q", "x", "all"), ("q", "bm25", "y")):
        with pytest.raises(ValueError):
            engine.check_request(*bad, 5)
    assert profiles.get("TR").key == "multilingual" and profiles.get(None).key == "minilm"
    with pytest.raises(ValueError):
        profiles.get("nope")


def test_readers(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2}\n')
    assert sorted(r["x"] for r in io.json_lines(spark, f"{at}/a.jsonl", "x long").collect()) == [1, 2]
    assert io.bad_lines(spark, f"{at}/a.jsonl", "x long").count() == 1
    assert io.json_lines(spark, f"{at}/none.jsonl", "x long").collect() == []
    with pytest.raises(Exception):
        io.json_lines(spark, f"{at}/a.jsonl", "x long", "strict").collect()
    (tmp_path / "d.json").write_text('[{"x": 1}, {"x": 3}]')
    assert io.json_document(spark, f"{at}/d.json").count() == 2
    with pytest.raises(ValueError):
        io.write_vectors(spark.createDataFrame([(1, None)], "id long, embedding array<float>"), f"{at}/v")
    md = io.report(spark.createDataFrame([("m", 0.5)], "method string, ndcg double"), "T", ["method", "ndcg"])
    assert md.splitlines()[-1] == "| m | 0.5000 |"


def test_engine(spark):
    texts = {1: "rainfall and river flow measurements for flood forecasting", 2: "stock market price history of many companies", 3: "images of plant disease on leaves", 4: "river water level records", 5: ""}
    docs = spark.createDataFrame([(i, f"ref{i}", "kaggle" if i % 2 else "huggingface", t.split(" ")[0] if t else "", t, t.split(" ")[:2], []) for i, t in texts.items()], "doc_id long, ref string, source string, title string, description string, keywords array<string>, quality_flags array<string>")
    load = dense.hashing_encoder(64)
    encode = dense.encoder_udf(load)
    vectors = docs.select("doc_id", encode("description").alias("embedding"))
    e = engine.Engine(docs, {"minilm": vectors, "multilingual": vectors}, {"minilm": load, "multilingual": load})
    e.warm()
    queries = spark.createDataFrame([(1, "river flow dataset"), (2, "stok fiyat verisi stock")], "query_id long, query string")
    got = e.compare(queries, 2)
    first = {(r["method"], r["query_id"]): r["doc_id"] for r in got.where("rank = 1").collect()}
    assert first[("bm25", 1)] in (1, 4) and first[("bm25", 2)] == 2 and first[("hybrid", 2)] == 2 and first[("semantic", 1)] in (1, 4)
    only = e.search(queries, "bm25", 3, source="huggingface").join(docs, "doc_id").collect()
    assert {r["source"] for r in only} == {"huggingface"}
    assert e.results(e.search(queries, "hybrid", 1)).count() == 2
    judged = spark.createDataFrame([(1, "river flow dataset", 1), (1, "river flow dataset", 4), (2, "stok fiyat verisi stock", 2)], "query_id long, query string, doc_id long")
    m = {(r["method"], r["query_id"]): r for r in e.evaluate(judged, 2, ("bm25",)).collect()}
    assert len(m) == 2 and m[("bm25", 2)]["mrr"] == 1 and m[("bm25", 1)]["recall_at_k"] == 1 and m[("bm25", 2)]["latency_ms"] > 0
    probes = spark.createDataFrame([(1, "river flow", "ref4"), (2, "stock market", "stock"), (3, "opera singers", "weak")], "probe_id long, query string, expected string")
    got = {r["combo"]: r for r in evaluate.probes(e.probe(probes, 3, ("bm25",)), probes.select("probe_id", "expected")).collect()}
    assert got["minilm/bm25"]["in_corpus"] == 2 and got["minilm/bm25"]["p_at_3"] == 1
    e.close()


def test_folding_of_all_characters(spark):
    """X1 to X3 against the Unicode database: every character that has an ASCII letter or digit in its decomposition, alone and among others."""
    import re
    import unicodedata

    turkish = str.maketrans("ÇçĞğİıÖöŞşÜü", "ccggiioossuu")

    def plain(s):
        folded = unicodedata.normalize("NFKD", s.strip(" ").translate(turkish).lower())
        return re.findall("[a-z0-9]+", "".join(c for c in folded if not unicodedata.combining(c)))

    chars = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if re.search("[a-zA-Z0-9]", unicodedata.normalize("NFKD", c.lower()))]
    assert len(chars) > 1800
    texts = [f"x{c}y 1{c}" for c in chars] + ["5½ ㎏ ﬁﬂ 𝐚𝑏𝟗 ① ™", "".join(chars)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(4)
    got = {r["i"]: r["k"] for r in df.select("i", T.tokens(F.col("t")).alias("k")).collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, (len(wrong), wrong[:5])
