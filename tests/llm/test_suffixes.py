"""Suffix deduplication against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm.suffixes import kept_texts, remove_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, t in enumerate(raw):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((d, p))
    gone = [[False] * len(t) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + length] = [True] * length
    out = []
    for t, g in zip(raw, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passage = " ".join(word() for _ in range(30))
    line = " ".join(word() for _ in range(9))
    texts = [None, "", "short", "De " * 60, "De " * 90, "e De " * 50, "a" * 300, "aa" * 40]
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts += base + base[:2]
    for _ in range(12):
        cut = sorted(rng.randrange(len(base[0])) for _ in range(2))
        texts.append(base[0][: cut[0]] + word() + base[0][cut[1] :])
    for _ in range(12):
        texts.append(" ".join(word() for _ in range(rng.randrange(20))) + passage[rng.randrange(40) :] + " ".join(word() for _ in range(rng.randrange(20))))
    for _ in range(12):
        texts.append(" ".join(word() for _ in range(15)) + line + " ".join(word() for _ in range(15)))
    return texts


@pytest.mark.parametrize("most", [1, 4, 20_000])
@pytest.mark.parametrize("length", [64, 100])
def test_against_brute_force(spark, most, length):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, h string").repartition(5)
    rows = remove_repeats(docs, length=length, most_fragments=most).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    docs = spark.createDataFrame([(1, t), (1, t), (None, "x" + t), (2, "other")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in remove_repeats(docs).collect())
    assert got == [(0, 501, 500), (1, 500, 500), (1, 500, 500), (2, 5, 0)]
    assert remove_repeats(docs.limit(0)).collect() == []


def brute_words(texts, n):
    split = [(t or "").split() for t in texts]
    seen = {}
    for d, w in enumerate(split):
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), []).append((d, p))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d].update(range(p, p + n))
    return [[x for i, x in enumerate(w) if i not in g] for w, g in zip(split, gone)]


@pytest.mark.parametrize("most", [1, 20_000])
def test_passages_by_words(spark, most):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    some = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "a " * 60, "b c " * 25]
    for n in (49, 50, 51, 52, 60, 62):
        passage = some(n)
        texts += [f"{some(20)} {passage} {some(9)}", f"{some(3)}\n{passage.replace(' ', chr(10), 3)} {some(30)}"]
    # Two passages of 30 words that recur apart are none of 60.
    a, b = some(30), some(30)
    texts += [f"{some(5)} {a} {b} {some(5)}", f"{some(8)} {a} {some(5)}", f"{some(9)} {b} {some(7)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in kept_texts(docs, words=51, most_fragments=most).collect()}
    assert [got[i].split() for i in range(len(texts))] == brute_words(texts, 51)


def test_pipeline_cuts_passages_of_51_words(spark):
    import corpus_pipeline

    rng = random.Random(9)
    some = lambda n: " ".join(f"{rng.randrange(10**5):x}" for _ in range(n))
    passage, heads = some(51), [some(30), some(40)]
    assert len(passage) < 400
    docs = spark.createDataFrame([(i, f"{h} {passage}") for i, h in enumerate(heads)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["suffix_array_dedup"]
    assert {r["doc_id"]: r["text"].strip() for r in stage(spark, docs, "").collect()} == dict(enumerate(heads))


def test_transform_goes_through_its_files(tmp_path, monkeypatch):
    import numpy as np

    from quarryline.llm import suffixes

    t = bytes(range(74))
    windows = lambda: suffixes.repeated_windows([t, t[:70], t[::-1]], np.array([10, 10, 10]), 64, f"file://{tmp_path}")
    assert windows().sum(axis=1).tolist() == [7, 7, 0]
    assert not list(tmp_path.iterdir())
    # What a round knows of the one before is in the file: other common prefixes there are other results.
    write = suffixes.Segments._write
    monkeypatch.setattr(suffixes.Segments, "_write", lambda self, order, before, common: write(self, order, before, np.zeros_like(common)))
    assert windows().sum() == 0


def test_counted_passages(spark):
    rng = random.Random(11)
    some = lambda n: " ".join(f"{rng.randrange(10**4):x}" for _ in range(n))
    passage = some(55)
    assert len(passage) < 400
    texts = [None, "", f"{some(9)} {passage}", f"{passage} {some(70)}", some(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_passage_words"]) for r in remove_repeats(docs, words=51).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 55), 3: (0, 55), 4: (0, 0)}


def test_bytes_and_words_in_one_construction(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in remove_repeats(docs, length=100, most_fragments=4, words=16).collect()}
    alone = {r["doc_id"]: r["n_passage_words"] for r in remove_repeats(docs, length=400, words=16).collect()}
    want = brute(texts, 100)
    for i, t in enumerate(texts):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want[i]
        assert got[i]["n_passage_words"] == alone[i] == len((t or "").split()) - len(brute_words(texts, 16)[i])


def test_documents_in_parts(spark, monkeypatch):
    from quarryline.llm import suffixes

    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(9000))
    texts = [text, text[2000:2400] + "x" + text[5990:6120], "y" * 10]
    monkeypatch.setattr(suffixes, "_PART", 1000)
    blocks = [(a, bytes(data)) for _, data, _, a in suffixes._parts([pa.record_batch({"t": [text]})], 100)]
    assert len(blocks) == 9 and all(text.encode()[a : a + len(d)] == d for a, d in blocks)
    whole = {(f[1].item(k) + a, f[2].item(k)) for a, d in blocks for f in [suffixes.fragments(np.frombuffer(d, np.uint8), np.array([0, len(d)]), 100)] for k in range(len(f[1]))}
    covered = sorted(x for s, n in whole for x in range(s, s + n))
    assert covered == list(range(len(text) - 99))


def test_other_columns_keep_their_names(spark):
    from quarryline.llm import language

    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    docs = spark.createDataFrame([(1, t, "a", 1, 2, 3), (2, t + "z", "b", 4, 5, 6)], "doc_id long, text string, lang string, `_` int, `a.b` int, t int")
    out = kept_texts(docs)
    assert out.columns == docs.columns
    assert sorted((r["_"], r["a.b"], r["t"], r["text"]) for r in out.collect()) == [(1, 2, 3, ""), (4, 5, 6, "z")]
    out = language.accepted(docs, language.fit(docs))
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in docs.collect())
