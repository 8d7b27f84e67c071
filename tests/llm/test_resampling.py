"""Importance resampling."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import numbering, resampling, tries

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(rows, target, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for r in out:
        r.append(None)
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[5] = k + 1
    return [(i, n, w, s_, rank) for i, n, w, s_, _, rank in out]


def tidy(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def collected(df):
    return tidy(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_states_follow_the_trie():
    rng = np.random.default_rng(2)
    advance = tries.Advance(most=8)
    for n in (0, 1, 7, 8, 9, 100, 5000):
        a, b = rng.bytes(12), rng.bytes(n)
        state = advance(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(state[0]) == zlib.crc32(a + b)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "One two"), (6, "Ünï ÇODE été " * 30), (None, "a b c d " * 6), (None, "a b c d " * 6), (7, "x" * 100_000 + " y"), (8, "benchmark words " * 9_000), (8, "benchmark words " * 9_000)]
    rows += [(i, f"w{i % 7} common words of a text number {i % 3} and more of it, again: " * 3) for i in range(10, 70)]
    target = ["benchmark words here", None, "", "w3 common words"]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, weight int, `a.b` string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.draw(resampling.weights(docs, resampling.gains(docs, bench)), percent=40)
    want = plain(rows, target, percent=40)
    assert collected(got) == tidy(want)
    drawn = resampling.resampled(docs, bench, percent=40)
    assert drawn.columns == docs.columns
    assert tidy((r["doc_id"],) for r in drawn.collect()) == tidy((r[0],) for r in want if r[4])


def test_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.draw(resampling.weights(none, resampling.gains(none, docs))).collect() == []
    assert len(resampling.draw(resampling.weights(docs, resampling.gains(docs, none))).collect()) == 1


def test_query_equals_plain_python(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert collected(resampling.op13_importance_resampling(spark, SF)) == tidy(plain(rows, target))


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_of_rows(spark, parts):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), "id").repartition(parts)
    got = numbering.numbered(df, [F.col("k").desc(), F.col("id")], "at").collect()
    want = {i: n + 1 for n, (_, i) in enumerate(sorted(((-(i % 10)), i) for i in range(1000)))}
    assert {r["id"]: r["at"] for r in got} == want
