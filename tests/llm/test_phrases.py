"""Collocations."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarryline.llm import phrases

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, most=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside.get((lang, p[i : i + k]), 0), a)
    out = []
    for (lang, p), a in cand.items():
        if 100 * inside.get((lang, p), 0) >= 100 * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out.sort()
    seen, ranked = Counter(), []
    for lang, score, a, p, l, r in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, l, r, n[lang], -score))
    return ranked


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_codes_are_those_of_spark(spark):
    rows = [(p, q) for p in (0, 1, -1, 2**62, -(2**63)) for q in (5, -7, 0)]
    want = [r[0] for r in spark.createDataFrame(rows, "p long, q long").select(F.xxhash64("p", "q")).collect()]
    assert phrases.pair_codes(np.array([p for p, _ in rows]), np.array([q for _, q in rows])).tolist() == want


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(None, "Null lang here"), ("en", None), ("en", ""), ("en", " ,;.\t\n"), ("", "empty lang name empty lang name"), ("und", "null LANG here"), ("en", "É é É é a a a a a"), ("en", "x" * 80_000 + " tail tail"), ("en", "tail tail " * 20_000)]
    rows += [(rng.choice(["en", "de", None]), "".join(rng.choice(["new york ", "city, ", "the ", "of the ", "big red dog ", "a\xa0b ", "x. ", "\x0b"]) for _ in range(60))) for _ in range(80)]
    rows += rows[-3:]
    docs = spark.createDataFrame([(a, t, i, 0) for i, (a, t) in enumerate(rows)], "lang string, text string, n int, `a.b` int").repartition(4)
    for least, top in ((2, 2000), (30, 2000), (3, 7)):
        assert collected(phrases.collocations(docs, least=least, top=top)) == sorted(plain(rows, least, top=top))
    assert collected(phrases.collocations(docs, least=2, most_words=2)) == sorted(plain(rows, 2, most=2))


def test_products_beyond_64_bits(spark):
    row = spark.sql("select array(9000000000000L) heads, array(9000000000L) tails, 8999999999L f, 90000000000000000L total")
    assert row.select(phrases.weakest_cut(2)["score"]).first()[0] == 1000 * 8999999999 * 90000000000000000 // (9000000000000 * 9000000000)


def test_a_full_filter_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    monkeypatch.setattr(phrases, "_LEAST_BITS", 64)
    rows = [("en", f"w{i % 50} w{i % 7} w{i % 11}, w{i % 3} w{i % 50}") for i in range(400)]
    assert collected(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3)) == sorted(plain(rows, 3))


def test_an_empty_table(spark):
    assert collected(phrases.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string").limit(0))) == []


def test_query_equals_its_sql(spark):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.ORACLE_SQL})").fetchall()
    assert want and collected(phrases.op11_phrase_collocations(spark, SF)) == sorted(want)
