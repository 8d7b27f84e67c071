"""Exact duplicates."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from quarryline.llm import exact

SF = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256("".join(c for c in text or "" if c not in " \t\n\x0b\f\r").encode()).hexdigest()


def plain(rows):
    """One (doc_id, keep_id, group_size, sha) a row and the kept (doc_id, text) of each group."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append((i, t or ""))
    out, kept = [], []
    for sha, members in groups.items():
        first = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        kept.append((first[0], sha))
        out += [(i, first[0], len(members), sha) for i, _ in members]
    return out, kept


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, `a.b` int").repartition(3)
    got = exact.decisions(docs, **options).collect()
    want, kept = plain(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert sorted(((r["doc_id"], r["text_sha256"]) for r in got if r["kept"]), key=key) == sorted(kept, key=key)
    stays = exact.unique(docs, **options)
    assert stays.columns == docs.columns
    assert sorted(((r["doc_id"], digest(r["text"])) for r in stays.collect()), key=key) == sorted(kept, key=key)


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (None, "a b"), (None, "ab"), (4, "ab"), (4, "ab"), (4, "a  b"), (5, "a  b"), (6, "a b"), (7, "é" * 50_000), (8, "é " * 50_000), (9, "é"), (10, "é")]


def test_odd_rows(spark):
    check(spark, ODD)


def test_frequent_texts_take_the_broadcast_way(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot text", "hot  text ", f"t{rng.randrange(40)}"])) for i in range(600)]
    rows += [(None, "hottext")] * 3
    check(spark, rows)
    check(spark, rows, tracked=8)  # more digests than counters
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(replace(text, ' ', '')) d")
    hot = docs.where("doc_id = 0 or d = xxhash64('hottext')").first()["d"]
    assert hot in {r["item"] for r in exact.frequent(docs, "d", 8).collect()}


def test_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert exact.decisions(docs).collect() == [] and exact.unique(docs).collect() == []


def test_no_python_in_the_plan(spark):
    plan = exact.op12_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("sf", [SF])
def test_query_equals_its_sql(spark, sf):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in exact.op12_exact_dedup(spark, sf).collect()) == sorted(want)
