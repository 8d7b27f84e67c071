"""Listings in bundles against a file each."""

import json

import duckdb

import __spark_entry__ as entry
from quarryline.sources import io
from tests.test_entry import rows


def test_bundles_give_what_single_files_give(spark, tmp_path):
    plain = [{"title": f"a\nb {i}", "ownerUser": "o"} for i in range(9)]
    texts = [json.dumps(p if i % 3 else {"info": p}) if i % 2 else json.dumps(json.dumps(p)) for i, p in enumerate(plain)] + ["{not json"]
    for i, t in enumerate(texts):
        (tmp_path / "single" / f"k{i}").mkdir(parents=True)
        (tmp_path / "single" / f"k{i}" / "listing.txt").write_text(t)
    (tmp_path / "bundled" / "k").mkdir(parents=True)
    (tmp_path / "bundled" / "k" / "listings.txt").write_text("\n".join(texts) + "\n")
    single, bundled = io.json_directory(spark, f"{tmp_path}/single/*/*.txt"), io.json_directory(spark, f"{tmp_path}/bundled/*/*.txt", lines=True)
    assert sorted(map(str, single.select("info").collect())) == sorted(map(str, bundled.select("info").collect())) and bundled.count() == 10
    assert {r["folder"] for r in bundled.collect()} == {"k"}


def test_files_of_the_query_do_not_grow_with_its_rows(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i}", "Brand#1") for i in range(60)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    df = entry.queries()["s4_s6_p8_listing_files"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    cur = db.execute(entry.oracle_sql()["s4_s6_p8_listing_files"])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())
    assert len(df.inputFiles()) <= 12
