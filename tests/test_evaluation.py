"""Queries of metrics against their SQL, where the first words of an item point elsewhere than the item."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_entry import rows

ITEM = "amber basin cedar delta ember fjord"
DOCUMENTS = [(1, f"some words before {ITEM} and some after", "en", "web"), (2, "granite harbor inlet jungle kelp lagoon stands alone here", "fr", "books")]
DOCUMENTS += [(i, "amber basin " * 3 + f"filler{i}", "en", "web") for i in range(3, 9)] + [(9, None, "de", "web"), (10, "granite harbor granite harbor", "de", "books")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("evaluation"))
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "granite harbor inlet jungle kelp lagoon")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", ["e1_e9_w2_metrics", "a9_summary", "a10_summary_by_field", "a11_j11_pairwise", "j10_a13_exposure"])
def test_same_rows_as_sql(spark, tables, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    df, cur = entry.queries()[name](spark, tables), db.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert want and rows(df.columns, df.collect()) == want
