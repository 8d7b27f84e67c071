"""The shapes of the test tables."""

from __future__ import annotations

from quarryline.plans import frames


def test_large_files_are_read_by_splits_without_a_shuffle(spark, tmp_path):
    n = spark.sparkContext.defaultParallelism
    at = str(tmp_path / "documents")
    spark.range(200_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 256) AS text").coalesce(1).write.option("parquet.block.size", 65536).parquet(at)
    whole, size = spark.read.parquet(at), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "64k")
        many = spark.read.parquet(at)
        assert len(many.inputFiles()) == 1 and many.rdd.getNumPartitions() > n
        assert frames.spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions()
        spark.conf.set(size, "1g")
        assert frames.spread(whole.select("*")).rdd.getNumPartitions() == n
        assert frames.spread(whole).count() == 200_000
    finally:
        spark.conf.set(size, before)
