"""The test tables in the shapes that the operators take."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import quality as Q
from ..functions import text as T
from ..operators import containment, dense, index_store, lexical


def folder(spark: SparkSession, what: str) -> str:
    """A new folder under the one that the cluster shares; a temporary one only where the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/quarryline-io"
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once below the shared folder and read back."""
    at = folder(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Tables of few splits with rows are dealt out before text is taken apart: a scan of one would run in one task. Files do not tell: a large one is read by many tasks, and its texts need no shuffle. No column is read to count."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.select(F.spark_partition_id().alias("p")).distinct().count() < n else df


def corpus(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """doc_id, source, lang, title (first six words), description, keywords; with ``of`` (doc_id) only of those documents."""
    d = table(spark, sf_dir, "documents")
    d = spread(d) if of is None else d.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    return d.select("doc_id", "source", "lang", T.truncate_words(F.col("text"), 6).alias("title"), F.col("text").alias("description"), F.array("lang", "source").alias("keywords"))


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


def bm25_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each benchmark item, counted."""
    b = table(spark, sf_dir, "benchmark")
    rows = b.select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("query_id", "token").agg(F.count("*").alias("qf"))


def bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.search(bm25_queries(spark, sf_dir), tokenised(spark, sf_dir), k)


_stored: dict[tuple[str, str], index_store.StoredIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> index_store.StoredIndex:
    """The lexical index of the documents, written by the first query of an application that asks for it, read by all."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        at = folder(spark, "lexical-index")
        index_store.build(tokenised(spark, sf_dir), at)
        _stored[key] = index_store.StoredIndex.open(spark, at)
    return _stored[key]


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): the documents that hold a benchmark item."""
    hit = containment.contains_join(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return hit.select(F.col("phrase_id").alias("query_id"), "doc_id")


#: The query set of vector searches.
PROBED = "vec_id % 50 = 0"


def nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The vectors whose ids are divisible by 50 as queries against all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return dense.knn(e.where(PROBED), e, k, query_id="vec_id", doc_id="vec_id")


def raw_flags(description) -> object:
    """Ingest flags of a text."""
    return F.array_compact(F.array(F.when(F.length(description) < 80, F.lit("short_description"))))


def described(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The corpus with quality columns; with ``of`` (doc_id) only those documents, told before any text is taken apart."""
    c = corpus(spark, sf_dir, of).withColumn("quality_flags", raw_flags(F.col("description")))
    return Q.adjustment(Q.flags(c, "description", "keywords", "quality_flags"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with quality columns and labels."""
    d = described(spark, sf_dir).withColumn("metadata_terms", F.array().cast("array<string>"))
    return L.with_labels(d, "title", "description", "keywords", "metadata_terms")
