"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed words, word pairs and pairs with one word between, and the stems of
its words (their first bytes), for inflected insults whose form was not in the sample. FTRL-proximal
keeps a rate per coordinate and an L1 term, so that most coordinates end at exactly zero; only the
others are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sample import bounded_sample

#: The hashed feature space; its size bounds a text's features and the model.
BITS = 20
#: Patterns of word positions: words, neighbours, neighbours but one.
PATTERNS = ((0,), (0, 1), (0, 2))
#: Lengths of stems in bytes; a shorter word is its own stem.
STEMS = (4, 5)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a block (repeats included) and the document of each."""
    h, starts, ends, counts = K.words(data, offsets)
    prefix, own = K.prefix_hash(K.fold(data)), np.repeat(np.arange(len(counts)), counts)
    stems = [K.slice_hash(prefix, starts, np.minimum(starts + n, ends)) + np.uint64(n) for n in STEMS]
    ids, docs = [K.mix(x) >> np.uint64(64 - BITS) for x in stems], [own] * len(STEMS)
    for n, gaps in enumerate(PATTERNS):
        first, doc = K.runs(counts, gaps[-1] + 1)
        ids.append(K.mix(K.chain(h, first, gaps) + np.uint64(n)) >> np.uint64(64 - BITS))
        docs.append(doc)
    return np.concatenate(ids).astype(np.int64), np.concatenate(docs)


@K.released
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, data, offsets in K.blocks(batches, "t"):
        ids, doc = grams(data, offsets)
        key = np.unique(doc << BITS | ids)
        cut = np.searchsorted(key, np.arange(len(offsets)) << BITS)
        own = (key & ((1 << BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([block.column("y"), pa.array([own[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["y", "x"])


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 5) -> tuple[np.ndarray, float]:
    """Weights (zero but for few) and the intercept, from rows of distinct feature ids and labels, in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    b, bn = 0.0, 0.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            bn += g * g
            b -= alpha / (beta + np.sqrt(bn)) * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)), b


class ToxicityModel:
    """Sparse weights and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.ids = np.flatnonzero(weights).astype(np.int32)
        self.values, self.intercept = weights[self.ids], intercept

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        place = np.full(1 << BITS, -1, np.int32)
        place[self.ids] = np.arange(len(self.ids))
        ids, doc = grams(data, offsets)
        at = place[ids]
        key = np.unique((doc << BITS | ids)[at >= 0])
        total = np.bincount(key >> BITS, self.values[place[key & ((1 << BITS) - 1)]], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, max_rows: int = 12000) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows (``where`` is over the label table). No labelled row: every score is 0.5.

    The sample's ids are small by that bound and are broadcast to the documents; texts become
    feature sets on the executors.
    """
    rows = labels.where(F.lit(True) if where is None else where).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    chosen = bounded_sample(rows, ["i", "y"], max_rows)
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    found = texts.join(F.broadcast(chosen), texts["d"] == chosen["i"]).select("t", "y")
    got = [(np.frombuffer(r["x"], np.int32), r["y"]) for r in found.mapInArrow(_feature_batches, "y int, x binary").toLocalIterator()]
    got.sort(key=lambda r: (K.mix(np.array([r[0].sum() + len(r[0]) * 7919], np.uint64))[0], len(r[0])))
    return ToxicityModel(*ftrl(got))


def _score_batches(model):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in K.blocks(batches, "t"):
            yield pa.RecordBatch.from_arrays([block.column("i"), pa.array(model.value.scores(data, offsets))], ["i", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from its whole text alone; null and empty texts get the intercept's score. Other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score_batches(shared), f"i {dict(rows.dtypes)['i']}, score double").select(F.col("i").alias("doc_id"), "score")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: learn from labels with crc32(doc_id) mod 3 <> 1, score all; predicted 1 from 0.7 on."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = score(docs, fit(docs, labels, where=~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
