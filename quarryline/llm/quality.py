"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

Every whole text becomes a fixed vector of statistics. Random Fourier features approximate a
Gaussian kernel over the standardised vector; ridge regression on them needs only the normal
equations, which each partition sums over its labelled rows. A bounded histogram of raw scores is
then calibrated with pool-adjacent-violators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import stored

#: Byte classes counted in a text, as fractions of its bytes.
_CLASSES = {
    "lower": [*range(97, 123)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "space": [32, 9, 11, 12, 13],
    "line": [10],
    "stop": [ord(c) for c in ".,;:'\"()-?"],
    "bang": [ord("!")],
    "bar": [ord("|")],
    "symbol": [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"],
    "high": [*range(128, 256)],
}
STATISTICS = [*_CLASSES, "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "same_next", "mixed_words", "mean_line", "same_lines"]
_CLASS_OF = np.zeros(256, np.int64)
for _n, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[_bytes] = _n + 1


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: distinct values of h and the count of the most frequent."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    size, top = np.diff(np.append(at, len(h))), np.zeros(n)
    np.maximum.at(top, doc[at], size)
    return np.bincount(doc[at], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document of a block; empty texts have zeros."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    doc = np.repeat(np.arange(n), size)
    k = len(_CLASSES) + 1
    out[:, : k - 1] = np.bincount(doc * k + _CLASS_OF[data], minlength=n * k).reshape(n, k)[:, 1:] / np.maximum(size, 1)[:, None]
    s, e, counts = K.spans(K.SPACE[data], offsets)
    h = K.slice_hash(K.prefix_hash(K.LOWER[data]), s, e) if len(s) else np.empty(0, np.uint64)
    w, lengths = np.repeat(np.arange(n), counts), e - s
    some = np.maximum(counts, 1)
    distinct, top = _distinct(h, w, n)
    inner = np.cumsum(np.concatenate([[0], (~K.LETTER[data]).astype(np.int64)]))
    mixed = (inner[e - 1] - inner[s] > 0) | ((e - s > 1) & ~K.LETTER[data[e - 2]]) if len(s) else np.zeros(0, bool)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (w[1:] == w[:-1])]) if len(h) else np.zeros(0, bool)
    ls, le, lines = K.spans(data != 10, offsets)
    lh = K.slice_hash(K.prefix_hash(data), ls, le) if len(ls) else np.empty(0, np.uint64)
    own, _ = _distinct(lh, np.repeat(np.arange(n), lines), n)
    at = len(_CLASSES)
    out[:, at:] = np.stack([
        np.log1p(size), np.log1p(counts), np.bincount(w, lengths, n) / some, np.bincount(w, lengths > 12, n) / some, distinct / some, top / some,
        np.bincount(w, same, n) / some, np.bincount(w, mixed, n) / some, np.log1p(size / np.maximum(lines, 1)), 1 - own / np.maximum(lines, 1),
    ], axis=1)
    return out


@K.released
def _statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, data, offsets in K.blocks(batches, "t"):
        x = statistics(data, offsets).astype(np.float32)
        yield pa.RecordBatch.from_arrays([block.column("i"), pa.array([r.tobytes() for r in x], pa.binary())], ["i", "x"])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(float)


@K.released
def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, len(STATISTICS)))
    for b in batches:
        if b.num_rows:
            x = _rows(b)
            total += [np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)]
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])


def _summed(partials: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of one small array per partition, by way of 64 and then 4 tasks that add up what they read one by one; the driver gets four arrays."""

    def add(batches):
        total = None
        for b in batches:
            for m in b.column("m"):
                part = np.frombuffer(m.as_buffer()).reshape(shape)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    total = np.zeros(shape)
    for width in (64, 4):
        partials = partials.repartition(width).mapInArrow(add, "m binary")
    for r in partials.collect():
        total += np.frombuffer(r["m"]).reshape(shape)
    return total


class QualityModel:
    """Standardisation, random features, ridge weights, calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = 256, width: float = 3.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.steps, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.levels), 0, 1)


def isotonic(value: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by value: block centres and non-decreasing rates."""
    blocks: list[list[float]] = []
    for v, o, c in zip(value, ones, count):
        blocks.append([v * c, o, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, x) of every row: its id and the statistics of its whole text; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_statistic_batches, f"i {dict(rows.dtypes)['i']}, x binary")


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", where: Column | None = None, features: int = 256, ridge: float = 1e-3, bins: int = 1000) -> QualityModel:
    """Fit on all labelled rows of the label table (``where``), joined to :func:`document_statistics`.

    What reaches the driver is of fixed size: moments, normal equations, ``bins`` histogram rows.
    Without labelled rows every score is 0.5.
    """
    spark = stats.sparkSession
    rows = labels.where(F.lit(True) if where is None else where).select(F.col(id_col).alias("l"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    train = stored(stats.join(rows, stats["i"] == rows["l"]).select("x", "y"), "quality-train")
    n, s, q = _summed(train.mapInArrow(_moments, "m binary"), (3, len(STATISTICS)))
    n = max(n[0], 1.0)
    sd = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
    model = QualityModel(s / n, np.where(sd > 1e-9, sd, 1.0), features)
    d = features + 1
    shared = spark.sparkContext.broadcast(model)

    def equations(batches):
        total = np.zeros((d, d + 1))
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                z = shared.value.features(_rows(part))
                total += z.T @ np.concatenate([z, np.asarray(part.column("y"))[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    total = _summed(train.mapInArrow(equations, "m binary"), (d, d + 1))
    model.beta = np.linalg.solve(total[:, :d] + ridge * n / d * np.eye(d), total[:, d])
    fitted = spark.sparkContext.broadcast(model)

    def raw(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(fitted.value.raw(_rows(b)))], ["y", "r"])

    bin_ = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "r")) * (bins / 3)).alias("bin")
    found = train.mapInArrow(raw, "y double, r double").groupBy(bin_).agg(F.avg("r").alias("v"), F.sum("y").alias("o"), F.count("*").alias("c")).orderBy("bin").collect()
    if found:
        model.steps, model.levels = isotonic(*(np.array([r[k] for r in found], float) for k in ("v", "o", "c")))
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row of :func:`document_statistics`; empty texts are scored by their zero statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(shared.value.calibrated(_rows(b)))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {dict(stats.dtypes)['i']}, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Query: learn from labels with crc32(doc_id) mod 5 <> 0, score all; predicted 1 from 0.3 on."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    stats = stored(document_statistics(docs), "quality-statistics")
    out = score(stats, fit(stats, labels, where=~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
