"""Language identification with string kernels.

Blended-spectrum presence kernel: a text is the set of its character n-grams, n = 1 to 3, and
k(x, y) = |P(x) & P(y)| / sqrt(|P(x)| |P(y)|). Nystroem landmarks approximate it, one-versus-rest
kernel ridge regression is fitted on the landmark features of a bounded sample of labelled rows.

Scores are batched matrix products: with landmark set matrix L, k(x, .) A = P(x) (L' A) / sqrt|P(x)|,
so the product L' A is made once on the driver and a batch of texts costs one product of its
presence matrix with an (n-grams x languages) matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sample import bounded_sample

#: Letters have classes 1 to 63 (the 62 most frequent of the sample their own, the rest 63), all else is 0.
CLASSES = 64
#: Codes of n-grams: uni-, bi- and trigrams of classes, one range after the other.
CODES = CLASSES + CLASSES**2 + CLASSES**3
UND = "und"
#: A machine says no up to this score: scores are the regression's -1 to 1 brought to 0 to 1.
REJECTED = 0.5


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts and the number of each text's."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4"), np.array([len(t) for t in texts], np.int64)


def letter_classes(texts: list[str]) -> np.ndarray:
    """Class of each code point; upper and lower case share one."""
    cp, _ = code_points(texts)
    folded = np.arange(0x110000)
    letters = np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            letters[c] = True
            low = ch.lower()
            if len(low) == 1:
                folded[c] = ord(low)
    counts = np.bincount(folded[cp], minlength=0x110000) * letters
    common = [c for c in np.argsort(-counts, kind="stable")[: CLASSES - 2] if counts[c]]
    classes = np.where(letters, CLASSES - 1, 0).astype(np.uint8)
    own = np.zeros(0x110000, np.uint8)
    own[common] = np.arange(1, len(common) + 1)
    return np.where(letters & (own[folded] > 0), own[folded], classes).astype(np.uint8)


def presence(texts: list[str], classes: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix (texts x n-grams of the vocabulary) and whether each text has a letter."""
    cp, counts = code_points(texts)
    out, lettered = np.zeros((len(texts), width), np.float32), np.zeros(len(texts), bool)
    if len(cp):
        x = classes[cp].astype(np.int32)
        doc = np.repeat(np.arange(len(texts)), counts)
        lettered[doc[x > 0]] = True
        for n, base in ((1, 0), (2, CLASSES), (3, CLASSES + CLASSES**2)):
            if len(x) < n:
                continue
            code, m = x[: len(x) - n + 1], len(x) - n + 1
            for k in range(1, n):
                code = code * CLASSES + x[k : k + m]
            inside = doc[:m] == doc[n - 1 :]
            col = column[code + base]
            keep = inside & (col >= 0)
            out[doc[:m][keep], col[keep]] = 1
    return out, lettered


@dataclass
class LanguageModel:
    languages: list[str]
    classes: np.ndarray
    column: np.ndarray
    weights: np.ndarray  # n-grams x languages: landmark sets times dual weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        p, lettered = presence([t or "" for t in texts], self.classes, self.column, len(self.weights))
        size = np.sqrt(np.maximum(p.sum(axis=1), 1))
        f = (p @ self.weights) / size[:, None]
        best = f.argmax(axis=1)
        score = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
        return [self.languages[b] if ok else UND for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def fit_rows(texts: list[str], labels: list[str], landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel:
    """Fit on rows in memory; the first ``landmarks`` texts with letters, dealt over the languages, are the landmarks."""
    languages = sorted(set(labels))
    classes = letter_classes(texts)
    by = {a: [i for i, b in enumerate(labels) if a == b] for a in languages}
    chosen = [i for k in range(max(map(len, by.values()))) for a in languages for i in by[a][k : k + 1]][:landmarks]
    every = np.arange(CODES, dtype=np.int32)
    seen = np.zeros(CODES, bool)
    for i in chosen:
        seen |= presence([texts[i]], classes, every, CODES)[0][0] > 0
    seen[[0, CLASSES, CLASSES + CLASSES**2]] = False  # n-grams without a letter
    column = np.where(seen, np.cumsum(seen) - 1, -1).astype(np.int32)
    width = max(1, int(seen.sum()))
    sets, sizes = [], []
    for at in range(0, len(texts), 128):
        p, _ = presence(texts[at : at + 128], classes, column, width)
        sets.append(p.astype(np.uint8))
        sizes.append(np.sqrt(np.maximum(p.sum(axis=1), 1)))
    p, size = np.concatenate(sets), np.concatenate(sizes)
    marks = p[chosen].astype(np.float32) / size[chosen][:, None]
    k = np.concatenate([(p[a : a + 256].astype(np.float32) / size[a : a + 256][:, None]) @ marks.T for a in range(0, len(p), 256)]).astype(float)
    values, vectors = np.linalg.eigh(k[chosen])
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    z = k @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + ridge * len(z) / 100 * np.eye(z.shape[1]), z.T @ y)
    return LanguageModel(languages, classes, column, (marks.T.astype(float) @ (root @ w)).astype(np.float32))


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", where: Column | None = None, max_rows: int = 3000, landmarks: int = 256) -> LanguageModel | None:
    """Fit on a bounded sample (at most ``max_rows``) of the rows with text and label; None if there is none."""
    rows = docs.where(F.lit(True) if where is None else where).select(F.col(text_col).alias("t"), F.col(label_col).alias("l")).where("t is not null and l is not null and length(t) > 0")
    rows = sorted((r["l"], r["t"]) for r in bounded_sample(rows, ["t", "l"], max_rows).collect())
    return fit_rows([t for _, t in rows], [a for a, _ in rows], landmarks) if rows else None


def _predict_batches(model, keep: bool = False):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for block, _, _ in K.blocks(batches, "t", 1 << 19, 256):
            texts = block.column("t").to_pylist()
            names, scores = m.predict(texts) if m else ([UND] * len(texts), np.zeros(len(texts)))
            own = [c for c in block.schema.names if c != "t" or keep]
            yield pa.RecordBatch.from_arrays([*map(block.column, own), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone.

    Null texts and texts without a letter: ``und``, score 0; without a model every text is ``und``.
    Other columns are ignored; repeated rows are scored each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict_batches(shared), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", least: float = 0.0, above: float = -1.0) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is known (not ``und``) with a score of ``least`` or more, and more than ``above``."""
    # The other columns by place, so that no name of theirs can clash.
    others = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col))
    rows = docs.select(others.alias("row"), F.col(f"`{text_col}`").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_predict_batches(shared, True), f"row {dict(rows.dtypes)['row']}, t string, lang_pred string, score double")
    return out.where((F.col("lang_pred") != UND) & (F.col("score") >= least) & (F.col("score") > above)).select(*(F.col("t").alias(c) if c == text_col else F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: learn from rows with crc32(doc_id) mod 4 <> 2, predict all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, where=F.coalesce(~held, F.lit(True)))
    return predict(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
