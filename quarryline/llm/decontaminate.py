"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The word n-grams of the test items are the seeds. A first pass counts in how many documents each
occurs. An item keeps its rare seeds: those in a tiny share of the documents, and the rarest of
every few neighbours however frequent, so that a passage copied into a third of the corpus is still
found. A second pass joins documents to items on the kept seeds and aligns the words around the
hits with the item, which scores edited copies too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

_FILTER_BITS = 22


@dataclass
class Items:
    """A block of test items as words and seeds. ``seed`` is sorted; a seed may belong to several items and places."""

    ids: np.ndarray
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def kept(self, keep: np.ndarray) -> Items:
        return Items(self.ids, self.words, self.seed[keep], self.item[keep], self.place[keep])

    def distinct(self) -> np.ndarray:
        return np.unique(self.seed)


def items_of(ids: list[int], texts: list[str], n: int) -> Items:
    """Words and seeds of the items; an item of fewer than ``n`` words has none and matches nothing: so few words are no passage."""
    data, offsets = K.text_bytes(pa.array([t or "" for t in texts], pa.string()))
    h, _, _, counts = K.words(data, offsets)
    at = np.concatenate([[0], np.cumsum(counts)])
    seed, item, place = [], [], []
    for i, (a, b) in enumerate(zip(at, at[1:])):
        if b - a >= n:
            first = np.arange(a, b - n + 1)
            seed.append(K.chain(h, first, tuple(range(n))))
            item.append(np.full(len(first), i))
            place.append(first - a)
    order = np.concatenate([np.zeros(0, np.uint64), *seed])
    item, place = np.concatenate([np.zeros(0, int), *item]), np.concatenate([np.zeros(0, int), *place])
    by = np.argsort(order, kind="stable")
    return Items(np.array(ids, np.int64), [h[a:b] for a, b in zip(at, at[1:])], order[by], item[by], place[by])


class SeedFilter:
    """Membership of hashes in a sorted set: a bit table first, a search for what passes."""

    def __init__(self, seeds: np.ndarray):
        self.seeds = seeds
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of members, and their places in the set."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _FILTER_BITS)])
        found = np.minimum(np.searchsorted(self.seeds, h[at]), len(self.seeds) - 1)
        good = self.seeds[found] == h[at]
        return at[good], found[good]


def align(item: np.ndarray, lengths: np.ndarray, window: np.ndarray, match: float = 1.0, mismatch: float = 0.5, gap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of many pairs at once: best local score and the window position where it ends.

    item: pairs x longest item, window: pairs x longest window, both hashes; ``lengths`` are the
    items'. Positions beyond an item's length are skipped; windows are padded with 0, which matches nothing.
    """
    b, w = window.shape
    h, best, end = np.zeros((b, w + 1), np.float32), np.zeros(b, np.float32), np.zeros(b, np.int64)
    ramp = (gap * np.arange(w + 1)).astype(np.float32)
    for i in range(item.shape[1]):
        s = np.where((window == item[:, i : i + 1]) & (window != 0), np.float32(match), np.float32(-mismatch))
        t = np.zeros_like(h)
        np.maximum(h[:, :-1] + s, h[:, 1:] - np.float32(gap), out=t[:, 1:])
        np.maximum(t, 0, out=t)
        h = np.where((i < lengths)[:, None], np.maximum.accumulate(t + ramp, axis=1) - ramp, 0)
        top = h.argmax(axis=1)
        value = h[np.arange(b), top]
        better = value > best
        best[better], end[better] = value[better], top[better] - 1
    return best, end


def _count_batches(shared, n: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = SeedFilter(shared.value)
        total = np.zeros(len(seeds.seeds), np.int64)
        for _, data, offsets in K.blocks(batches, "t"):
            h, _, _, counts = K.words(data, offsets)
            first, doc = K.runs(counts, n)
            at, seed = seeds.find(K.chain(h, first, tuple(range(n))))
            total += np.bincount(np.unique(doc[at] * len(total) + seed) % max(len(total), 1), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["s", "c"])

    return run


def rare(items: Items, frequency: np.ndarray, documents: int, share: float, stretch: int) -> Items:
    """Only the rare seeds: in at most ``share`` of the documents (10 at least), or the rarest of ``stretch`` neighbours in their item."""
    df = frequency[np.searchsorted(items.distinct(), items.seed)] if len(items.seed) else np.zeros(0)
    keep = df <= max(10, share * documents)
    order = np.lexsort((items.place, items.item))
    own, d = items.item[order], df[order]
    if len(own) >= stretch:
        near = np.lib.stride_tricks.sliding_window_view(d, stretch)
        at = np.flatnonzero(own[: len(near)] == own[stretch - 1 :])
        keep[order[at + near[at].argmin(axis=1)]] = True
    # Items of fewer seeds than a stretch.
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(own)))
    start, size = start[size < stretch], size[size < stretch]
    if len(start):
        place = np.arange(stretch)
        few = np.where(place < size[:, None], d[np.minimum(start[:, None] + place, len(d) - 1)], np.inf)
        keep[order[start + few.argmin(axis=1)]] = True
    return items.kept(keep)


def _align_batches(shared, n: int, threshold: float):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        seeds = SeedFilter(items.distinct())
        lo, hi = np.searchsorted(items.seed, seeds.seeds), np.searchsorted(items.seed, seeds.seeds, "right")
        sizes = np.array([len(w) for w in items.words])
        for block, data, offsets in K.blocks(batches, "t"):
            h, _, _, counts = K.words(data, offsets)
            first, doc = K.runs(counts, n)
            at, seed = seeds.find(K.chain(h, first, tuple(range(n))))
            if not len(at):
                continue
            many = hi[seed] - lo[seed]
            entry = np.repeat(lo[seed] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = np.repeat(at, many)
            item, d, start = items.item[entry], doc[at], first[at] - items.place[entry]
            order = np.lexsort((start, item, d))
            item, d, start = item[order], d[order], start[order]
            # Hits of one document and item whose expected starts lie within an item's length make one window.
            new = np.concatenate([[True], (item[1:] != item[:-1]) | (d[1:] != d[:-1]) | (start[1:] - start[:-1] > sizes[item[1:]])])
            cut = np.flatnonzero(new)
            item, d, low, high = item[cut], d[cut], start[cut], start[np.append(cut[1:], len(start)) - 1]
            slack = sizes[item] // 2 + 4
            base = np.cumsum(counts) - counts
            a, b = np.maximum(low - slack, base[d]), np.minimum(high + sizes[item] + slack, base[d] + counts[d])
            score, end = np.zeros(len(item)), np.zeros(len(item), np.int64)
            by = np.argsort(b - a, kind="stable")
            k = 0
            while k < len(by):
                m = k + 1
                while m < len(by) and (m - k + 1) * (b[by[m]] - a[by[m]]) <= 1 << 19:
                    m += 1
                part = by[k:m]
                width, tall = int((b - a)[part].max()), int(sizes[item[part]].max())
                window, words = np.zeros((len(part), width), np.uint64), np.zeros((len(part), tall), np.uint64)
                for r, p in enumerate(part):
                    window[r, : b[p] - a[p]] = h[a[p] : b[p]]
                    words[r, : sizes[item[p]]] = items.words[item[p]]
                best, at_end = align(words, sizes[item[part]], window)
                score[part], end[part] = best / sizes[item[part]], at_end + a[part] - base[d[part]]
                k = m
            good = np.flatnonzero(score >= threshold)
            order = good[np.lexsort((-score[good], item[good], d[good]))]
            one = np.concatenate([[True], (item[order][1:] != item[order][:-1]) | (d[order][1:] != d[order][:-1])]) if len(order) else np.zeros(0, bool)
            order = order[one]
            yield pa.RecordBatch.from_arrays([block.column("i").take(pa.array(d[order])), pa.array(items.ids[item[order]]), pa.array(score[order]), pa.array(end[order])], ["i", "item_id", "score", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 3, threshold: float = 0.4, share: float = 1e-4, stretch: int = 4, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, score, end_word): one row for each document and item that aligns.

    ``score``: best local alignment of whole texts (match 1, mismatch and gap -0.5) over the item's
    words, 1 for an exact copy; kept from ``threshold``. ``end_word``: the document's word where it
    ends. Null and empty texts and items match nothing, nor do items of fewer than ``n`` words;
    repeated rows are reported each; other columns are ignored. Items are taken in blocks of at
    most ``block_bytes`` of text, each broadcast on its own, so any number of items will do.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    documents, kind = docs.count(), dict(rows.dtypes)["i"]
    out = None

    def scan(ids: list[int], texts: list[str]) -> DataFrame:
        items = items_of(ids, texts, n)
        frequency = np.zeros(len(items.distinct()), np.int64)
        counts = rows.mapInArrow(_count_batches(spark.sparkContext.broadcast(items.distinct()), n), "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
        for s, c in counts.collect():  # one row a seed of this block at most
            frequency[s] = c
        shared = spark.sparkContext.broadcast(rare(items, frequency, documents, share, stretch))
        return rows.mapInArrow(_align_batches(shared, n, threshold), f"i {kind}, item_id long, score double, end_word long")

    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null").toLocalIterator():
        if texts and size + 4 * len(r["t"]) > block_bytes:
            part = scan(ids, texts)
            out, ids, texts, size = part if out is None else out.unionAll(part), [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += 4 * len(r["t"])
    part = scan(ids, texts)
    return (part if out is None else out.unionAll(part)).withColumnRenamed("i", "doc_id")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: all documents against all benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
