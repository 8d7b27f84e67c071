"""Removal of repeated byte strings by a column-wise suffix construction over many documents.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. Three steps:

1. Anchors. Every window of ``length`` bytes has an anchor, the leftmost smallest hash among its
   32-byte grams, which depends on the window's bytes alone. Neighbouring windows with one anchor
   form a fragment. Equal windows have equal anchors, at the same place in the window, so an anchor
   that occurs once in the corpus has no repeated window, and equal windows are equal column by
   column when their fragments are laid out with the anchors in one column.
2. Collection transform. The distinct fragments of repeated anchors are a collection of short
   documents. Its transform is built column by column from the right: each round inserts one symbol
   of each document before the suffix inserted in the round before. A round reads the segment
   before from a file, in sequence: the documents in the order of their suffixes, the symbols before
   those (the transform) and the common prefixes of neighbours. It sorts by the symbols, which
   gives the next order, takes common prefixes as range minima, and writes the next segment. As
   suffixes that start in different columns cannot be equal windows, columns act as distinct
   symbols: insertions fall in one segment, and the files of two rounds are all there is. They
   lie in the shared folder; a collection is as many rows as ``COLLECTION``, so a round is one
   sequential read and one write of a hundred kilobytes. A window is repeated if the suffix that
   starts it shares ``length`` symbols with a neighbour, or if its fragment occurs more than once.
3. Ranges go back to the occurrences of their fragments and are merged for each document.

An anchor with more than ``most_fragments`` distinct fragments is dealt out anew: its fragments are cut
into pieces whose windows all cover a core, keyed by the core's bytes; step by step the core
grows to the whole window, and windows of equal bytes are repeats. No step drops or caps anything.

Fragments are told by 128 bits of BLAKE2b over their bytes, windows by their bytes; the faster sums
that deal them out decide nothing.

Passages can be told by words instead: with four bytes of hash for each word, a passage of n words is
a window of 4 n bytes, whatever the length of its words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import drop, shared_dir, stored

GRAM = 32
#: Bits of the packed minimum that hold a position; a longer document is taken in overlapping parts.
_POS_BITS = 24
_PART = (1 << _POS_BITS) - (1 << 16)
U = np.uint64
#: Bytes of hash for a word.
_CODE = 4
#: Keeps the anchors of word codes apart from those of bytes.
_WORD_ANCHORS = 0x5851F42D4C957F2D
#: Rows of a collection whose transform is built at once.
COLLECTION = 8_192
#: An anchor with more than this share of all fragments is joined in as many parts as ``_SALTS``.
_HOT_SHARE, _SALTS = 0.001, 16


class Kind(NamedTuple):
    """Strings of ``length`` bytes of the text, or of the codes of ``words`` words."""

    length: int
    words: int = 0


def _by_words(words: int) -> Kind:
    return Kind(words * _CODE, words)


def anchors(data: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
    """For each window start in ``data`` (0 to len - length): the position of its anchor."""
    g = K.slice_hash(prefix, np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1))
    low = (g >> U(_POS_BITS) << U(_POS_BITS)) | np.arange(len(g), dtype=U)
    w = length - GRAM + 1  # grams of a window
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    return (low & U((1 << _POS_BITS) - 1)).astype(np.int64)


def fragments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Fragments of a block: document, first window, number of windows, anchor position, anchor hash, content digest (two columns)."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(U), np.empty((0, 2), np.int64)
    prefix = K.prefix_hash(data)
    a = anchors(data, prefix, length)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(a)]
    whole = np.arange(len(a)) + length <= offsets[doc + 1]
    new = np.empty(len(a), bool)
    new[0], new[1:] = True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(whole & (new | ~np.concatenate([[False], whole[:-1]])))
    stop = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]]))
    n = stop - at + 1
    raw = memoryview(np.ascontiguousarray(data))
    digest = b"".join([blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(at.tolist(), (at + n - 1 + length).tolist())])
    return doc[at], at, n, a[at], K.slice_hash(prefix, a[at], a[at] + GRAM), np.frombuffer(digest, np.int64).reshape(-1, 2)


def _parts(batches, length: int):
    """Blocks, with documents beyond the packed positions' reach cut into parts that overlap by length - 1 bytes: every window lies in one part."""
    for block, data, offsets in K.blocks(batches, "t"):
        if len(data) <= _PART:
            yield block, data, offsets, 0
        else:
            for a in range(0, len(data) - length + 1, _PART):
                part = data[a : a + _PART + length - 1]
                yield block, part, np.array([0, len(part)]), a


def _index_batches(kinds: list[Kind]):
    """Fragments of all kinds from one reading of the texts."""

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in kinds:
                for block, data, offsets, shift in _parts(_coded([batch], kind.words) if kind.words else [batch], kind.length):
                    doc, at, n, anchor, h, c = fragments(data, offsets, kind.length)
                    if len(doc):
                        yield _fragment_batch(block, kind, doc, at, n, anchor, h ^ U(_WORD_ANCHORS if kind.words else 0), c, offsets, shift)

    return run


def _fragment_batch(block: pa.RecordBatch, kind: Kind, doc, at, n, anchor, h, c, offsets, shift) -> pa.RecordBatch:
    # A fragment that recurs in its document is one row with all its places.
    order = np.lexsort((at, c[:, 1], c[:, 0], h, doc))
    d, h, c, n, anchor, start = doc[order], h[order], c[order], n[order], (anchor - at)[order], (at - offsets[doc] + shift)[order]
    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1]).any(axis=1)]))
    starts = pa.ListArray.from_arrays(pa.array(np.append(cut, len(start)), pa.int32()), pa.array(start))
    return pa.RecordBatch.from_arrays(
        [*(block.column(k).take(pa.array(d[cut])) for k in ("i", "x")), pa.array(np.full(len(cut), bool(kind.words))), pa.array(h[cut].view(np.int64)), pa.array(c[cut, 0]), pa.array(c[cut, 1]), pa.array(n[cut].astype(np.int32)), pa.array(anchor[cut].astype(np.int32)), starts],
        ["i", "x", "w", "h", "c", "d", "n", "a", "starts"],
    )


class Segments:
    """The transform of a collection of anchored fragments, one column a round.

    ``symbols`` is fragments x columns, 256 where a fragment has no byte. Between rounds everything is
    in the segment's file below ``folder``: documents in order, the symbols before their suffixes,
    common prefixes. Only one round's file is needed to go on; the one before goes.
    """

    def __init__(self, symbols: np.ndarray, folder: str):
        from pyarrow import fs

        self.symbols, self.round = symbols, 0
        self.fs, at = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        self.folder = f"{at}/collection-{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder)
        none = np.zeros(len(symbols), np.int32)  # no suffixes yet: all equal, nothing in common
        self._write(np.arange(len(symbols), dtype=np.int32), symbols[:, -1], none)

    def _write(self, order: np.ndarray, before: np.ndarray, common: np.ndarray) -> None:
        # A new name each round: writing over a file makes some file systems wait for the disk.
        with self.fs.open_output_stream(f"{self.folder}/segment-{self.round}") as f:
            f.write(order.astype(np.int32).tobytes() + before.astype(np.uint16).tobytes() + common.astype(np.int32).tobytes())
        if self.round:
            self.fs.delete_file(f"{self.folder}/segment-{self.round - 1}")

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last segment: documents in the order of their suffixes, symbols before those, common prefix of each suffix and the one before it in order."""
        n = len(self.symbols)
        with self.fs.open_input_stream(f"{self.folder}/segment-{self.round}") as f:
            raw = f.read()
        return np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.uint16, n, 4 * n), np.frombuffer(raw, np.int32, n, 6 * n)

    def insert(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Insert the column's symbol before each document's suffix; the order and common prefixes of the segment before, as read."""
        before, s, common = self.read()
        by = np.argsort(s, kind="stable")
        ordered = s[by]
        longer = np.zeros(len(s), np.int32)
        at = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        if len(at):
            longer[at] = 1 + range_minima(common, by[at - 1] + 1, by[at] + 1)
        order = before[by]
        self.round += 1
        self._write(order, self.symbols[order, column - 1] if column else np.zeros(len(s), np.uint16), longer)
        return before, common

    def close(self) -> None:
        self.fs.delete_dir(self.folder)


def range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) for each pair, hi > lo, from a table of minima over powers of two."""
    size = hi - lo
    out = np.empty(len(lo), x.dtype)
    level, table, top = 0, x, int(size.max())
    while True:
        span = 1 << level
        now = np.flatnonzero((size >= span) & (size < 2 * span))
        out[now] = np.minimum(table[lo[now]], table[hi[now] - span])
        if 2 * span > top:
            return out
        table = np.minimum(table[:-span], table[span:])
        level += 1


def repeated_windows(texts: list[bytes], anchor: np.ndarray, length: int, folder: str) -> np.ndarray:
    """Boolean matrix fragments x columns: the window that starts there equals one of another fragment. Column 0 is ``length - GRAM`` before the anchors. Segments are kept below ``folder`` while it works."""
    lead, width = length - GRAM, 2 * length - GRAM
    symbols = np.full((len(texts), width), 256, np.uint16)
    for r, (t, a) in enumerate(zip(texts, anchor)):
        symbols[r, lead - a : lead - a + len(t)] = np.frombuffer(t, np.uint8)
    segments = Segments(symbols, folder)
    found = np.zeros((len(texts), lead + 1), bool)
    try:
        for column in range(width - 1, -2, -1):
            if column >= 0:
                order, common = segments.insert(column)
            else:
                order, _, common = segments.read()
            if column < lead:  # what was read is the segment of the column to the right
                far = common >= length
                both = far | np.concatenate([far[1:], [False]])
                found[order[both], column + 1] = True
    finally:
        segments.close()
    # Symbols of absent bytes are common too, but a window has none of them.
    for r, (t, a) in enumerate(zip(texts, anchor)):
        found[r, : lead - a] = False
        found[r, lead - a + max(0, len(t) - length + 1) :] = False
    return found


def _ranges(row: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = COLLECTION) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (but for the last) that split no run of equal keys; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        for a in range(0, b.num_rows, rows):
            held.append(b.slice(a, rows))
            n += held[-1].num_rows
            if n < rows:
                continue
            last = held[-1].column(key)
            if held[0].column(key)[0].as_py() == last[len(last) - 1].as_py():
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            k = np.asarray(t.column(key))
            at = int(np.flatnonzero(k != k[-1])[-1]) + 1
            yield t.slice(0, at)
            held = t.slice(at).to_batches()
            n = len(k) - at
    if held:
        yield pa.Table.from_batches(held)


_PAIRS = "array<struct<a:int,b:int>>"


def _transform_batches(lengths: dict[bool, int], folder: str):
    """Repeated windows of fragments that occur once (the others are repeated as they are). Several anchors share a collection: equal windows have equal anchors."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, "k"):
            of_words = np.asarray(whole.combine_chunks().column("w"))
            for w, length in lengths.items():
                t = whole.take(pa.array(np.flatnonzero(of_words == w))).combine_chunks()
                if not t.num_rows:
                    continue
                lead, anchor, shift = length - GRAM, np.asarray(t.column("a")).astype(np.int64), np.asarray(t.column("o")).tolist()
                found = repeated_windows([x.as_py() for x in t.column("bytes")], anchor, length, folder)
                keep = np.flatnonzero(found.any(axis=1) & (np.asarray(t.column("m")) == 1))
                ranges = [[{"a": x - lead + int(anchor[i]) + shift[i], "b": y - lead + int(anchor[i]) + shift[i]} for x, y in _ranges(found[i])] for i in keep]
                yield pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks().take(pa.array(keep)) for k in _KEY), pa.array(ranges, kind)], [*_KEY, "ranges"])

    return run


def _cut_batches(lengths: dict[bool, int], step: int):
    """Pieces of fragments whose windows all cover a core of length - step + 1 bytes, keyed by it."""

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, h, c, d, m, a, o, t in zip(*(b.column(k).to_pylist() for k in (*_KEY, "m", "a", "o", "bytes"))):
                length = lengths[w]
                data = np.frombuffer(t, np.uint8)
                prefix, n = K.prefix_hash(data), len(t) - length + 1
                # Windows start from -a to n - 1 - a relative to the anchor; groups of ``step`` starts.
                lo = np.arange((-a) // step * step, n - a, step)
                first, last = np.maximum(lo, -a), np.minimum(lo + step, n - a) - 1
                # The core [lo + step - 1, lo + length) lies in every window of its group.
                core = lo + step - 1 + a
                keys = K.slice_hash(prefix, core, lo + length + a) ^ K.mix(lo.view(U) + U(h & (2**64 - 1)))
                rows += [(k, w, h, c, d, m, -x, o + x + a, t[x + a : y + a + length]) for x, y, k in zip(first.tolist(), last.tolist(), keys.view(np.int64).tolist())]
                if len(rows) > 20000:
                    yield _piece_batch(rows)
                    rows = []
            if rows:
                yield _piece_batch(rows)

    return run


#: What tells a distinct fragment.
_KEY = ["w", "h", "c", "d"]
_PIECES = "k long, w boolean, h long, c long, d long, m long, a int, o int, bytes binary"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["k", *_KEY, "m", "a", "o", "bytes"])


def _fetch_batches(lengths: dict[bool, int]):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in K.blocks(batches, "t"):
            rows, all_wanted = [], block.column("wanted").to_pylist()
            code, last = _codes(data, offsets) if any(w["w"] for ws in all_wanted for w in ws) else (b"", [])
            for d, wanted in enumerate(all_wanted):
                for w in wanted:
                    at, n = w["s"], w["n"] - 1 + lengths[w["w"]]
                    text = code[last[d] + at : last[d] + at + n] if w["w"] else data[offsets[d] + at : offsets[d] + at + n].tobytes()
                    rows.append((w["h"], *(w[k] for k in _KEY), w["m"], w["a"], 0, text))
                if len(rows) > 20000:
                    yield _piece_batch(rows)
                    rows = []
            if rows:
                yield _piece_batch(rows)

    return run


def _covered(size: int, ranges: list[dict]) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, [r["a"] for r in ranges], 1)
    np.add.at(edge, [r["b"] for r in ranges], -1)
    return np.cumsum(edge[:-1]) > 0


def _remove_batches(cut_words: bool):
    """Ranges in bytes are cut out; those in words (``w``) are counted, and with ``cut_words`` cut out too."""
    import hashlib

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in K.blocks(batches, "t"):
            yield _removed_block(block, data, offsets, cut_words, hashlib.sha256)

    return run


def _removed_block(block: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, cut_words: bool, sha256) -> pa.RecordBatch:
    removed, spans, digest, kept, at, passage = [], [], [], [], [], []
    for d, ranges in enumerate(block.column("ranges").to_pylist()):
        text, own, words = data[offsets[d] : offsets[d + 1]], [], []
        if ranges:
            words, ranges = [r for r in ranges if r["w"]], [r for r in ranges if not r["w"]]
            if words and cut_words:
                start, end, _ = K.spans(K.SPACE[text], np.array([0, len(text)]))
                ranges += [{"a": start[r["a"]], "b": end[r["b"] - 1]} for r in words]
        if ranges:
            gone = _covered(len(text), ranges)
            own = _ranges(gone)
            text = text[~gone]
        passage.append(int(_covered(max(r["b"] for r in words), words).sum()) if words else 0)
        raw = text.tobytes()
        removed.append(sum(b - a for a, b in own))
        spans.append(len(own))
        at.append([{"a": a, "b": b} for a, b in own])
        digest.append(sha256(raw).hexdigest())
        kept.append(raw.decode("utf-8", "ignore"))
    long, own_columns = pa.int64(), [c for c in block.schema.names if c not in ("t", "ranges")]
    return pa.RecordBatch.from_arrays(
        [*map(block.column, own_columns), pa.array(np.diff(offsets)), pa.array(removed, long), pa.array(spans, long), pa.array(passage, long), pa.array(digest), pa.array(at, pa.list_(pa.struct([("a", long), ("b", long)]))), pa.array(kept)],
        [*own_columns, "n_bytes", "n_removed", "n_spans", "n_passage_words", "kept_sha256", "spans", "kept"],
    )


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The hashes of all white-space separated words of a block, and where those of each document begin."""
    starts, ends, counts = K.spans(K.SPACE[data], offsets)
    code = K.slice_hash(K.prefix_hash(data), starts, ends).astype("<u4").tobytes()
    return code, np.concatenate([[0], np.cumsum(counts)]) * _CODE


def _coded(batches, words: int) -> Iterator[pa.RecordBatch]:
    """Texts of at least ``words`` words as the hashes of their words."""
    for block, data, offsets in K.blocks(batches, "t"):
        code, last = _codes(data, offsets)
        keep = np.flatnonzero(np.diff(last) >= words * _CODE)
        texts = pa.array([code[last[d] : last[d + 1]] for d in keep], pa.binary())
        yield pa.RecordBatch.from_arrays([*(block.column(c).take(pa.array(keep)) for c in ("i", "x")), texts], ["i", "x", "t"])


def repeated_words(rows: DataFrame, words: int, most_fragments: int = 20_000) -> DataFrame:
    """(i, x, a, b): ranges of words to remove from the documents (i, x, t), such that each string of ``words`` words in them starts anywhere else too. White space between words does not count."""
    return _repeats(rows, [_by_words(words)], most_fragments).drop("w")


def _sides(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, x, t, row): ``row`` holds the other columns by place, so that no name of theirs can clash."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(t).alias("x"), t.alias("t"), others.alias("row"))


def repeated_ranges(rows: DataFrame, length: int = 400, most_fragments: int = 20_000) -> DataFrame:
    """(i, x, a, b): byte ranges to remove from the documents (i, x, t); they may overlap."""
    return _repeats(rows, [Kind(length)], most_fragments).drop("w")


def _repeats(rows: DataFrame, kinds: list[Kind], most_fragments: int) -> DataFrame:
    """(i, x, w, a, b): ranges of repeated strings of each kind, in bytes, or in words where ``w``; one construction for all kinds."""
    folder = f"{shared_dir(rows.sparkSession)}/quarryline/segments"
    lengths, key = {bool(k.words): k.length for k in kinds}, _KEY
    rows = rows.select("i", "x", "t")
    source = rows if lengths.get(True) else rows.where(F.octet_length("t") >= lengths[False])
    index = stored(source.mapInArrow(_index_batches(kinds), "i long, x long, w boolean, h long, c long, d long, n int, a int, starts array<long>"), "fragments")
    anchor = index.groupBy("h").agg(F.sum(F.size("starts")).alias("m"), F.count("*").alias("z"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("c", "d") for f in (F.min, F.max))).where("m > 1")
    anchor = stored(anchor.select(F.col("h").alias("g"), "z", ((F.col("min_c") != F.col("max_c")) | (F.col("min_d") != F.col("max_d"))).alias("several")), "anchors")
    # Anchors with a share of all fragments are a bounded number; their fragments are dealt to several tasks.
    hot_rows = F.broadcast(anchor.join(index.agg((F.count("*") * _HOT_SHARE).alias("least")), F.col("z") > F.greatest("least", F.lit(100))).select(F.col("g").alias("hot")))
    salted = index.join(hot_rows, index["h"] == hot_rows["hot"], "left").withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("i", "x", "c"), F.lit(_SALTS)).cast("int"))).drop("hot")
    salts = F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    of = anchor.join(hot_rows, anchor["g"] == hot_rows["hot"], "left").select("g", "several", F.explode(salts).alias("part"))
    found = stored(salted.join(of, (salted["h"] == of["g"]) & (salted["salt"] == of["part"])).drop("g", "salt", "part"), "repeated-anchors")
    drop(index)
    # One row a distinct fragment, with one of its places and how many it has.
    each = found.groupBy(*key, "several").agg(F.sum(F.size("starts")).alias("m"), F.min(F.struct("i", "x", F.element_at("starts", 1).alias("s"), "n", "a")).alias("p"))
    each = stored(each.select(*key, "several", "m", "p.*"), "distinct-fragments")
    wanted = each.where("several").groupBy(F.col("i").alias("wi"), F.col("x").alias("wx")).agg(F.collect_list(F.struct(*key, "m", "s", "n", "a")).alias("wanted"))
    one = rows.join(wanted, rows["i"].eqNullSafe(wanted["wi"]) & (rows["x"] == wanted["wx"])).select("t", "wanted")
    pieces = one.mapInArrow(_fetch_batches(lengths), _PIECES)
    sizes = each.where("several").groupBy(F.col("h").alias("g")).agg(F.count("*").alias("z"))
    hot = stored(sizes.where(F.col("z") > most_fragments).select("g"), "hot-anchors")
    kept, parts, ranges = [anchor, hot], [], each.where("m > 1").select(*key, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("ranges"))
    # Cores grow until a piece is a single window, which is told by its bytes.
    for step in (50, 8, 1):
        if hot.isEmpty():
            parts.append(pieces)
            break
        pieces = stored(pieces, "pieces")
        kept.append(pieces)
        parts.append(pieces.join(hot, pieces["k"] == hot["g"], "left_anti"))
        cut = stored(pieces.join(hot, pieces["k"] == hot["g"], "left_semi").mapInArrow(_cut_batches(lengths, step), _PIECES), "pieces")
        kept.append(cut)
        if step > 1:
            keys = cut.groupBy(F.col("k").alias("g")).agg(F.count("*").alias("z")).where("z > 1")
            pieces = cut.join(keys, cut["k"] == keys["g"], "left_semi")
            hot = stored(keys.where(F.col("z") > most_fragments).select("g"), "hot-anchors")
            kept.append(hot)
        else:
            same = cut.groupBy(F.col("k").alias("g"), F.col("bytes").alias("window")).agg(F.count("*").alias("z")).where("z > 1")
            once = F.array(F.struct(F.col("o").alias("a"), (F.col("o") + 1).cast("int").alias("b")))
            ranges = ranges.unionAll(cut.where("m = 1").join(same, (cut["k"] == same["g"]) & (cut["bytes"] == same["window"]), "left_semi").select(*key, once.alias("ranges")))
    for part in parts:
        ranges = ranges.unionAll(part.repartition("k").sortWithinPartitions("k").mapInArrow(_transform_batches(lengths, folder), f"w boolean, h long, c long, d long, ranges {_PAIRS}"))
    ranges = stored(ranges.select(*(F.col(k).alias(f"r{k}") for k in key), "ranges"), "ranges")
    drop(each, *kept)
    hit = found.join(ranges, (found["h"] == ranges["rh"]) & (found["c"] == ranges["rc"]) & (found["d"] == ranges["rd"]) & (found["w"] == ranges["rw"])).select("i", "x", "w", F.explode("starts").alias("s"), "ranges")
    hit = hit.select("i", "x", "w", "s", F.explode("ranges").alias("r"))
    length = F.when(F.col("w"), lengths.get(True, 0)).otherwise(lengths.get(False, 0))
    hit = hit.select("i", "x", "w", (F.col("s") + F.col("r.a")).alias("a"), (F.col("s") + F.col("r.b") - 1).alias("last"), length.alias("length"))
    # Windows of codes that start at a word; those between are halves of words.
    first, until = F.ceil(F.col("a") / _CODE), F.floor(F.col("last") / _CODE) + F.floor(F.col("length") / _CODE)
    hit = hit.select("i", "x", "w", F.when(F.col("w"), first).otherwise(F.col("a")).alias("a"), F.when(F.col("w"), until).otherwise(F.col("last") + F.col("length")).alias("b"), "length")
    return hit.where(~F.col("w") | (F.col("b") - F.col("a") >= F.floor(F.col("length") / _CODE))).drop("length")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, most_fragments: int = 20_000, words: int | None = None) -> DataFrame:
    """One row per input row: doc_id, x (hash of its text), n_bytes, n_removed, n_spans, n_passage_words, kept_sha256, spans (removed byte ranges) and kept (the rest as text; a character cut in two is left out of it, not out of the digest).

    Texts are UTF-8 bytes, null counts as empty. Strings are judged on the input. A repeated row is
    a repeat of all its strings. Texts under ``length`` bytes stay as they are. ``n_passage_words``:
    words that lie in a string of ``words`` words (16 at least) that starts anywhere else too, however
    few bytes it has; nothing is removed for it (0 without ``words``). Other columns are ignored.
    """
    _check(length, words)
    rows = _sides(docs, id_col, text_col)
    return _removed(rows.drop("row"), length, most_fragments, words, False).withColumnRenamed("i", "doc_id")


def _check(length: int, words: int | None) -> None:
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    if words and words * _CODE < 2 * GRAM:
        raise ValueError(f"words must be {2 * GRAM // _CODE} at least")


def _removed(rows: DataFrame, length: int, most_fragments: int, words: int | None, cut_words: bool) -> DataFrame:
    ranges = _repeats(rows, [Kind(length), *([_by_words(words)] if words else [])], most_fragments)
    own = ranges.groupBy(F.col("i").alias("ri"), F.col("x").alias("rx")).agg(F.collect_set(F.struct("a", "b", "w")).alias("ranges"))
    joined = rows.join(own, rows["i"].eqNullSafe(own["ri"]) & (rows["x"] == own["rx"]), "left").drop("ri", "rx")
    pairs = "array<struct<a:long,b:long>>"
    carried = ", ".join(f"{c} {t}" for c, t in joined.dtypes if c not in ("t", "ranges"))
    return joined.mapInArrow(_remove_batches(cut_words), f"{carried}, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept_sha256 string, spans {pairs}, kept string")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, most_fragments: int = 20_000, words: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are but for the text, which is what :func:`remove_repeats` keeps; with ``words`` (16 at least), repeated strings of so many words go too, however few bytes they have."""
    _check(length, words)
    out = _removed(_sides(docs, id_col, text_col), length, most_fragments, words, True)
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: strings of 400 bytes, all documents; ``n_passage_words`` also tells repeated passages of over 50 words that are shorter than that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, words=51).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
