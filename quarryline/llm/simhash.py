"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most four differing bits share at least four of their eight bytes,
position by position. Postings are keyed by the bytes at three positions; the twenty position
triples of a Turan cover are such that any four positions contain one of them, so every pair that
reaches the guaranteed count meets under some key. There the shared positional bytes of a pair are
tallied, pairs under four are dropped, the rest are verified by the differing bits.

Only a spanning forest of the links of each posting list is emitted, never all pairs: a group of n
near copies costs n - 1 rows a list. Equal fingerprints are one node from the start.

Four bits are an estimated cosine of 0.98. Fingerprints of texts that share 0.8 of their shingles differ
in about ten bits, often in sixteen, and sixteen of 64 bits leave no byte that must be shared. So
:func:`representatives`, which is about similarity, takes the links of that index, verifies them on whole
shingle sets, and checks exactly for those that the radius does not hold: postings by the smallest
shingle hashes of a text that are not common, candidates by sketches; see :func:`similar`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .scratch import drop, stored

#: Eight positions in three groups; a triple is kept if it lies in one group, or has two in a group and one in the next.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: A posting list of more fingerprints is dealt out anew by one more shared position.
LONG_LIST = 4096


def position_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of which each set of four positions contains one."""
    of = {p: g for g, ps in enumerate(_GROUPS) for p in ps}

    def kept(t: tuple[int, ...]) -> bool:
        g = sorted(of[p] for p in t)
        return g[0] == g[2] or g in ([0, 0, 1], [1, 1, 2], [0, 2, 2])

    return [t for t in combinations(range(8), 3) if kept(t)]


def _mask(positions: tuple[int, ...], width: int = 8) -> int:
    """The bits of some positions of ``width`` bits, as a signed long."""
    m = sum(((1 << width) - 1) << (width * p) for p in positions)
    return m - 2**64 if m >= 2**63 else m


def first_masks(max_bits: int) -> list[int]:
    """Byte positions to key by, such that fingerprints within ``max_bits`` bits agree at all positions of one mask at least."""
    if max_bits <= 4:  # four bytes agree at least
        return [_mask(t) for t in position_triples()]
    return [_mask(t) for t in combinations(range(8), 8 - max_bits)]


def longer_masks(mask: int, max_bits: int) -> list[int]:
    """The mask with one more position. As long as fewer bytes are in it than must agree, the next is any other byte; then any other half byte: of the 2 * ``max_bits`` left as many as ``max_bits`` agree at least, so the last of them leaves 4 * ``max_bits`` bits at most."""
    m = mask % 2**64
    whole = [p for p in range(8) if m >> 8 * p & 255 == 255]
    if len(whole) < 8 - max_bits:
        return [mask | _mask((p,)) for p in range(8) if p not in whole]
    halves = [p for p in range(16) if m >> 4 * p & 15 == 0]
    return [mask | _mask((p,), 4) for p in halves] if len(halves) > max_bits else []


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of a block's documents, in order, and how many each document has."""
    is_word = K.SPACE[data]
    starts, ends, counts = K.spans(is_word, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    keep = is_word.copy()
    gap = ends[ends < len(data)]
    keep[gap] = True  # one separator after each word; a word that follows at once belongs to the next document
    place = np.cumsum(keep) - 1
    buffer = K.LOWER[np.where(is_word, data, 32)[keep]]
    starts, ends = place[starts], place[ends - 1] + 1
    short = np.minimum(counts, width)
    n = np.where(counts > 0, counts - short + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    base = np.cumsum(counts) - counts
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[doc]
    last = first + short[doc] - 1
    return K.xxh64(buffer, starts[first], ends[last] - starts[first]), n


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of a block's documents: bit i is set if it is in over half of the hashes of the ``width``-word shingles."""
    return votes(*shingles(data, offsets, width))


def votes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``n`` hashes; 0 for none."""
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    # Eight one-byte counters in a word: sums of at most 255 hashes do not overflow them.
    own = np.flatnonzero(n)
    begin = (np.cumsum(n) - n)[own]
    pieces = (n[own] + 254) // 255
    cut = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    mask, bits = np.uint64(0x0101010101010101), np.empty((len(own), 8, 8), np.int64)
    for b in range(8):
        sums = np.add.reduceat((h >> np.uint64(b)) & mask, cut).view(np.uint8).reshape(-1, 8)
        bits[:, :, b] = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
    on = bits.reshape(len(own), 64) * 2 > n[own][:, None]
    out[own] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(width: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in K.blocks(batches, "t"):
            fp = fingerprints(data, offsets, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("i"), block.column("x"), pa.array(fp)], ["i", "x", "fp"])

    return run


def forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) among one posting list: each found fingerprint is compared with those not found yet, so a dense list costs little more than its length."""
    a, b = [], []
    rest = np.arange(len(fp))
    need = 8 - most
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            d = fp[rest] ^ fp[x]
            tally = (d.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = (tally >= need) & (np.bitwise_count(d) <= most)
            if near.any():
                found = rest[near]
                a += [x] * len(found)
                b += found.tolist()
                front += found.tolist()
                rest = rest[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole posting lists: rows come sorted by key, a list may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        k = np.asarray(batch.column("k"))
        if k[0] == k[-1] and (len(held) == 1 or np.asarray(held[0].column("k"))[-1] == k[0]):
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        at = int(np.searchsorted(np.asarray(whole.column("k")), k[-1]))
        yield whole.slice(0, at)
        held = whole.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _link_batches(most: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _lists(batches):
            k, nodes = (np.asarray(t.column(c)) for c in ("k", "fp"))
            fp = nodes.view(np.uint64)
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(cut, len(k)))
            a, b = [], []
            two = cut[size == 2]
            d = fp[two] ^ fp[two + 1]
            near = ((d.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - most) & (np.bitwise_count(d) <= most)
            a.append(two[near])
            b.append(two[near] + 1)
            for i, n in zip(cut[size > 2], size[size > 2]):
                x, y = forest(fp[i : i + n], most)
                a.append(x + i)
                b.append(y + i)
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return run


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(i, x, fp) of every row: id, hash of the text, fingerprint; null and empty texts have fingerprint 0."""
    t = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(t).alias("x"), t.alias("t")).mapInArrow(_fingerprint_batches(width), "i long, x long, fp long")


def _postings(members: DataFrame, masks: Column) -> DataFrame:
    """(fp, mask, k) for (fp, ...): one row a mask, keyed by the bits it covers."""
    out = members.select("fp", F.explode(masks).alias("mask"))
    return out.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"))


def fingerprint_links(fps: DataFrame, max_bits: int = 4, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): spanning links among the distinct fingerprints (fp) that differ in at most ``max_bits`` bits.

    Lists of more than ``long_list`` are dealt out again by one more shared position, until the
    fingerprints of a list differ in so few bits that there cannot be many (2**16 at four bits).
    """
    spark = fps.sparkSession
    # The dictionary of masks is small and fixed: which come after which.
    level, links = first_masks(max_bits), []
    postings = _postings(fps, F.array(*map(F.lit, level)))
    while True:
        after = {m: longer_masks(m, max_bits) for m in level}
        if any(after.values()):
            postings = stored(postings, "simhash-postings")
            sizes = postings.groupBy("k").agg(F.count("*").alias("z")).where("z > 1")
            long = stored(sizes.where(F.col("z") > long_list).select(F.col("k").alias("key")), "simhash-long")
            split = not long.isEmpty()
        else:
            split = False
        short = postings.join(long, postings["k"] == long["key"], "left_anti") if split else postings
        links.append(short.repartition("k").sortWithinPartitions("k").mapInArrow(_link_batches(max_bits), "a long, b long"))
        if not split:
            return reduce(DataFrame.unionAll, links)
        following = spark.createDataFrame([(m, n) for m, ns in after.items() for n in ns], "of long, next long")
        cut = postings.join(long, postings["k"] == long["key"], "left_semi").join(F.broadcast(following), F.col("mask") == F.col("of"))
        postings = cut.select("fp", F.col("next").alias("mask")).distinct().select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"))
        level = sorted({n for ns in after.values() for n in ns})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_bits: int = 4) -> DataFrame:
    """(doc_id, x, fingerprint as signed long, component_id), one row per input row; x is the hash of its text.

    ``width``: words of a shingle (fewer words: the whole sequence); ``max_bits``: differing bits at
    which two fingerprints link, from 0 to 7 (beyond it no byte must be shared; 4 of 64 bits is an
    estimated cosine similarity of 0.98). Null and empty texts: fingerprint 0, linked like any other.
    Repeated rows and ids stay; rows with null ids link like others, but a null id is a component's
    name only where all its rows have null ids. Other columns are ignored; an empty table gives none.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be from 0 to 7")
    fps = stored(fingerprint_table(docs, id_col, text_col, width), "simhash")
    # A fingerprint is a node, whoever has it; its smallest id (null: none) counts once components are known.
    reps = stored(fps.groupBy("fp").agg(F.min("i").alias("rep")), "simhash-reps")
    comp = components(fingerprint_links(reps.select("fp"), max_bits))
    of = stored(reps.join(comp, reps["fp"] == comp["node"], "left").select(F.col("fp").alias("f"), F.coalesce("component", "fp").alias("c"), "rep"), "simhash-components")
    names = of.groupBy(F.col("c").alias("n")).agg(F.min("rep").alias("component_id"))
    named = of.join(names, of["c"] == names["n"]).select("f", "component_id")
    return fps.join(named, fps["fp"] == named["f"]).select(F.col("i").alias("doc_id"), "x", F.col("fp").alias("fingerprint"), "component_id")


#: Smallest shingle hashes of a text: so many are postings, so many a sketch. A pair of similarity 0.8 shares no posting with probability 0.2**12 = 4e-9 (never, if one has under 55 shingles), and its sketches look under half alike with 2e-8.
POSTINGS, SKETCH = 12, 64
#: A shingle in more sketches than this is common. A sketch with at most this share of others beyond what two alike texts may differ in is mostly common: a pair of similarity 0.8 has no other shingle of its sketches in common with probability 1e-7 at most.
COMMON, MARGIN = 256, 0.32
#: Texts, and shingles, of one side of a task that compares all with all.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1_000_000
#: Candidate components of more blocks are compared list by list.
WHOLE_BLOCKS = 4
_NONE = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and how many each has."""
    h, n = shingles(data, offsets, width)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(n))


def _list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.view(np.int64)))


def _sketch_batches(width: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in K.blocks(batches, "t"):
            h, n = shingle_sets(data, offsets, width)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(h), dtype=np.uint64)])
            last = np.cumsum(n)
            name = K.mix(sums[last] - sums[last - n] + n.astype(np.uint64))
            fp = votes(h, n).view(np.int64)
            low = np.arange(len(h)) - np.repeat(last - n, n) < SKETCH
            yield pa.RecordBatch.from_arrays([block.column("i"), block.column("x"), pa.array(name.view(np.int64)), pa.array(n), _list_array(h[low], np.minimum(n, SKETCH)), pa.array(fp)], ["i", "x", "g", "n", "s", "fp"])

    return run


def _set_batches(width: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in K.blocks(batches, "t"):
            yield pa.RecordBatch.from_arrays([block.column("g"), _list_array(*shingle_sets(data, offsets, width))], ["g", "s"])

    return run


class Sketches:
    """Sketches of some texts in one matrix, and which pairs of them can be alike.

    Sets of at most SKETCH hashes are whole in their sketches: two such texts are judged exactly. For
    others the seen part of the union is a sample, and pairs count within 5.6 standard deviations
    (at most 0.3) of the similarity; the more of the union is seen, the less.
    """

    def __init__(self, column: pa.Array, n: np.ndarray, similarity: float):
        ends = np.asarray(column.offsets)
        size = np.diff(ends)
        values = np.asarray(column.values).view(np.uint64)[ends[0] : ends[-1]]
        self.rows, self.n, self.least = np.full((len(n), SKETCH), _NONE), n, similarity
        self.rows[np.repeat(np.arange(len(n)), size), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], size)] = values
        self.reach = np.where(n > SKETCH, self.rows[:, -1], _NONE)  # up to there a sketch has all hashes

    def alike(self, a: np.ndarray, b: np.ndarray, at_once: int = 16384) -> np.ndarray:
        """Pairs whose sizes allow the similarity and whose sketches do not rule it out."""
        out = np.minimum(self.n[a], self.n[b]) >= self.least * np.maximum(self.n[a], self.n[b]) - 1e-9
        left = np.flatnonzero(out)
        for at in range(0, len(left), at_once):
            pairs = left[at : at + at_once]
            x, y = a[pairs], b[pairs]
            both = np.sort(np.concatenate([self.rows[x], self.rows[y]], axis=1), axis=1)
            shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)).sum(axis=1)
            seen = ((both <= np.minimum(self.reach[x], self.reach[y])[:, None]) & (both != _NONE)).sum(axis=1)
            union = seen - shared
            whole = (self.n[x] <= SKETCH) & (self.n[y] <= SKETCH)
            unseen = np.maximum(0, 1 - union * (1 + self.least) / (self.n[x] + self.n[y]))  # of the largest union that reaches the similarity
            slack = np.where(whole, 0, np.minimum(0.3, 5.6 * np.sqrt(self.least * (1 - self.least) * unseen / union)))
            out[pairs] = shared >= (self.least - slack) * union - 1e-9
        return out

    def forest(self, first: int, size: int) -> list[tuple[int, int]]:
        """Spanning links of the rows from ``first``."""
        out, rest = [], np.arange(first, first + size)
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = self.alike(np.full(len(rest), x), rest)
                found = rest[near]
                out += [(x, y) for y in found]
                front += found.tolist()
                rest = rest[~near]
        return out


def _candidate_batches(similarity: float):
    """(a, b, k): a spanning forest of each posting list by sketches."""

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _lists(batches):
            t = t.combine_chunks()
            k, g, n = (np.asarray(t.column(x)) for x in ("k", "g", "n"))
            s = t.column("s").combine_chunks()
            sketches = Sketches(s.chunk(0) if isinstance(s, pa.ChunkedArray) else s, n, similarity)
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(cut, len(k)))
            two = cut[size == 2]
            two = two[sketches.alike(two, two + 1)]
            links = [np.stack([two, two + 1], axis=1)]
            links += [np.array(sketches.forest(i, m), np.int64).reshape(-1, 2) for i, m in zip(cut[size > 2], size[size > 2])]
            a, b = np.concatenate(links).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(g[a], g[b])), pa.array(np.maximum(g[a], g[b])), pa.array(k[a])], ["a", "b", "k"])

    return run


def exact_forest(values: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning links of all pairs of a ``left`` and a ``right`` set of similarity or more. ``values``: the sets' distinct hashes, one set after the other.

    Shared hashes are counted for all pairs at once: those of many sets as matrix products, the
    others pair by pair.
    """
    m = len(counts)
    codes, code, df = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), counts)
    shared = np.zeros((m, m), np.float32)
    many = np.flatnonzero(df > 16)
    place = np.full(len(codes), -1)
    place[many] = np.arange(len(many))
    for at in range(0, len(many), 1024):
        width = min(1024, len(many) - at)
        inside = (place[code] >= at) & (place[code] < at + width)
        of = np.zeros((m, width), np.float32)
        of[row[inside], place[code[inside]] - at] = 1
        shared += of @ of.T
    order = np.argsort(code, kind="stable")
    first = np.cumsum(df) - df
    for n in range(2, 17):
        of = first[df == n]
        if len(of):
            rows = row[order[of[:, None] + np.arange(n)]]
            for x, y in combinations(range(n), 2):
                np.add.at(shared, (rows[:, x], rows[:, y]), 1)
                np.add.at(shared, (rows[:, y], rows[:, x]), 1)
    out, waiting = [], np.ones(m, bool)
    for root in range(m):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front:
            x = front.pop()
            sides = (left[x] & right) | (right[x] & left)
            found = np.flatnonzero(waiting & sides & (shared[x] >= similarity * (counts[x] + counts - shared[x]) - 1e-4))
            waiting[found] = False
            out += [(x, y) for y in found.tolist()]
            front += found.tolist()
    return out


def _exact_batches(similarity: float):
    """(a, b) of the groups (k, g, e, s): e is 0 for sets compared with all, 1 and 2 for sets compared with those of the other side."""

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _lists(batches):
            t = t.combine_chunks()
            k, g, e = (np.asarray(t.column(x)) for x in ("k", "g", "e"))
            s = t.column("s").combine_chunks()
            s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
            ends, values = np.asarray(s.offsets), np.asarray(s.values)
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])).tolist() + [len(k)]
            a, b = [], []
            for i, j in zip(cut[:-1], cut[1:]):
                for x, y in exact_forest(values[ends[i] : ends[j]], np.diff(ends[i : j + 1]), e[i:j] != 2, e[i:j] != 1, similarity) if j - i > 1 else ():
                    a.append(g[i + x])
                    b.append(g[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocks_of() -> Column:
    """Aggregate of (g, n): blocks of a bounded size that a group needs."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")


def _placed(members: DataFrame) -> DataFrame:
    """(c, g, own, blocks) for members (c, g, n): each group c cut into blocks of a bounded size, the first of which leads."""
    sizes = members.groupBy(F.col("c").alias("sc")).agg(_blocks_of())
    return stored(members.join(sizes, members["c"] == sizes["sc"]).select("c", "g", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int").alias("own"), "blocks"), "group-blocks")


def _leaders_and_all(placed: DataFrame) -> DataFrame:
    """(k, g, e): the leading block of each group against every block: a text is sent once, a leader once a block."""
    others = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = placed.select("c", "g", "own", F.explode(others).alias("block"))
    return dealt.select(F.xxhash64("c", "block").alias("k"), "g", F.when(F.col("block") == 0, 0).when(F.col("own") == 0, 1).otherwise(2).alias("e"))


def _rest_and_all(placed: DataFrame, comp: DataFrame) -> DataFrame:
    """(k, g, e): the texts outside the largest component of their group, but for leaders, against all of the group.

    Texts of one component need no link between them, so what the leaders have joined is not compared with itself.
    """
    several = placed.where("blocks > 1")
    now = several.join(comp, several["g"] == comp["node"], "left").select("c", "g", "own", "blocks", F.coalesce("component", "g").alias("now"))
    now = stored(now, "group-components")
    largest = now.groupBy("c", "now").agg(F.count("*").alias("z")).groupBy(F.col("c").alias("lc")).agg(F.max_by("now", F.struct("z", "now")).alias("largest"))
    marked = now.join(largest, now["c"] == largest["lc"]).withColumn("left", (F.col("now") != F.col("largest")) & (F.col("own") > 0))
    parts = marked.where("left").groupBy(F.col("c").alias("pc")).agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("parts"))
    marked = marked.join(parts, marked["c"] == parts["pc"]).select("c", "g", "own", "blocks", "left", "parts")
    own_part = F.pmod(F.xxhash64(F.lit(1), "g"), F.col("parts")).cast("int")
    key = lambda part, block: F.xxhash64("c", part, block, F.lit(2)).alias("k")
    all_ = marked.select("c", "g", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(key("part", "own"), "g", F.lit(2).alias("e"))
    rest = marked.where("left").select("c", "g", own_part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(key("part", "block"), "g", F.lit(1).alias("e"))
    return all_.unionAll(rest)


def _group_links(members: DataFrame, sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Spanning links (a, b) of all groups (c, g, n), exact, given the ``links`` there are.

    Leaders first, which in a group of near copies find nearly all of it; then only what is still apart
    from the group's largest component is compared with all. A dense group so costs a few rows a text; one
    without a large component is compared all with all, as it has to be.
    """
    placed = _placed(members)
    first = stored(_exact_links(_leaders_and_all(placed), sets, similarity), "leader-links")
    if placed.where("blocks > 1").isEmpty():
        return first
    comp = components(links.unionAll(first))
    return first.unionAll(stored(_exact_links(_rest_and_all(placed, comp), sets, similarity), "rest-links"))


def _sets_of(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(g, s): the whole shingle sets of the nodes (g, p)."""
    texts = nodes.select("g", F.col("p.i").alias("pi"), F.col("p.x").alias("px"))
    texts = rows.join(texts, rows["i"].eqNullSafe(texts["pi"]) & (rows["x"] == texts["px"])).select("g", "t")
    return stored(texts.mapInArrow(_set_batches(width), "g long, s array<long>").dropDuplicates(["g"]), "shingle-sets")


def _exact_links(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    of = sets.withColumnRenamed("g", "node")
    return groups.join(of, groups["g"] == of["node"]).select("k", "g", "e", "s").repartition("k").sortWithinPartitions("k").mapInArrow(_exact_batches(similarity), "a long, b long")


def _doubtful(found: DataFrame, failed: DataFrame, comp: DataFrame, nodes: DataFrame, whole_blocks: int) -> DataFrame:
    """(c, g, n): texts that have to be compared whole because a candidate link failed while its ends are in several components.

    Two texts of one list that can be alike are joined by candidate links, so a link that is still
    missing lies within a component of those. Such components are groups; a text is in one of them,
    not in every list it shares. Those of more than ``whole_blocks`` blocks fall apart into their lists.
    """
    near = components(found.select("a", "b")).withColumnRenamed("component", "c")
    near = near.join(nodes.select("g", "n"), near["node"] == nodes["g"]).select("c", "g", "n")
    near = stored(near.join(comp, near["g"] == comp["node"], "left").select("c", "g", "n", F.coalesce("component", "g").alias("now")), "candidate-components")
    sizes = near.groupBy(F.col("c").alias("key")).agg(_blocks_of(), F.min("now").alias("lo"), F.max("now").alias("hi")).where("lo < hi")
    of = near.join(sizes, near["c"] == sizes["key"]).select("c", "g", "n", "now", (F.col("blocks") <= whole_blocks).alias("whole"))
    apart = stored(of.where("not whole").select(F.col("g").alias("node"), "n", "now"), "candidate-lists")
    whole = of.where("whole").select("c", "g", "n")
    if apart.isEmpty():
        return whole
    lists = found.join(found.join(failed, ["a", "b"], "left_semi").select("k").distinct(), "k", "left_semi")
    ends = lists.select("k", F.col("a").alias("e")).union(lists.select("k", F.col("b").alias("e"))).distinct()
    members = ends.join(apart, ends["e"] == apart["node"]).select("k", "e", "n", "now")
    several = members.groupBy(F.col("k").alias("key")).agg(F.min("now").alias("lo"), F.max("now").alias("hi")).where("lo < hi")
    return whole.unionAll(members.join(several, members["k"] == several["key"], "left_semi").select(F.xxhash64(F.lit(1), "k").alias("c"), F.col("e").alias("g"), "n"))


def _near_nodes(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b), a < b: spanning links of the nodes (g, fp) whose fingerprints are equal or within ``max_bits`` bits. Of nodes with one fingerprint the smallest stands for it."""
    owners = stored(nodes.groupBy(F.col("fp").alias("f")).agg(F.min("g").alias("o")), "simhash-reps")
    left, right = owners.select(F.col("f").alias("a"), F.col("o").alias("x")), owners.select(F.col("f").alias("b"), F.col("o").alias("y"))
    links = fingerprint_links(owners.select(F.col("f").alias("fp")), max_bits).join(left, "a").join(right, "b").select("x", "y")
    equal = nodes.join(owners, nodes["fp"] == owners["f"]).where("g <> o").select(F.col("o").alias("x"), F.col("g").alias("y"))
    return stored(links.unionAll(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "simhash-pairs")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, common: int = COMMON, whole_blocks: int = WHOLE_BLOCKS, max_bits: int = 4) -> DataFrame:
    """(i, x, component), one row for each distinct shingle set: the first row that has it (smallest id, null last) and its component.

    Two texts link if their sets of ``width``-word shingles (fewer words: the whole sequence; case and
    white space do not count) have a Jaccard similarity of ``similarity`` or more.

    1. SimHash: fingerprints of the sets, the byte-position index with its count filter and spanning
       links within ``max_bits`` bits, as in :func:`near_duplicates`; links are verified on whole sets.
       The radius holds only part of the pairs of that similarity, so two exact checks follow.
    2. Rare shingles: posting lists of the smallest hashes that few sketches (``common``) have; a
       spanning forest of each list by sketches, its links verified on whole sets. Where some fail and
       texts joined by candidate links are still in several components, those are compared exactly.
    3. Common shingles: texts made mostly of shingles that many have (copies of one passage, large
       groups of near copies) need share no rare one. Those that are connected by common shingles are
       compared exactly, in blocks, so that no task has more than a bounded part of a group: leaders with
       all, then what they have not joined with all; see :func:`_group_links`.

    No pairs are made but those of spanning forests.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity must be from 0.8 to 1")
    t = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(t).alias("x"), t.alias("t"))
    sketched = rows.mapInArrow(_sketch_batches(width), "i long, x long, g long, n long, s array<long>, fp long")
    nodes = stored(sketched.groupBy("g").agg(F.min(F.struct(F.col("i").isNull().alias("last"), "i", "x")).alias("p"), F.first("n").alias("n"), F.first("s").alias("s"), F.first("fp").alias("fp")), "shingle-nodes")
    often = stored(nodes.select(F.explode("s").alias("key")).groupBy("key").agg(F.count("*").alias("z")).where(F.col("z") > common).select("key"), "shingle-common")
    entries = nodes.select(F.col("g").alias("cg"), F.explode("s").alias("k"))
    have = entries.join(often, entries["k"] == often["key"], "left_semi").groupBy("cg").agg(F.collect_set("k").alias("common"))  # SKETCH at most
    told = nodes.join(have, nodes["g"] == have["cg"], "left")
    rare = F.when(F.col("common").isNull(), F.slice("s", 1, POSTINGS)).otherwise(F.array_except("s", "common"))
    few = F.when(F.col("n") <= SKETCH, (1 - similarity) * F.col("n") + 1e-9).otherwise((1 - similarity + MARGIN) * SKETCH)
    told = stored(told.select("g", "n", "s", rare.alias("rare"), F.when(F.col("common").isNotNull() & (F.size("rare") <= few), F.array_intersect(F.slice("s", 1, POSTINGS), "common")).alias("keys")), "shingle-keys")

    # 1. SimHash.
    near = _near_nodes(nodes, max_bits)

    # 2. Rare shingles.
    postings = told.select("g", F.explode("rare").alias("k"))
    shared = postings.groupBy(F.col("k").alias("key")).agg(F.count("*").alias("z")).where("z > 1")
    lists = postings.join(shared, postings["k"] == shared["key"], "left_semi").withColumnRenamed("g", "node")
    lists = stored(lists.join(nodes, lists["node"] == nodes["g"]).select("k", "g", "n", "s"), "shingle-lists")
    drop(often)
    found = stored(lists.repartition("k").sortWithinPartitions("k", "n").mapInArrow(_candidate_batches(similarity), "a long, b long, k long"), "candidates")
    drop(lists)
    pairs = stored(near.unionAll(found.select("a", "b")).distinct(), "candidate-pairs")
    drop(near)

    # 3. Common shingles: keys that a text has together are one group.
    mostly = stored(told.where(F.size("keys") > 0).select("g", "n", "keys"), "shingle-mostly-common")
    drop(told)
    joint = components(mostly.select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).distinct())
    grouped = mostly.join(joint, F.col("keys")[0] == joint["node"], "left").select(F.coalesce("component", F.col("keys")[0]).alias("c"), "g", "n")

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(mostly.select(F.col("g").alias("node"))).distinct()
    sets = _sets_of(rows, nodes.join(ends, nodes["g"] == ends["node"], "left_semi"), width)
    judged = pairs.join(sets.select(F.col("g").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("g").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    judged = stored(judged.select("a", "b", (both >= F.lit(similarity) * union - 1e-9).alias("ok")), "verified")
    links = judged.where("ok").select("a", "b")
    links = links.unionAll(_group_links(grouped, sets, links, similarity))
    comp = components(links)

    failed = judged.where("not ok").select("a", "b")
    if not failed.isEmpty():
        members = stored(_doubtful(found, failed, comp, nodes, whole_blocks), "doubtful")
        if not members.isEmpty():
            comp = components(links.unionAll(_group_links(members, sets, links, similarity)))
    drop(sets, found, pairs)
    return nodes.join(comp, nodes["g"] == comp["node"], "left").select("p.i", "p.x", F.coalesce("component", "g").alias("component"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, common: int = COMMON) -> DataFrame:
    """The rows of ``docs`` with one of each component of :func:`similar` left: the one with the smallest id (of repeated rows with that id and text, any one). Rows without id stay only where all of their component have none. Null texts are empty ones; an empty table stays empty; all columns stay as they are."""
    first = F.min(F.struct(F.col("i").isNull().alias("last"), "i", "x")).alias("p")
    kept = stored(similar(docs, id_col, text_col, width, similarity, common).groupBy("component").agg(first).select(F.col("p.i").alias("gi"), F.col("p.x").alias("gx")), "representatives")

    def within(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, rows[id_col].cast("long").eqNullSafe(keys["gi"]) & (F.xxhash64(rows[text_col]) == keys["gx"]), how)

    left = within(docs, kept, "left_semi")
    again = stored(left.groupBy(F.col(id_col).cast("long").alias("gi"), F.xxhash64(F.col(text_col)).alias("gx")).agg(F.count("*").alias("z")).where("z > 1").select("gi", "gx"), "simhash-repeats")
    if again.isEmpty():
        return left
    return within(left, again, "left_anti").unionByName(within(left, again, "left_semi").dropDuplicates([id_col, text_col]))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: 4-word shingles, fingerprints link at 4 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, width=4, max_bits=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
