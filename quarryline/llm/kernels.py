"""NumPy kernels over Arrow text columns.

A block is a run of whole documents whose UTF-8 bytes lie in one array; every kernel works on all
documents of a block at once. Blocks are bounded in bytes, a single document is never split here.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over batches that gives its memory back to the system when a task ends: worker processes live on, idle ones beside those of the next stage."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Free memory that Arrow and the C library hold for later; nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and those of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, b, U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[i] = sum of (byte + 1) * base**j over j < i; see :func:`slice_hash`."""
    up, _ = powers(len(data) + 1)
    s = np.empty(len(data) + 1, U)
    s[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=s[1:])
    return s


def slice_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [start, end): equal slices have equal hashes wherever they lie."""
    _, down = powers(len(s))
    return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty) and the documents' offsets in them."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of text and at most ``rows`` rows (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            j = min(j, i + rows, batch.num_rows)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def table_of(classes: str) -> np.ndarray:
    """Which byte values belong to words: ``space`` has all but white space, ``letter`` letters, digits and all of UTF-8's higher bytes."""
    t = np.ones(256, bool)
    if classes == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:128] = [chr(c).isalnum() for c in range(128)]
    return t


SPACE, LETTER = table_of("space"), table_of("letter")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``is_word``, none across documents, and how many each document has."""
    if not len(is_word):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(is_word)]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of the letters of ASCII and Latin-1 (two bytes in UTF-8, the second 0x80 to 0x9E but for the multiplication sign)."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.empty(0, np.int64)
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the case-folded words, their starts and ends, and the number of words of each document."""
    starts, ends, counts = spans(table[data], offsets)
    return slice_hash(prefix_hash(fold(data)), starts, ends), starts, ends, counts


def runs(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of ``width`` words that lies in one document, and the document of each."""
    base = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[doc]
    return first, doc


def chain(hashes: np.ndarray, first: np.ndarray, gaps: tuple[int, ...]) -> np.ndarray:
    """One hash for the words at first + gap, in order."""
    h = np.zeros(len(first), U)
    for g in gaps:
        h = mix(h * U(0x9FB21C651E98DF25) + hashes[first + g])
    return h


# --- XXH64 -------------------------------------------------------------------------------------
# Fixed values of the published algorithm.
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x, r):
    return (x << U(r)) | (x >> U(64 - r))


def _lane(acc, value):
    return _rotl(acc + value * _P2, 31) * _P1


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buffer[start : start + length] for all slices at once."""
    with np.errstate(over="ignore"):
        buffer = np.concatenate([buffer, np.zeros(8, np.uint8)])
        at8 = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        at4 = np.ndarray((len(buffer) - 3,), "<u4", buffer, strides=(1,))
        s, n = U(seed), lengths
        h = np.full(len(starts), s + _P5, U)
        stripes = n // 32
        long = np.flatnonzero(stripes)
        if len(long):
            acc = [np.full(len(long), x, U) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            left, at = stripes[long], starts[long].copy()
            active = np.arange(len(long))
            k = 0
            while len(active):
                for i in range(4):
                    acc[i][active] = _lane(acc[i][active], at8[at[active] + 8 * i])
                at[active] += 32
                k += 1
                active = active[left[active] > k]
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _lane(U(0), a)) * _P1 + _P4
            h[long] = x
        h += n.astype(U)
        at, rest = starts + stripes * 32, n % 32
        for _ in range(3):
            a = np.flatnonzero(rest >= 8)
            h[a] = _rotl(h[a] ^ _lane(U(0), at8[at[a]]), 27) * _P1 + _P4
            at[a] += 8
            rest[a] -= 8
        a = np.flatnonzero(rest >= 4)
        h[a] = _rotl(h[a] ^ (at4[at[a]].astype(U) * _P1), 23) * _P2 + _P3
        at[a] += 4
        rest[a] -= 4
        for _ in range(3):
            a = np.flatnonzero(rest > 0)
            h[a] = _rotl(h[a] ^ (buffer[at[a]].astype(U) * _P5), 11) * _P1
            at[a] += 1
            rest[a] -= 1
        h = (h ^ (h >> U(33))) * _P2
        h = (h ^ (h >> U(29))) * _P3
        return h ^ (h >> U(32))
