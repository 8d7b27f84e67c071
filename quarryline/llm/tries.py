"""Word n-grams of a block of texts as the nodes of a trie.

A level is an array with the node of every position of the block where an n-gram starts, and for
every node its parent on the level before and the word it adds. Nodes are numbered by first sight and
told by parent and word, so two n-grams share a node only if they are equal word for word. A block's
trie goes when its totals are taken: memory is that of one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from . import kernels as K


def numbered_words(data: np.ndarray, is_word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of every word and the distinct words by number; ``starts`` and ``ends`` are those of all runs of ``is_word``."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[is_word])])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def nodes(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The node of each pair of numbers (the right one below ``size``), and the left and right number of each node."""
    number, distinct = pd.factorize(left * size + right)
    return number, distinct // size, distinct % size


# --- CRC-32 ---------------------------------------------------------------------------------------

#: The reflected polynomial of CRC-32, a fixed value.
_POLYNOMIAL = 0xEDB88320


def _byte_steps() -> np.ndarray:
    """What a zero byte makes of each value of the register's lowest byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


class Advance:
    """The register of a CRC-32 after so many more zero bytes, for arrays of states and lengths.

    CRC-32 is linear: the state of a child node is its parent's, advanced by the bytes the child adds,
    plus (bitwise) the sum of those bytes alone. Tables of one length are made when it is first seen.
    """

    def __init__(self, most: int = 64):
        self.most, self.step = most, _byte_steps()
        byte = np.arange(256, dtype=np.uint32)
        self.tables = np.zeros((most + 1, 4, 256), np.uint32)
        self.tables[0] = [byte << np.uint32(8 * k) for k in range(4)]
        for n in range(1, most + 1):
            self.tables[n] = self._zero_byte(self.tables[n - 1])

    def _zero_byte(self, state: np.ndarray) -> np.ndarray:
        return (state >> np.uint32(8)) ^ self.step[state & np.uint32(255)]

    def __call__(self, states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = states.astype(np.uint32)
        left = lengths.astype(np.int64).copy()
        while True:
            now = np.flatnonzero(left > 0)
            if not len(now):
                return out
            n, s = np.minimum(left[now], self.most), out[now]
            x = self.tables[n, 0, s & 255]
            for k in (1, 2, 3):
                x = x ^ self.tables[n, k, (s >> np.uint32(8 * k)) & 255]
            out[now] = x
            left[now] -= n
