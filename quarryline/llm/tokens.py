"""Token counts without token ids.

A text's pre-tokens (what its tokenizer's pattern cuts before any merge) repeat a lot. Every distinct
pre-token is given to the tokenizer once a task and only the number of its pieces is kept; each
document's pre-tokens are joined to those numbers by hash, a block of documents at a time, and
summed. The table of piece counts is kept through a task up to a bound, then started anew.

The join is made within a task on purpose: shuffling (document, pre-token, frequency) rows moves
more bytes than the texts themselves, while counting a pre-token's pieces again in another task
costs microseconds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

def _latin_classes() -> np.ndarray:
    """Class of each Latin-1 character in the pattern: 0 white space, 1 letter, 2 number, 3 other."""
    import regex

    out = np.full(256, 3, np.uint8)
    for k, pattern in enumerate((r"\p{White_Space}", r"\p{L}", r"\p{N}")):
        out[[c for c in range(256) if regex.match(pattern, chr(c))]] = k
    return out


class LatinCutter:
    """The byte-level pattern over whole blocks of Latin-1 texts: where pre-tokens start.

    Runs of one class are pre-tokens. A blank right before a run belongs to it; of other white space the
    last character stands alone before a run, what is before it is one pre-token, and so is white
    space at the end of a text. An apostrophe without a blank takes s, t, m, d, re, ve or ll.
    """

    def __init__(self):
        self.classes = _latin_classes()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean array: a pre-token starts at this character of the texts ``data[offsets[i] : offsets[i + 1]]``."""
        n = len(data)
        c = self.classes[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        new = edge[:n].copy()
        new[1:] |= c[1:] != c[:-1]
        white, blank = c == 0, data == 32
        before = np.zeros(n, bool)  # a blank of the same text is right before
        before[1:] = blank[:-1] & ~edge[1:n]
        start = new & (white | ~before)
        # The last white space before a run: a blank goes with the run, another character stands alone.
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n]) if n > 1 else np.empty(0, np.int64)
        start[last] = True
        # Contractions.
        at = np.flatnonzero((data[:-1] == 39) & new[:-1] & ~before[:-1] & (c[1:] == 1) & ~edge[1:n]) if n > 1 else np.empty(0, np.int64)
        if len(at):
            longer = np.concatenate([data, np.zeros(2, np.uint8)])
            one, two = longer[at + 1], longer[at + 2]
            taken = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
            pair = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))
            taken = np.where(pair & ~edge[np.minimum(at + 2, n)], 2, taken)
            at, taken = at[taken > 0], taken[taken > 0]
            start[at + 1] = False
            rest = at + 1 + taken
            rest = rest[rest < n]
            start[rest[(c[rest] == 1) & ~edge[rest]]] = True
        return start


class Merges:
    """Byte-pair merges of many words at once, for their number of pieces alone.

    As the library does, a word's pair of the lowest rank, the leftmost of them, is merged first, until
    none is left. Each round merges one pair of every word that has one.
    """

    def __init__(self, model: dict):
        # The published byte alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        vocab = model["vocab"]
        self.byte = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        key, first = np.unique(key, return_index=True)
        self.key = np.append(key, np.iinfo(np.int64).max)
        self.rank = np.append(first, len(pairs))
        self.none = len(pairs)
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [-1], np.int64)

    @staticmethod
    def suits(model: dict) -> bool:
        """Whether the model has no rule but merges."""
        return model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], self.none)

    def count(self, words: list[bytes]) -> np.ndarray:
        size = np.array([len(w) for w in words], np.int64)
        out = size.copy()
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        if len(sym) < 2:
            return out
        rank = np.full(len(sym), self.none, np.int64)  # of the pair that starts here
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank * (1 << 32) + np.arange(len(rank)), head)
            at = best & 0xFFFFFFFF
            found = rank[at] < self.none
            if not found.any():
                break
            at = at[found]
            sym[at] = self.merged[rank[at]]
            out[word[at]] -= 1
            stay = np.ones(len(sym), bool)
            if not found.all():  # words without a pair are done
                stay = np.repeat(found, np.diff(np.append(head, len(sym))))
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, rank, at = sym[stay], word[stay], rank[stay], place[at]
            for i in (at, at[at > 0] - 1):
                j = i[i + 1 < len(sym)]
                rank[i[i + 1 >= len(sym)]] = self.none
                same = word[j] == word[j + 1]
                rank[j] = np.where(same, self.ranks(sym[j], sym[j + 1]), self.none)
        return out


class PieceCounter:
    """Counts tokens of texts for one vocabulary file (.json: tokenizers, .model: sentencepiece).

    Texts in Latin-1 are cut a block at a time; the others, and those with special strings, one by one.
    A vocabulary with other rules than the byte-level pattern needs the library on whole texts. All
    three give the library's counts.
    """

    #: Slots of the table of piece counts that is looked up for whole blocks: two places a pre-token; what finds no place is counted again when it comes again.
    SLOTS = 1 << 20

    def __init__(self, path: str, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.most = most
        self.special = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cut = None
            return
        import json

        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = [t["content"] for t in spec.get("added_tokens", [])]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            self.cut = None  # the library's own rules need the whole text
        else:
            self.cut = LatinCutter()
            self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
            self.merges = Merges(spec["model"]) if Merges.suits(spec["model"]) else None
            self.slots = [(np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32), np.uint64(shift)) for shift in (0, 40)]

    def pieces(self, fresh: list[str]) -> list[int]:
        """Number of pieces of each distinct pre-token."""
        if self.merges:
            return self.merges.count([w.encode() for w in fresh]).tolist()
        return [len(e) for e in self.model.encode_batch(fresh, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if self.cut is None:
            if hasattr(self.model, "encode_batch"):
                return [len(e) for e in self.model.encode_batch(texts, add_special_tokens=False)]
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        out = np.zeros(len(texts), np.int64)
        latin, raw, others = [], [], []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                others.append(i)
                continue
            try:
                raw.append(text.encode("latin-1"))
                latin.append(i)
            except UnicodeEncodeError:
                others.append(i)
        if latin:
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            out[latin] = self.count_latin(np.frombuffer(b"".join(raw), np.uint8), offsets)
        if others:
            out[others] = self.count_others([texts[i] for i in others])
        return out.tolist()

    def count_latin(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block: pre-tokens joined to the numbers of their pieces by hash, summed."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        first = np.flatnonzero(self.cut.starts(data, offsets))
        last = np.append(first[1:], len(data))
        h = K.slice_hash(K.prefix_hash(data), first, last)
        n = np.zeros(len(h), np.int64)
        miss = np.arange(len(h))
        for keys, pieces, shift in self.slots:
            own = ((h[miss] >> shift) & np.uint64(self.SLOTS - 1)).astype(np.int64)
            hit = (keys[own] == h[miss]) & (pieces[own] > 0)
            n[miss[hit]] = pieces[own[hit]]
            miss = miss[~hit]
        if len(miss):
            fresh, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            counted = np.array(self.pieces([data[first[i] : last[i]].tobytes().decode("latin-1") for i in miss[at].tolist()]), np.int64)
            n[miss] = counted[back]
            left = np.arange(len(fresh))
            for way, (keys, pieces, shift) in enumerate(self.slots):
                own = ((fresh[left] >> shift) & np.uint64(self.SLOTS - 1)).astype(np.int64)
                free = pieces[own] == 0 if way == 0 else np.ones(len(own), bool)
                keys[own[free]], pieces[own[free]] = fresh[left[free]], 0
                placed = free & (keys[own] == fresh[left])  # of several with one slot the last is there
                pieces[own[placed]] = counted[left[placed]]
                left = left[~placed]
        sums = np.concatenate([[0], np.cumsum(n)])
        return np.diff(sums[np.searchsorted(first, offsets)])

    def count_others(self, texts: list[str]) -> list[int]:
        """Texts one by one, with the library's own tables for characters beyond Latin-1 and its default for special strings."""
        bags, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            bags.append(Counter(part[a:b] for part in parts for _, (a, b) in self.model.pre_tokenizer.pre_tokenize_str(part)))
        fresh = list(set().union(*bags).difference(self.known))
        if len(self.known) + len(fresh) > self.most:
            self.known.clear()
            fresh = list(set().union(*bags))
        self.known.update(zip(fresh, self.pieces(fresh)))
        known = self.known
        return [n + sum(known[w] * f for w, f in bag.items()) for n, bag in zip(extra, bags)]


def _count_batches(path: str):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(path)
        for block, _, offsets in K.blocks(batches, "t"):
            n = counter.count([x or "" for x in block.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("i"), pa.array(np.diff(offsets)), pa.array(n, pa.int64())], ["i", "b", "n"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per input row, order of columns fixed, other columns ignored.

    Null and empty texts have 0 bytes and 0 tokens; special strings inside texts count as the
    library's default has it (one token each); no special tokens are added, nothing is cut.
    """
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = dict(out.dtypes)["i"]
    return out.mapInArrow(_count_batches(tokenizer), f"i {kind}, b long, n long").select(F.col("i").alias("doc_id"), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: tokens of every whole text with the 50k byte-level vocabulary; over_limit: more than 512."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)
