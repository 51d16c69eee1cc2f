"""Byte-level BPE encoding and decoding by ranked merges.

Texts fall into pre-tokens; only distinct ones are encoded, all new ones of a batch at once: their bytes are symbols of one long
array, and each step merges in every word the first of its adjacent pairs that has the least rank, until no pair has one. Words are
kept by the Python worker up to a bounded number. Decoding concatenates the byte pieces of the ids. No shuffle is needed.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import sliced, trimmed
from tidemark.llm.pretokens import coded

#: Bytes of a word beyond which a heap takes over; text of a batch; words that a worker keeps.
LONG, BATCH_BYTES, WORDS = 64, 2 << 20, 200_000
NONE = np.int32((1 << 31) - 1)


def read_ranks(content: str) -> dict[bytes, int]:
    """Ranks from a file's lines: a token in base64, a space, its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(str.split, content.splitlines())}


class Merges:
    """The rank of each pair of tokens that a token consists of, in an open-addressing table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        key, value = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        #: Pairs of single bytes have a table of their own, small enough to stay in a CPU's cache.
        self.byte_of = np.full(int(max(ranks.values(), default=0)) + 1, -1, np.int32)
        self.byte_of[self.bytes] = np.arange(256)
        left, right = self.byte_of[key >> 32], self.byte_of[key & 0xFFFFFFFF]
        self.first = np.full(1 << 16, NONE, np.int32)
        plain = (left >= 0) & (right >= 0)
        self.first[left[plain] << 8 | right[plain]] = value[plain]
        self.bits = max(4, len(pairs).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = key[free]
            lost = self.keys[slot] != key
            self.values[slot[~lost]] = value[~lost]
            key, value, slot = key[lost], value[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for one that no token consists of."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            slot = (slot[open_] if len(slot) == len(key) else slot) + 1 & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == key[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            open_, slot = open_[on], slot[on]
        return out

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        out: list = [(self.ranks[w],) if w in self.ranks else None for w in words]
        for i, w in enumerate(words):
            if out[i] is None and len(w) > LONG:
                out[i] = self._long(w)
        todo = [i for i, x in enumerate(out) if x is None and words[i]]
        if todo:
            for i, ids in zip(todo, self._short([words[i] for i in todo]), strict=True):
                out[i] = ids
        return [x or () for x in out]

    def _short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """All words at once; ranks of pairs are kept and looked up anew only beside a merge."""
        out: list = [None] * len(words)
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        symbol, owner = self.bytes[raw].astype(np.int32), np.repeat(np.arange(len(words), dtype=np.int32), size)
        pair = np.full(len(raw), NONE, np.int32)
        pair[:-1] = self.first[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        first = np.cumsum(size) - size
        pair[first + size - 1] = NONE
        while len(symbol):
            least = np.minimum.reduceat(pair, first)
            ended = least == NONE
            wide = np.repeat(least, size)
            if ended.any():
                gone = np.repeat(ended, size)
                flat, at = symbol[gone].tolist(), 0
                for w, n in zip(owner[first[ended]].tolist(), size[ended].tolist(), strict=True):
                    out[w] = tuple(flat[at : at + n])
                    at += n
                keep = ~gone
                symbol, owner, pair, wide, size = symbol[keep], owner[keep], pair[keep], wide[keep], size[~ended]
                if not len(symbol):
                    break
                first = np.cumsum(size) - size
            hit = np.flatnonzero(pair == wide)
            hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]
            symbol[hit] = pair[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, owner, pair = symbol[stay], owner[stay], pair[stay]
            hit = hit - np.arange(len(hit))
            size = size - 1
            first = np.cumsum(size) - size
            ends = np.append(owner[1:] != owner[:-1], True)
            for at in (hit, hit[hit > 0] - 1):
                open_ = at[~ends[at]]
                pair[at] = NONE
                pair[open_] = self.rank(symbol[open_], symbol[open_ + 1])
        return out

    def _long(self, word: bytes) -> tuple[int, ...]:
        symbol, after = self.bytes[np.frombuffer(word, np.uint8)].tolist(), list(range(1, len(word) + 1))
        before, known = list(range(-1, len(word) - 1)), self.table
        heap = [(r, i) for i in range(len(word) - 1) if (r := known.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= len(word) or known.get((symbol[i], symbol[j])) != r:
                continue
            symbol[i], symbol[j] = r, -1
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(word) and (r := known.get((symbol[a], symbol[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return tuple(s for s in symbol if s >= 0)

    @property
    def table(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_table"):
            held = self.keys >= 0
            self._table = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(v) for k, v in zip(self.keys[held].tolist(), self.values[held].tolist(), strict=True)}
        return self._table


class WordCache:
    """The ids of words, kept in two generations: what was asked lately stays when the older one goes."""

    def __init__(self, encode, most: int = WORDS):
        self.encode, self.most = encode, most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def lookup(self, words: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at all places, one after the other, and how many each has. words: distinct."""
        young, old = self.young, self.old
        parts = list(map(young.get, words))
        wait = []
        for i in [i for i, x in enumerate(parts) if x is None]:
            held = old.get(words[i])
            if held is None:
                wait.append(i)
            else:
                parts[i] = young[words[i]] = held
        for i, ids in zip(wait, self.encode([words[i] for i in wait]) if wait else (), strict=True):
            parts[i] = young[words[i]] = array("i", ids).tobytes()
        if len(young) > self.most // 2:
            self.young, self.old = {}, young
        ids = np.frombuffer(b"".join(parts), np.int32)
        own = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first, size = np.cumsum(own) - own, own[places]
        total = np.cumsum(size)
        at = np.repeat(first[places] - total + size, size) + np.arange(total[-1] if len(total) else 0)
        return ids[at], size


def text_ids(texts: list[bytes], cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and how many each has."""
    words, places, counts = coded(texts)
    ids, size = cache.lookup(words, places)
    ends = np.append(0, np.cumsum(size))
    text_ends = np.cumsum(counts)
    return ids, ends[text_ends] - ends[text_ends - counts]


@lru_cache(maxsize=2)
def _cache(content: str) -> WordCache:
    merges = Merges(read_ranks(content))
    return WordCache(merges.encode)


@lru_cache(maxsize=2)
def _pieces(content: str) -> pa.Array:
    """The bytes of each id."""
    ranks = read_ranks(content)
    out: list = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def joined(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The pieces of each list, put together; null for a null list."""
    each = pieces.take(ids.flatten())
    if each.null_count:
        raise ValueError("an id is not in the vocabulary")
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))
    bytes_at = np.append(0, np.cumsum(pc.binary_length(each).to_numpy()))[ends]
    out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bytes_at.astype(np.int32)), each.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.binary())) if ids.null_count else out


def encode(docs: DataFrame, ranks: str, text_col: str = "text", name: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text; all its columns and rows stay. ranks: the content of a rank file.

    Null and empty texts have no ids. Special tokens are ordinary text. With ``decoded``, a column of that name has the bytes that the ids
    decode to. Both names must be new to the table.
    """
    more = [name, *[decoded] * (decoded is not None)]
    if set(more) & set(docs.columns) or len(set(more)) < len(more):
        raise ValueError(f"columns {more} exist already")
    at, held = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pieces = _cache(held.value), _pieces(held.value)
        for rows in sliced(batches, at, BATCH_BYTES):
            flat, size = text_ids([t or b"" for t in rows.column(at).cast(pa.binary()).to_pylist()], cache)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat))
            columns = [ids] if decoded is None else [ids, joined(ids, pieces)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *more])

    kinds = [T.StructField(name, T.ArrayType(T.IntegerType())), T.StructField(decoded or "", T.BinaryType())][: len(more)]
    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, *kinds]))


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids; null ids give null, an unknown id is an error."""
    if name in encoded.columns:
        raise ValueError(f"column {name} exists already")
    at, held = encoded.columns.index(ids_col), encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(held.value)
        for part in sliced(batches, at, BATCH_BYTES // 4):
            yield pa.RecordBatch.from_arrays([*part.columns, joined(part.column(at), pieces)], names=[*part.schema.names, name])

    return encoded.mapInArrow(trimmed(run), T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())]))
