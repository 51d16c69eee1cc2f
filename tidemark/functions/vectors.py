"""Vectors as arrays of doubles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bigram_codes, pair_of, solid, text_terms

DIMENSIONS = 32


def dot(a: Column, b: Column) -> Column:
    """0 where lengths differ."""
    total = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


#: Features whose hashes a worker keeps, and bytes of texts and terms that are unpacked at once.
KEPT, SLICE = 1 << 18, 1 << 22


def _hashed(feature: str, dimensions: int) -> tuple[int, float]:
    """Where a feature counts, and with which sign."""
    digest = hashlib.sha256(feature.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(digest[:4], "big") % dimensions, 1.0 if digest[4] % 2 == 0 else -1.0


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed feature hashing of terms and of bigrams, of length 1 (or 0 without features). A term that is a bigram counts as both.

    Words are found by Spark; pairs and hashes in Arrow batches, a feature's hash once while a worker keeps it.
    """

    held: dict[int | str, tuple[int, float]] = {}

    def counted(lists: list[np.ndarray], name) -> np.ndarray:
        """The signed counts of a batch's features, a row a text; each different one is looked up once."""
        if len(held) > KEPT:
            held.clear()
        every, back = (lambda u: (u[1], u[0]))(pd.factorize(np.concatenate([np.zeros(0, lists[0].dtype), *lists])))
        spots = [held.get(f) or held.setdefault(f, _hashed(name(f), dimensions)) for f in every.tolist()]
        at, sign = (np.array(x) for x in zip(*spots, strict=True)) if spots else (np.zeros(0, np.int64), np.zeros(0))
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return np.bincount(row * dimensions + at.astype(np.int64)[back], sign[back], len(lists) * dimensions).astype(float).reshape(-1, dimensions)

    def sums(texts: pa.Array, terms: pa.Array) -> np.ndarray:
        words = [np.asarray(w, object) for w in terms.to_pylist()]
        found = counted([bigram_codes(t) for t in texts.to_pylist()], pair_of) + counted(words, str)
        norm = np.sqrt((found * found).sum(axis=1, keepdims=True))
        return np.divide(found, norm, out=found, where=norm > 0)

    def run(texts: pa.Array, terms: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.list_(pa.float64()))
        # Cuts by running size, so that objects are made of a slice and not of the whole Arrow batch.
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), len(texts)]
        made = np.concatenate([sums(texts[lo:hi], terms[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * dimensions, pa.int32()), pa.array(made.ravel()))

    return F.arrow_udf(run, "array<double>")(solid(text), text_terms(text))
