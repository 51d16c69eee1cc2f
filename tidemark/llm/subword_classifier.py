"""Text classifier on supervised subword embeddings: hashed words and character n-grams have learned vectors, a text is their average, a softmax decides.

A text is read as bytes of UTF-8. Words are runs of anything but ASCII white space. Features are each word, the byte n-grams of NGRAMS lengths within a word and its
borders, a word that stands right after itself (the word pair whose second part is only said to be the same), and one end mark a text. All are hashed into
BUCKETS buckets. Training is stochastic gradient descent in numpy over a bounded sample of labelled texts. Since the output is linear in the average,
a trained model is one number for each bucket and class, and a text's logits are means of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, sliced, trimmed

BUCKETS, WIDTH, NGRAMS = 1 << 16, 16, (2, 3, 4)
#: Labelled texts that are read for training, at most.
TRAIN_DOCS = 6000
EPOCHS, RATE, BATCH, SEED = 6, 0.5, 16, 7
#: Texts are read in pieces of so many bytes, cut at white space; a run of more without any is read as words of this size.
STEP = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
#: How buckets and their counts come to the driver.
PACKED = (np.uint16, np.uint32)
#: Buckets 0 and 1: the end mark, a repeated word.
END, REPEAT, FIRST = 0, 1, 2


def _mixed(code: np.ndarray, salt: int) -> np.ndarray:
    """Buckets of 64-bit codes."""
    code = (code ^ np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(FACTOR)
    return (FIRST + ((code >> np.uint64(32)) * np.uint64(BUCKETS - FIRST) >> np.uint64(32))).astype(np.int32)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """FACTOR to the powers 0 to n-1, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1 << 12), FACTOR, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[:n]


def features(raw: bytes, before: int | None = None, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(buckets, a byte of the word that each feature is of, the code of the last word).

    before: the code of the word that stands before ``raw``, if any. texts: where texts begin, if ``raw`` has several, each after a white space.
    """
    code = np.frombuffer(raw, np.uint8)
    gap = (code == 32) | ((code >= 9) & (code <= 13))
    start = np.flatnonzero(~gap & np.append(True, gap[:-1])[: len(gap)])
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), before
    # A word's code: its bytes times powers by place in the word, summed modulo 2^64.
    begun = np.zeros(len(code), np.int64)
    begun[start] = start
    place = np.arange(len(code)) - np.maximum.accumulate(begun)
    value = np.where(gap, np.uint64(0), (code.astype(np.uint64) + np.uint64(1)) * _powers(len(code))[place])
    word = np.add.reduceat(value, start)
    same = np.append(before is not None and int(word[0]) == before, word[1:] == word[:-1])
    if texts is not None:
        owner = np.searchsorted(texts, start, "right")
        same &= np.append(True, owner[1:] == owner[:-1])
    parts, places = [_mixed(word, 1), np.full(int(same.sum()), REPEAT, np.int32)], [start, start[same]]
    # White space is one sign, so that a word's borders look alike; an n-gram has none inside.
    sign = np.concatenate(([32], np.where(gap, 32, code), [32])).astype(np.uint32)
    blank = sign == 32
    for n in NGRAMS:
        size = len(sign) - n + 1
        if size < 1:
            continue
        whole, inner = np.zeros(size, np.uint32), np.zeros(size, bool)
        for k in range(n):
            whole = whole << np.uint32(8) | sign[k : k + size]
            if 0 < k < n - 1:
                inner |= blank[k : k + size]
        at = np.flatnonzero(~inner & ~(blank[:size] & blank[n - 1 :]))
        parts.append(_mixed(whole[at].astype(np.uint64), n + 1))
        places.append(at - 1 + blank[at])
    return np.concatenate(parts), np.concatenate(places), int(word[-1])


def pieces(text: bytes) -> Iterator[bytes]:
    """The whole text in pieces of at most STEP bytes."""
    at = 0
    while len(text) - at > STEP:
        cut = max(text.rfind(s, at, at + STEP) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        cut = cut + 1 if cut >= at else at + STEP
        yield text[at:cut]
        at = cut
    yield text[at:]


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each is met, the end mark included."""
    total, before = np.zeros(BUCKETS, np.int64), None
    for piece in pieces(text):
        found, _, before = features(piece, before)
        total += np.bincount(found, minlength=BUCKETS)
    total[END] += 1
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


@dataclass(frozen=True)
class Classifier:
    """labels in order; table: for each bucket and label what it adds to the label's logit."""

    labels: tuple
    table: np.ndarray

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """For each text and label the mean over the text's features."""
        out, weight = np.tile(self.table[END].astype(np.float64), (len(texts), 1)), np.ones(len(texts))
        short = [i for i, t in enumerate(texts) if len(t) <= STEP]
        if short:
            sizes = np.array([len(texts[i]) + 1 for i in short])
            starts = np.cumsum(sizes) - sizes
            found, place, _ = features(b"\n".join(texts[i] for i in short), texts=starts)
            owner = np.searchsorted(starts, place, "right") - 1
            rows = np.array(short)
            weight[rows] += np.bincount(owner, minlength=len(short))
            for c in range(len(self.labels)):
                out[rows, c] += np.bincount(owner, self.table[found, c], len(short))
        for i, text in enumerate(texts):
            if len(text) > STEP:
                at, n = counted(text)
                weight[i], out[i] = n.sum(), n @ self.table[at].astype(np.float64)
        return out / weight[:, None]

    def chances(self, texts: list[bytes]) -> np.ndarray:
        """For each text and label its probability."""
        found = self.logits(texts)
        grown = np.exp(found - found.max(axis=1, keepdims=True))
        return grown / grown.sum(axis=1, keepdims=True)


def trained(rows: list[tuple[np.ndarray, np.ndarray]], labels: list, seed: int = SEED, epochs: int = EPOCHS, rate: float = RATE) -> Classifier:
    """Vectors and softmax by stochastic gradient descent over (buckets, counts), BATCH texts a step, at a rate that falls to 0."""
    names = tuple(sorted(set(labels)))
    y = np.searchsorted(np.array(names), np.array(labels))
    rng = np.random.default_rng(seed)
    vectors, output = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((len(names), WIDTH), np.float32)
    shares = [(n / n.sum()).astype(np.float32) for _, n in rows]
    total, done = epochs * len(rows), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch, now = order[at : at + BATCH], rate * (1 - done / total)
            hidden = np.stack([shares[i] @ vectors[rows[i][0]] for i in batch])
            logit = hidden @ output.T
            grown = np.exp(logit - logit.max(axis=1, keepdims=True))
            error = grown / grown.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), y[batch]] -= 1
            back = error @ output
            # Both steps are normalised: the longer the other factor, the shorter the step, lest they drive each other up.
            output -= now / (1 + float((hidden**2).sum(axis=1).mean())) * error.T @ hidden
            step = now / (1 + float((output**2).sum()))
            for i, g in zip(batch, back, strict=True):
                # Each feature moves by its share, so far that the text's mean moves by the step times its gradient.
                vectors[rows[i][0]] -= np.outer(shares[i] * (step / (shares[i] @ shares[i])), g)
            done += len(batch)
    return Classifier(names, (vectors @ output.T).astype(np.float32))


def _as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Classifier | None:
    """A classifier from the ``labels`` (id, label) of ``docs``, or None if there is no label.

    Of the ids that have one label, the ``train_docs`` first by a hash of the id are read, whole texts; ids that are null or have labels that differ are left out, a null
    text is empty, and of texts that share an id one is taken. What comes to the driver are the sampled texts' buckets and counts: at most BUCKETS pairs for each of ``train_docs`` texts.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    own = own.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")
    drawn = F.broadcast(own.orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(train_docs))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(drawn, "id")
    texts = texts.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            found = [counted(t) for t in _as_bytes(batch.column(2))]
            packed = [pa.array([x[k].astype(kind).tobytes() for x in found], pa.binary()) for k, kind in enumerate(PACKED)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["id", "label", "bucket", "n"])

    schema = T.StructType([*texts.schema.fields[:2], *[T.StructField(c, T.BinaryType()) for c in ("bucket", "n")]])
    table = texts.mapInArrow(trimmed(run), schema).toArrow()
    if not len(table):
        return None
    order = pc.sort_indices(table.column("id")).to_pylist()
    packed = [table.column(c) for c in ("bucket", "n")]
    rows = [tuple(np.frombuffer(column[i].as_buffer(), kind) for column, kind in zip(packed, PACKED, strict=True)) for i in order]
    labels_of = table.column("label").to_pylist()
    return trained(rows, [labels_of[i] for i in order])


def classify(docs: DataFrame, model: Classifier | None, label, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of ``label``; all rows and columns stay. Null texts are empty, empty ones have their end mark only. Without a model, or for a label
    that it doesn't have, the probability is 0.5 or 0. ``name`` must be new to the table."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists already")
    at, column = docs.columns.index(text_col), fresh(docs, "score")[0]
    where = model.labels.index(label) if model and label in model.labels else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            if where is None:
                score = np.full(len(batch), 0.0 if model else 0.5)
            else:
                score = model.chances(_as_bytes(batch.column(at)))[:, where]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(trimmed(run), schema).withColumnRenamed(column, name)
