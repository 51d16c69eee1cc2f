"""Language-model scoring by deleted interpolation.

P(word | previous) mixes the maximum-likelihood bigram, unigram and uniform estimates. The weights depend on the frequency bucket
(power of two) of the previous word and are learned by expectation-maximisation: a part of the training texts is deleted from
the counts, and the weights that make it likeliest are those of the bucket. The final counts are of all training texts.

Texts are read once, after a scan that counts their bytes, into a table of blocks that hold word places and word hashes. A block sends the distinct words and bigrams it
has, as sorted packed 64-bit hashes with its own training counts, to buckets that add up the counts of the corpus and send them back; it then
scores its texts. So the shuffle holds each distinct n-gram of a block once, a frequent one is a row of each block and no hot
key, and no task holds a vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, sliced, trimmed
from tidemark.llm.exchange import BLOCK_BYTES, KINDS, NAMES, SENT, Form, exchanged, pack, place_of, planned, unpack
from tidemark.llm.shingle_join import mix

END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
KEPT, DELETED, UNUSED = 0, 1, 2
#: One training text in so many is deleted to learn the weights; steps of a halving in which EM's table holds estimates.
DELETE, STEPS, ROUNDS, LEAST = 8, 16, 60, 1e-6


def _bigrams(words: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the place of its context and the hash of the bigram. hashes: of words, then of END; START is the place after."""
    context = np.empty_like(words)
    context[1:] = words[:-1]
    context[np.cumsum(lengths) - lengths] = len(hashes)
    every = np.append(hashes, START)
    return context, mix(mix(every[context] + np.uint64(1)) + every[words])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bucket below 0, ids, hashes of words and END, places of all tokens, lengths and roles)."""
    from pyspark import TaskContext

    part, number, rows, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal number, rows, size
        ids, roles, texts = map(list, zip(*rows, strict=True))
        key, number, rows, size = part << 20 | number, number + 1, [], 0
        place: dict[bytes, int] = {}
        seqs = [[place.setdefault(w, len(place)) for w in text.lower().split()] for text in texts]
        hashes = np.array([*map(xxhash.xxh3_64_intdigest, place), int(END)], np.uint64)
        words = np.array([x for s in seqs for x in (*s, len(place))], np.int32)
        # Frequent words have small places, whose bytes pack better.
        order = np.argsort(-np.bincount(words, minlength=len(hashes))[:-1], kind="stable")
        new = np.empty(len(hashes), np.int32)
        new[np.append(order, len(place))] = np.arange(len(hashes))
        hashes = hashes[np.append(order, len(place))]
        tail = np.array([*(len(s) + 1 for s in seqs), *roles], np.int32)
        row = (key, -1 - key % (1 << 30), ids, pack(hashes), pack(new[words]), pack(tail))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, KINDS, strict=True)], names=NAMES)

    for batch in sliced(batches, 2):
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            rows.append((row[0], row[1], row[2] or b""))
            size += len(rows[-1][2])
            if size >= 2 * BLOCK_BYTES or len(rows) >= 20_000:
                yield flush()
    if rows:
        yield flush()


def _send(buckets: int):
    """Per bucket a block's distinct words or bigrams with its counts of kept and of deleted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("block", "a", "b", "c")), strict=True):
                hashes, words = unpack(a, np.uint64), unpack(b, np.int32)
                lengths, roles = np.split(unpack(c, np.int32), 2)
                role, rows = np.repeat(roles, lengths), []
                grams = _bigrams(words, lengths, hashes)[1]
                for level, (token, back) in enumerate((_ordered(hashes, words), np.unique(grams, return_inverse=True))):
                    count = [np.bincount(back[role == r], minlength=len(token)).astype(np.uint32) for r in (KEPT, DELETED)]
                    cut = np.searchsorted(place_of(token, buckets), np.arange(buckets + 1, dtype=np.uint64))
                    rows += [(key, 2 * k + level, None, pack(token[lo:hi]), pack(count[0][lo:hi]), pack(count[1][lo:hi])) for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if lo < hi]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    return run


def _ordered(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and the place of each token's word among them."""
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[order], rank[words]


def _total(table: pa.Table) -> pa.Table:
    """One bucket of words or bigrams: the corpus counts of each block's n-grams, and of words a row of sums."""
    bucket = table.column("bucket")[0].as_py()
    token = [unpack(x, np.uint64) for x in table.column("a").to_pylist()]
    every, back = np.unique(np.concatenate(token), return_inverse=True)
    own = [np.concatenate([unpack(x, np.uint32) for x in table.column(c).to_pylist()]) for c in "bc"]
    kept, deleted = (np.bincount(back, x, len(every)).astype(np.uint64) for x in own)
    both, ends = kept + deleted, np.cumsum([0, *map(len, token)])
    blocks, spans = table.column("block").to_pylist(), list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    if "who" in table.column_names:
        rows = [(key, bucket, None, pack(both[back[lo:hi]]), pack(kept[back[lo:hi]]), pack(own[1][lo:hi] > 0), who) for key, (lo, hi), who in zip(blocks, spans, table.column("who").to_pylist(), strict=True)]
    else:
        rows = [(key, bucket, None, *_closed(both[back[lo:hi]], kept[back[lo:hi]], own[1][lo:hi] > 0)) for key, (lo, hi) in zip(blocks, spans, strict=True)]
    if bucket % 2 == 0:
        rows.append((-1, bucket, [int(kept.sum()), int(deleted.sum()), int((kept > 0).sum()), int((both > 0).sum())], *[None] * (len(rows[0]) - 3)))
    names, kinds = [*NAMES, "who"][: len(rows[0])], [*KINDS, pa.binary()][: len(rows[0])]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _closed(both: np.ndarray, kept: np.ndarray, mask: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Counts without the deleted texts are wanted only for what a block's own deleted texts have."""
    return pack(both), pack(kept[mask]), pack(mask)


FORM = Form(((np.uint64, np.uint32, np.uint32),) * 2, ((np.uint64, np.uint64, bool),) * 2, _closed)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 more than the power of two of its count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _steps(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-STEPS * np.log2(np.where(p > 0, p, 1))), -1).astype(np.int64)


def _join(kept_tokens: int):
    """One block: its texts with the counts of every token; and, of deleted texts, a table of (bucket, estimates) with counts."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "ids", "a", "b", "c")), strict=True), key=lambda r: r[0])
        head = rows[0]
        hashes, words, tail = unpack(head[2], np.uint64), unpack(head[3], np.int32), unpack(head[4], np.int32)
        lengths, roles = np.split(tail, 2)
        counts = []
        for level in (0, 1):
            own = [r for r in rows[1:] if r[0] % 2 == level]
            both, mask = (np.concatenate([unpack(r[k], t) for r in own]) for k, t in ((2, np.uint64), (4, bool)))
            kept = np.zeros(len(both), np.uint64)
            kept[mask] = np.concatenate([unpack(r[3], np.uint64) for r in own])
            counts.append([both, kept])
        context, grams = _bigrams(words, lengths, hashes)
        back = np.unique(grams, return_inverse=True)[1]
        order = np.argsort(hashes)
        one = [np.empty(len(order), np.uint64) for _ in range(2)]
        for k in range(2):
            one[k][order] = counts[0][k]
        # START stands before each text as END stands after it. A context that no deleted text has as a word has no deleted bigram.
        before = np.where(context == len(hashes), len(hashes) - 1, context)
        deleted = np.repeat(roles == DELETED, lengths)
        c1, ch, c2 = (x.astype(np.float64) for x in (one[1][words[deleted]], one[1][before[deleted]], counts[1][1][back[deleted]]))
        cells = np.stack((context_bucket(ch), _steps(c2 / np.maximum(ch, 1)), _steps(c1 / max(1, kept_tokens))))
        cells, n = np.unique(cells, axis=1, return_counts=True)
        flat = [*cells.ravel().tolist(), *n.tolist()]
        out = ([head[1]], [head[3]], [head[4]], [pack(one[0])], [pack(counts[1][0][back])], [flat])
        kinds = [KINDS[2], *[pa.binary()] * 4, pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["ids", "words", "texts", "one", "two", "cells"])

    return run


def learn_weights(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """EM. cells: columns bucket, steps of the bigram and of the unigram estimate (-1: zero), count. Rows of the result, by bucket: bigram, unigram, uniform."""
    out = np.full((66, 3), 1 / 3)
    if not len(cells):
        return out
    p = np.stack([np.where(cells[:, k] >= 0, 2.0 ** (-np.maximum(cells[:, k], 0) / STEPS), 0.0) for k in (1, 2)] + [np.full(len(cells), 1.0 / (vocabulary + 1))], axis=1)
    seen = np.zeros(66, bool)
    for b in np.unique(cells[:, 0]):
        own, n = p[cells[:, 0] == b], cells[cells[:, 0] == b, 3]
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            part = own * w
            w = (n[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
        out[b], seen[b] = w, True
    for b in range(1, 66):  # a bucket without deleted tokens is as the one below
        if not seen[b]:
            out[b] = out[b - 1]
    out = np.maximum(out, LEAST)
    return out / out.sum(axis=1, keepdims=True)


def _score(weights: np.ndarray, tokens: int, vocabulary: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, places, texts, one, two in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                lengths, roles = np.split(unpack(texts, np.int32), 2)
                words, one = unpack(places, np.int32), unpack(one, np.uint64).astype(np.float64)
                before = np.append(len(one) - 1, words[:-1])
                c1, ch, c2 = one[words], one[before], unpack(two, np.uint64).astype(np.float64)
                w = weights[context_bucket(ch)]
                p = w[:, 0] * c2 / np.maximum(ch, 1) + w[:, 1] * c1 / max(1, tokens) + w[:, 2] / (vocabulary + 1)
                base = np.log10((c1 + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                first = np.cumsum(lengths) - lengths
                cols = [pa.array(ids, pa.int64()), pa.array(roles == UNUSED), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), first)), pa.array([tokens] * len(ids), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``trains``: a condition on a row that says whether the counts take it; null is false. Tokens: words after lower-casing A-Z, then an end, which
    is all that null and empty texts have. base_score: log10 probability under add-half unigrams; score: under the model. Rows that
    repeat an id each count. Without training rows every estimate is the uniform one. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    plan = planned(docs, text_col)
    deleted = F.pmod(F.xxhash64(F.lit("deleted"), F.col(id_col)), F.lit(DELETE)) == 0
    role = F.when(F.coalesce(trains, F.lit(False)), F.when(deleted, DELETED).otherwise(KEPT)).otherwise(UNUSED)
    sent = docs.select(F.col(id_col).cast("long"), role.cast("int"), F.col(text_col)).mapInArrow(trimmed(_blocks), SENT)
    blocks = scratch.save(sent, "blocks")
    got = scratch.save(exchanged(blocks.mapInArrow(trimmed(_send(plan.first)), SENT), _total, plan, FORM, scratch, heads=False), "counted", large=True)
    sums = got.where("block = -1").agg(*[F.coalesce(F.sum(F.col("ids")[k]), F.lit(0)).alias(f"s{k}") for k in range(4)]).first()
    tokens, kept_words, words = sums["s0"] + sums["s1"], sums["s2"], sums["s3"]

    shape = "ids array<long>, words binary, texts binary, one binary, two binary, cells array<long>"
    joined = scratch.save(blocks.unionByName(got.where("block >= 0")).groupBy("block").applyInArrow(_join(sums["s0"]), shape), "joined", large=True)
    scratch.drop("blocks", "counted")
    quarter = F.size("cells") / 4
    cell = F.transform(F.sequence(F.lit(0), quarter.cast("int") - 1), lambda i: F.struct(*[F.get("cells", (i + k * quarter).cast("int")).alias(f"c{k}") for k in range(4)]))
    cells = joined.where("size(cells) > 0").select(F.explode(cell).alias("x")).groupBy("x.c0", "x.c1", "x.c2").agg(F.sum("x.c3").alias("n"))
    # At most 66 buckets by two estimates in steps of a sixteenth of a halving, however large the corpus.
    table = np.array([tuple(r) for r in cells.collect()], np.int64).reshape(-1, 4)
    weights = learn_weights(table[np.lexsort(table.T)] if len(table) else table, kept_words)
    if not tokens:
        weights[:] = 0.0, 0.0, 1.0
    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.select("ids", "words", "texts", "one", "two").mapInArrow(trimmed(_score(weights, tokens, words, id_col)), schema)
