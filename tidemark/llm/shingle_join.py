"""N-gram Jaccard join by several global orders.

Two sets with Jaccard t or more share a token within the first n - ceil(t n) + 1 tokens of each, under any global order.
Here a candidate must do so under every one of ORDERS orders; what is left is verified by exact intersection. Every order puts rare tokens
first, by the power of two of their document frequency, and differs in how it arranges tokens alike in frequency.

Texts are read once, after a scan that counts their bytes. A token that only one set has can be in no intersection, so each block of documents sends its
token hashes, sorted and packed, to buckets that count them, and gets back the shared ones. Sets of which too
few tokens are shared end there. Equal sets are one node. The rest meet by the tokens of their first prefix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.clusters import BROADCAST, LABEL_BYTES, cluster
from tidemark.llm.common import Scratch, sliced, spared, trimmed
from tidemark.llm.exchange import BLOCK_BYTES, KINDS, NAMES, SENT, Form, exchanged, pack, place_of, planned, unpack

WORDS, PERCENT, ORDERS = 5, 80, 3
#: Bits of a set's bitmap.
BITS = 512
#: Tokens of a bucket that are counted at once.
COUNTED = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles. Word hashes are kept between texts, up to a bounded number."""

    def __init__(self, words: int = WORDS, most: int = 200_000):
        self.words, self.most, self.held = words, most, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        held, out = self.held, []
        if len(held) > self.most:
            held.clear()
        for w in words:
            h = held.get(w)
            if h is None:
                h = held[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        h = np.array(out, np.uint64)
        k = min(self.words, len(h))
        code = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            code = mix(code + h[i : len(h) - k + 1 + i])
        return np.unique(code)


def _send(buckets: int, words: int):
    """Per block a row of its documents (bucket below 0) and for each bucket the block's distinct tokens, each with its set's place."""

    def block(key: int, docs: list[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        prints = [xxhash.xxh3_128_digest(s.tobytes()) for _, s in docs]
        place: dict[bytes, int] = {}
        at = [place.setdefault(p, len(place)) if len(s) else -1 for p, (_, s) in zip(prints, docs, strict=True)]
        own = {a: s for a, (_, s) in zip(at, docs, strict=True) if a >= 0}
        sizes = np.array([len(own[a]) for a in range(len(own))], np.int32)
        head = pa.array([d for d, _ in docs], pa.int64()), b"".join(prints), np.array([len(s) for _, s in docs], np.int32)
        yield key, -1 - key % (1 << 30), head[0].to_pylist(), head[1], head[2].tobytes(), np.array(at, np.int32).tobytes()
        if not own:
            return
        token = np.concatenate([own[a] for a in range(len(own))])
        owner = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        bucket = place_of(token, buckets)
        order = np.argsort(token, kind="stable")
        token, owner, bucket = token[order], owner[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            lo, hi = cut[b], cut[b + 1]
            if lo < hi:
                yield key, b, None, pack(token[lo:hi]), pack(owner[lo:hi]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, docs, size, number = Shingler(words), [], 0, 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal docs, size, number
            rows = list(block(part << 20 | number, docs))
            docs, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

        for batch in sliced(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                docs.append((doc, shingles(text)))
                size += len(text or b"")
                if size >= BLOCK_BYTES or len(docs) >= 20_000:
                    yield flush()
        if docs:
            yield flush()

    return trimmed(run)


def _count(table: pa.Table) -> pa.Table:
    """One bucket: each block gets the tokens that more than one set has, with the power of two of their frequency. Tokens are counted a range after the other."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    tokens = [unpack(x, np.uint64) for x in table.column("a").to_pylist()]
    low, high = int(min(t[0] for t in tokens)), int(max(t[-1] for t in tokens))
    parts = -(-sum(map(len, tokens)) // COUNTED)
    bounds = np.array([low + (high - low) * k // parts for k in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(t, bounds).tolist(), len(t)] for t in tokens]
    power = [np.zeros(len(t), np.uint8) for t in tokens]
    for k in range(parts):
        pieces = [t[c[k] : c[k + 1]] for t, c in zip(tokens, cuts, strict=True)]
        _, back, n = np.unique(np.concatenate(pieces), return_inverse=True, return_counts=True)
        found = np.minimum(255, np.log2(n)).astype(np.uint8)[back]
        for p, c, piece in zip(power, cuts, np.split(found, np.cumsum([len(x) for x in pieces])[:-1]), strict=True):
            p[c[k] : c[k + 1]] = piece
    rows = []
    whose = table.column("who").to_pylist() if "who" in table.column_names else None
    for i, owner in enumerate(table.column("b").to_pylist()):
        keep = power[i] > 0
        if keep.any():
            row = (table.column("block")[i].as_py(), table.column("bucket")[i].as_py(), None)
            kept = tokens[i][keep], unpack(owner, np.int32)[keep], power[i][keep]
            rows.append((*row, *_closed(*kept)) if whose is None else (*row, *map(pack, kept), pack(unpack(whose[i], np.int64)[keep])))
    names, kinds = (NAMES, KINDS) if whose is None else ([*NAMES, "who"], [*KINDS, pa.binary()])
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _closed(token: np.ndarray, owner: np.ndarray, power: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return pack(token), pack(owner), power.tobytes()


FORM = Form(((np.uint64, np.int32, None),), ((np.uint64, np.int32, np.uint8),), _closed)


def differing(a: dict, b: dict) -> Column:
    """In how many bits two bitmaps, each in BITS // 64 columns, differ."""
    total = F.lit(0)
    for k in range(BITS // 64):
        total = total + F.bit_count(a[f"bits{k}"].bitwiseXOR(b[f"bits{k}"]))
    return total


def _enough(size: int, percent: int) -> int:
    """Least intersection that a set of this size needs with any partner."""
    return -(-percent * size // 100)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of the tokens that hash to it: two bitmaps differ in no more bits than their sets do in tokens."""
    odd = np.bincount((mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _gather(percent: int, orders: int):
    """One block: its sets whose shared tokens suffice, with prefixes under each order."""

    def run(table: pa.Table) -> pa.Table:
        names = ["print", "n", "tokens", "bits", *(f"prefix{k}" for k in range(orders))]
        kinds = [pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * (2 + orders)]
        rows = []
        heads = [i for i, x in enumerate(table.column("bucket").to_pylist()) if x < 0]
        rest = [i for i, x in enumerate(table.column("bucket").to_pylist()) if x >= 0]
        if heads and rest:
            prints, at = table.column("a")[heads[0]].as_py(), np.frombuffer(table.column("c")[heads[0]].as_py(), np.int32)
            sizes = np.frombuffer(table.column("b")[heads[0]].as_py(), np.int32)
            cols = [table.column(c).take(pa.array(rest)).to_pylist() for c in "abc"]
            token = np.concatenate([unpack(x, np.uint64) for x in cols[0]])
            owner = np.concatenate([unpack(x, np.int32) for x in cols[1]])
            power = np.concatenate([np.frombuffer(x, np.uint8) for x in cols[2]])
            order = np.lexsort((token, owner))
            token, owner, power = token[order], owner[order], power[order]
            cut = np.searchsorted(owner, np.arange(int(at.max()) + 2))
            first = {a: i for i, a in reversed(list(enumerate(at.tolist())))}
            for a, i in first.items():
                if a < 0:
                    continue
                mine, df, n = token[cut[a] : cut[a + 1]], power[cut[a] : cut[a + 1]], int(sizes[i])
                if len(mine) < _enough(n, percent):
                    continue
                # Tokens of this set alone come first under every order.
                reach = n - _enough(n, percent) + 1 - (n - len(mine))
                by = [mine[np.lexsort((mix(mine + np.uint64(977 * k + 1)), df))][: max(0, reach)] for k in range(orders)]
                rows.append((prints[16 * i : 16 * i + 16], n, *(x.view(np.int64).tolist() for x in (mine, bitmap(mine), *by))))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return run


def _exact(percent: int):
    def run(frame: pd.DataFrame) -> pd.Series:
        same = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(frame["x"], frame["y"], strict=True)]
        return pd.Series([100 * s >= percent * (n + m - s) for s, n, m in zip(same, frame["n"], frame["m"], strict=True)], dtype=bool)

    return run


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    A document's set: its distinct shingles of ``words`` words after lower-casing A-Z, or of all its words if it has fewer.
    Two documents link when 100 * intersection >= percent * union; component_id is the smallest id that links reach. Null, empty and blank
    texts have no set and link with nothing. Shingles are compared by 64-bit hashes, sets by 128-bit ones. Rows that repeat an id
    stay rows of their own, each in the component of its own text; rows without an id link too, but have no component_id. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shingles")
    plan = planned(docs, text_col)
    sent = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_send(plan.first, words), SENT)
    got = scratch.save(exchanged(sent, spared(_count), plan, FORM, scratch, heads=True), "counted", large=True)
    scratch.drop("sent")

    heads = got.where("bucket < 0").select("ids", "a", "b")
    schema = "id long, n int, print binary"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, prints, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = [prints[i : i + 16] for i in range(0, len(prints), 16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(sizes, np.int32)), pa.array(own, pa.binary())], names=["id", "n", "print"])

    thin = scratch.save(heads.mapInArrow(spread, schema), "thin")
    # A node is a set, whatever ids its rows have; its number stays as the table is written.
    equal = thin.where("n > 0").groupBy("print").agg(F.min("id").alias("first_id"))
    equal = scratch.save(equal.withColumn("node", F.monotonically_increasing_id()), "equal")

    lists = ", ".join(f"prefix{k} array<long>" for k in range(orders))
    sets = got.select(*NAMES).groupBy("block").applyInArrow(spared(_gather(percent, orders)), f"print binary, n int, tokens array<long>, bits array<long>, {lists}")
    sets = sets.dropDuplicates(["print"]).join(equal.select("print", F.col("node").alias("id")), "print").drop("print")
    sets = scratch.save(sets, "sets", large=True)
    scratch.drop("counted")

    def verify(pairs: DataFrame) -> DataFrame:
        def both(part: list[str]) -> DataFrame:
            x = sets.select(F.col("id").alias("a"), *[F.col(c).alias(f"x_{c}") for c in part])
            y = sets.select(F.col("id").alias("b"), *[F.col(c).alias(f"y_{c}") for c in part])
            return x, y

        # The other orders are intersected on prefixes alone, before whole sets travel.
        x, y = both([f"prefix{k}" for k in range(1, orders)])
        for k, side in (("a", x), ("b", y)):
            pairs = pairs.join(side, k)
        passed = F.lit(True)
        for k in range(1, orders):
            passed = passed & F.arrays_overlap(f"x_prefix{k}", f"y_prefix{k}")
        pairs = scratch.save(pairs.where(passed).select("a", "b"), f"candidates{len(kept)}")
        kept.append(1)
        x, y = both(["tokens", "n"])
        pairs = pairs.join(x, "a").join(y, "b")
        test = F.pandas_udf(_exact(percent), "boolean")
        return pairs.where(test(F.struct(F.col("x_tokens").alias("x"), F.col("y_tokens").alias("y"), F.col("x_n").alias("n"), F.col("y_n").alias("m")))).select("a", "b")

    kept: list[int] = []
    # left: tokens from this one on, in the first order; of the first token that two sets share, both need their whole overlap left.
    # alone: tokens that no other set has. These and the bits in which two bitmaps differ are a part of what two sets differ in.
    index = sets.select(F.posexplode("prefix0").alias("at", "key"), "id", "n", *[F.col("bits")[k].alias(f"bits{k}") for k in range(BITS // 64)], F.size("tokens").alias("size"))
    index = index.withColumn("left", F.col("size") - F.col("at")).withColumn("alone", F.col("n") - F.col("size")).withColumn("odd", F.col("alone") / F.col("n")).drop("size")

    def near(a: dict, b: dict) -> Column:
        sizes = F.greatest(a["n"], b["n"]) * percent <= 100 * F.least(a["n"], b["n"])
        enough = F.least(a["left"], b["left"]) * (100 + percent) >= (a["n"] + b["n"]) * percent
        return sizes & enough & ((differing(a, b) + a["alone"] + b["alone"]) * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent))

    # The fewer tokens of its own a set has, the more copies it is near to.
    roots = cluster(index.drop("at"), sets.select("id", F.col("prefix0").alias("keys")), verify, scratch, near, "odd")
    scratch.drop("sets")

    roots = equal.select("node", F.col("node").alias("root")).where("false") if roots is None else roots
    placed = scratch.save(equal.join(roots.select("node", "root"), "node", "left").select("print", "first_id", F.coalesce("root", "node").alias("node")), "placed")
    labels = placed.groupBy("node").agg(F.min("first_id").alias("root"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("node", "root")
    labels = scratch.save(labels, "labels")
    small = labels.count() * LABEL_BYTES <= BROADCAST
    firsts = placed.join(F.broadcast(labels) if small else labels, "node", "left").select("print", F.coalesce("root", "first_id").alias("root"))
    firsts = scratch.save(firsts, "firsts")
    out = thin.join(firsts, "print", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))
