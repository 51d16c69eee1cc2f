"""Keys of blocks meet in buckets, and the answers go back to the blocks.

A block sends its keys, sorted and packed, to buckets: one row for each bucket. Blocks and buckets both grow with the text, so the rows of one
exchange grow with its square. Beyond FAN buckets there are two steps each way: a block sends to about the square root of all buckets; there
the runs of as many blocks are merged into one and cut into the buckets proper; an answer comes back as one run for those blocks, which the
way back cuts into one row a block. Rows are then the blocks times the root, and one row has some hundred keys at least: a block of 4 MB
has up to 600,000, and 100 TB have 6 million buckets, whose root is 2,500.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BUCKET_BYTES, Scratch, spared

#: Buckets that a block sends to before there are two steps.
FAN = 1024
#: Text of a block.
BLOCK_BYTES = 4 << 20
NAMES = ["block", "bucket", "ids", "a", "b", "c"]
KINDS = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
SENT = "block long, bucket int, ids array<long>, a binary, b binary, c binary"


def pack(array: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed: sorted integers lose their leading bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array.view(np.uint8).reshape(-1, array.itemsize).T).tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


@dataclass(frozen=True)
class Plan:
    """first: buckets that a block sends to. second: buckets proper in each of these. parts: groups of blocks whose runs are merged."""

    first: int
    second: int = 1
    parts: int = 1


@dataclass(frozen=True)
class Form:
    """The columns a, b, c of what is sent and of the answers, for each kind of key; bucket = kinds * place + kind.

    In two steps an answer has a value of a, b and c for each key in it, and ``who``, the key's block; ``close`` makes a block's columns of them.
    """

    sent: tuple[tuple[type | None, ...], ...]
    answer: tuple[tuple[type, ...], ...]
    close: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[bytes, bytes, bytes]]


def planned(docs: DataFrame, text_col: str) -> Plan:
    """So many buckets that the keys of about BUCKET_BYTES of text meet in each, as counted by a scan of its own; no less than Spark's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    return plan_for(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def plan_for(size: int, least: int) -> Plan:
    buckets = max(least, math.ceil(size / BUCKET_BYTES))
    if buckets <= FAN:
        return Plan(buckets)
    first = math.ceil(math.sqrt(buckets))
    second = math.ceil(buckets / first)
    return Plan(first, second, max(1, math.ceil(size / (BLOCK_BYTES * second))))


def place_of(token: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key by its upper half: sorted keys have sorted buckets, and those of k times as many are parts of these."""
    return (token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _made(rows: list[tuple], width: int) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([*KINDS, pa.binary()][:width])], names=[*NAMES, "who"][:width])


def _merge(plan: Plan, form: Form):
    """The keys that a group of blocks sent to one first bucket, in order, as a row for each bucket proper."""

    def run(table: pa.Table) -> pa.Table:
        kinds, bucket = len(form.sent), table.column("bucket")[0].as_py()
        values = [np.concatenate([unpack(x, t) for x in table.column(c).to_pylist()]) if t else None for c, t in zip("abc", form.sent[bucket % kinds], strict=True)]
        sizes = [len(unpack(x, np.uint64)) for x in table.column("a").to_pylist()]
        who = np.repeat(np.array(table.column("block").to_pylist(), np.int64), sizes)
        order = np.argsort(values[0], kind="stable")
        values, who = [x if x is None else x[order] for x in values], who[order]
        ends = np.searchsorted(place_of(values[0], plan.first * plan.second), bucket // kinds * plan.second + np.arange(plan.second + 1, dtype=np.uint64))
        part, rows = table.column("part")[0].as_py(), []
        for j, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if lo < hi:
                number = (bucket // kinds * plan.second + j) * kinds + bucket % kinds
                rows.append((part, number, None, *(x if x is None else pack(x[lo:hi]) for x in values), pack(who[lo:hi])))
        return _made(rows, len(NAMES) + 1)

    return run


def _split(form: Form):
    """The answers of the buckets proper of one first bucket to a group of blocks, as a row for each block. Rows of no block stay."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("block")[0].as_py() < 0:
            return table.select(NAMES)
        home, rows = table.column("home")[0].as_py(), []
        numbers = table.column("bucket").to_pylist()
        table = table.take(pa.array(np.argsort(numbers)))
        kinds = (*form.answer[numbers[0] % len(form.answer)], np.int64)
        *values, who = (np.concatenate([unpack(x, t) for x in table.column(c).to_pylist()]) for c, t in zip(("a", "b", "c", "who"), kinds, strict=True))
        order = np.argsort(who, kind="stable")
        blocks, starts = np.unique(who[order], return_index=True)
        for block, own in zip(blocks.tolist(), np.split(order, starts[1:]), strict=True):
            rows.append((block, home, None, *form.close(*(x[own] for x in values))))
        return _made(rows, len(NAMES))

    return run


def exchanged(sent: DataFrame, answer: Callable[[pa.Table], pa.Table], plan: Plan, form: Form, scratch: Scratch, heads: bool) -> DataFrame:
    """What the buckets answer, by block. sent: SENT; rows of a bucket below 0 (``heads``: there are any) come back as they are.

    ``answer`` takes the rows of a bucket. In two steps they have a column ``who`` and a group of blocks for a block, of which a key comes as often as
    blocks have it; the answers' rows have ``who`` then.
    """
    if plan.second == 1:
        return sent.groupBy("bucket").applyInArrow(answer, SENT)
    if heads:
        sent = scratch.save(sent, "sent", large=True)
    kinds, wide = len(form.sent), f"{SENT}, who binary"
    keyed = sent.where("bucket >= 0").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(plan.parts)).cast("int"))
    merged = keyed.groupBy("part", "bucket").applyInArrow(spared(_merge(plan, form)), wide)
    met = merged.groupBy("bucket").applyInArrow(answer, wide)
    home = F.floor(F.col("bucket") / (kinds * plan.second)) * kinds + F.col("bucket") % kinds
    back = met.withColumn("home", home.cast("int")).groupBy("block", "home").applyInArrow(spared(_split(form)), SENT)
    return back.unionByName(sent.where("bucket < 0")) if heads else back
