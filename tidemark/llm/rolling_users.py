"""Distinct users in trailing windows of minutes, from timelines held as bitsets.

A user's clicks of one kind are a timeline, cut into chunks of several windows. In a chunk every run of clicks that lie less than the longest
window apart has a stretch of bits, one a minute, and the stretches of many users stand side by side in one big integer. Level k of a timeline has the minutes
with at least k clicks (a thermometer). Windows grow by doubling: two neighbouring windows of 2^i minutes make one of 2^(i+1) by a shift, and a
window of any length is put together from those of its binary digits; no two overlap, so that the levels stay exact counts. Each run of ones of the
result begins with an edge of +1 and ends with one of -1. Edges are summed over users by kind and minute, and a running sum within the chunk gives the users.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, spared

#: Bits of one big integer.
PIECE_BITS = 1 << 22
#: A chunk is so many times the longest window.
CHUNK_WINDOWS = 7


@dataclass(frozen=True)
class Measure:
    """A column to return: users with at least ``least`` clicks in the last ``minutes`` minutes, the present one included."""

    name: str
    minutes: int
    least: int = 1


def joined(near: list[int], far: list[int], by: int) -> list[int]:
    """The levels of two windows as one: that of ``near``, which ends now and is ``by`` minutes long, and that of ``far``, which ends before it."""
    moved = [x << by for x in far]
    out = []
    for k, own in enumerate(near):
        both = own | moved[k]
        for i in range(k):
            both |= near[i] & moved[k - 1 - i]
        out.append(both)
    return out


def dilated(levels: list[int], needs: dict[int, int]) -> dict[int, list[int]]:
    """``needs``: for each length of a window how many levels it is asked for. levels: the minutes with at least 1, 2, ... clicks."""
    found: dict[int, list[int]] = {}
    size, power = 1, levels
    while True:
        for length, depth in needs.items():
            if length & size:
                found[length] = joined(found[length], power[:depth], length & (size - 1)) if length in found else power[:depth]
        if 2 * size > max(needs):
            return found
        power, size = joined(power, power, size), 2 * size


def edges(bits: int, n_bytes: int) -> np.ndarray:
    """Where runs of ones begin and end (one past the last), in turn."""
    raw = np.frombuffer((bits ^ (bits << 1)).to_bytes(n_bytes, "little"), np.uint8)
    at = np.flatnonzero(raw)
    row, bit = np.nonzero(np.unpackbits(raw[at], bitorder="little").reshape(-1, 8))
    return at[row] * 8 + bit


def run_edges(owner: np.ndarray, minute: np.ndarray, clicks: np.ndarray, measures: list[Measure]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each measure (row, minute, step): the edges of its runs. ``row`` is the first row of the stretch, which names its owner.

    The three arrays are sorted by owner and minute, (owner, minute) pairs are distinct.
    """
    longest, depth = max(m.minutes for m in measures), max(m.least for m in measures)
    needs = {m.minutes: max(x.least for x in measures if x.minutes == m.minutes) for m in measures}
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (np.diff(minute) >= longest)))
    last = np.append(first[1:], len(minute)) - 1
    # One bit between stretches, lest runs of two of them touch.
    width = minute[last] - minute[first] + longest + 1
    offset = np.cumsum(width) - width
    cuts = np.flatnonzero(np.diff(offset // PIECE_BITS)) + 1
    out: list[list] = [[] for _ in measures]
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(first)), strict=True):
        rows = slice(first[a], last[b - 1] + 1)
        stretch = np.repeat(np.arange(a, b), np.append(first[a + 1 : b], last[b - 1] + 1) - first[a:b])
        at = offset[stretch] - offset[a] + minute[rows] - minute[first[stretch]]
        n_bytes = int(offset[b - 1] - offset[a] + width[b - 1]) // 8 + 1
        levels = []
        for k in range(1, depth + 1):
            bits = np.zeros(8 * n_bytes, bool)
            bits[at[clicks[rows] >= k]] = True
            levels.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
        grown = dilated(levels, needs)
        for m, found in zip(measures, out, strict=True):
            place = edges(grown[m.minutes][m.least - 1], n_bytes)
            own = np.searchsorted(offset[a:b] - offset[a], place, "right") - 1 + a
            found.append((first[own], minute[first[own]] + place - (offset[own] - offset[a]), 1 - 2 * (np.arange(len(place)) & 1)))
    return [tuple(np.concatenate([x[i] for x in found]) for i in range(3)) for found in out]


def _deltas(measures: list[Measure], names: list[str], chunk_minutes: int):
    kind_at, user_at, minute_at, clicks_at, chunk_at = names

    def run(table: pa.Table) -> pa.Table:
        start = table.column(chunk_at)[0].as_py() * chunk_minutes
        kinds = table.column(kind_at).combine_chunks().dictionary_encode()
        kind, minute = kinds.indices.to_numpy(), table.column(minute_at).to_numpy()
        # Pairs of kind and minute of the chunk as one number.
        span = np.int64(chunk_minutes)
        own = minute >= start
        keys, steps = [kind[own] * span + minute[own] - start], []
        users = table.column(user_at).combine_chunks().dictionary_encode().indices
        known = users.is_valid().to_numpy(zero_copy_only=False)
        if known.any():
            rows = np.flatnonzero(known)
            user = users.fill_null(0).to_numpy().astype(np.int64)
            rows = rows[np.lexsort((minute[rows], user[rows], kind[rows]))]
            owner = kind[rows] * np.int64(len(users.unique()) + 1) + user[rows]
            found = run_edges(owner, minute[rows], table.column(clicks_at).to_numpy()[rows], measures)
            for row, at, step in found:
                # What reaches in from before the chunk begins with it; what reaches beyond it is the next chunk's.
                inside = at < start + chunk_minutes
                steps.append((kind[rows[row[inside]]] * span + np.maximum(at[inside], start) - start, step[inside]))
        keys += [x[0] for x in steps]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        held = [np.bincount(back[: len(keys[0])], minlength=len(every)) > 0]
        done = len(keys[0])
        for key, step in steps or [(keys[0][:0], keys[0][:0])] * len(measures):
            held.append(np.bincount(back[done : done + len(key)], step, len(every)).astype(np.int64))
            done += len(key)
        chunk = np.full(len(every), table.column(chunk_at)[0].as_py(), np.int64)
        return pa.table([kinds.dictionary.take(pa.array(every // span)), pa.array(chunk), pa.array(every % span + start), *map(pa.array, held)], names=[kind_at, chunk_at, minute_at, "present", *[f"d{i}" for i in range(len(measures))]])

    return run


def minute_of(df: DataFrame, ts_col: str) -> Column:
    """Whole minutes since 1970, rounded down. A time without a zone is read as UTC, whatever the session's zone."""
    ts = F.col(ts_col)
    if dict(df.dtypes)[ts_col] == "timestamp_ntz":
        return F.unix_date(ts.cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    micros = F.unix_micros(ts)
    return ((micros - F.pmod(micros, F.lit(60_000_000))) / 60_000_000).cast("long")


def rolling_users(clicks: DataFrame, measures: list[Measure], id_col: str = "click_id", ts_col: str = "ts", user_col: str = "client_id", kind_col: str = "kind", chunk_minutes: int | None = None) -> DataFrame:
    """(kind, minute, a column for each measure), a row for each kind and minute with a click; columns beside those named are ignored.

    Rows without a time or a kind take no part. Rows of equal ids are one click; if they differ, the one with the first time, then kind, then user
    (null first) counts. A row without an id is a click of its own. A click without a user makes a row but is nobody's. An empty table gives an empty one.
    A user's clicks of a minute are one row before they are dealt out, and a timeline is dealt by chunk: a user with a third of all rows has at most a row for each
    minute and kind. ``chunk_minutes``, at least the longest window, is seven times that unless it is given.
    """
    if not measures or min(min(m.minutes, m.least) for m in measures) < 1:
        raise ValueError("measures need minutes and clicks of 1 or more")
    longest = max(m.minutes for m in measures)
    length = chunk_minutes or CHUNK_WINDOWS * longest
    if length < longest:
        raise ValueError("a chunk is as long as the longest window or longer")
    most = max(m.least for m in measures)
    rows = clicks.select(F.col(id_col).alias("id"), minute_of(clicks, ts_col).alias("minute"), F.col(ts_col).alias("ts"), F.col(user_col).alias("user"), F.col(kind_col).alias("kind"))
    rows = rows.where("ts is not null and kind is not null").withColumn("own", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    one = rows.groupBy("id", "own").agg(F.min(F.struct("ts", "kind", "user", "minute")).alias("c")).select("c.kind", "c.user", "c.minute")
    held = one.groupBy("kind", "user", "minute").agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("int").alias("clicks"))
    # A click counts in its own chunk and in the next one if a window reaches there.
    chunk = lambda c: F.floor(c / length).cast("long")
    dealt = held.withColumn("chunk", F.explode(F.when(F.col("user").isNull(), F.array(chunk(F.col("minute")))).otherwise(F.array_distinct(F.array(chunk(F.col("minute")), chunk(F.col("minute") + longest - 1))))))
    parts = max(1, int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.withColumn("part", F.when(F.col("user").isNull(), F.pmod(F.xxhash64("minute"), F.lit(parts))).otherwise(F.pmod(F.xxhash64("user"), F.lit(parts))))
    kind_type = clicks.schema[kind_col].dataType
    schema = T.StructType([T.StructField("kind", kind_type), *[T.StructField(c, T.LongType()) for c in ("chunk", "minute")], T.StructField("present", T.BooleanType()), *[T.StructField(f"d{i}", T.LongType()) for i in range(len(measures))]])
    steps = dealt.groupBy("chunk", "part").applyInArrow(spared(_deltas(measures, ["kind", "user", "minute", "clicks", "chunk"], length)), schema)
    summed = steps.groupBy("kind", "chunk", "minute").agg(F.max("present").alias("present"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(len(measures))])
    upto = Window.partitionBy("kind", "chunk").orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = fresh(summed, *[f"n{i}" for i in range(len(measures))])
    running = summed.select("kind", "minute", "present", *[F.sum(f"d{i}").over(upto).alias(n) for i, n in enumerate(names)])
    return running.where("present").select(F.col("kind").alias(kind_col), "minute", *[F.col(n).alias(m.name) for n, m in zip(names, measures, strict=True)])
