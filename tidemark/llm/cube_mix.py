"""Mixing sources to target weights by the cube method of balanced sampling.

A document of a source whose target is r times its size is taken floor(r) times, and once more with probability r - floor(r).
The flight phase moves those probabilities through the null-space of two constraints, tokens and documents, until at most
two documents of a block are undecided. Blocks are dealt by hash, so that a large source is many blocks; what is undecided
meets in the blocks of the next round, and the last round of a source lands its few remaining documents on
the rounding that misses the token total least.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Scratch

#: Documents of one flight block.
BLOCK = 1024
#: Single units that landing may turn.
TURNS = 64
#: Probabilities closer than this to 0 or 1 are decided.
EDGE = 1e-9


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: dict, weights: dict, cap: float = 3.0) -> dict:
    """Targets that share the sum of all sizes by weight, none above ``cap`` times its size; the excess is shared anew."""
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        out |= {s: cap * sizes[s] for s in over}
        left, free = left - sum(cap * sizes[s] for s in over), free - over
    return out


def flight(sizes: list[float], start: list[float], rng: np.random.Generator) -> list[float]:
    """Moves ``start`` (values in 0..1) until at most two are strictly between 0 and 1; keeps both totals.

    Three undecided units a, b, c always have a direction with sum(u) = 0 and sum(u * size) = 0:
    (size_b - size_c, size_c - size_a, size_a - size_b), or (1, -1, 0) where two sizes are equal.
    """
    p, hold = list(start), []
    draws = iter(rng.random(4 * len(p) + 8).tolist())
    for i in range(len(p)):
        if EDGE < p[i] < 1 - EDGE:
            hold.append(i)
        while len(hold) == 3 or len(hold) == 2 and sizes[hold[0]] == sizes[hold[1]]:
            if sizes[hold[0]] == sizes[hold[1]]:
                unit = ((hold[0], 1.0), (hold[1], -1.0))
            elif len(hold) == 3 and sizes[hold[1]] == sizes[hold[2]]:
                unit = ((hold[1], 1.0), (hold[2], -1.0))
            else:
                a, b, c = hold
                unit = ((a, sizes[b] - sizes[c]), (b, sizes[c] - sizes[a]), (c, sizes[a] - sizes[b]))
            up = min((1 - p[k]) / u if u > 0 else p[k] / -u for k, u in unit if u)
            down = min(p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in unit if u)
            step = up if next(draws) * (up + down) < down else -down
            for k, u in unit:
                p[k] = min(1.0, max(0.0, p[k] + step * u))
                if p[k] <= EDGE or p[k] >= 1 - EDGE:
                    p[k] = float(p[k] > 0.5)
            hold = [k for k in hold if 0 < p[k] < 1]
    return p


def land(sizes: list[float], start: list[float], p: list[float]) -> None:
    """Rounds the undecided units, then turns single units while that brings the tokens nearer to their total.

    A source of few documents may end with a very long one undecided, whose rounding alone would miss the total by far.
    """
    open_ = [k for k, x in enumerate(p) if 0 < x < 1]
    size, want = np.array(sizes), float(np.dot(sizes, start))
    corners = list(itertools.product((0.0, 1.0), repeat=len(open_)))
    missed = [abs(sum(sizes[k] * (x - p[k]) for k, x in zip(open_, c, strict=True))) for c in corners]
    for k, x in zip(open_, corners[int(np.argmin(missed))], strict=True):
        p[k] = x
    value = np.array(p)
    for _ in range(TURNS):
        off = float(size @ value) - want
        after = np.abs(off + size * (1 - 2 * value))
        k = int(np.argmin(after))
        if after[k] >= abs(off):
            break
        value[k] = 1 - value[k]
    p[:] = value.tolist()


def _fly(seed: int):
    """Flies one block; a block that is its source's only one also lands."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "order_key", "id", *(["key"] if "key" in frame else [])], ascending=[False, True, True, True][: 4 if "key" in frame else 3], kind="stable", na_position="first", ignore_index=True)
        rng = np.random.default_rng([seed, int(frame["block"].iloc[0]), int(frame["order_key"].iloc[0]) & 0xFFFFFFFF, len(frame)])
        sizes = frame["size"].astype(float).tolist()
        start = frame["p"].tolist()
        p = flight(sizes, start, rng)
        if int(frame["blocks"].iloc[0]) == 1:
            land(sizes, start, p)
        frame["p"] = p
        return frame

    return run


def cube_mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, seed: int = 7, key_col: str | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    ``weights`` gives each source's weight (None stands for null); sources that it lacks weigh 0. Without it, sources in
    code-point order with null last weigh 1, 2, 3, repeating. Sources are held on the driver: a mixture names each of
    them, so their number is that of a configuration. Null text has size 0 and is taken 0 times; empty tables give
    empty results; rows that repeat an id are separate documents. The same input and seed give the same result on any layout.
    With ``key_col``, a column that tells all rows apart, the result has it too, and rows of one id are ordered by their texts.
    """
    scratch = Scratch(docs.sparkSession, "cube")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.col(key_col).alias("key"), F.xxhash64(text_col).alias("body")] if key_col else []))
    key = ["key"] if key_col else []
    sized = scratch.save(sized, "sizes")
    per = {r["source"]: (int(r["size"]), int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")).collect()}
    if weights is None:
        weights = {s: 1 + i % 3 for i, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    totals = {s: x[0] for s, x in per.items()}
    weighed = {s: x for s, x in totals.items() if weights.get(s, 0) > 0}
    targets = {s: 0.0 for s in totals} | water_fill(weighed, weights, cap)
    blocks = {s: max(1, math.ceil(n / BLOCK)) for s, (_, n) in per.items()}
    rows = [(s, s is None, totals[s], targets[s], targets[s] / totals[s] if totals[s] else 0.0, blocks[s]) for s in per]
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "source string, is_null boolean, source_size long, target double, ratio double, blocks int")
    plan = F.broadcast(plan.withColumnRenamed("source", "name").drop("is_null"))
    known = sized.join(plan, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    whole = F.floor("ratio").cast("int")
    known = known.select("id", "source", "size", *key, *(["body"] if key_col else []), "source_size", "target", "blocks", whole.alias("whole"), F.col("ratio").alias("ratio"))
    state = known.withColumn("p", F.when(F.col("size") > 0, F.col("ratio") - F.col("whole")).otherwise(F.lit(0.0))).drop("ratio")
    state = state.withColumn("order_key", F.xxhash64(F.lit(seed), F.col("id"), F.col("size"), *([F.col("body")] if key_col else []))).drop("body").withColumn("block", F.lit(0))

    open_ = F.col("p").between(EDGE, 1 - EDGE) & (F.col("size") > 0)
    done, flying, round_ = [state.where(~open_)], state.where(open_), 0
    while True:
        last = max(blocks.values(), default=1) == 1
        dealt = flying.withColumn("block", F.pmod(F.xxhash64(F.lit(round_), F.col("order_key")), F.col("blocks")).cast("int"))
        flown = scratch.save(dealt.groupBy("source", "block").applyInPandas(_fly(seed), dealt.schema), f"round{round_}")
        done.append(flown.where(~F.col("p").between(EDGE, 1 - EDGE)))
        if last:
            break
        blocks = {s: max(1, math.ceil(2 * b / BLOCK)) if b > 1 else 1 for s, b in blocks.items()}
        shrunk = F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / BLOCK)).cast("int")
        flying, round_ = flown.where(F.col("p").between(EDGE, 1 - EDGE)).withColumn("blocks", shrunk), round_ + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p")).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(c).alias(key_col) for c in key])

