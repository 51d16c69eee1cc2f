"""Distributed union-find: connected components of an edge table, labelled by their smallest id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

EDGE_SCHEMA = "node long, root long"
#: So many edges are one task's work.
SMALL = 1 << 19


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node that some pair has, with the smallest node that its pairs connect it to; roots themselves are left out."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: r for x in list(parent) if (r := find(x)) != x}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = (p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    found = forest(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, root) for every node that is not the smallest of its component. ``edges``: two columns of ids, any order.

    Each partition first contracts its own edges, so that a hub stands in at most one row of each; then rounds of meeting
    by node, contracting and jumping to the root's root, until no root has a root and no node two. Nothing goes to the driver
    but one count a round. Every round is a written table. SMALL edges or fewer are contracted by one task. ``edges`` is read twice.
    """
    a, b = edges.columns
    # An edge meets others at its larger end: a hub with a small id is never a key of many rows.
    state = edges.select(F.col(a).alias("node"), F.col(b).alias("root")).where("node <> root")
    if edges.count() <= SMALL:
        return scratch.save(state.coalesce(1).mapInArrow(_contract, EDGE_SCHEMA), f"{tag}0")
    state = state.mapInArrow(_contract, EDGE_SCHEMA)
    for round_ in range(200):
        met = scratch.save(state.repartition("node").mapInArrow(_contract, EDGE_SCHEMA).distinct(), f"{tag}{round_}")
        ends = met.select(F.col("node").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("end")).unionByName(met.select(F.col("root").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("end")))
        ends = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("end").alias("end"))
        if ends.where("up > 1 or (up = 1 and end = 1)").limit(1).count() == 0:
            return met
        tops = met.select(F.col("node").alias("root"), F.col("root").alias("top"))
        state = met.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")).mapInArrow(_contract, EDGE_SCHEMA)
        if round_:
            scratch.drop(f"{tag}{round_ - 1}")
    raise RuntimeError("components did not settle")
