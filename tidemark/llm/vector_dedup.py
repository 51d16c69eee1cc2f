"""Embedding near-dedup by sorted projection passes.

Each pass orders all vectors of a label by the signs of its own 64 random projections, read as one number, and compares
every vector with the WINDOW that follow it. A vector's rows are dealt by ranges of (pass, label, hash, id), so that no
label, hash or group of near copies is a partition's bound; equal vectors of a label are one row with a count; the last rows of a partition are compared with the WINDOW that
follow it, from as many partitions as it takes, in a second, small step. Pairs of a partition are contracted to a spanning forest there, so that a group of near copies gives
as many rows as it has members. The components come from distributed union-find; links are then counted inside components,
in tiles, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components, forest

PASSES, WINDOW, BITS, TILE = 12, 48, 64, 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1. The largest component is made 1 first, so that no square overflows or vanishes."""
    matrix = vectors / np.abs(vectors).max(axis=1)[:, None]
    return matrix / np.linalg.norm(matrix, axis=1)[:, None]


def _planes(dims: int, pass_: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, pass_, dims]).standard_normal((dims, BITS))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, label, vec): the vector of length 1 as doubles, and the hash of it and the label; all null but the id where a vector can't be compared."""
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            ids, labels, vectors = part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist()
            out: list[list] = [[None] * len(part) for _ in range(3)]
            good: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if labels[i] is not None and v and None not in v:
                    good.setdefault(len(v), []).append(i)
            for dims, rows in good.items():
                matrix = np.array([vectors[i] for i in rows], np.float64)
                usable = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
                # Adding 0 makes -0 plain.
                for i, x in zip(np.array(rows)[usable].tolist(), _unit(matrix[usable]) + 0.0, strict=True):
                    label, vec = f"{dims}:{labels[i]}", x.tobytes()
                    for column, value in zip(out, (xxhash.xxh3_128_digest(label.encode() + b"\0" + vec), label, vec), strict=True):
                        column[i] = value
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["id", "h", "label", "vec"])


def _keyed(passes: int, seed: int):
    """(pass, label, hash, id, vec) of each vector, once a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: dict[int, list[int]] = {}
            blobs = batch.column(2).to_pylist()
            for i, blob in enumerate(blobs):
                good.setdefault(len(blob) // 8, []).append(i)
            for dims, rows in good.items():
                unit, part = np.frombuffer(b"".join(blobs[i] for i in rows), np.float64).reshape(len(rows), dims), batch.take(pa.array(rows))
                for p in range(passes):
                    bits = (unit @ _planes(dims, p, seed)) >= 0
                    key = np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel() ^ np.int64(-(2**63))
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.int32()), part.column(1), pa.array(key), part.column(0), part.column(2)], names=["pass", "label", "hash", "id", "vec"])

    return run


def _near(ids: np.ndarray, group: np.ndarray, vecs: list[bytes], window: int, least: float, first: int | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of rows of one group, at most ``window`` apart, whose cosine is ``least`` or more. first: only pairs across that row."""
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        unit = np.frombuffer(b"".join(vecs[i] for i in at), np.float64).reshape(len(at), -1)
        for d in range(1, min(window, len(at) - 1) + 1):
            hit = np.flatnonzero(np.einsum("ij,ij->i", unit[:-d], unit[d:]) >= least)
            for i in hit.tolist():
                if first is None or at[i] < first <= at[i + d]:
                    yield int(ids[at[i]]), int(ids[at[i + d]])


def _windows(window: int, least: float):
    """Of a sorted partition: a spanning forest of its pairs, and the rows at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        held = None
        tree: dict[int, int] = {}
        names = ["node", "root", "part", "edge", "pos", "group", "vec"]
        head: list[tuple] = []

        def ends(rows: list[tuple], edge: int, part: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([edge] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=names)

        for batch in batches:
            rows = list(zip(batch.column("id").to_pylist(), [f"{p}/{g}" for p, g in zip(batch.column("pass").to_pylist(), batch.column("label").to_pylist(), strict=True)], batch.column("vec").to_pylist(), strict=True))
            head += rows[: max(0, window - len(head))]
            rows = (held or []) + rows
            ids = np.array([r[0] for r in rows], np.int64)
            group = np.unique([r[1] for r in rows], return_inverse=True)[1] if rows else np.zeros(0)
            pairs = ((a, b) for a, b in _near(ids, group, [r[2] for r in rows], window, least))
            tree = forest((p for source in (tree.items(), pairs) for p in source))
            held = rows[-window:]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(tree), pa.int64()), pa.array(list(tree.values()), pa.int64()), *(pa.nulls(len(tree), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()))], names=names)
            yield ends(head, 1, here)
            yield ends(held, 0, here)

    return run


def _across(window: int, least: float):
    """The last rows of a partition against the first of those after it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["edge", "part", "pos"])
        group = np.unique(frame["group"], return_inverse=True)[1]
        tree = forest(_near(frame["node"].to_numpy(np.int64), group, frame["vec"].tolist(), window, least, first=int((frame["edge"] == 0).sum())))
        return pd.DataFrame({"node": list(tree), "root": list(tree.values())}, dtype="int64")

    return run


def _follow(sizes: dict[int, int], window: int) -> list[tuple[int, int]]:
    """(part, to): the first rows of ``part`` are among the ``window`` rows after partition ``to``. sizes: rows of the partitions that have any, up to ``window``."""
    parts, out = sorted(sizes), []
    for i, to in enumerate(parts):
        reach = 0
        for part in parts[i + 1 :]:
            out.append((part, to))
            reach += sizes[part]
            if reach >= window:
                break
    return out


def _tile(least: float):
    """Of two tiles of a component: for each vector of the first how many rows of the second are near, its own excluded."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["side"] == 0], frame[frame["side"] == 1]
        x, y = (np.frombuffer(b"".join(f["vec"]), np.float64).reshape(len(f), -1) for f in (a, b))
        near = (x @ y.T) >= least
        near &= a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": a["id"].to_numpy(np.int64), "n": near @ b["n"].to_numpy(np.int64)})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, passes: int = PASSES, window: int = WINDOW, seed: int = 11) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared only where labels are equal and not null and lengths are equal. A vector that is null, empty, zero, or holds null or
    non-finite components links with nothing; any other does, however long or short. Rows that repeat an id are vectors of their own, and so are rows without an id,
    which are no component_id unless alone. An empty table gives an empty result; other columns are ignored. The windows may miss a pair (tests measure how often);
    of the pairs inside a component none is missed.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = scratch.save(source.mapInArrow(_named, "id long, h binary, label string, vec binary"), "rows")
    usable = rows.where("h is not null")
    counted = usable.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    nodes = usable.select("h", "label", "vec").dropDuplicates(["h"]).join(counted, "h").withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.save(nodes, "nodes")

    keyed = nodes.select("node", "label", "vec").mapInArrow(_keyed(passes, seed), "pass int, label string, hash long, id long, vec binary")
    dealt = keyed.repartitionByRange(max(parts, 1), "pass", "label", "hash", "id").sortWithinPartitions("pass", "label", "hash", "id")
    found = scratch.save(dealt.mapInArrow(_windows(window, least), "node long, root long, part int, edge int, pos int, group string, vec binary"), "windows", large=True)
    inside = found.where("root is not null").select("node", "root")
    # A row per partition.
    sizes = {r["part"]: r["n"] for r in found.where("edge = 1").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    follow = F.broadcast(spark.createDataFrame(_follow(sizes, window), "part int, to int"))
    ends = found.where("part is not null").drop("root")
    ends = ends.where("edge = 0").withColumn("to", F.col("part")).unionByName(ends.where("edge = 1").join(follow, "part"))
    across = scratch.save(ends.groupBy("to").applyInPandas(_across(window, least), "node long, root long"), "across")
    links = connected_components(inside.unionByName(across), scratch)

    # Members of components, each with its tile; a component of one tile meets itself, larger ones tile by tile.
    members = links.select("node", "root").unionByName(links.select(F.col("root").alias("node"), "root").distinct())
    members = scratch.save(members.join(nodes.select("node", "n", "vec"), "node").withColumnRenamed("node", "id"), "members")
    tiles = scratch.save(members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "tiles")
    placed = members.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = placed.select("root", F.col("tile").alias("ta"), other.alias("tb"), F.lit(0).alias("side"), "id", "n", "vec")
    right = placed.select("root", other.alias("ta"), F.col("tile").alias("tb"), F.lit(1).alias("side"), "id", "n", "vec")
    counts = left.unionByName(right.select(*left.columns)).groupBy("root", "ta", "tb").applyInPandas(_tile(least), "id long, n long")
    counts = scratch.save(counts.groupBy("id").agg(F.sum("n").alias("others")), "counts")

    known = nodes.select("h", "n", "first_id", F.col("node").alias("id")).join(counts, "id", "left").join(members.select("id", "root"), "id", "left")
    known = scratch.save(known.select("h", "first_id", F.coalesce("root", "id").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "known")
    firsts = known.groupBy("root").agg(F.min("first_id").alias("component"))
    known = known.join(firsts, "root").select("h", "n_links", "component")
    out = rows.select("id", "h").join(known, "h", "left")
    label = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), F.col("id").eqNullSafe(label).alias("kept"))
