"""Sealed receipts in chains: each binds the hash of the one before it and those of its inputs."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import canonical_json
from tidemark.stages import Stages

#: Buckets of the version's hash tree.
BUCKETS = 4096
#: Receipts of a run that is walked in one piece.
WHOLE = 1 << 14
#: What goes before a text that is no hash, and what is wrong with a receipt by itself, the first that is so.
OTHER, PROBLEMS = bytes(33), ("changed", "twice", "input", "gap", "fork")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def sealed(rows: DataFrame, body: str, before: str | Column | None = None, inputs: str | None = None) -> DataFrame:
    """``rows`` with ``receipt``, the JSON of body, before and inputs (members by name), and ``receipt_sha256``, its hash.

    body: JSON; before: the hash of the receipt before, null for the first; inputs: a map of names to hashes. A body that is no JSON gives null.
    """
    prior = F.lit(None).cast("string") if before is None else F.col(before) if isinstance(before, str) else before
    named = F.lit("{}") if inputs is None else F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(inputs))))), F.lit("{}"))
    text = F.concat(F.lit('{"before":'), F.coalesce(F.concat(F.lit('"'), prior, F.lit('"')), F.lit("null")), F.lit(',"body":'), canonical_json(F.col(body)), F.lit(',"inputs":'), named, F.lit("}"))
    return rows.withColumn("receipt", text).withColumn("receipt_sha256", _sha(F.col("receipt")))


def phase_state(run: Column, phase: str, completed: Column, receipt_sha256: Column) -> Column:
    """The JSON of a run's state once a receipt is written: its phase, the phases that are done, the receipt's hash."""
    return F.to_json(F.struct(receipt_sha256.alias("blind_seal_receipt_sha256"), completed.alias("completed_phases"), F.lit(phase).alias("phase"), run.alias("run_id")))


def _packed(text: Column) -> Column:
    """A hash as 32 bytes; any other text as more than those."""
    return F.when(text.rlike("^[0-9a-f]{64}$"), F.unhex(text)).otherwise(F.concat(F.lit(OTHER), text.cast("binary")))


def _unpacked(held: Column) -> Column:
    return F.when(F.octet_length(held) == 32, F.lower(F.hex(held))).otherwise(F.substring(held, len(OTHER) + 1, 1 << 30).cast("string"))


def _thin(receipts: DataFrame, inputs: DataFrame | None) -> DataFrame:
    """(run_id, sha, before, changed, wrong): of each receipt what chains need, the hashes packed; wrong: an input is missing or has another hash. The texts stay behind."""
    held = receipts.where("run_id is not null and receipt_sha256 is not null")
    before = F.get_json_object("receipt", "$.before")
    thin = held.select("run_id", _packed(F.col("receipt_sha256")).alias("sha"), _packed(before).alias("before"), (~_sha(F.col("receipt")).eqNullSafe(F.col("receipt_sha256"))).alias("changed"))
    if inputs is None:
        return thin.withColumn("wrong", F.lit(False))
    named = held.select("run_id", _packed(F.col("receipt_sha256")).alias("sha"), F.explode(F.from_json(F.get_json_object("receipt", "$.inputs"), "map<string,string>")).alias("name", "hash"))
    now = inputs.select("run_id", "name", F.col("sha256").alias("now"))
    bad = named.join(now, ["run_id", "name"], "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select("run_id", "sha").distinct().withColumn("_bad", F.lit(True))
    return thin.join(bad, ["run_id", "sha"], "left").withColumn("wrong", F.coalesce("_bad", F.lit(False))).drop("_bad")


def _own_problem(thin: DataFrame) -> DataFrame:
    """(run_id, sha, before, problem, linked): what is wrong with each receipt by itself, the first of PROBLEMS."""
    # One row for each hash of a run; a receipt that is there twice is one node.
    nodes = thin.groupBy("run_id", "sha").agg(F.max("changed").alias("changed"), F.max("wrong").alias("wrong"), F.min("before").alias("before"), F.count(F.lit(1)).alias("copies"))
    ends = nodes.select("run_id", F.col("sha").alias("before"), F.lit(True).alias("there"))
    # First receipts all follow the same nothing.
    nodes = nodes.withColumn("_after", F.coalesce("before", F.lit(OTHER)))
    after = nodes.groupBy("run_id", "_after").agg(F.count(F.lit(1)).alias("followers"))
    met = nodes.join(ends, ["run_id", "before"], "left").join(after, ["run_id", "_after"]).drop("_after")
    wrong = [F.col("changed"), F.col("copies") > 1, F.col("wrong"), F.col("before").isNotNull() & F.col("there").isNull(), F.col("followers") > 1]
    problem = F.coalesce(*[F.when(w, name) for w, name in zip(wrong, PROBLEMS, strict=True)])
    return met.select("run_id", "sha", "before", problem.alias("problem"), F.col("there").isNotNull().alias("linked"))


REPORT = "sha binary, depth long, problem string, broken binary, broken_problem string"


def _walked(rows: list[tuple]) -> Iterator[tuple]:
    """The report's rows of one run, of its (sha, before, changed, wrong)."""
    nodes: dict[bytes, list] = {}
    for sha, before, changed, wrong in rows:
        n = nodes.setdefault(sha, [before, False, 0, False])
        n[:] = [before if n[0] is None else n[0] if before is None else min(n[0], before), n[1] or changed, n[2] + 1, n[3] or wrong]
    followers = Counter(n[0] or OTHER for n in nodes.values())
    problems = {}
    for sha, (before, changed, copies, wrong) in nodes.items():
        flags = (changed, copies > 1, wrong, before is not None and before not in nodes, followers[before or OTHER] > 1)
        problems[sha] = next((name for name, is_so in zip(PROBLEMS, flags, strict=True) if is_so), None)
    # depth and the first broken one on the way from the beginning; depth -1 where the way back never ends.
    known: dict[bytes, tuple[int, bytes | None]] = {}
    for start in nodes:
        way, at, seen = [], start, set()
        while at in nodes and at not in known and at not in seen:
            way.append(at)
            seen.add(at)
            at = nodes[at][0]
        depth, first = (-1, None) if at in seen else known.get(at, (0, None))
        for sha in reversed(way):
            if depth >= 0:
                depth, first = depth + 1, first if first is not None else sha if problems[sha] else None
            known[sha] = (depth, first)
    for sha in nodes:
        depth, first = known[sha]
        own = problems[sha]
        yield (sha, depth, own, first, first and problems[first]) if depth >= 0 else (sha, -1, own or "cycle", sha, "cycle")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of whole runs, from rows in order of their run."""
    held, run = [], None

    def report(runs: list, kind: pa.DataType) -> pa.RecordBatch:
        out = [(r, *row) for r, rows in runs for row in _walked(rows)]
        kinds = [kind, pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["run_id", "sha", "depth", "problem", "broken", "broken_problem"])

    kind = None
    for batch in batches:
        kind, done = batch.column(0).type, []
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for name, *row in zip(*columns, strict=True):
            if name != run and held:
                done.append((run, held))
                held = []
            run = name
            held.append(row)
        if done:
            yield report(done, kind)
    if held:
        yield report([(run, held)], kind)


def _doubled(thin: DataFrame, stages: Stages) -> DataFrame:
    """The report of runs of any length, by doubling pointers: log2 of the longest chain rounds, each a written table."""
    own = stages.save(_own_problem(thin), "own")
    # first: the broken receipt nearest to the beginning of the stretch from here up to, and without, the one that ``to`` names; depth: that stretch's length.
    broken = F.when(F.col("problem").isNotNull(), F.struct("sha", "problem"))
    state = stages.save(own.select("run_id", "sha", F.when(F.col("linked"), F.col("before")).alias("to"), broken.alias("first"), F.lit(1).cast("long").alias("depth"), "problem"), "round0")
    for k in range(1, 64):
        open_ = state.where("to is not null")
        if open_.limit(1).count() == 0:
            break
        if 1 << (k - 1) > own.count():  # longer than any chain can be
            break
        far = state.select("run_id", F.col("sha").alias("to"), F.col("to").alias("_to"), F.col("first").alias("_first"), F.col("depth").alias("_depth"))
        moved = open_.join(far, ["run_id", "to"]).select("run_id", "sha", F.col("_to").alias("to"), F.coalesce("_first", "first").alias("first"), (F.col("depth") + F.col("_depth")).alias("depth"), "problem")
        state = stages.save(state.where("to is null").unionByName(moved), f"round{k}")
        if k > 1:
            stages.drop(f"round{k - 1}")
    endless = F.col("to").isNotNull()
    first = F.when(endless, F.struct("sha", F.lit("cycle").alias("problem"))).otherwise(F.col("first"))
    out = state.withColumn("first", first).withColumn("problem", F.when(endless, F.coalesce("problem", F.lit("cycle"))).otherwise(F.col("problem")))
    return out.select("run_id", "sha", F.when(endless, F.lit(-1).cast("long")).otherwise(F.col("depth")).alias("depth"), "problem", F.col("first.sha").alias("broken"), F.col("first.problem").alias("broken_problem"))


def chain_report(receipts: DataFrame, inputs: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """(run_id, receipt_sha256, depth, problem, first_broken, first_problem, valid), a row for each receipt of a run.

    receipts: (run_id, receipt, receipt_sha256); inputs: (run_id, name, sha256), the hashes that the inputs have now. problem: changed (the text is not what the hash says), twice, input (an input is missing or
    has another hash), gap (the one before is not there), fork (another receipt follows the same one, or there are two first ones). first_broken: of the receipt and those before it, the broken one nearest to the chain's
    beginning; a receipt is valid if there is none. A receipt whose way back never ends has depth -1 and the problem cycle.
    Runs of up to ``whole`` receipts are walked each in one piece, after one shuffle of packed hashes; longer ones by doubling pointers.
    """
    stages = Stages(receipts.sparkSession, "chain")
    thin = stages.save(_thin(receipts, inputs), "thin")
    long_ = stages.save(thin.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select("run_id"), "long")
    kind = thin.select("run_id").schema.fields[0].dataType.simpleString()
    if long_.limit(1).count():
        short = thin.join(long_, "run_id", "left_anti")
        more = _doubled(thin.join(long_, "run_id", "left_semi"), stages)
    else:
        short, more = thin, None
    out = short.repartition("run_id").sortWithinPartitions("run_id").mapInArrow(_runs, f"run_id {kind}, {REPORT}")
    out = out if more is None else out.unionByName(more)
    return out.select("run_id", _unpacked(F.col("sha")).alias("receipt_sha256"), "depth", "problem", _unpacked(F.col("broken")).alias("first_broken"), F.col("broken_problem").alias("first_problem"), F.col("broken").isNull().alias("valid"))


def version_of(hashes: DataFrame, settings: dict, prefix: str = "brain", length: int = 10) -> str:
    """The name of what was compiled from the sources (key, sha) with the settings: equal inputs in any order give the same name.

    A tree of hashes: keys of a bucket in order, then BUCKETS hashes on the driver. A bucket's keys and hashes make one row: some thousand for some millions of sources.
    """
    pair = F.to_json(F.struct(F.col("key").cast("string").alias("key"), F.col("sha").alias("sha")))
    each = hashes.select(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(BUCKETS)).alias("b"), _sha(pair).alias("h"))
    parts = each.groupBy("b").agg(_sha(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("h")).orderBy("b").collect()
    text = json.dumps({"settings": settings, "sources": [[r["b"], r["h"]] for r in parts]}, sort_keys=True)
    return f"{prefix}-{hashes.sparkSession.range(1).select(_sha(F.lit(text))).first()[0][:length]}"
