"""Payloads as rows against a walk in Python; the index over them."""

import json
import random

from pyspark.sql import functions as F

from tidemark.functions.payload import references as walked
from tidemark.operators import json_tree
from tidemark.operators.json_tree import FIELDS, InvertedIndex, objects_with, postings, references, tree
from tidemark.stages import Stages

NAMES = ["ticker", "peer_universe", "D_outcome", "outcome", "code", "fact_id", "support_fact_ids", "a_fact_or_inference_id", "event_ids", "x", "url", "time_verified", "odd name", 'q"\\', "theme_ids"]


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice([None, True, False, 0, 7, -2.5, "", " A ", "B", "FACT-1", "INF-2", "EVT-3", "漢"])
    if kind < 0.7:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NAMES): made(rng, depth - 1) for _ in range(rng.randrange(5))}


def step(name):
    return f".{name}" if name.isidentifier() else '."' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def nodes(value, path="$", member=None, where="$", lists=0):
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else {str: "string", list: "array", dict: "object"}[type(value)]
    text = value if kind == "string" else json.dumps(value) if kind in ("number", "boolean") else None
    yield path, member, where, lists, kind, text, tuple(sorted(value)) if kind == "object" else None
    for i, x in enumerate(value) if kind == "array" else ():
        yield from nodes(x, f"{path}[{i}]", member, where, lists + 1)
    for name, x in value.items() if kind == "object" else ():
        yield from nodes(x, path + step(name), name, path + step(name), 0)


def test_tree(spark, tmp_path):
    rng = random.Random(4)
    payloads = [json.dumps({n: made(rng, 7) for n in rng.sample(NAMES, 6)}) for _ in range(60)] + [None, "{broken", "3", "[[[[[[[[[[1]]]]]]]]]]", "{}", "null"]
    rows = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    held = tree(rows, "id", "payload").persist()
    got = sorted(((r["id"], r["path"], r["member"], r["member_path"], r["lists"], r["kind"], r["text"], tuple(sorted(r["names"])) if r["names"] is not None else None) for r in held.collect()), key=repr)
    valid = {}
    for i, p in enumerate(payloads):
        try:
            valid[i] = json.loads(p)
        except (TypeError, ValueError):
            pass
    assert got == sorted(((i, *n) for i, v in valid.items() for n in nodes(v)), key=repr)
    want = {(r["id"], x["kind"], x["id"]) for r in rows.select("id", walked(F.col("payload")).alias("r")).collect() for x in r["r"]}
    assert {tuple(r) for r in references(held, "id").collect()} == want and want
    paths = {i: [n for n in nodes(v)] for i, v in valid.items()}
    found = objects_with(held, "id", values=("url",)).collect()
    assert {(r["id"], r["path"]) for r in found} == {(i, n[0]) for i, ns in paths.items() for n in ns if n[4] == "object" and {"url", "time_verified"} & set(n[6])}
    assert all(r["url"] == next((n[5] for n in paths[r["id"]] if n[0] == r["path"] + ".url"), None) for r in found)
    values = {(f, n[5].strip() if n[4] == "string" else n[5], i) for i, ns in paths.items() for n in ns for f, names in FIELDS.items() if n[4] in ("string", "number") and n[2].removeprefix("$.") in names and n[5].strip()}
    entries = postings(held, "id")
    assert {tuple(r) for r in entries.collect()} == values and len({v[0] for v in values}) >= 2
    index = InvertedIndex(spark, str(tmp_path / "index"), "id", 16)
    index.write(entries)
    narrowed = index.narrowed(rows, {"ticker": "A", "theme_id": "B"})
    both = {i for f, v, i in values if (f, v) == ("ticker", "A")} & {i for f, v, i in values if (f, v) == ("theme_id", "B")}
    assert {r["id"] for r in narrowed.collect()} == both
    assert "PartitionFilters: [isnotnull(field" in narrowed._jdf.queryExecution().executedPlan().toString()
    queries = spark.createDataFrame([(1, "ticker", "A"), (1, "theme_id", "B"), (1, "ticker", "A"), (2, "ticker", "nowhere"), (3, "ticker", "7")], "query_id int, field string, value string")
    assert {tuple(r) for r in index.answers(queries, rows).collect()} == {(1, i) for i in both} | {(3, i) for f, v, i in values if (f, v) == ("ticker", "7")}
    assert "Python" not in held._jdf.queryExecution().toString()


def _saved(monkeypatch):
    """The rows of every table that is written between the steps, by name."""
    held, save = {}, Stages.save

    def counted(self, df, name):
        out = save(self, df, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(Stages, "save", counted)
    return held


def test_queries_that_ask_the_same_are_answered_once(spark, tmp_path, monkeypatch):
    records = spark.range(3000).select(F.col("id"), F.format_string('{"ticker": "T%s", "path_type": "P"}', (F.col("id") % 3).cast("string")).alias("payload"))
    index = InvertedIndex(spark, str(tmp_path / "index"), "id", 4)
    index.write(postings(tree(records, "id", "payload"), "id"))
    asks = F.explode(F.array(F.struct(F.lit("ticker").alias("field"), F.format_string("T%s", (F.col("id") % 2).cast("string")).alias("value")), F.struct(F.lit("path_type").alias("field"), F.lit("P").alias("value"))))
    queries = spark.range(2000).select(F.col("id").alias("query_id"), asks.alias("a")).select("query_id", "a.*")
    more = spark.createDataFrame([(9001, "ticker", "T2"), (9001, "ticker", None), (9002, "ticker", "T1")], "query_id long, field string, value string")
    held = _saved(monkeypatch)
    got = index.answers(queries.unionByName(more), records)
    assert got.groupBy("query_id").count().groupBy("count").count().collect() == [(1000, 2001)]
    assert got.where(F.col("query_id") < 9001).where("query_id % 2 <> id % 3").count() == 0 and got.where("query_id = 9001").count() == 0 and got.distinct().count() == 2001000
    # Two conjunctions and two single questions, whoever asks them: no step holds a row for each query and record.
    assert held["full"] == 3000 and max(held.values()) <= 3000


def test_values_are_unfolded_once(spark, monkeypatch):
    held = _saved(monkeypatch)
    rows = spark.range(5).select("id", F.lit('{"a": [1, {"b": null}], "c": "x"}').alias("payload"))
    found = tree(rows, "id", "payload")
    assert found.count() == 5 * 6 and held == {"parsed": 5, "level0": 5, "level1": 10, "level2": 10, "level3": 5}
    plan = found.select("path", "text")._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan and "variant_explode" not in plan


def test_blocks_of_answers_are_not_multiplied_in_one_step(spark, tmp_path):
    records = spark.range(2500).select(F.col("id"), F.lit('{"ticker": "T"}').alias("payload"))
    index = InvertedIndex(spark, str(tmp_path / "index"), "id", 4)
    index.write(postings(tree(records, "id", "payload"), "id"))
    got = index.answers(spark.range(1500).select(F.col("id").alias("query_id"), F.lit("ticker").alias("field"), F.lit("T").alias("value")), records)
    assert got.count() == got.distinct().count() == 2500 * 1500
    # Generated code runs until all rows of its input row are made: ids of both blocks in one step would be a million rows on the heap of a task.
    steps = [line.strip(" :+-*").split(" ")[0] for line in got._jdf.queryExecution().sparkPlan().toString().splitlines()]
    first, last = [i for i, s in enumerate(steps) if s == "Generate"][:2]
    assert "Coalesce" in steps[first:last], steps


def test_payloads_are_dealt_out_before_they_are_parsed(spark, monkeypatch):
    held, save = {}, Stages.save
    monkeypatch.setattr(Stages, "save", lambda self, df, name: held.setdefault(name, save(self, df, name)))
    monkeypatch.setattr(json_tree, "PAYLOADS", 10)
    rows = spark.range(50).coalesce(1).select("id", F.lit('{"a": [1]}').alias("payload"))
    assert tree(rows, "id", "payload").count() == 150
    assert len(held["parsed"].inputFiles()) == 5
