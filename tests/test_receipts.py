"""Chains of receipts against following each one back."""

import hashlib
import json
import random
from pathlib import Path

from tidemark.operators.receipts import chain_report, sealed, version_of

SCHEMA = "run_id int, receipt string, receipt_sha256 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def receipt(before, body, inputs):
    return json.dumps({"before": before, "body": body, "inputs": inputs}, sort_keys=True, separators=(",", ":"))


def made(seed):
    rng, rows, inputs = random.Random(seed), [], []
    for run in range(30):
        inputs += [(run, n, sha(f"{run}{n}")) for n in "ab"]
        before, chain = None, []
        for i in range(rng.randrange(1, 14)):
            text = receipt(before, {"i": i, "run": run}, {n: sha(f"{run}{n}") if rng.random() > 0.04 else "old" for n in rng.sample("ab", rng.randrange(3))})
            chain.append((run, text, sha(text)))
            before = sha(text)
        odd = rng.random()
        at = rng.randrange(len(chain))
        if odd < 0.2:
            del chain[at]
        elif odd < 0.4:
            chain[at] = (run, chain[at][1].replace('"i":', '"j":'), chain[at][2])
        elif odd < 0.6:
            text = receipt(chain[at][2], {"fork": 1}, {})
            chain.append((run, text, sha(text)))
        elif odd < 0.7:
            chain.append(chain[at])
        rows += chain
    return rows, inputs


def plain(rows, inputs):
    now = {(r, n): h for r, n, h in inputs}
    nodes, out = {}, {}
    for run, text, h in rows:
        nodes.setdefault((run, h), []).append(text)
    back = {k: json.loads(v[0])["before"] for k, v in nodes.items()}
    for (run, h), texts in nodes.items():
        held = json.loads(texts[0])
        before = held["before"]
        followers = sum(r == run and b == before for (r, _), b in back.items())
        bad = any(now.get((run, n)) != x for n, x in held["inputs"].items())
        out[run, h] = "changed" if sha(texts[0]) != h else "twice" if len(texts) > 1 else "input" if bad else "gap" if before and (run, before) not in nodes else "fork" if followers > 1 else None
    result = set()
    for run, h in nodes:
        way, at = [], h
        while at is not None and (run, at) in nodes and at not in way:
            way.append(at)
            at = back[run, at]
        if at in way:
            result.add((run, h, -1, out[run, h] or "cycle", h, "cycle", False))
            continue
        first = next((x for x in reversed(way) if out[run, x]), None)
        result.add((run, h, len(way), out[run, h], first, out.get((run, first)), first is None))
    return result


def test_chains(spark):
    rows, inputs = made(2)
    rows += [(50, receipt("B" * 64, {}, {}), "A" * 64), (50, receipt("A" * 64, {}, {}), "B" * 64)]  # a circle, which only changed receipts can make
    got = chain_report(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(inputs, "run_id int, name string, sha256 string")).collect()
    assert {tuple(r) for r in got} == plain(rows, inputs) and len(got) == len({r[::2] for r in rows})
    assert {"changed", "gap", "fork", "input"} <= {r["problem"] for r in got} and any(r["valid"] for r in got)
    assert chain_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sealed(spark):
    rows = spark.createDataFrame([(1, '{"b": 1, "a": "x"}', "p" * 64, {"n": "2", "m": "1"}), (2, "{}", None, None), (3, "{", None, None)], "run_id int, body string, prev string, ins map<string,string>")
    got = {r["run_id"]: r for r in sealed(rows, "body", "prev", "ins").collect()}
    assert got[1]["receipt"] == receipt("p" * 64, {"a": "x", "b": 1}, {"m": "1", "n": "2"}) and got[1]["receipt_sha256"] == sha(got[1]["receipt"])
    assert got[2]["receipt"] == receipt(None, {}, {}) and got[3]["receipt"] is None


def test_version(spark):
    rows = [(f"E{i}", sha(str(i))) for i in range(50)]
    frame = lambda r: spark.createDataFrame(r, "key string, sha string")
    name = version_of(frame(rows), {"mode": "full"})
    assert name == version_of(frame(rows[::-1]), {"mode": "full"}) and name.startswith("brain-") and len(name) == 16
    assert len({name, version_of(frame(rows[1:]), {"mode": "full"}), version_of(frame(rows), {"mode": "catalog"}), version_of(frame([("E0", "x"), *rows[1:]]), {"mode": "full"})}) == 4


def test_long_runs_are_doubled(spark):
    rows, inputs = made(11)
    tables = [spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(inputs, "run_id int, name string, sha256 string")]
    for whole in (0, 6):
        assert {tuple(r) for r in chain_report(*tables, whole=whole).collect()} == plain(rows, inputs), whole


def test_short_runs_are_not_written_round_by_round(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before, rows = None, []
    for i in range(200):
        text = receipt(before, {"i": i}, {})
        before = sha(text)
        rows.append((1, text, before))
    there = set(shared.glob("tidemark-chain-*/*"))
    found = chain_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["depth"] for r in found) == list(range(1, 201)) and all(r["valid"] for r in found)
    assert {p.name for p in set(shared.glob("tidemark-chain-*/*")) - there} == {"thin", "long"}
