"""Imports and prompts on rows that the queries do not hold: nulls, broken payloads, empty tables."""

import json

from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.operators import imports, prompts


def test_envelopes_of_odd_payloads(spark):
    texts = [None, "{broken", "[1]", "{}", '{"record_type": "a", "training_eligible": "true"}', '{"record_type": "a", "training_eligible": true, "brain_delta_id": 3, "edge_id": "e", "status": ""}']
    rows = spark.createDataFrame([(i, "E", t) for i, t in enumerate(texts)], "n int, episode_id string, payload string")
    got = {r["n"]: r for r in imports.envelopes(rows, {"a": F.lit(True)}).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["record_type"] == "unknown" and not got[i]["training_eligible"] for i in range(4))
    assert all(got[i]["normalized_payload_sha256"] is None for i in range(3))
    assert not got[4]["training_eligible"]  # a string is no flag
    assert got[5]["training_eligible"] and got[5]["record_id"] == "e" and got[5]["status"] == "tentative"


def test_pair_needs_both_sides(spark):
    held = {"record_type": imports.PAIR_TYPE, "training_eligible": True, "blind_preferred_ticker": "A", "eligibility_reason": "old"}
    rows = spark.createDataFrame([("E", json.dumps(held)), ("E", json.dumps(held | {"blind_rejected_candidate_id": "B"}))], "episode_id string, payload string")
    got = sorted(imports.envelopes(rows, {imports.PAIR_TYPE: F.lit(True)}).collect(), key=lambda r: r["training_eligible"])
    assert [r["training_eligible"] for r in got] == [False, True]
    assert got[0]["eligibility_reason"] == "old; sealed_preference_pair_missing" and got[0]["typed_payload_status"] == "KNOWN_TYPED_PAYLOAD"
    assert got[1]["eligibility_reason"] == "old"


def test_admit_again_and_empty(spark):
    bundles = spark.createDataFrame([("E", "s")], "episode_id string, sha string")
    records = spark.createDataFrame([("E", 1, "r", "h", None)], "episode_id string, position int, record_id string, sha string, eligible boolean")
    stored = spark.createDataFrame([("r", "E", "h")], "record_id string, episode_id string, sha string")
    assert imports.admit(bundles, records, bundles, stored).first()["outcome"] == "stored"
    assert imports.admit(bundles, records.limit(0), bundles.limit(0), stored.limit(0)).first()["n_records"] == 0
    assert imports.admit(bundles.limit(0), records, bundles, stored).count() == 0


def test_replaced_and_compact(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": "x"}', '{"b": 2}'), ("{", '{"b": 2}'), ('{"b": 1}', None)], "p string, m string")
    assert [r[0] for r in rows.select(payload.replaced(F.col("p"), F.col("m"))).collect()] == ['{"a":"x","b":2}', None, '{"b":1}']
    deep = json.dumps({f"k{i:02}": list(range(20)) for i in range(40)})
    kept = json.loads(spark.createDataFrame([(deep,)], "p string").select(prompts.compact(F.col("p"))).first()[0])
    assert len(kept) == 32 and all(len(v) == 12 for v in kept.values())
    assert spark.createDataFrame([(None,), ("7",)], "p string").select(prompts.compact(F.col("p")).alias("c")).distinct().collect()[0]["c"] == "{}"
