"""Every condition of a bundle with a case that breaks it, and one that doesn't."""

import hashlib
import json

from tidemark.operators import imports
from tidemark.operators.validation import bundle_findings


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


GOOD = [
    {"record_type": "supervised_issuer_day_case", "record_id": "R1", "training_eligible": True, "ticker": "T", "trade_date": "2024-01-02", "sample_weight": 0.5, "issuer_day_sample_weight_policy": "fractional_issuer_day_group", "event_level_weights": {"a": 0.25, "b": 0.75}, "provenance_source_ids": ["S1"], "available_from": "2024-01-02T10:00:00+09:00"},
    {"record_type": "supervised_issuer_day_case", "record_id": "R2", "training_eligible": True, "ticker": "T", "trade_date": "2024-01-02", "sample_weight": 0.5, "issuer_day_sample_weight_policy": "fractional_issuer_day_group", "label_quality": "verified"},
    {"record_type": "supervised_direct_event_case", "record_id": "R3", "training_eligible": True, "issuer_day_case_id": "C", "sample_weight": 1, "fact_ids": ["F1"], "fact_id": "F1"},
    {"record_type": "event_ticker_edge", "record_id": "R4", "training_eligible": True, "edge_origin": "news", "time_verified": True, "available_before_cutoff": True, "provenance_source_ids": ["S2", "S1"]},
    {"record_type": "company_memory_delta", "record_id": "R5", "known_at": "2024-01-02T10:00:00+09:00", "available_from": "2024-01-02T00:30:00Z"},
    {"record_type": "unheard_of", "ticker": 7, "known_at": 3},
]


def run(spark, changes):
    """The findings of bundles, each the good one with something changed: (bundles, {bundle_id: checks})."""
    rows = {n: [] for n in ("bundles", "records", "sources", "definitions", "blocks", "expected", "declared", "loss")}
    for k, change in enumerate(changes):
        records = change.get("records", GOOD)
        n, ne = change.get("counts", (len(records), sum(isinstance(r, dict) and r.get("training_eligible") is True for r in records)))
        rows["bundles"].append((k, n, ne))
        rows["records"] += [(k, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
        rows["sources"] += [(k, *s) for s in change.get("sources", [(0, "S1", True, True), (1, "S2", False, True)])]
        rows["definitions"] += [(k, "fact", "F1"), (k + 1000, "fact", "F2")]
        rows["blocks"] += [(k, "a.json", "text"), (k, "b.json", None)]
        rows["expected"] += [(k, *e) for e in change.get("expected", [("a.json", 0, sha("text"), False), ("gone.json", 0, "x", False)])]
        rows["declared"].append((k, "front_matter.available_from", change.get("declared", "2024-01-01")))
        rows["loss"].append((k, change.get("loss", True)))
    kinds = {
        "bundles": "record_count int, eligible_count int", "records": "line int, payload string", "sources": "line int, source_id string, time_verified boolean, available_before_cutoff boolean", "definitions": "kind string, id string",
        "blocks": "block string, content string", "expected": "block string, position int, sha256 string, embedded boolean", "declared": "field string, value string", "loss": "passed boolean",
    }
    tables = [spark.createDataFrame(rows[n], f"bundle_id int, {schema}") for n, schema in kinds.items()]
    found = bundle_findings(*tables)
    got = {k: set() for k in range(len(changes))}
    for r in found.collect():
        got[r["bundle_id"]].add(r["check_id"])
    return tables[0], found, got


def altered(at, **members):
    return [r | members if i == at else r for i, r in enumerate(GOOD)]


CASES = {
    "record_count": [{"counts": (9, 4)}], "training_eligible_count": [{"counts": (6, 1)}], "block_hash": [{"expected": [("a.json", 0, sha("other"), False)]}, {"expected": [("a.json", 0, sha("text"), False), ("a.json", 1, "z", True)]}],
    "hash_expectation": [{"expected": [("a.json", 0, sha("text"), True), ("a.json", 1, "z", False)]}], "source_reference": [{"records": altered(1, provenance_source_ids=["S9"])}], "payload_reference": [{"records": altered(0, x={"y": [{"support_fact_ids": ["F2"]}]})}],
    "available_from": [{"declared": "soon"}, {"declared": None}, {"records": altered(0, available_from="soon")}, {"records": altered(1, available_from=None)}], "outcome_label_quality": [{"records": altered(1, label_quality="good")}, {"records": altered(1, D_outcome={"label_quality": None})}],
    "typed_payload": [{"records": altered(0, company_name=4)}, {"records": altered(2, fact_ids=["F1", 2])}, {"records": altered(2, fact_ids=None)}, {"records": altered(2, D_outcome=[])}],
    "edge_cutoff_provenance": [{"records": altered(3, edge_origin="outcome-only association")}, {"records": altered(3, time_verified="true")}], "edge_source_ledger_cutoff": [{"records": altered(3, provenance_source_ids=["S2"])}, {"sources": [(0, "S1", True, True), (2, "S1", True, None), (1, "S2", False, True)]}],
    "company_known_at": [{"records": altered(4, known_at="2024-01-02T10:00:00")}, {"records": altered(4, known_at=5)}], "company_known_at_backdated": [{"records": altered(4, known_at="2024-01-02T09:00:00+09:00")}],
    "issuer_day_weights": [{"records": altered(0, event_level_weights={"a": 0.5})}, {"records": altered(0, event_level_weights={})}], "sample_weights": [{"records": altered(1, sample_weight=0.25)}, {"records": altered(1, issuer_day_sample_weight_policy=None)}, {"records": altered(2, sample_weight="1")}],
    "import_loss": [{"loss": False}, {"loss": None}],
}


def test_conditions(spark):
    assert set(CASES) == set(imports.CHECKS)
    changes = [{}, {"records": [*GOOD, "{broken"], "counts": (7, 4)}, *[c for each in CASES.values() for c in each]]
    names = [None, None, *[check for check, each in CASES.items() for _ in each]]
    bundles, found, got = run(spark, changes)
    for k, check in enumerate(names):
        # An embedded hash that differs is a conflict as well.
        more = {"hash_expectation"} if check == "block_hash" else set()
        assert got[k] == set() if check is None else check in got[k] and got[k] <= {check} | more, (check, changes[k], got[k])
    verdict = {r["bundle_id"]: r for r in imports.verdicts(bundles, found).collect()}
    assert all(verdict[k]["passed"] == (check is None) and (check is None or verdict[k][check] > 0) for k, check in enumerate(names))
