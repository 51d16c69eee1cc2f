"""Normalisation of nested records against a plain version, member by member."""

import json
import random
from pathlib import Path

from tidemark.operators.direct_ingest import ALIASES, DIRECT, ISSUER, TARGETS, normalised

MISSING = object()


def text(v):
    return v if isinstance(v, str) and v else None


def texts(v):
    return [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def refs(r, *names):
    return [x for n in names for x in ([r[n]] if text(r.get(n)) else [y for y in texts(r.get(n)) if y])]


def plain(records, facts, sources):
    """What the rules say, one record after the other."""
    out = {}
    for bundle, line, payload in records:
        try:
            own = json.loads(payload)
        except (TypeError, ValueError):
            own = None
        if not isinstance(own, dict):
            out[bundle, line] = None
            continue
        inner = own["payload"] if isinstance(own.get("payload"), dict) else {}
        r = inner | own
        company = next((x for x in (text(r.get("company_name")), *[text(inner.get(n)) for n in ("company_name", "entity_name", "name", "name_on_D")]) if x), None)
        lacking = lambda name, value: r.setdefault(name, value) if value is not MISSING else None  # noqa: E731, B023
        lacking("company_name", company or MISSING)
        lacking("path_type", text(r.get("candidate_lane")) or MISSING)
        ids = texts(r.get("fact_ids"))
        for x in [text(r.get("fact_id")), *texts(r.get("source_fact_ids"))]:
            if x is not None and x not in ids:
                ids.append(x)
        if ids:
            r["fact_ids"] = ids
            lacking("blind_fact_ids", ids)
        names = ("ticker", "company_name", "outcome_high_return_pct", "outcome_close_return_pct", "outcome_high_return_rank", "upper_limit_touched")
        outcome = {n.removeprefix("outcome_"): r[n] for n in names if n in r}
        lacking("D_outcome", outcome or MISSING)
        kind, record, ticker, day = text(r.get("record_type")), text(r.get("brain_delta_id")) or text(r.get("record_id")), text(r.get("ticker")), text(r.get("trade_date"))
        group = f"{day}:{ticker}" if day and ticker else None
        stand = {"ticker": ticker, "company": text(r.get("company_name")), "record": record, "group": group, "group_known": group or MISSING, "record_or_group": record or group, "classification": r.get("classification"), "audit": r.get("audit_id") or record, "verified": (r["pair_direction_verified"] is True) if "pair_direction_verified" in r else MISSING}
        for name, value in ALIASES.get(kind, {}).items():
            lacking(name, stand[value])
        listed = texts(r.get("provenance_source_ids"))
        fact_of = {f: s for b, _, f, s in sorted(facts, key=lambda x: x[1]) if b == bundle and f and s}
        row_of = {w: s for b, _, s, w in sorted(sources, key=lambda x: x[1]) if b == bundle and w and s}
        there = {s for b, _, s, _ in sources if b == bundle}
        for x in [*refs(r, "source_id", "source_ids"), *[fact_of.get(f) for f in refs(r, "fact_id", "fact_ids", "source_fact_ids")], *[row_of.get(w) for w in refs(r, "row_id", "matched_row_ids")]]:
            if x and x not in listed:
                listed.append(x)
        if not listed and "SRC-BLIND-SNAPSHOT" in there and {"blind_score", "blind_rank", "candidate_lane", "matched_screening_ids", "screening_id"} & set(r):
            listed = ["SRC-BLIND-SNAPSHOT"]
        if not listed and "SRC-GOLD-REFERENCE" in there and set(names) & set(r):
            listed = ["SRC-GOLD-REFERENCE"]
        if listed:
            r["provenance_source_ids"] = listed
        lacking("training_target", TARGETS.get(kind))
        said = (text(r.get("source_phase")) or "").upper()
        phase = "POSTMORTEM" if "POSTSEAL" in said or "OUTCOME" in said else "BLIND" if "BLIND" in said else "AUDIT" if "AUDIT" in said else "AUDIT" if kind == "memory_claim" else "POSTMORTEM"
        lacking("evidence_phase", phase)
        lacking("status", "supported")
        out[bundle, line] = r
    number = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else 0.0
    groups = {}
    for (bundle, _), r in out.items():
        if r and r.get("record_type") in (ISSUER, DIRECT) and r.get("training_eligible") is True and text(r.get("ticker")) and text(r.get("trade_date")):
            groups.setdefault((bundle, r["record_type"], f"{r['trade_date']}:{r['ticker']}"), []).append(r)
    for (_, kind, group), rows in groups.items():
        given = sum(number(r.get("sample_weight")) for r in rows if number(r.get("sample_weight")) > 0)
        missing = [r for r in rows if number(r.get("sample_weight")) == 0]
        for r in missing:
            r["sample_weight"] = max(0.0, 1 - given) / len(missing)
        for r in rows:
            r.setdefault("issuer_day_weight_group_id", group)
            if kind == ISSUER:
                r["issuer_day_sample_weight_policy"] = "fractional_issuer_day_group"
            r.setdefault("issuer_day_case_id", (text(r.get("brain_delta_id")) or text(r.get("record_id")) or group) if kind == ISSUER else group)
    return out


VALUES = {
    "record_type": [*ALIASES, "memory_claim", "other", None, 3], "ticker": ["T1", "T2", "", None, 7], "trade_date": ["2024-01-02", "2024-01-03", None], "company_name": ["Co", "", None], "entity_name": ["En"], "name": ["Na", 4],
    "brain_delta_id": ["B1", ""], "record_id": ["R1", None], "fact_id": ["F1", "F2", ""], "fact_ids": [["F3", "", 1, "F1"], [], "F2", None], "source_fact_ids": [["F4", "F3", "F4"], {}], "candidate_lane": ["lane", None, ""],
    "outcome_high_return_pct": [1.5, None], "upper_limit_touched": [True], "source_id": ["S1"], "source_ids": [["S2", "S1", ""], "S3"], "row_id": ["W1"], "matched_row_ids": [["W2", "W9"]], "provenance_source_ids": [["P1", "S1", None], []],
    "training_eligible": [True, True, False, "true"], "sample_weight": [0, 0.25, 0.5, -1, None, "1", True, 2], "classification": ["c", None, {"deep": [1, {"er": None}]}], "audit_id": ["A1", 0, "", [], {"x": 1}], "pair_direction_verified": [True, False, None, "yes"],
    "source_phase": ["postseal", "Blind run", "audit", ""], "evidence_phase": ["X", None], "issuer_day_case_id": [None, "own"], "error_type": [None], "status": [None, "ok"], "blind_rank": [1], "D_outcome": [None],
}


def made(seed, n):
    rng = random.Random(seed)
    pick = lambda share: {k: rng.choice(v) for k, v in VALUES.items() if rng.random() < share}
    rows = []
    for i in range(n):
        r = pick(0.35) | {"record_type": rng.choice(VALUES["record_type"])}
        if rng.random() < 0.8:
            r["payload"] = pick(0.3) | {"inner": {"deeper": [None, {"x": 1}]}} if rng.random() < 0.9 else rng.choice([None, [], "x", {}])
        rows.append((i % 7, i, json.dumps(r)))
    rows += [(0, n, None), (0, n + 1, "{broken"), (0, n + 2, "[1]"), (0, n + 3, "{}"), (99, 0, '{"ticker":"T1","blind_rank":null}')]
    facts = [(b, k, f"F{rng.randrange(5)}", rng.choice(["S1", "S4", "S5", None, ""])) for b in range(6) for k in range(6)]
    sources = [(b, k, rng.choice(["S1", "S6", "SRC-BLIND-SNAPSHOT", "SRC-GOLD-REFERENCE", None]), rng.choice(["W1", "W2", None])) for b in range(7) for k in range(4)]
    return rows, facts, sources


def test_plain(spark):
    rows, facts, sources = made(11, 600)
    tables = spark.createDataFrame(rows, "bundle_id int, line int, payload string"), spark.createDataFrame(facts, "bundle_id int, line int, fact_id string, source_id string"), spark.createDataFrame(sources, "bundle_id int, line int, source_id string, row_id string")
    got = {(r["bundle_id"], r["line"]): r["payload"] and json.loads(r["payload"]) for r in normalised(*tables).collect()}
    want = plain(rows, facts, sources)
    assert set(got) == set(want)
    for k in want:
        if want[k] and isinstance(want[k].get("sample_weight"), float):
            assert abs(got[k].pop("sample_weight") - want[k].pop("sample_weight")) < 1e-12, k
        assert got[k] == want[k], (k, rows[k[1]] if k[1] < len(rows) else None)


def test_empty(spark):
    none = [spark.createDataFrame([], s) for s in ("bundle_id int, line int, payload string, note string", "bundle_id int, line int, fact_id string, source_id string", "bundle_id int, line int, source_id string, row_id string")]
    df = normalised(*none)
    assert df.columns == ["bundle_id", "line", "payload", "note"] and df.collect() == []
    assert "Python" not in df._jdf.queryExecution().toString()


def test_dealt_out(spark):
    """Records of one partition are parsed by several tasks."""
    rows, facts, sources = made(5, 40)
    tables = spark.createDataFrame(rows, "bundle_id int, line int, payload string").coalesce(1), spark.createDataFrame(facts, "bundle_id int, line int, fact_id string, source_id string"), spark.createDataFrame(sources, "bundle_id int, line int, source_id string, row_id string")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("tidemark-ingest-*/flat/*.parquet"))
    assert normalised(*tables).count() == len(rows)
    assert len(set(shared.glob("tidemark-ingest-*/flat/*.parquet")) - before) == 4
