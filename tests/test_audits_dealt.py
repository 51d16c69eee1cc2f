"""Audits by key deal rows into parts by their number."""

import re

from tidemark.operators import audits


def test_parts_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(audits, "ROWS", 5)
    asked, known = spark.range(100).selectExpr("id % 7 AS s", "id AS k"), spark.range(0, 100, 2).selectExpr("id AS k")
    plan = audits.missing(asked, known, "GONE", "s", "k")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\([^)]*, 20\)", plan)
    got = {(r["subject_id"], r["detail"]) for r in audits.missing(asked, known, "GONE", "s", "k").collect()}
    assert got == {(str(k % 7), str(k)) for k in range(1, 100, 2)}
    assert audits.duplicate(asked, "TWICE", "s").count() == 7
