"""Rules as data: each kind on a few rows, and one scan of each table however many rules there are."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.rulebook import RULES, Counted, Refers, Row, Total, Unique, facts, findings
from tidemark.plans.checks import SUBJECTS

AT = datetime.datetime(2024, 1, 1)


def tables(spark):
    a = [(1, "x", 10, AT, 2), (2, "x", None, None, 0), (2, None, 7, AT, None), (None, "z", 8, AT + datetime.timedelta(1), 1)]
    b = [("x", 10, AT, 0.5), ("x", 9, AT, 0.25), ("y", None, None, 1.0), (None, 1, AT, 3.0)]
    return {"a": (spark.createDataFrame(a, "id int, ref string, v int, at timestamp, n int"), "id"), "b": (spark.createDataFrame(b, "k string, v int, at timestamp, w double"), "concat(k, '-', v)")}


def test_kinds(spark):
    rules = [
        Row("NO_V", "a", "v IS NULL"), Row("V_TEN", "a", "v = 10"), Unique("A_TWICE", "a", "id"), Unique("B_TWICE", "b", "k"), Refers("LOST", "a", "ref", ("b", "k")),
        Refers("V_DIFFERS", "a", "id", ("a", "id"), "v", "v"), Refers("EARLY", "b", "v", ("a", "v"), "at", "at", "not before"), Total("SUM", "b", "k", "w", "total <> 1"), Total("SOME", "b", "k", "w", "n > 1 AND least < 0.3", "v IS NOT NULL"), Counted("COUNT", "a", "ref", "n", ("b", "k")),
    ]
    got = sorted((r["check_id"], r["subject_id"] or "-", r["detail"] or "-") for r in findings(rules, tables(spark)).collect())
    assert got == sorted([
        ("NO_V", "2", "-"), ("V_TEN", "1", "-"), ("A_TWICE", "2", "2"), ("B_TWICE", "x", "2"), ("LOST", "-", "z"), ("V_DIFFERS", "2", "2"), ("SUM", "x", "2"), ("SOME", "x", "2"), ("COUNT", "2", "2"), ("COUNT", "-", "0"),
    ])
    with pytest.raises(ValueError, match="one name"):
        findings([rules[0], rules[0]], tables(spark))
    assert findings(rules, {n: (d.limit(0), s) for n, (d, s) in tables(spark).items()}).collect() == []


def test_one_scan_a_table(spark, tmp_path):
    """The 58 rules of the book read each of their tables once."""
    own = {}
    folder = "/root/testdata/sf0.001"
    for name in ("orders", "lineitem", "clients", "sales", "events", "clicks"):
        try:
            spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
        except Exception:
            pytest.skip("test tables are not here")
    own = {name: (spark.sql(sql), subject) for name, (sql, subject) in {n: (s, k) for n, (k, s) in SUBJECTS.items()}.items()}
    plan = facts(RULES, own)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plan)
    assert len(RULES) >= 50 and sorted(scans) == sorted(["orders", "lineitem", "clients", "sales", "events", "clicks", "lineitem"])
    assert "Exchange" not in plan and "Python" not in plan
    assert facts(RULES, own).where(F.col("role") == "found").limit(1).count() == 1


def test_counts_are_hashed(spark):
    """Keys that must be unique are counted without sorting them."""
    plan = findings([Unique("A_TWICE", "a", "id"), Unique("B_TWICE", "b", "k")], tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
