"""Rows joined by what their texts contain."""

from pyspark.sql import functions as F

from tidemark.operators.training import keyed_or_contained


def test_contained_by_pieces(spark):
    keys = ["ab", "b", "", None, "漢字", "zz", "abc", "b", "a.c", "longer than any"]
    texts = [(3, "xabcx"), (1, "xx漢字ab"), (2, None), (4, "abc"), (5, "a.c"), (0, "")]
    left = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    right = spark.createDataFrame(texts, "at int, name string")
    found = keyed_or_contained(left, right, "k", "name", "at", F.col("k"), F.col("name"))
    names = {name: at for at, name in texts if name is not None}
    want = set()
    for k in set(keys):
        inside = sorted(at for at, name in texts if k is not None and name is not None and k in name)
        want.add((k, names[k], "exact") if k in names else (k, inside[0], "contained") if inside else (k, None, None))
    assert sorted(((r["k"], r["at"], r["match"]) for r in found.collect()), key=repr) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan  # no text is searched for every key
