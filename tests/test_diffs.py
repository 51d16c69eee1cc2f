"""Line diffs: applying one gives the second text; on lines that are all different they are the standard library's."""

import difflib
import random

from pyspark.sql import functions as F

from tidemark.operators import diffs
from tidemark.operators.diffs import changes, line_diffs, rising, unified


def applied(a, b, found):
    out, at = [], 0
    for a0, a1, b0, b1 in found:
        out += a[at:a0] + b[b0:b1]
        at = a1
    return out + a[at:]


def test_changes():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcdefgh") * rng.choice((1, 2)) for _ in range(rng.randrange(14))] for _ in "ab")
        found = changes(a, b)
        assert applied(a, b, found) == b
        assert all(x[1] <= y[0] and x[3] <= y[2] and x[1] - x[0] + x[3] - x[2] for x, y in zip(found, [*found[1:], (99, 99, 99, 99)]))
    assert changes(["a"], ["a"]) == [] and changes([], ["a"]) == [(0, 0, 0, 1)]
    values = rng.sample(range(200), 60)
    best = [1] * 60
    for i in range(60):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    run = rising(values)
    assert len(run) == max(best) and all(values[i] < values[j] for i, j in zip(run, run[1:]))


def test_unified(spark):
    rng, rows = random.Random(2), []
    for k in range(40):
        a = [f"line {i} {k}" for i in range(rng.randrange(40))]
        b = [x for x in a if rng.random() > 0.1]
        for n in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), f"new {n}")
        rows.append((k, "\n".join(a), "\n".join(b) + "\n" * (k % 2)))
    rows += [(90, None, "x\r\ny"), (91, "", None), (92, "same\n", "same")]
    df = line_diffs(spark.createDataFrame(rows, "k int, a string, b string"), "a", "b")
    got = df.withColumn("u", unified(F.col("a"), F.col("b"), F.col("changes"), F.lit("old"), F.lit("new"))).collect()
    for r in got:
        a, b = ((r[c] or "").splitlines() for c in "ab")
        want = list(difflib.unified_diff(a, b, "old", "new", lineterm=""))
        assert r["u"] == want, (r["k"], r["u"], want)
        assert r["added"] - r["removed"] == len(b) - len(a) and (r["status"] == "changed") == (a != b)


def test_changes_applied_give_the_second_text(spark):
    rng = random.Random(9)
    text = lambda: "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))
    pairs = [(i, text() or None, text()) for i in range(60)] + [(60, "a\r\nb\n", "b\nc"), (61, "", ""), (62, "a", "a")]
    rows = diffs.line_diffs(spark.createDataFrame(pairs, "id int, a string, b string"), "a", "b")
    got = rows.select(diffs.applied(F.col("a"), F.col("b"), F.col("changes")).alias("x"), diffs.lines_of(F.col("b")).alias("y")).collect()
    assert len(got) == 63 and all(r["x"] == r["y"] for r in got)
