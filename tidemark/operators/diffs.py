"""Line diffs of pairs of texts, a pair a row.

Lines that both sides have just once are anchors. Of those the longest run that rises on both sides stands; between two anchors the same is done again, until a stretch has no
anchor: it is replaced as a whole. Equal lines at a stretch's ends are taken off first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import bound

OPS = "array<struct<a_from: int, a_to: int, b_from: int, b_to: int>>"


def rising(values: list[int]) -> list[int]:
    """The places of a longest strictly rising run of values (all different)."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k:k + 1], ends[k:k + 1] = [v], [i]
        back[i] = ends[k - 1] if k else -1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def changes(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """The stretches of ``a`` and ``b`` that stand for each other, in order; what lies between them is equal."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 and b0 == b1:
            continue
        once_a, once_b = (Counter(x) for x in (a[a0:a1], b[b0:b1]))
        at = {line: j for j, line in enumerate(b[b0:b1], b0) if once_b[line] == 1}
        pairs = [(i, at[line]) for i, line in enumerate(a[a0:a1], a0) if once_a[line] == 1 and line in at]
        kept = [pairs[k] for k in rising([j for _, j in pairs])]
        if not kept:
            out.append((a0, a1, b0, b1))
            continue
        for i, j in kept:
            todo.append((a0, i, b0, j))
            a0, b0 = i + 1, j + 1
        todo.append((a0, a1, b0, b1))
    return sorted(out)


def line_changes(a: Column, b: Column) -> Column:
    """For two columns of lists of lines the stretches that differ, ends excluded, counted from 0. Null lists are empty."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        one = lambda x: [] if x is None else list(x)
        return pd.Series([[dict(zip(("a_from", "a_to", "b_from", "b_to"), c, strict=True)) for c in changes(one(x), one(y))] for x, y in zip(left, right, strict=True)])

    return F.pandas_udf(run, OPS)(a, b)


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends; an end at the end of a text opens no line, a null or empty text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "(\r\n|\r|\n)$", ""), "\r\n|\r|\n"))


def line_diffs(pairs: DataFrame, a: str, b: str, changes_to: str = "changes") -> DataFrame:
    """``pairs`` with the columns ``changes`` (see ``line_changes``), ``removed`` and ``added``: how many lines are gone and new, and ``status``: unchanged or changed."""
    spans = F.col(changes_to)
    size = lambda side: F.aggregate(spans, F.lit(0), lambda n, c: n + c[f"{side}_to"] - c[f"{side}_from"])
    rows = pairs.withColumn(changes_to, line_changes(lines_of(F.col(a)), lines_of(F.col(b))))
    return rows.withColumns({"removed": size("a"), "added": size("b"), "status": F.when(F.size(spans) == 0, "unchanged").otherwise("changed")})


def applied(a: Column, b: Column, spans: Column) -> Column:
    """The lines of ``a`` with its changes put in from ``b``. Texts are cut into lines once, and each stretch is copied once."""
    cut = lambda lines, lo, hi: F.slice(lines, lo + 1, F.greatest(hi - lo, F.lit(0)))

    def walked(s: Column) -> Column:
        x, y, c = s["a"], s["b"], s["spans"]
        since = lambda i: F.coalesce(F.get(c, i - 1)["a_to"], F.lit(0))
        pieces = F.transform(c, lambda one, i: F.concat(cut(x, since(i), one["a_from"]), cut(y, one["b_from"], one["b_to"])))
        return F.concat(F.flatten(pieces), cut(x, since(F.size(c)), F.size(x)))

    return bound(F.struct(lines_of(a).alias("a"), lines_of(b).alias("b"), spans.alias("spans")), walked)


def unified(a: Column, b: Column, spans: Column, old_name: Column, new_name: Column, context: int = 3) -> Column:
    """The unified diff of two texts as a list of lines, from their changes; an empty list if there are none."""
    x, y, grown = lines_of(a), lines_of(b), F.array().cast(OPS)
    near = lambda g, c: F.element_at(g["spans"], -1)["a_to"] + 2 * context >= c["a_from"]
    group = F.struct(grown.alias("spans"))
    # Changes that lie closer than twice the context share a hunk.
    hunks = F.aggregate(
        spans,
        F.array().cast(f"array<struct<spans: {OPS}>>"),
        lambda acc, c: F.when((F.size(acc) > 0) & near(F.coalesce(F.try_element_at(acc, F.lit(-1)), group), c), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.array_append(F.try_element_at(acc, F.lit(-1))["spans"], c).alias("spans"))))).otherwise(
            F.array_append(acc, F.struct(F.array(c).alias("spans")))
        ),
    )
    cut = lambda lines, lo, hi: F.slice(lines, lo + 1, F.greatest(hi - lo, F.lit(0)))
    signed = lambda sign, lines: F.transform(lines, lambda s: F.concat(F.lit(sign), s))

    def place(lo: Column, n: Column) -> Column:
        return F.when(n == 1, (lo + 1).cast("string")).otherwise(F.concat_ws(",", F.when(n == 0, lo).otherwise(lo + 1).cast("string"), n.cast("string")))

    def body(h: Column) -> Column:
        s = h["spans"]
        first, last = s[0], F.element_at(s, -1)
        a0, a1 = F.greatest(first["a_from"] - context, F.lit(0)), F.least(last["a_to"] + context, F.size(x))
        b0, b1 = F.greatest(first["b_from"] - context, F.lit(0)), F.least(last["b_to"] + context, F.size(y))
        head = F.concat(F.lit("@@ -"), place(a0, a1 - a0), F.lit(" +"), place(b0, b1 - b0), F.lit(" @@"))
        start = F.struct(a0.alias("at"), F.array(head).alias("out"))
        walked = F.aggregate(s, start, lambda acc, c: F.struct(c["a_to"].alias("at"), F.concat(acc["out"], signed(" ", cut(x, acc["at"], c["a_from"])), signed("-", cut(x, c["a_from"], c["a_to"])), signed("+", cut(y, c["b_from"], c["b_to"]))).alias("out")))
        return F.concat(walked["out"], signed(" ", cut(x, walked["at"], a1)))

    names = F.array(F.concat(F.lit("--- "), old_name), F.concat(F.lit("+++ "), new_name))
    return F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(F.concat(names, F.flatten(F.transform(hunks, body))))
