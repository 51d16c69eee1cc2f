"""Rows without a doc_id, and rows that share one, are documents of their own."""

from collections import Counter

import corpus_pipeline as pipeline

from tests.llm.test_operators import lines_of
from tests.llm.test_pipeline import table
from tidemark.llm.cube_mix import cube_mix
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.shingle_join import shingle_classes


def test_mixture(spark):
    texts = [" ".join(lines_of(2, 50 + i)) for i in range(60)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    docs = table(spark, rows)
    taken = Counter(r["text"] for r in pipeline.mixture(spark, docs, "").collect())
    size = dict(zip(texts, (len(t.split()) for t in texts), strict=True))
    for source in "ab":
        own = [t for i, t in enumerate(texts) if "ab"[i % 2] == source]
        target = cube_mix(docs).where(f"source = '{source}'").first()["target"]
        assert abs(sum(taken[t] * size[t] for t in own) - target) <= max(size.values())
    assert any(taken[t] for t in texts[::3]) and any(taken[t] for t in texts[1::3])


def test_lines(spark):
    own = lines_of(8, 70)
    texts = [(None, own[0] + "\n" + own[1]), (None, own[2] + "\n" + own[0]), (None, own[3] + "\n" + own[4]), (5, own[5] + "\n" + own[6]), (5, own[5] + "\n" + own[7])]
    got = dedup_lines(table(spark, [(i, t, "en", "a") for i, t in texts]).coalesce(1)).collect()
    kept = Counter(x for r in got for x in r["text"].split("\n") if x)
    assert kept == Counter(own) and sorted(r["n_kept"] for r in got) == [1, 1, 2, 2, 2]


def test_near_duplicates(spark):
    a, b, c = (" ".join(lines_of(8, 80 + i)) for i in range(3))
    rows = [(3, a), (5, a + " more"), (5, b), (7, b + " more"), (None, c), (None, c + " more"), (9, None), (9, None)]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in shingle_classes(docs).collect()}
    size = len(a.split()) - 4
    assert [got[i, size + more] for i, more in ((3, 0), (5, 1), (5, 0), (7, 1), (None, 0))] == [3, 3, 5, 5, None]
    left = pipeline.near_duplicates(spark, docs, "").collect()
    found = Counter(next((k for k, x in enumerate((a, b, c)) if (r["text"] or "-").startswith(x)), None) for r in left)
    assert found == {0: 1, 1: 1, 2: 1, None: 1} and {r["doc_id"] for r in left} == {3, 5, None, 9}


def test_short_lines(spark):
    texts = ["-----\nababab", "------\nbababa\nabcdefg", "-------", "----------\nabcdefh", "漢字漢字漢字", "字漢字漢字漢"]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert got == {0: texts[0], 1: "abcdefg", 2: "", 3: "abcdefh", 4: texts[4], 5: ""}
