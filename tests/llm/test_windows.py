"""Windows of vectors span as many partitions as they need."""

import numpy as np

from tidemark.llm.vector_dedup import _follow, near_vectors


def test_follow():
    assert _follow({0: 48, 2: 10, 3: 38, 5: 7}, 48) == [(2, 0), (3, 0), (3, 2), (5, 2), (5, 3)]
    assert _follow({}, 48) == []


def test_layout(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(8)
    rows = [(i, 1, (base + 0.16 * rng.standard_normal(8)).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    held, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted((r["vec_id"], r["component_id"], r["n_links"]) for r in near_vectors(vectors, passes=1, window=12).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert found[0] == found[1] and any(n for _, _, n in found[0])
