"""The exchange in two steps: the same answers as in one, and rows that grow with the text."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exchange, line_dedup, lm_score, shingle_join
from tidemark.llm.common import Scratch, fold

SCHEMA = "doc_id long, text string, block string, bucket string, who string"


@pytest.fixture
def two_steps(monkeypatch):
    """Turns the second step on for small tables, with several groups of blocks."""

    def on():
        monkeypatch.setattr(exchange, "FAN", 1)
        monkeypatch.setattr(exchange, "BLOCK_BYTES", 20_000)

    return on


def corpus(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    near = [t.replace(t.split()[0], "other", 1) for t in texts[:20]]
    lines = ["\n".join([f"a line of the page with number {k} of all", t, "one line that all the documents share, word by word"]) for k, t in enumerate(texts[20:40])]
    odd = [(None, texts[0]), (None, None), (3, texts[5]), (3, texts[6]), (500, ""), (501, None), (502, " \n \t"), (503, "x"), (504, "\n".join(texts) * 3), (505, "É é\n\nÉ é")]
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(near)), *((200 + i, t) for i, t in enumerate(lines)), *((300 + i, texts[1]) for i in range(15)), *odd]
    return spark.createDataFrame([(i, t, "b", "k", "w") for i, t in rows], SCHEMA).repartition(9)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_plan():
    assert exchange.plan_for(0, 8) == exchange.Plan(8) and exchange.plan_for(10 << 30, 8).second == 1
    before = None
    for size in (1 << 40, 10 << 40, 100 << 40):
        plan = exchange.plan_for(size, 8)
        assert plan.first * plan.second >= size / exchange.BUCKET_BYTES
        # A block has up to 600,000 keys: each row has more than a hundred. The second step has no more rows than the first.
        assert 600_000 / plan.first > 100 and plan.parts * plan.first * plan.second <= 1.01 * size / exchange.BLOCK_BYTES * plan.first + plan.first * plan.second
        rows = size / exchange.BLOCK_BYTES * plan.first
        assert before is None or rows < 33 * before  # direct rows grow 100 times
        before = rows


def test_place():
    token = np.sort(np.random.default_rng(0).integers(0, 2**64, 5000, np.uint64))
    for first, second in ((3, 3), (7, 1), (33, 31)):
        assert (exchange.place_of(token, first * second) // np.uint64(second) == exchange.place_of(token, first)).all()


def test_merge_and_split():
    """Keys of several blocks, some with the same key, come back to each in its own order."""
    plan, form = exchange.Plan(2, 3, 1), exchange.Form(((np.uint64, np.int32, None),), ((np.uint64, np.int32, np.uint8),), lambda a, b, c: (exchange.pack(a), exchange.pack(b), exchange.pack(c)))
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 40, np.uint64)
    blocks = {k: np.sort(np.concatenate([shared, rng.integers(0, 2**63, 30, np.uint64)])) for k in (7, 1 << 40, 9)}
    rows = [(k, 0, None, exchange.pack(t), exchange.pack(np.arange(len(t), dtype=np.int32)), None) for k, t in blocks.items()]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), exchange.KINDS, strict=True)], names=exchange.NAMES).append_column("part", pa.array([0] * 3, pa.int32()))
    merged = exchange._merge(plan, form)(table)
    assert len(merged) == 3 and merged.column("bucket").to_pylist() == [0, 1, 2]
    answers = merged.to_pylist()
    for r in answers:
        r["c"] = exchange.pack((exchange.unpack(r["a"], np.uint64) % np.uint64(251)).astype(np.uint8))
    back = exchange._split(form)(pa.Table.from_pylist(answers[::-1], merged.schema).append_column("home", pa.array([0] * 3, pa.int32())))
    assert back.column("block").to_pylist() == sorted(blocks)
    for r in back.to_pylist():
        token = exchange.unpack(r["a"], np.uint64)
        assert (token == blocks[r["block"]]).all() and (exchange.unpack(r["b"], np.int32) == np.arange(70)).all()
        assert (exchange.unpack(r["c"], np.uint8) == token % np.uint64(251)).all()


@pytest.mark.parametrize("name", ["lm", "shingles", "lines"])
def test_same_answers(spark, two_steps, name):
    docs = corpus(spark)
    run = {
        "lm": lambda d: lm_score.score_texts(d, fold(F.col("doc_id"), 5) != 1),
        "shingles": shingle_join.shingle_classes,
        "lines": lambda d: line_dedup.dedup_lines(d),
    }[name]
    # Written, so that blocks are the same both times.
    docs = Scratch(spark, "corpus").save(docs, "docs")
    once = rows_of(run(docs))
    two_steps()
    plan = exchange.planned(docs, "text")
    assert plan.second > 1 and plan.parts > 1
    assert rows_of(run(docs)) == once and len(once) == docs.count()
    assert rows_of(run(docs.where("false"))) == []
