"""The subword classifier: features against a plain version, held-out accuracy, odd texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import op13
from tidemark.llm import subword_classifier as S


def plain_buckets(text):
    """Features one by one in Python integers."""

    def mixed(code, salt):
        code = ((code ^ (salt * 0x632BE59BD9B4E019 % 2**64)) * S.FACTOR) % 2**64
        return S.FIRST + ((code >> 32) * (S.BUCKETS - S.FIRST) >> 32)

    out, before = [S.END], None
    for word in text.split():
        code = sum((c + 1) * pow(S.FACTOR, i, 2**64) for i, c in enumerate(word)) % 2**64
        out += [mixed(code, 1)] + [S.REPEAT] * (code == before)
        before = code
        bordered = b" " + word + b" "
        for n in S.NGRAMS:
            for i in range(len(bordered) - n + 1):
                if not (bordered[i] == 32 and bordered[i + n - 1] == 32):
                    out.append(mixed(int.from_bytes(bordered[i : i + n], "big"), n + 1))
    return np.bincount(out, minlength=S.BUCKETS)


TEXTS = [b"", b" ", b"a", b"a a  a\n\tb", b"  one two two\x0b\x0ctwo", "größer 漢字 漢字 \x1c  ".encode(), b"x" * 300]


def test_features(monkeypatch):
    for text in TEXTS:
        at, n = S.counted(text)
        held = np.zeros(S.BUCKETS, np.int64)
        held[at] = n
        assert (held == plain_buckets(text)).all(), text
    # Pieces make no difference where there is white space to cut at.
    long = b" ".join(random.Random(1).choices([b"alpha", b"beta", b"beta", b"gamma,", b"d"], k=3000))
    whole = S.counted(long)
    monkeypatch.setattr(S, "STEP", 101)
    cut = S.counted(long)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert b"".join(S.pieces(b"y" * 250 + b" z")) == b"y" * 250 + b" z"


def test_batch(monkeypatch):
    """Texts of a batch score as each one does alone, long ones too."""
    rng = np.random.default_rng(2)
    model = S.Classifier((0, 1), rng.normal(size=(S.BUCKETS, 2)).astype(np.float32))
    texts = TEXTS + [b"b b", b"b", b"b c"] + [b"word " * 60]
    monkeypatch.setattr(S, "STEP", 250)
    got = model.logits(texts)
    for text, row in zip(texts, got, strict=True):
        n = plain_buckets(text) if len(text) <= 250 or b" " in text else None
        if n is not None:
            assert np.allclose(row, n @ model.table.astype(np.float64) / n.sum())
    assert np.allclose(model.chances(texts).sum(axis=1), 1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng, rows = tmp_path_factory.mktemp("tables"), random.Random(6), []
    good = ["the river ran past old stone houses", "she wrote a long letter home", "wheat and barley grow in spring"]
    for i in range(600):
        words = [w for _ in range(12) for w in rng.choice(good).split()]
        kind = i % 6
        if kind == 0:
            words = [w + "%%%" for w in words]
        elif kind == 3:
            words = [words[0]] * 40
        rows.append((i, " ".join(words), int(kind not in (0, 3))))
    rows += [(600, None, None), (601, "", None), (602, " \n", 1), (603, rows[1][1], 1), (603, rows[1][1] * 9, 0), (None, rows[1][1], 1), (None, rows[0][1], 0), (604, "漢字 " * 50, None)]
    ids, texts, quality = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "score": pa.array([0.5] * len(ids)), "lang": ["x"] * len(ids)}), path / "documents.parquet")
    labelled = [(i, q) for i, _, q in rows if q is not None]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labelled], pa.int64()), "quality": pa.array([x[1] for x in labelled], pa.int32()), "toxic": pa.array([0] * len(labelled), pa.int32())}), path / "labels.parquet")
    return str(path), rows


def test_query(spark, folder):
    path, rows = folder
    got = op13.query(spark, path)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    quality = {i: q for i, _, q in rows[:600]}
    held = [(r["predicted"], quality[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in quality]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97


def test_repeats(spark, folder):
    """Two runs agree, ids with labels that differ teach nothing, no labels give no model."""
    path, _ = folder
    again = [sorted((str(r["doc_id"]), r["score"]) for r in op13.query(spark, path).collect()) for _ in range(2)]
    assert again[0] == again[1]
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    assert S.fit(docs, labels.where("doc_id = 603 or doc_id is null"), "quality") is None
    left = S.classify(docs, None, 1, name="chance")
    assert left.columns == [*docs.columns, "chance"] and {r["chance"] for r in left.collect()} == {0.5}
    with pytest.raises(ValueError):
        S.classify(docs, None, 1)
    assert S.classify(docs.limit(0), None, 1, name="chance").collect() == []


def test_long(spark):
    """A text of several pieces in one word, and one of many words."""
    model = S.Classifier((0, 1), np.zeros((S.BUCKETS, 2), np.float32))
    assert np.allclose(model.chances([b"z" * (3 * S.STEP), b"z y " * S.STEP]), 0.5)
