"""The queries op1 to op10 and the pipeline on a small folder, against brute force or the libraries."""

import hashlib
import math
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers
from pyspark.sql import functions as F

from tests.llm.test_operators import EN, FR, library, lines_of
from tidemark.llm import line_dedup, lm_score, op1, op2, op3, op4, op7, op8, op9, op10
from tidemark.llm.vocabularies import content
from tidemark.llm.vector_dedup import near_vectors


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def made():
    rng = np.random.default_rng(4)
    own = lines_of(90, 77, 12)
    rows = []
    for i in range(60):
        text = (EN if i % 2 else FR) * 2 + "\n" + own[i] + "\n" + own[(i * 7) % 30]
        rows.append([i, text, "en" if i % 2 else "fr", "abc"[i % 3]])
    for i in range(20):  # near copies: a word of the last line differs
        words = rows[i][1].split(" ")
        words[-int(rng.integers(1, 5))] = "changed"
        rows.append([100 + i, " ".join(words), rows[i][2], None if i % 5 == 0 else "d"])
    rows += [[200, None, "en", "a"], [201, "", None, None], [202, "12 !! 7", None, "a"], [203, rows[3][1].upper(), "en", "b"], [204, "<|endoftext|> and <|endoftext|>", None, "b"], [205, " \n\t ", "fr", "c"]]
    return rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rows = tmp_path_factory.mktemp("tables"), made()
    ids, texts, langs, sources = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), path / "documents.parquet")
    return str(path)


def jaccard(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def classes(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_language(spark, folder):
    got = {r["doc_id"]: r for r in op1.query(spark, folder).collect()}
    rows = made()
    assert set(got) == {r[0] for r in rows} and all(got[r[0]]["held_out"] == (remainder(r[0], 4) == 2) and 0 <= got[r[0]]["score"] <= 1 for r in rows)
    held = [r for r in rows[:80] if remainder(r[0], 4) == 2]
    assert held and all(got[r[0]]["lang_pred"] == r[2] for r in held)
    assert all(got[i]["lang_pred"] == "und" for i in (200, 201, 202, 205))


def test_mixture(spark, folder):
    rows = made()
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    want, left, free = {}, float(sum(total.values())), {s: 1 + k % 3 for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    while over := [s for s in free if left * free[s] / sum(free.values()) > 3 * total[s]]:
        want |= {s: 3.0 * total[s] for s in over}
        left, free = left - sum(3 * total[s] for s in over), {s: w for s, w in free.items() if s not in over}
    want |= {s: left * w / sum(free.values()) for s, w in free.items()}
    got = {r["doc_id"]: r for r in op2.query(spark, folder).collect()}
    taken = Counter()
    for i, _, _, source in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], total[source]) and r["target"] == pytest.approx(want[source])
        assert r["taken"] <= 3 * size[i] and (not size[i] or r["taken"] % size[i] == 0)
        taken[source] += r["taken"]
    assert all(abs(taken[s] - w) <= max(size.values()) for s, w in want.items())
    assert [tuple(r) for r in op2.query(spark, folder).orderBy("doc_id").collect()] == [tuple(got[i]) for i in sorted(got)]


def test_language_model(spark, folder):
    """Base columns, and the model's score from counts, weights and EM spelled out."""
    rows = made()
    words = {r[0]: [*(r[1] or "").encode().lower().split(), None] for r in rows}
    deleted = {r["doc_id"]: r["d"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", (F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(lm_score.DELETE)) == 0).alias("d")).collect()}
    train = [i for i in words if remainder(i, 5) != 1]
    kept = [i for i in train if not deleted[i]]
    pairs = lambda ws: list(zip(["start", *ws], ws))
    one, two = ({"all": Counter(x for i in train for x in f(words[i])), "kept": Counter(x for i in kept for x in f(words[i]))} for f in (list, pairs))
    ends = {"all": len(train), "kept": len(kept)}
    before = lambda h, part: ends[part] if h == "start" else one[part][h]
    n_kept, cells = sum(one["kept"].values()), Counter()
    steps = lambda p: round(-lm_score.STEPS * math.log2(p)) if p > 0 else -1
    for i in train:
        for h, w in pairs(words[i]) if deleted[i] else ():
            c = before(h, "kept")
            cells[int(lm_score.context_bucket(np.array([c]))[0]), steps(two["kept"][h, w] / max(c, 1)), steps(one["kept"][w] / n_kept)] += 1
    weights = lm_score.learn_weights(np.array([(*k, n) for k, n in cells.items()]), len(one["kept"]))
    n, v = sum(one["all"].values()), len(one["all"])
    better = []
    for r in op3.query(spark, folder).collect():
        ws = words[r["doc_id"]]
        base = sum(math.log10((one["all"][w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = 0.0
        for h, w in pairs(ws):
            c = before(h, "all")
            x = weights[int(lm_score.context_bucket(np.array([c]))[0])]
            score += math.log10(x[0] * two["all"][h, w] / max(c, 1) + x[1] * one["all"][w] / n + x[2] / (v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(r["doc_id"], 5) == 1, len(ws), sum(one["all"][w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=1e-6)
        better.append(r["score"] > r["base_score"])
    assert sum(better) > len(better) / 2


def test_vectors(spark, tmp_path):
    """Pairs planted just above the threshold among 4,000 vectors of 48 dimensions; lengths of any size; repeated and null ids."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 48))
    near = x[:1000] / np.linalg.norm(x[:1000], axis=1)[:, None]
    side = rng.standard_normal((1000, 48))
    side -= (side * near).sum(axis=1)[:, None] * near
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.9801, 0.984, 1000)[:, None]
    every = np.concatenate([x, cos * near + np.sqrt(1 - cos**2) * side])
    labels = np.concatenate([np.arange(3000) % 3, np.arange(1000) % 3])
    pq.write_table(pa.table({"vec_id": np.arange(4000), "embedding": pa.array(list(every.astype(np.float32)), pa.list_(pa.float32())), "label": labels}), tmp_path / "embeddings.parquet")
    got = {r["vec_id"]: r for r in op4.query(spark, str(tmp_path)).collect()}
    unit = every.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    want, found = links.sum(axis=1), np.array([got[i]["n_links"] for i in range(4000)])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(4000))
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (3, 2, [0.0, 1.0]), (4, 3, [1e-200, 2e-200]), (5, 3, [1e200, 2e200]), (None, 3, [1.0, 2.0]), (6, 3, [1.0, float("inf")]), (7, 4, [0.0, -0.0])]
    out = sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()), key=repr)
    assert out == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False), (4, 2, 4, True), (5, 2, 4, False), (None, 2, 4, False), (6, 0, 6, True), (7, 0, 7, True)], key=repr)


def test_shingles(spark, folder):
    rows = made()
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    want = {r[0]: (len(s), rows[c][0]) for r, s, c in zip(rows, sets, classes(sets), strict=True)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7.query(spark, folder).collect()} == want


def digest(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_tokens(spark, folder):
    enc, rows = library(), made()
    want = {r[0]: enc.encode_ordinary(r[1] or "") for r in rows}
    got = {r["doc_id"]: r for r in op8.query(spark, folder).collect()}
    for r in rows:
        g = got[r[0]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(want[r[0]]), digest(want[r[0]]), hashlib.sha256((r[1] or "").encode()).hexdigest())


def test_files(spark, folder):
    enc, start, want = tokenizers.Tokenizer.from_str(content("byte_bpe_50k.json")), 0, []
    for i, text, *_ in sorted(made(), key=lambda r: r[0]):
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in op9.query(spark, folder).orderBy("doc_id").select("doc_id", "start", "n_tokens", "ids_crc32").collect()] == want


def test_lines(spark, folder):
    rows = sorted(made(), key=lambda r: r[0])
    places = [(k, n, x.strip().lower()) for k, r in enumerate(rows) for n, x in enumerate((r[1] or "").split("\n")) if x.strip()]
    names = list(dict.fromkeys(x for *_, x in places))
    of = dict(zip(names, classes([line_dedup.shingles(x) for x in names]), strict=True))
    first, gone = {}, set()
    for k, n, x in places:
        if first.setdefault(of[x], (k, n)) != (k, n):
            gone.add((k, n))
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["text_sha256"]) for r in op10.query(spark, folder).collect()}
    for k, r in enumerate(rows):
        lines = [x for n, x in enumerate((r[1] or "").split("\n")) if (k, n) not in gone]
        n = sum(1 for p in places if p[0] == k)
        sha = None if r[1] is None else hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert got[r[0]] == (n, n - sum(1 for p in gone if p[0] == k), sha)


def test_line_recall(spark):
    """Lines planted just above the threshold: candidates are found with probability 0.998."""
    rng = np.random.default_rng(12)
    texts, pairs = [], 0
    for k, line in enumerate(lines_of(400, 91, 16)):
        other = list(line)
        for at in rng.choice(len(line), 2, replace=False):
            other[at] = "z"
        other = "".join(other)
        pairs += jaccard(line_dedup.shingles(line), line_dedup.shingles(other))
        texts += [(2 * k, line), (2 * k + 1, other)]
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    removed = got.where("n_kept = 0").count()
    assert pairs > 300 and 0.98 * pairs <= removed <= pairs


def test_pipeline(spark, folder):
    out = pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    enc = library()
    want = Counter((r["doc_id"], digest(enc.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.collect())
    got = Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    assert got == want and got and not {200, 201, 202, 205} & {k[0] for k in got}


def test_pipeline_edges(spark):
    """Empty tables, null and repeated ids, and columns with names that the stages use, in every stage."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, copies long, copy string, lines_kept int, lang_pred string, body string, gone_lines string"
    rest = (1, "c", 2, "x", "b", "g")
    rows = [(None, EN * 2, "en", None, 1, *rest), (None, FR * 2, "fr", "a", 1, *rest), (4, EN + "more", "en", "a", 1, *rest), (4, FR + "encore", "fr", "a", 1, *rest), (4, FR + "encore", "fr", "a", 1, *rest), (5, None, None, "a", 0, *rest), (6, "", "en", "a", 0, *rest)]
    for stage in (s for _, s in pipeline.STAGES):
        none = stage(spark, spark.createDataFrame([], kinds), "")
        assert none.count() == 0
        some = stage(spark, spark.createDataFrame(rows, kinds), "")
        if stage is not pipeline.tokens:
            assert some.columns == none.columns == [k.split()[0] for k in kinds.split(", ")]
        assert some.count() > 0
