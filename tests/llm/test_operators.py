"""The training-data operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, cube_mix, exact_dedup, language_id, line_dedup, lm_score, shingle_join, token_files, url_filter, vector_dedup
from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components
from tidemark.llm.pretokens import pretokens
from tidemark.llm.vocabularies import content

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, body string, key string, size string, n string, h string"
EN = "the cat and the dog went to the house of the king and then they were there with them "
FR = "le chat et le chien vont dans la maison du roi et puis ils sont avec eux pour une nuit "


def docs(spark, texts, lang="en", source="s"):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, None, 7, "b", "k", "s", "n", "h") for i, t in (texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts)))], DOC)


def lines_of(n, seed, words=8):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(words)) for _ in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(50)}


def test_exact(spark):
    rows = docs(spark, [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "x" * 200_000), (2, "aB")])
    for limit in (0, 1 << 20):
        got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(rows, keep="max", broadcast_bytes=limit).collect())
        assert [(a, b, c, d) for a, b, c, d, _ in got] == [(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True)]
        assert got[0][4] == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup.exact_groups(docs(spark, []), keep="max").count() == 0


def test_language(spark):
    train = docs(spark, [(i, EN) for i in range(5)]).unionByName(docs(spark, [(10 + i, FR) for i in range(5)], "fr")).unionByName(docs(spark, [(30, "zzz")], None))
    model = language_id.fit(train)
    assert model.languages == ("en", "fr")
    asked = docs(spark, [(1, "the dog and the king"), (2, "le chien et la maison du roi"), (3, None), (4, " 12 !"), (5, EN * 2000)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.detect(asked, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "fr", "und", "und", "en"] and got[3][1] == 0.0 and 0 < got[1][1] <= 1
    own = language_id.ranked("the dog and the king")
    brute = [sum(abs(int(row[np.searchsorted(model.codes, c)]) - i) if c in model.codes and row[np.searchsorted(model.codes, c)] < language_id.TOP else language_id.TOP for i, c in enumerate(own.tolist())) for row in model.ranks]
    assert got[1][1] == pytest.approx(1 - min(brute) / (language_id.TOP * len(own)))
    none = language_id.fit(docs(spark, []))
    assert language_id.detect(asked, none).where("lang_pred <> 'und'").count() == 0
    with pytest.raises(ValueError):
        language_id.detect(asked, model, names=("lang", "score"))


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = docs(spark, [(i, "w " * int(rng.integers(1, 60))) for i in range(300)], source="a").unionByName(docs(spark, [(1000 + i, "w " * int(rng.integers(1, 60))) for i in range(80)], source="b"))
    rows = rows.unionByName(docs(spark, [(2000, None), (2001, ""), (2002, "one"), (2002, "one")], source=None))
    runs = [sorted(map(tuple, cube_mix.cube_mix(d).collect()), key=repr) for d in (rows, rows.repartition(3))]
    assert runs[0] == runs[1] and len(runs[0]) == 384
    by = {}
    for _, source, size, total, target, _, taken in runs[0]:
        assert taken <= 3 * size and (size or not taken)
        by.setdefault(source, [total, target, 0])[2] += taken
    assert by[None][1] == 3 * by[None][0] and sum(x[1] for x in by.values()) == pytest.approx(sum(x[0] for x in by.values()))
    assert all(abs(t - want) <= 0.02 * want + 3 for _, want, t in by.values())
    assert cube_mix.cube_mix(docs(spark, [])).count() == 0
    sizes, start = rng.integers(1, 99, 50).astype(float).tolist(), rng.random(50).tolist()
    flown = cube_mix.flight(sizes, start, np.random.default_rng(2))
    assert sum(0 < x < 1 for x in flown) <= 2 and sum(flown) == pytest.approx(sum(start)) and np.dot(flown, sizes) == pytest.approx(np.dot(start, sizes))


def test_language_model(spark):
    texts = [(i, t) for i, t in enumerate([EN, FR, "the cat", None, "", "The  CAT\tand", "new words here", EN * 300] * 3)]
    got = {r["doc_id"]: r for r in lm_score.score_texts(docs(spark, texts), F.col("doc_id") % 5 != 1).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts}
    c = Counter(w for i, ws in tokens.items() if i % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(c[w] > 0 for w in ws), n, i % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) and r["score"] < 0
    none = lm_score.score_texts(docs(spark, ["a b"]), F.lit(False)).first()
    assert (none["train_tokens"], none["n_known"], none["base_score"], none["score"]) == (0, 0, 0.0, 0.0)
    assert lm_score.score_texts(docs(spark, []), F.lit(True)).count() == 0
    cells = np.array([(3, 8, 64, 90), (3, -1, 32, 10)])
    w = lm_score.learn_weights(cells, 100)[3]
    like = lambda x: 90 * math.log(x[0] * 2**-0.5 + x[1] * 2**-4 + x[2] / 101) + 10 * math.log(x[1] * 2**-2 + x[2] / 101)
    assert w.sum() == pytest.approx(1) and all(like(w) >= like(x) - 1e-3 for x in ((1 / 3, 1 / 3, 1 / 3), (0.8, 0.1, 0.1), (0.6, 0.39, 0.01)))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, 1, v.tolist()) for i, v in enumerate(base)] + [(100 + i, 1, (base[0] + 0.02 * rng.standard_normal(16)).tolist()) for i in range(150)]
    rows += [(300, 1, base[1].tolist()), (301, 2, base[1].tolist()), (302, None, base[1].tolist()), (303, 1, None), (304, 1, [0.0] * 16), (305, 1, [float("nan")] * 16), (306, 1, [None] * 16), (307, 1, (3 * base[1]).tolist()), (308, 1, [])]
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    ids, x = [r[0] for r in rows[:191] if r[1] == 1] + [307], np.array([r[2] for r in rows[:191]] + [rows[-2][2]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    assert len(got) == len(rows) and [got[i]["n_links"] for i in ids] == (near.sum(axis=1) - 1).tolist()
    assert got[307]["component_id"] == 1 and not got[300]["kept"] and all(got[i]["kept"] and not got[i]["n_links"] for i in (301, 302, 303, 304, 305, 306, 308))
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_urls(spark):
    captures = spark.createDataFrame([(1, "http://a.x.org/p", "2024-01-05"), (2, "HTTP://user@X.org:80", "2024-01-20"), (3, "http://x.org/b", "2024-02-01"), (4, None, "2024-01-05"), (5, "no url", "2024-01-05"), (6, "http://y.org/One", "2024-01-05"), (7, "http://x.org", None), (1, "http://notx.org", "2024-01-05")], "id long, url string, at string")
    entries = spark.createDataFrame([("domain", "x.org", "2024-01-05", "add"), ("domain", "x.org", "2024-01-07", "add"), ("domain", "x.org", "2024-01-20", "remove"), ("domain", "x.org", "2024-01-20", "add"), ("domain", "x.org", "2024-01-30", "remove"), ("url", "http://y.org/one", "2024-01-01", "add"), ("domain", None, "2024-01-01", "add"), ("domain", "org", "2024-01-01", "odd")], "kind string, pattern string, at string, action string")
    for limit in (0, 1 << 20):
        got = sorted((r["id"], r["n_active"], r["host"]) for r in url_filter.active_entries(captures, entries, "id", "url", "at", limit).collect())
        assert got == [(1, 0, "notx.org"), (1, 1, "a.x.org"), (2, 1, "x.org"), (3, 0, "x.org"), (4, 0, ""), (5, 0, ""), (6, 1, "y.org"), (7, 0, "x.org")]
    assert url_filter.active_entries(captures.limit(0), entries, "id", "url", "at").count() == 0


def test_shingles(spark):
    rng = np.random.default_rng(5)
    vocabulary = np.array(lines_of(400, 6, 1))
    base = [rng.choice(vocabulary, 60).tolist() for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base * 5:
        copy = list(b)
        for k in rng.integers(0, 60, rng.integers(1, 4)):
            copy[k] = "edited"
        texts.append(" ".join(copy))
    texts += [texts[0].upper(), None, "", "  ", "one two", "One  two", "one", " ".join(base[0] * 400)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.shingle_classes(docs(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert shingle_join.shingle_classes(docs(spark, [])).count() == 0


RANKS = content("byte_bpe_50k.tiktoken")


def library():
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "It's we'll 'tis  \n\n x\t", "naïve Ünï 漢字 ½ ²", "a" * 5000, "  lead", "trail  ", "<|endoftext|>", "\x1c\x85 z", EN * 50]


def test_pretokens():
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(list("ab's 'llre\n\t é½.!1　"), rng.integers(0, 20))) for _ in range(3000)]
    words, counts = pretokens(texts)
    assert words == [w for t in texts for w in pattern.findall(t)] and counts.tolist() == [len(pattern.findall(t)) for t in texts]
    assert pretokens([])[0] == []


def test_bpe(spark):
    rows = docs(spark, TEXTS)
    both = byte_bpe.decode(byte_bpe.encode(rows, RANKS), RANKS).orderBy("doc_id").collect()
    enc = library()
    assert [r["ids"] for r in both] == [enc.encode_ordinary(t or "") for t in TEXTS] and [bytes(r["decoded"]) for r in both] == [(t or "").encode() for t in TEXTS]
    assert byte_bpe.encode(docs(spark, []), RANKS).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(rows, RANKS, name="source")


def test_token_files(spark):
    scratch = Scratch(spark, "t")
    rows = docs(spark, [(i * 7 % 11, t) for i, t in enumerate(TEXTS)]).unionByName(docs(spark, [(50, "same"), (50, "same")]))
    token_files.write_token_files(rows, content("byte_bpe_50k.json"), f"{scratch.base}/files", scratch)
    got = sorted(map(tuple, token_files.read_token_files(spark, f"{scratch.base}/files", token_files.crc32, "c long").collect()))
    start, want = 0, []
    enc = tokenizers.Tokenizer.from_str(content("byte_bpe_50k.json"))
    assert 50256 in enc.encode("<|endoftext|>", add_special_tokens=False).ids
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in rows.collect()):
        ids = np.array([*enc.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    values = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint32)
    assert token_files.unpack_ids(*token_files.pack_ids(values), len(values)).tolist() == values.tolist()
    token_files.write_token_files(docs(spark, []), content("byte_bpe_50k.json"), f"{scratch.base}/none", scratch)
    assert token_files.read_token_files(spark, f"{scratch.base}/none", token_files.crc32, "c long").count() == 0


def test_lines(spark):
    own = lines_of(12, 9)
    texts = ["\n".join(own[:4]), "\n".join([own[0].upper(), "", own[4], "  " + own[1] + " "]), own[2][:-1] + "z\n" + own[5], None, "", "\n\n", "ab\nab", own[6] * 300, own[6] * 300]
    rows = docs(spark, texts)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in line_dedup.dedup_lines(rows).collect()}
    sets, first = [], {}
    for i, t in enumerate(texts):
        kept = []
        for k, line in enumerate((t or "").split("\n")):
            z = line.strip().lower()
            s = line_dedup.shingles(z)
            if z and any(100 * len(s & o) >= 80 * len(s | o) for o in sets):
                continue
            if z:
                sets.append(s)
            kept.append(line)
        n = sum(bool(x.strip()) for x in (t or "").split("\n"))
        first[i] = (None if t is None else "\n".join(kept), n, sum(bool(x.strip()) for x in kept))
    assert got == first
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
