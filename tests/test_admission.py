"""Admission of batches against bundles taken one after the other."""

import random
from pathlib import Path

import pytest

from tidemark.operators import admission, imports
from tidemark.operators.admission import admit
from tidemark.stages import Stages

BUNDLES = "bundle_id string, arrival int, episode_id string, sha string, outcome int"
RECORDS = "bundle_id string, position int, record_id string, sha string, eligible boolean"


def in_turn(bundles, records, stored_bundles, stored_records):
    episodes, held, out = dict(stored_bundles), {r: (e, s) for r, e, s in stored_records}, []
    for bundle, _, episode, sha, _ in sorted(bundles, key=lambda b: (b[1], b[0])):
        own = sorted((r for r in records if r[0] == bundle), key=lambda r: r[1])
        named = [r for r in own if r[2] is not None]
        reason = clash = None
        if episodes.get(episode, sha) != sha:
            reason = "EPISODE_HASH_CONFLICT"
        else:
            clash = next((r[2] for r in named if r[2] in held and held[r[2]] != (episode, r[3])), None)
            reason = "RECORD_ID_CONFLICT" if clash else None
        if reason is None:
            episodes[episode] = sha
            held |= {r[2]: (episode, r[3]) for r in named}
        out.append((bundle, episode, "quarantined" if reason else "stored", reason, clash, f"{episode}-{sha[:12]}" if reason else None, len(own), sum(bool(r[4]) for r in own)))
    return sorted(out)


def batch(seed, n):
    rng = random.Random(seed)
    bundles, records = [], []
    for i in range(n):
        again = rng.random() < 0.15 and bundles
        episode, sha = (rng.choice(bundles)[2:4]) if again else (f"E{rng.randrange(n)}", f"sha-{rng.randrange(3)}-0123456789")
        bundles.append((f"B{i:03}", rng.randrange(n // 2), episode, sha, 1))
        for p in range(rng.randrange(5)):
            hot = "hot" if rng.random() < 0.1 else f"R{rng.randrange(2 * n)}"
            records.append((f"B{i:03}", p, None if rng.random() < 0.05 else hot, rng.choice("gh"), rng.choice((True, False, None))))
        if rng.random() < 0.1 and records and records[-1][0] == f"B{i:03}":  # one id twice, perhaps with two contents
            records.append((*records[-1][:1], 9, records[-1][2], rng.choice("gh"), True))
    stored_bundles = [(f"E{i}", "sha-0-0123456789") for i in rng.sample(range(n), n // 10)]
    stored_records = [(f"R{i}", f"E{rng.randrange(n)}", "g") for i in rng.sample(range(2 * n), n // 10)]
    return bundles, records, stored_bundles, stored_records


@pytest.mark.parametrize("seed, small", [(1, 0), (2, 0), (3, 20), (4, 1 << 17), (5, 1 << 17)])
def test_batches(spark, seed, small):
    bundles, records, episodes, ids = batch(seed, 80)
    tables = [spark.createDataFrame(x, s) for x, s in ((bundles, BUNDLES), (records, RECORDS), (episodes, "episode_id string, sha string"), (ids, "record_id string, episode_id string, sha string"))]
    assert sorted(map(tuple, admit(*tables, small=small).collect())) == in_turn(bundles, records, episodes, ids)


def test_a_refused_bundle_frees_its_ids(spark):
    bundles = [("a", 1, "E1", "s", 0), ("b", 2, "E2", "s", 0), ("c", 3, "E3", "s", 0), ("d", 4, "E1", "t", 0), ("e", 5, "E1", "s", 0)]
    records = [("a", 0, "x", "g", True), ("b", 0, "x", "g", True), ("b", 1, "y", "g", True), ("c", 0, "y", "g", True), ("e", 0, "x", "g", True)]
    none = [spark.createDataFrame([], s) for s in ("episode_id string, sha string", "record_id string, episode_id string, sha string")]
    for small in (0, 100):
        got = {r["bundle_id"]: (r["reason"], r["record_id"]) for r in admit(spark.createDataFrame(bundles, BUNDLES), spark.createDataFrame(records, RECORDS), *none, small=small).collect()}
        assert got == {"a": (None, None), "b": ("RECORD_ID_CONFLICT", "x"), "c": (None, None), "d": ("EPISODE_HASH_CONFLICT", None), "e": (None, None)}


@pytest.mark.parametrize("small", [0, 100])
def test_a_later_bundle_does_not_refuse_one_with_two_contents(spark, small):
    # a is refused, so that b holds y and x; c says of x what b said last, d says of y something else.
    bundles = [("a", 1, "E1", "s", 0), ("b", 2, "E2", "s", 0), ("c", 3, "E2", "s", 0), ("d", 4, "E3", "s", 0)]
    records = [("a", 0, "z", "g", True), ("a", 1, "y", "g", True), ("b", 0, "y", "g", True), ("b", 1, "x", "g", True), ("b", 2, "x", "h", True), ("c", 0, "x", "h", True), ("d", 0, "y", "g", True)]
    stored = [("z", "E0", "g")]
    tables = [spark.createDataFrame(x, s) for x, s in ((bundles, BUNDLES), (records, RECORDS), ([], "episode_id string, sha string"), (stored, "record_id string, episode_id string, sha string"))]
    assert sorted(map(tuple, admit(*tables, small=small).collect())) == in_turn(bundles, records, [], stored)


def test_two_contents_at_one_place_have_an_order(spark):
    bundles = [("a", 1, "E1", "s", 0), ("b", 2, "E1", "s", 0)]
    none = [spark.createDataFrame([], s) for s in ("episode_id string, sha string", "record_id string, episode_id string, sha string")]
    for twice in ("gh", "hg"):
        records = [("a", 0, "x", twice[0], True), ("a", 0, "x", twice[1], True), ("b", 0, "x", "h", True)]
        found = admit(spark.createDataFrame(bundles, BUNDLES).coalesce(1), spark.createDataFrame(records, RECORDS).coalesce(1), *none).collect()
        assert {r["bundle_id"]: r["outcome"] for r in found} == {"a": "stored", "b": "stored"}, twice


def test_a_gate_with_an_unknown_check_stays_shut(spark):
    found = imports.verdicts(spark.createDataFrame([(1,), (2,)], "bundle_id int"), spark.createDataFrame([(1, "blockhash"), (1, None)], "bundle_id int, check_id string"))
    assert {r["bundle_id"]: (r["unknown_checks"], r["passed"]) for r in found.collect()} == {1: (2, False), 2: (0, True)}


@pytest.mark.parametrize("seed, hot, slice_", [(6, 2, 1 << 23), (7, 1 << 16, 16)])
def test_hot_keys_and_slices(spark, monkeypatch, seed, hot, slice_):
    monkeypatch.setattr(admission, "SLICE", slice_)
    monkeypatch.setattr(admission, "BUNDLES", 8)
    bundles, records, episodes, ids = batch(seed, 60)
    tables = [spark.createDataFrame(x, s) for x, s in ((bundles, BUNDLES), (records, RECORDS), (episodes, "episode_id string, sha string"), (ids, "record_id string, episode_id string, sha string"))]
    assert sorted(map(tuple, admit(*tables, small=10, hot=hot).collect())) == in_turn(bundles, records, episodes, ids)


def test_claims_are_thin_and_tables_go(spark, monkeypatch):
    kinds, base, save = {}, set(), Stages.save

    def watched(self, df, name):
        base.add(self.base)
        kinds[name] = {f.dataType.typeName() for f in df.schema}
        return save(self, df, name)

    monkeypatch.setattr(Stages, "save", watched)
    bundles, records, episodes, ids = batch(8, 40)
    tables = [spark.createDataFrame(x, s) for x, s in ((bundles, BUNDLES), (records, RECORDS), (episodes, "episode_id string, sha string"), (ids, "record_id string, episode_id string, sha string"))]
    found = admit(*tables, small=0)
    # No step but the numbering of bundles writes a text, and of its tables only what the result reads is left.
    assert all(k <= {"long", "integer", "boolean"} for n, k in kinds.items() if not n.startswith(("turns", "numbered"))) and len(kinds) > 6
    (folder,) = base
    assert {p.name for p in Path(folder).iterdir()} == {"numbered", "clash"}
    assert sorted(map(tuple, found.collect())) == in_turn(bundles, records, episodes, ids)
