"""Lists of packs against sets recomputed pack by pack."""

import datetime
import random

from tidemark.operators import scopes
from tidemark.operators.scopes import scope_differences, scope_report

LISTS = {"available_ids": "available", "unavailable_ids": "unavailable", "training_ids": "eligible", "swept_ids": "all"}


def day(n):
    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_plain(spark):
    rng = random.Random(3)
    records = [(f"R{i}", None if rng.random() < 0.05 else rng.randrange(20), rng.choice((True, False, None))) for i in range(200)]
    packs = [(p, None if p == 7 else rng.randrange(-1, 22)) for p in range(12)]
    listed, want, report = [], set(), {}
    claims = []
    for pack, cut in packs:
        then = {r for r, t, _ in records if t is not None and cut is not None and t <= cut}
        sets = {"available": then, "unavailable": {r for r, *_ in records} - then, "eligible": {r for r, _, e in records if e and r in then}, "all": {r for r, *_ in records}}
        claims.append((pack, day(cut), len(then) if pack % 3 else None, len(sets["all"])))
        for name, kind in LISTS.items():
            ids = sorted(sets[kind])
            if pack % 2:
                ids = [r for r in ids if rng.random() > 0.03] + [r for r, *_ in records if rng.random() < 0.02] + (["stranger", None] if pack % 4 == 1 else [])
            known = {r for r, *_ in records}
            mine = {r for r in ids if r is not None}
            want |= {(pack, name, r, "unknown" if r not in known else "unexpected") for r in mine - sets[kind]} | {(pack, name, r, "missing") for r in sets[kind] - mine} | {(pack, name, r, "duplicate") for r in mine if ids.count(r) > 1}
            count = {"available_ids": len(then) if pack % 3 else None, "swept_ids": len(sets["all"])}.get(name, len(sets[kind])) == len(sets[kind])
            again = sum(ids.count(r) - 1 for r in mine)
            report[pack, name] = (len(sets[kind]), len(mine), again, mine == sets[kind], count, mine == sets[kind] and count and not again)
            listed += [(pack, name, r) for r in ids]
    listed += [(99, "available_ids", "R1"), (1, "another", "R1")]
    tables = spark.createDataFrame([(r, day(t), e) for r, t, e in records], "record_id string, available_from timestamp, eligible boolean"), spark.createDataFrame(claims, "pack_id int, cutoff timestamp, n_available int, n_all int"), spark.createDataFrame(listed, "pack_id int, list string, record_id string")
    for buckets in (1, 5):
        got = scope_differences(*tables, LISTS, buckets=buckets).collect()
        assert set(map(tuple, got)) == want and len(got) == len(want)
        rows = scope_report(*tables, LISTS, {"available_ids": "n_available", "swept_ids": "n_all"}, buckets=buckets).collect()
        assert {(r[0], r[1]): tuple(r[2:]) for r in rows} == report and len(rows) == len(report)


def test_empty(spark):
    none = [spark.createDataFrame([], s) for s in ("record_id string, available_from timestamp, eligible boolean", "pack_id int, cutoff timestamp", "pack_id int, list string, record_id string")]
    assert scope_report(*none, LISTS).collect() == [] and scope_differences(*none, LISTS).collect() == []
    packs = spark.createDataFrame([(1, None)], "pack_id int, cutoff timestamp")
    assert {(r["expected"], r["passed"]) for r in scope_report(none[0], packs, none[2], LISTS).collect()} == {(0, True)}


def test_an_id_listed_many_times(spark):
    # More often than the bits of a pack hold, beside packs that list it once.
    records = spark.createDataFrame([("R1", day(1), True), ("R2", day(9), True)], "record_id string, available_from timestamp, eligible boolean")
    packs = spark.createDataFrame([(p, day(5)) for p in range(40)], "pack_id int, cutoff timestamp")
    listed = [(p, "available_ids", "R1") for p in range(40) for _ in range({3: 40, 4: 16, 17: 2}.get(p, 1))]
    lists = {"available_ids": "available"}
    tables = records, packs, spark.createDataFrame(listed, "pack_id int, list string, record_id string")
    assert {r["pack_id"]: r["duplicates"] for r in scope_report(*tables, lists).collect()} == {p: {3: 39, 4: 15, 17: 1}.get(p, 0) for p in range(40)}
    assert set(map(tuple, scope_differences(*tables, lists).collect())) == {(p, "available_ids", "R1", "duplicate") for p in (3, 4, 17)}


def test_lists_are_counted_by_words_of_packs(spark):
    rows = spark.createDataFrame([(p, "available_ids", f"R{i}") for p in range(30) for i in range(50)], "pack_id int, list string, record_id string")
    packs = spark.createDataFrame([(p, day(5)) for p in range(30)], "pack_id int, cutoff timestamp")
    assert scopes._counted(rows, scopes._numbered(packs), {"available_ids": "available"}).count() == 100
