"""Commits of several tables, and updates by what has changed against making everything."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.incremental import Grouped, Mapped, update
from tidemark.sources.snapshots import ConflictError, Snapshots

SCHEMA = "key int, sha string, words array<string>"
STEPS = [
    Mapped("claims", "sources", "owner", "word", lambda d: d.select(F.col("key").alias("owner"), F.explode("words").alias("word"))),
    Grouped("brain", "claims", "word", lambda d: d.groupBy("word").agg(F.min("owner").alias("first"), F.count(F.lit(1)).alias("n"))),
    Mapped("initials", "brain", "word", "letter", lambda d: d.select("word", F.substring("word", 1, 1).alias("letter"), "n")),
    Grouped("totals", "initials", "letter", lambda d: d.groupBy("letter").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))),
]
TABLES = ("sources", "claims", "brain", "initials", "totals")


def listing(spark, held):
    return spark.createDataFrame([(k, str(hash(tuple(w))), list(w)) for k, w in held.items()], SCHEMA)


def contents(store):
    return {t: sorted(map(repr, store.read(t).collect())) for t in TABLES}


def test_updates(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(30)}"
    held = {k: tuple(word() for _ in range(rng.randrange(4))) for k in range(60)}
    store = Snapshots(spark, str(tmp_path / "kept"))
    update(store, listing(spark, held), STEPS, parts=8)
    for turn in range(2):
        for _ in range(3):
            what, k = rng.choice("icd"), rng.randrange(70)
            if what == "d":
                held.pop(k, None)
            else:
                held[k] = tuple(word() for _ in range(rng.randrange(1, 4)))
        before = store.at()
        written = update(store, listing(spark, held), STEPS, parts=8)
        whole = Snapshots(spark, str(tmp_path / f"whole{turn}"))
        update(whole, listing(spark, held), STEPS, parts=8)
        assert contents(store) == contents(whole)
        for t in TABLES:
            after = store.at()[t]
            assert len(written[t]) < 8 or t in ("totals", "initials", "claims", "brain")
            assert all(after.shards.get(s) == before[t].shards.get(s) for s in map(str, range(8)) if int(s) not in written[t])
    assert update(store, listing(spark, held), STEPS, parts=8) == {t: [] for t in TABLES}
    assert update(store, listing(spark, {}), STEPS, parts=8) and all(not rows for rows in contents(store).values())


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    update(store, listing(spark, {1: ("a", "b"), 2: ("b",)}), STEPS, parts=4)
    before, number = contents(store), store.head()[0]

    def dies(_):
        raise RuntimeError("lost")

    broken = [STEPS[0], Grouped("brain", "claims", "word", dies), *STEPS[2:]]
    with pytest.raises(RuntimeError, match="lost"):
        update(store, listing(spark, {1: ("c",), 3: ("d",)}), broken, parts=4)
    assert contents(store) == before and store.head()[0] == number
    # A manifest that was not written whole doesn't count; the next writer passes it by.
    (tmp_path / "manifests" / f"{number + 1:012d}.json").write_text('{"tables": {"cl')
    assert contents(store) == before
    update(store, listing(spark, {1: ("c",), 3: ("d",)}), STEPS, parts=4)
    assert store.head()[0] == number + 2 and sorted(r["word"] for r in store.read("brain").collect()) == ["c", "d"]
    assert [r["word"] for r in store.read("brain", number).orderBy("word").collect()] == ["a", "b"]
    held = contents(store)
    assert store.vacuum(1) > 0 and contents(store) == held


def test_two_writers(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    assert store.publish({"t": (rows, "k"), "u": (rows, "v")}, 3) == 1
    base, tables = store.head()
    other = Snapshots(spark, str(tmp_path))
    other.publish({"t": (rows.where("k = 1"), "k")}, 3)
    with pytest.raises(ConflictError):
        store.commit(tables, base)
    assert store.read("t").count() == 1 and store.read("u").count() == 2 and store.read("t", base).count() == 2


def test_changes_for_mapped_only(spark, tmp_path):
    """Keys are compared only for tables that a mapped one is of; a mapped table that is new to an old store has all its rows."""
    from tidemark.operators.incremental import Grouped, Mapped, update

    store, shared = Snapshots(spark, str(tmp_path / "s")), Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("tidemark-update-*/*"))
    steps = [Mapped("m", "sources", "key", "k", lambda d: d.select("key", (F.col("key") % 3).alias("k"))), Grouped("g", "m", "k", lambda d: d.groupBy("k").agg(F.count("key").alias("n")))]
    listing = lambda last: spark.range(10).select(F.col("id").alias("key"), F.when(F.col("id") == 9, last).otherwise("a").alias("sha"))
    update(store, listing("a"), steps, parts=2)
    update(store, listing("b"), [*steps, Mapped("new", "sources", "key", "key", lambda d: d.select("key"))], parts=2)
    assert not [p for p in set(shared.glob("tidemark-update-*/*")) - before if p.name.endswith("-changes")]
    assert store.read("new").count() == 10 and {r["k"]: r["n"] for r in store.read("g").collect()} == {0: 4, 1: 3, 2: 3}


def test_fingerprint_tells_apart(spark):
    """Rows that hash alike by value alone: a null in another column, a negative zero, a list within."""
    from tidemark.sources.snapshots import fingerprint

    rows = [(None, 1, 0.0, [None, 1]), (1, None, 0.0, [None, 1]), (None, 1, -0.0, [None, 1]), (None, 1, 0.0, [1, None]), (None, 1, None, [None, 1])]
    prints = [df.agg(fingerprint(df.schema).alias("f")).first()["f"] for df in (spark.createDataFrame([r], "a int, b int, c double, d array<int>") for r in rows)]
    assert len(set(prints)) == len(rows)
