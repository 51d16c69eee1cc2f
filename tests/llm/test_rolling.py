"""Rolling users against a plain count, on made clicks and on the test tables' SQL."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests.test_queries import FOLDER
from tidemark.llm import op11
from tidemark.llm.rolling_users import Measure, dilated, rolling_users

MEASURES = [Measure("a", 3), Measure("b", 10), Measure("c", 10, 2), Measure("d", 7, 3), Measure("e", 1)]
SCHEMA = "click_id long, ts timestamp, client_id long, kind string, minute int, present int"


def plain(clicks, measures):
    one = {}
    for n, (i, ts, user, kind, *_) in enumerate(clicks):
        if ts is not None and kind is not None:
            key = ("own", n) if i is None else i
            row = (ts, kind, (user is not None, user or 0))
            one[key] = min(one.get(key, row), row)
    rows = [(int(ts.replace(tzinfo=datetime.UTC).timestamp() // 60), kind, user[1] if user[0] else None) for ts, kind, user in one.values()]
    out = set()
    for minute, kind, _ in rows:
        counts = []
        for m in measures:
            held = {}
            for at, k, user in rows:
                if k == kind and user is not None and minute - m.minutes < at <= minute:
                    held[user] = held.get(user, 0) + 1
            counts.append(sum(n >= m.least for n in held.values()))
        out.add((kind, minute, *counts))
    return sorted(out)


def made(seed, n, users=9):
    rng, base, rows = random.Random(seed), datetime.datetime(1969, 12, 31, 23, 0), []
    for i in range(n):
        user = None if rng.random() < 0.05 else 1 if rng.random() < 0.33 else rng.randrange(users)
        ts = None if rng.random() < 0.02 else base + datetime.timedelta(seconds=rng.randrange(0, 7200), microseconds=rng.choice((0, 1, 999_999)))
        rows.append((None if rng.random() < 0.1 else i, ts, user, rng.choice(("view", "buy", None, "漢")), 1, 0))
    rows += [rows[k] for k in range(0, n, 7)]  # repeated rows
    rows += [(r[0], r[1] and r[1] + datetime.timedelta(minutes=4), r[2], r[3], 1, 0) for r in rows[:20]]  # ids on other rows
    return rows


@pytest.mark.parametrize("chunk", [10, 13, None])
def test_plain(spark, chunk):
    rows = made(3, 400)
    got = rolling_users(spark.createDataFrame(rows, SCHEMA), MEASURES, chunk_minutes=chunk)
    assert got.columns == ["kind", "minute", "a", "b", "c", "d", "e"]
    assert sorted(map(tuple, got.collect())) == plain(rows, MEASURES)


def test_windows():
    for length in (1, 2, 3, 15, 96, 100):
        for at in (0, 5):
            (level,) = dilated([1 << at], {length: 1})[length]
            assert level == sum(1 << (at + i) for i in range(length))
    two = dilated([0b1001, 0], {4: 2})[4]
    assert two == [0b1111111, 0b1000]


def test_no_zone(spark):
    """A time without a zone is UTC in any session."""
    rows = made(4, 60)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.mode("overwrite").saveAsTable("clicks_without_zone")
    want = plain(rows, MEASURES)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(map(tuple, rolling_users(spark.table("clicks_without_zone"), MEASURES).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.sql("drop table clicks_without_zone")
    assert got == want


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rolling_users(none, MEASURES).collect() == []
    alone = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), None, "view", 1, 1)], SCHEMA)
    assert [tuple(r)[2:] for r in rolling_users(alone, MEASURES).collect()] == [(0,) * 5]
    for bad in ([], [Measure("x", 0)], [Measure("x", 5, 0)]):
        with pytest.raises(ValueError):
            rolling_users(none, bad)
    with pytest.raises(ValueError):
        rolling_users(none, MEASURES, chunk_minutes=9)


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view clicks as select * from '{FOLDER}/clicks.parquet'")
    found = con.execute(op11.SQL)
    names = [d[0] for d in found.description]
    got = op11.query(spark, str(FOLDER))
    assert sorted(map(tuple, got.select(names).collect())) == sorted(found.fetchall())
