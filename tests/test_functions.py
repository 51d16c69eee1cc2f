import datetime as dt
import hashlib

from pyspark.sql import functions as F

from tidemark.functions import clock, ids, numbers, payload, text, vectors


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return tuple(row) if len(cols) > 1 else row[0]


def test_ids(spark):
    want = "CASE-" + hashlib.sha256(b"a|None|3").hexdigest()[:12]
    assert one(spark, ids.stable_id("CASE", F.lit("a"), F.lit(None), F.lit(3))) == want
    assert one(spark, ids.identity(F.lit("a"), F.lit(None).cast("string"), F.lit(1))) == "a||1"


def test_clock(spark):
    day = F.lit("2030-01-10").cast("date")
    assert one(spark, clock.window_start(day), clock.cutoff(day)) == (dt.datetime(2030, 1, 9, 15, 30), dt.datetime(2030, 1, 10, 8, 59, 59))
    friday, saturday = F.lit("2030-01-11").cast("date"), F.lit("2030-01-12").cast("date")
    assert one(spark, clock.next_trading_day(friday), clock.next_trading_day(saturday), clock.next_trading_day(day)) == (dt.date(2030, 1, 14), dt.date(2030, 1, 14), dt.date(2030, 1, 11))
    assert one(spark, clock.at_time(day, F.lit("8:1")), clock.at_time(day, F.lit("8:1:2"))) == (None, dt.datetime(2030, 1, 10, 8, 1, 2))
    assert one(spark, clock.web_time(F.lit("2030-01-09")), clock.web_time(F.lit("3 hours ago"))) == (dt.datetime(2030, 1, 9, 23, 59, 59), None)


def test_text(spark):
    assert one(spark, text.text_terms(F.lit("Ab, ab! c D2"))) == ["ab", "d2"]
    assert one(spark, text.text_bigrams(F.lit("A b")), text.text_bigrams(F.lit("x"))) == (["ab"], [])
    assert one(spark, text.slug(F.lit("  Hello, World 가 ")), text.slug(F.lit("!"))) == ("hello-world-가", "item")
    assert one(spark, text.ticker(F.lit("A00-001")), text.ticker(F.lit("A1234567"))) == (None, None)
    assert one(spark, text.ticker(F.lit("A000001"))) == "000001"
    assert one(spark, text.drop_controls(F.lit("a\x00b\tc\x1f"))) == "ab\tc"
    assert one(spark, text.token_estimate(F.lit("")), text.token_estimate(F.lit("abc")), text.token_estimate(F.lit("x" * 9))) == (0, 1, 2)
    assert one(spark, text.cluster_text(F.lit("Current  Catalyst"), F.lit("Repeated update"))) == one(spark, text.cluster_text(F.lit(" current catalyst "), F.lit("Repeated     update")))


def test_numbers(spark):
    assert one(spark, numbers.pct_return(F.lit(129.0), F.lit(100.0))) == (129 / 100 - 1) * 100
    assert one(spark, numbers.parse_number(F.lit(" "), F.lit("1,234.5")), numbers.parse_number(F.lit("n/a"), F.lit("1"))) == (1234.5, None)
    assert one(spark, numbers.rate(F.lit(1), F.lit(0)), numbers.turnover(F.lit(2000.0), F.lit(10000.0))) == (None, 20.0)


def test_vectors(spark):
    assert one(spark, vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), vectors.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))) == (11.0, 0.0)
    got = one(spark, vectors.hash_embedding(F.lit("Ab ab")))
    want = [0.0] * 32
    for f in ("ab", "ab", "ba"):
        h = hashlib.sha256(f.encode()).hexdigest()
        want[int(h[:8], 16) % 32] += 1.0 if int(h[8:10], 16) % 2 == 0 else -1.0
    size = sum(x * x for x in want) ** 0.5
    assert got == [x / size for x in want]
    assert one(spark, vectors.hash_embedding(F.lit(""))) == [0.0] * 32


def test_payload(spark):
    doc = F.lit('{"b": 1.0, "a": ["x", " y "], "payload": {"c": 2, "b": 3}, "n": null}')
    assert one(spark, payload.canonical_json(doc)) == '{"a":["x"," y "],"b":1.0,"n":null,"payload":{"b":3,"c":2}}'
    assert one(spark, payload.alias_values(doc, ["$.a", "$.b", "$.payload.c", "$.gone"])) == ["x", "y", "1.0", "2"]
    assert one(spark, payload.has_key(doc, "n"), payload.has_key(doc, "z")) == (True, False)
    assert one(spark, payload.outer_wins(doc, "b"), payload.outer_wins(doc, "c"), payload.outer_wins(doc, "n")) == ("1.0", "2", None)
    assert one(spark, payload.canonical_json(F.lit("no json"))) is None


def test_mail_times(spark):
    from email.utils import format_datetime, parsedate_to_datetime

    texts = ["Tue, 02 Jan 2024 10:00:00 GMT", "2 Jan 2024 9:05 +0900", "Tue, 2 Jan 24 09:05:07 EST", "02-Jan-2024 10:00:00 UT", "Tue, 02 Jan 2024 10:00:00 -0530 (note)", "tue, 02 jan 2024 10:00:00 utc", "Mon, 01 Jul 1996 00:00:00 PDT", format_datetime(dt.datetime(2024, 2, 29, 1, 2, 3, tzinfo=dt.UTC))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_timestamp(clock.web_time(F.col("t")))).collect()]
    assert got == [int(parsedate_to_datetime(t).timestamp()) for t in texts]
    local = ["Tue, 02 Jan 2024 10:00:00", "2 Jan 2024 10:00 -0000", "2 Jan 2024 10:00 XYZ", "2024-01-02 10:00:00"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in local], "t string").select(clock.web_time(F.col("t"), "Asia/Seoul").cast("string")).collect()]
    assert got == ["2024-01-02 01:00:00"] * 4
    none = ["2 hours ago", "Tue, 45 Jan 2024 10:00:00 GMT", "2 Foo 2024 10:00:00 GMT", "2 anf 2024 10:00:00 GMT", "", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in none], "t string").select(clock.web_time(F.col("t"))).collect()] == [None] * 6


def test_segments_of_a_repeated_key(spark):
    from tidemark.functions.segments import segments

    rows = spark.createDataFrame([(1, "Aa. Bb."), (1, "Cc."), (2, None)], "k int, t string")
    assert sorted((r["segment"], r["char_start"], r["char_end"], r["excerpt"]) for r in segments(rows, "k", "t").collect()) == [(1, 0, 3, "Aa."), (1, 0, 3, "Cc."), (2, 4, 7, "Bb.")]


def test_embeddings_do_not_depend_on_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i == 3 else "" if i == 5 else f"alpha beta {i} gamma{i % 4} 가나") for i in range(40)], "id int, text string").coalesce(1)
    whole = rows.select("id", vectors.hash_embedding(F.col("text")).alias("v")).collect()
    monkeypatch.setattr(vectors, "SLICE", 16)
    assert rows.select("id", vectors.hash_embedding(F.col("text")).alias("v")).collect() == whole and len(whole) == 40
    assert sum(whole[3]["v"]) == 0 and abs(sum(x * x for x in whole[0]["v"]) - 1) < 1e-9
