"""Sources and rules on small inputs, with values that the tables don't have."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock, payload
from tidemark.operators import audits, guards, ranking, retrieval
from tidemark.sources import episodes, news_csv, prices


def shard(root, ticker, year, text):
    path = root / ticker[:3] / ticker
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{year}.csv").write_bytes(text)


def test_prices(spark, tmp_path):
    shard(tmp_path, "900100", 2024, "Trade Date,Open,High,Low,Close,Volume\n2024-01-02 00:00:00,1,2,3,\"1,234.5\",10\nnever,1,1,1,1,1\n2024-01-03,n/a,2,3,4,\n".encode())
    shard(tmp_path, "900200", 2024, "﻿close_price,d\r\n7,2024-01-05\r\n".encode())
    shard(tmp_path, "900300", 2024, b"d,c\n2024-01-05,\xff\n")
    got = sorted((r["ticker"], r["trade_date"].isoformat(), r["o"], r["c"], r["v"]) for r in prices.read_prices(spark, str(tmp_path)).collect())
    assert got == [("900100", "2024-01-02", 1.0, 1234.5, 10.0), ("900100", "2024-01-03", None, 4.0, None), ("900200", "2024-01-05", None, 7.0, None)]


def test_news(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("date,time,title,body,collected_at\n2030-01-09,14:59:00,A,B,2030-01-09T00:00:00Z\n2030-01-09,15:00:00,C,,2030-01-09T10:00:00\n")
    rows = news_csv.read_news(spark, str(path)).orderBy("row_number").collect()
    assert [r["collected_at"] for r in rows] == [dt.datetime(2030, 1, 9, 9), dt.datetime(2030, 1, 9, 10)]
    assert rows[0]["event_id"] == "EVT-" + hashlib.sha256("A|B|2030-01-09T14:59:00+09:00".encode()).hexdigest()[:12]
    for text, match in (("2030-13-09,10:00:00,A", "row 1 has an invalid date: 2030-13-09"), ("2030-01-09,ten,A", "row 1 has an invalid time: ten")):
        path.write_text(f"date,time,title\n{text}\n")
        with pytest.raises(ValueError, match=match):
            news_csv.read_news(spark, str(path))


def test_times(spark):
    ask = lambda text: spark.range(1).select(clock.web_time(F.lit(text), "Asia/Seoul")).first()[0]
    end = dt.datetime(2030, 1, 9, 14, 59, 59)
    assert ask("2030-01-09") == ask("2030/01/09") == ask(" 2030.01.09 ") == end and ask("2030-01/09") is None
    assert ask("2030-01-09T09:00:00") == dt.datetime(2030, 1, 9) and ask("2030-01-09T09:00:00Z") == dt.datetime(2030, 1, 9, 9) and ask("2 hours ago") is None


def test_payload(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(payload.alias_values(F.lit('{"a": [true, ["y", [2.0]], {"b": 1}, " "], "c": {"d": 3}}'), ["$.a", "$.c.d", "$.c"])) == ["y", "2.0", "3"]
    assert one(payload.alias_values(F.lit("[1"), ["$.a"])) == [] and one(payload.alias_values(F.lit(None).cast("string"), ["$.a"])) == []
    held = '{"b": 1, "own": "x"}'
    assert one(payload.seal(F.lit(held), "own")) == hashlib.sha256(b'{"b":1,"own":null}').hexdigest() and one(payload.seal(F.lit("[]"), "own")) is None
    found = one(payload.references(F.lit(json.dumps({"Event_IDs": ["EVT-2", 3], "x": {"base_fact_id": "F1", "fact_ids": "no"}}))))
    assert [(r["kind"], r["id"]) for r in found] == [("event", "EVT-2"), ("fact", "F1")]


def test_recalls(spark):
    c = spark.createDataFrame([("p", k + 1, f"T{k}") for k in range(8)] + [("p", 9, "T0")], "prediction_id string, rank int, ticker string")
    own = spark.createDataFrame([("p", f"T{k}", None, 30.0 if k in (0, 6) else None, k in (0, 6), False) for k in range(8)], "prediction_id string, ticker string, gap_return double, high_return double, touched boolean, closed boolean")
    u = spark.createDataFrame([("p", "T0", 30.0, True, False), ("p", "T6", 30.0, True, False), ("p", "T1", 30.0, True, True), ("p", "X", 30.0, True, False)], "prediction_id string, ticker string, high_return double, touched boolean, closed boolean")
    m = ranking.metrics_at(c, own, u).first()
    assert (m["limit_recall_at_5"], m["limit_recall_at_10"], m["limit_recall"], m["closed_recall_at_5"], m["recall_ge_20_at_5"], m["high_ge_5_rate"]) == (0.25, 0.5, 0.5, 0.0, 0.25, 1.0)


def test_retrieval(spark):
    store = spark.createDataFrame([(i, [f"w{i % 7}", "all"], [float(i % 3), 1.0]) for i in range(3000)], "id long, terms array<string>, vector array<double>").repartition(5)
    asked = spark.createDataFrame([("a", ["w3", "none"], [1.0, 0.0]), ("b", [], [])], "q string, terms array<string>, vector array<double>")
    got = [(r["q"], r["id"], r["score"]) for r in retrieval.hybrid(asked, store, "q", "id", 3).orderBy("q", "rank").collect()]
    best = sorted(((-(int(i % 7 == 3) + i % 3), i) for i in range(3000)))[:3]
    assert got == [("a", i, float(-s)) for s, i in best] + [("b", i, 0.0) for i in range(3)]
    assert retrieval.hybrid(asked.limit(0), store, "q", "id", 3).count() == 0


def test_twins(spark):
    rows = spark.createDataFrame([("a", "# A\nProvider: x\n body \n\nend"), ("b", "Model: y\nbody\nend"), ("c", "body\nend "), ("d", "other"), ("e", "other")], "path string, text string")
    assert sorted((r["check_id"], r["subject_id"], r["detail"]) for r in audits.twins(rows, "path", "text").collect()) == [("IDENTICAL_BODIES", "a", "a"), ("IDENTICAL_BODIES", "b", "a"), ("IDENTICAL_BODIES", "c", "a"), ("IDENTICAL_BODIES", "d", "d"), ("IDENTICAL_BODIES", "e", "d"), ("IDENTICAL_FILES", "d", "d"), ("IDENTICAL_FILES", "e", "d")]


def test_episodes(spark, tmp_path):
    for name, day in (("b", "2030-01-01"), ("a", "2030-01-02")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"episode_id": name, "trade_date": day}, indent=1))
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"record_id": f"{name}{k}", "episode_id": name, "trade_date": day}) + "\n\n" for k in (2, 1)))
    kind = "record_id string, episode_id string, trade_date date"
    assert [r["episode_id"] for r in episodes.episodes(spark, str(tmp_path), "episode_id string, trade_date date").collect()] == ["b", "a"]
    manifests = spark.createDataFrame([("a", False), ("c", None)], "episode_id string, accepted boolean")
    assert [r["record_id"] for r in episodes.record_lines(spark, f"{tmp_path}/*.jsonl", kind).collect()] == ["b1", "b2", "a1", "a2"]
    left = episodes.record_lines(spark, f"{tmp_path}/*.jsonl", kind, manifests)
    assert [r["record_id"] for r in left.collect()] == ["b1", "b2"] and episodes.by_ids(left, spark.createDataFrame([("b2",), ("z",)], "record_id string")).count() == 1
    assert {r["n_lines"] for r in episodes.line_counts(spark, f"{tmp_path}/*.jsonl").collect()} == {2}


def test_guards(spark):
    asked = spark.createDataFrame([("u",), ("v",)], "url string")
    assert {(r["url"], r["may_open"]) for r in guards.openable(asked, asked.where("url = 'u'"), "url").collect()} == {("u", True), ("v", False)}
    rows = spark.createDataFrame([("k", "rejected"), ("k", "accepted"), ("m", "odd"), ("m", "episode")], "k string, s string")
    assert {(r["k"], r["s"]) for r in guards.by_precedence(rows, "k", "s").collect()} == {("k", "accepted"), ("m", "episode")}
