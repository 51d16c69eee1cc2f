import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, audits, news, outcomes, packing, ranking, reconcile, records, training, weights
from tidemark.sources import bundles, news_csv
from tidemark.sources.warehouse import Warehouse

D = dt.date


def bars(spark, rows):
    return spark.createDataFrame(rows, "ticker string, trade_date date, o double, h double, l double, c double, v double, s double")


PRICES = [
    ("901001", D(2030, 1, 8), 100.0, 110.0, 95.0, 100.0, 1000.0, 10000.0), ("901001", D(2030, 1, 10), 105.0, 130.0, 100.0, 129.0, 2000.0, 10000.0),
    ("903003", D(2030, 1, 8), 100.0, 100.0, 100.0, 100.0, 1000.0, 10000.0), ("903003", D(2030, 1, 10), 130.0, 130.0, 130.0, 130.0, 3000.0, 10000.0),
    ("333333", D(2030, 1, 10), 130.0, 130.0, 130.0, 130.0, 1.0, 10000.0),
    ("444444", D(2030, 1, 8), 0.0, 0.0, 0.0, 0.0, 1.0, 10000.0), ("444444", D(2030, 1, 10), 130.0, 130.0, 130.0, 130.0, 1.0, 10000.0),
    ("555555", D(2030, 1, 8), 100.0, 100.0, 100.0, 100.0, 1.0, 10000.0), ("555555", D(2030, 1, 10), 130.0, 130.0, 130.0, 130.0, 1.0, 11000.0),
]


def test_outcomes(spark):
    b = bars(spark, PRICES)
    rows = {r["ticker"]: r for r in outcomes.outcome_labels(b).where("trade_date = '2030-01-10'").collect()}
    a = rows["901001"]
    assert (round(a["gap_return"]), round(a["high_return"]), a["touched_limit"], a["closed_limit"], a["released"], a["one_price"]) == (5, 30, True, True, False, False)
    assert rows["903003"]["one_price"] and rows["333333"]["unavailable"] and rows["333333"]["touched_limit"] is False
    flags = {r["ticker"]: r["flags"] for r in outcomes.reference_flags(b).where("trade_date = '2030-01-10'").collect()}
    assert flags["901001"] == [] and flags["333333"][1] == outcomes.NEW and flags["444444"][1] == outcomes.UNCERTAIN and flags["555555"][1] == outcomes.SUSPECT
    assert {r["ticker"] for r in outcomes.outcome_universe(b, "2030-01-10").collect()} == {"901001", "903003"}
    asked = spark.createDataFrame([("901001",), ("000000",)], "ticker string")
    assert {r["ticker"]: r["flags"] for r in outcomes.outcomes_on(asked, b, "2030-01-10").collect()} == {"901001": [], "000000": [outcomes.UNAVAILABLE]}


def test_ranking(spark):
    c = spark.createDataFrame([("p", 1, "T1", "SINGLE_EVENT"), ("p", 2, "T2", "THEME_BENEFICIARY"), ("p", 3, "T3", "CONTINUATION")], "prediction_id string, rank int, ticker string, path_type string")
    own = spark.createDataFrame([("p", "T1", 2.0, 29.0, True, True), ("p", "T2", 0.0, 12.0, False, False), ("p", "T3", None, 4.0, False, False)], "prediction_id string, ticker string, gap_return double, high_return double, touched boolean, closed boolean")
    m = ranking.metrics_at(c, own).first()
    assert (m["hits_at_5"], m["precision_at_5"], m["avg_high_at_5"], m["gap_up_rate"], m["false_positive_rate"], m["high_ge_5_rate"], m["high_ge_15_rate"]) == (1, 1 / 3, 15.0, 0.5, 2 / 3, 2 / 3, 1 / 3)
    u = spark.createDataFrame([("p", "T1", 29.0, True, True), ("p", "T2", 12.0, False, False), ("p", "T4", 18.0, True, False), ("p", "T5", 4.0, False, False)], "prediction_id string, ticker string, high_return double, touched boolean, closed boolean")
    two = c.where("rank < 3")
    m = ranking.metrics_at(two, own, u).first()
    assert (m["limit_recall"], m["closed_recall"], m["recall_ge_5"], m["recall_ge_10"], m["recall_ge_15"], m["recall_ge_20"]) == (0.5, 1.0, 2 / 3, 2 / 3, 0.5, 1.0)
    p = ranking.path_recall(two, u, {"single": ("SINGLE_EVENT",), "theme": ("THEME_BENEFICIARY",)}).first()
    assert (p["single"], p["theme"]) == (0.5, 0.0)
    assert [r["ticker"] for r in ranking.misses(u, two).collect()] == ["T4"]
    codes = ranking.failure_codes(ranking.false_positives(two, own), ranking.misses(u, two), two).first()
    assert codes["failure_codes"] == ["UNKNOWN", "RANKING_MISS"]


def test_clusters(spark):
    rows = spark.createDataFrame([(2, "2030-01-10 08:00", "Current  Catalyst", "Repeated update"), (3, "2030-01-10 08:01", " current catalyst ", "Repeated     update"), (4, "2030-01-10 08:02", "Another catalyst", "Different update")], "row_number long, ts string, title string, body string")
    assert [r["members"] for r in news.cluster_members(rows, "row_number", "title", "body").orderBy("cluster_index").collect()] == [[2, 3], [4]]
    s = news.cluster_summary(news.event_clusters(rows, "row_number", F.col("ts"), "title", "body", cut=F.lit("2030-01-10 08:01"))).first()
    assert (s["n_clusters"], s["n_exact_repeats"], s["n_repeated_clusters"]) == (2, 1, 1)


def test_news_csv(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_bytes("page,row,date,time,title,body,collected_date,collected_time\n1,1,2030-01-09,14:59:00,\"속보, \"\"A\"\"\",\"본문\n둘째\",2030-01-10,08:31:02\n1,2,2030-01-10,8:1:2,B,,,\n".encode("cp949"))
    rows = news_csv.read_news(spark, str(path)).orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == [1, 2] and rows[0]["body"] == "본문\n둘째" and rows[1]["published_at"] == dt.datetime(2030, 1, 10, 8, 1, 2)
    assert rows[0]["collected_at"] == dt.datetime(2030, 1, 10, 8, 31, 2) and rows[1]["body"] == ""
    path.write_text("date,body\n2030-01-09,x\n")
    with pytest.raises(ValueError, match="time, title"):
        news_csv.read_news(spark, str(path))
    path.write_text("date,time,title\n2030-01-09,10:00:00,A\n2030-01-09,10:00:00,\n")
    with pytest.raises(ValueError, match="row 2 missing required title"):
        news_csv.read_news(spark, str(path))


def test_bundle(spark):
    text = "---\nepisode_id: 'EP-1'\n---\n<!-- BUNDLE:BEGIN a.jsonl -->\n```json\n{\"x\": 1}\n\n[2]\n```\n<!-- BUNDLE:END a.jsonl -->\n<!-- BUNDLE:BEGIN b.json -->\n"
    t = spark.createDataFrame([("p", text)], "path string, text string")
    assert [(r["key"], r["value"]) for r in bundles.front_matter(t).collect()] == [("episode_id", "EP-1")]
    assert [(r["line"], r["valid"]) for r in bundles.json_lines(bundles.blocks(t)).orderBy("line").collect()] == [(1, True), (2, False)]
    assert [(r["block"], r["error"]) for r in bundles.block_errors(t).collect()] == [("b.json", "missing_end")]


def test_weights(spark):
    w = spark.createDataFrame([("a", "0.5"), ("a", "0.5"), ("b", "0.5"), ("c", "x")], "k string, w string")
    assert {(r["k"], r["weight_sum"]) for r in weights.sum_check(w, F.col("w"), "k").collect()} == {("b", 0.5), ("c", 0.0)}
    f = [r["weight"] for r in weights.fractional(spark.range(128).withColumn("k", F.lit(1)), ["id"], "k").orderBy("id").collect()]
    assert f[0] == 0.007812 and abs(sum(f) - 1) < 1e-9


def test_packing(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate([50, 60, 40, 200, 10])], "g string, id long, cost long")
    assert [r["id"] for r in packing.pack_greedy(rows, 100, "cost", "id", "g").where("packed").orderBy("id").collect()] == [0, 2, 4]
    s = packing.shards(spark.range(45), 20, F.floor(F.col("id") / 7), "id")
    assert [r["n"] for r in s.groupBy("shard").agg(F.count("id").alias("n")).orderBy("shard").collect()] == [20, 20, 5]


def test_reconcile(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(1, "x"), (3, "z")], "k long, v string")
    assert {(r["k"], r["status"]) for r in reconcile.identity_delta(a, b, "k").collect()} == {(2, "missing"), (3, "extra")}
    assert {(r["k"], r["n_expected"], r["n_actual"]) for r in reconcile.multiset_delta(a, b, "k").collect()} == {(1, 2, 1), (2, 1, 0), (3, 0, 1)}
    assert {(r["k"], r["status"]) for r in reconcile.snapshot_diff(a.distinct(), b, "k", F.col("v")).collect()} == {(2, "removed"), (3, "added")}
    assert reconcile.multisets_equal(a, a, "k", "v") and not reconcile.multisets_equal(a, b, "k", "v")


def test_asof(spark):
    facts = spark.createDataFrame([("u", dt.datetime(2030, 1, 1), 1, 1.0), ("u", dt.datetime(2030, 1, 3), 2, 2.0)], "u string, t timestamp_ntz, id long, v double")
    asks = spark.createDataFrame([("u", dt.datetime(2030, 1, 3)), ("u", dt.datetime(2029, 1, 1)), ("w", dt.datetime(2030, 1, 1))], "u string, at timestamp_ntz")
    got = {(r["u"], r["at"].year, r["v"]) for r in asof.latest_as_of(asks, facts, "u", "at", "t", "id", "v").collect()}
    assert got == {("u", 2030, 2.0), ("u", 2029, None), ("w", 2030, None)}
    strict = asof.latest_as_of(asks.where("u = 'u' and at > '2030-01-01'"), facts, "u", "at", "t", "id", "v", inclusive=False).first()
    assert strict["v"] == 1.0
    prices = asof.BlindPrices(spark.createDataFrame([(D(2030, 1, 9),), (D(2030, 1, 10),)], "trade_date date"), "2030-01-10")
    assert prices.before().count() == 1
    with pytest.raises(PermissionError):
        prices.before("2030-01-11")
    with pytest.raises(PermissionError):
        prices.outcomes()


def test_record_query(spark):
    rows = spark.createDataFrame([("R1", "theme", D(2030, 1, 1), '{"peer_universe": ["000001", "000002"], "chosen_leader_company_name": "Leader Co", "chosen_leader_ticker": "000001"}', True), ("R2", "beneficiary", D(2030, 1, 2), '{"candidate_ticker": "000003", "D_outcome": {"code": "000004", "name": "Outcome Co"}, "candidate_lane": "INFERRED_NEW"}', False)], "record_id string, record_type string, trade_date date, payload string, training_eligible boolean")
    r = records.with_aliases(rows)
    ask = lambda **k: [x["record_id"] for x in records.query_records(r, **k).collect()]
    assert ask(ticker="000002", company_name="Leader Co") == ["R1"] and ask(ticker="000004", path_type="INFERRED_NEW") == ["R2"]
    assert ask(record_type=["theme", "beneficiary"]) == ["R1", "R2"] and ask(record_type=[]) == ["R1", "R2"] and ask(limit=1) == ["R1"]
    assert [x["ticker"] for x in r.orderBy("record_id").collect()] == ["000001", "000003"]
    with pytest.raises(ValueError):
        ask(limit=0)


def test_audits_and_training(spark):
    rows = spark.createDataFrame([("a", "t", True), ("a", "t", True), ("b", "t", None)], "record_id string, kind string, training_eligible boolean")
    assert [(r["check_id"], r["subject_id"]) for r in audits.duplicate(rows, "DUP", "record_id").collect()] == [("DUP", "a")]
    with pytest.raises(ValueError, match="DUP:a"):
        audits.gate(audits.duplicate(rows, "DUP", "record_id"))
    done, skipped = training.export(rows, {"sft": ["t"]}, "kind", F.col("training_eligible"), F.lit(True))
    assert done.count() == 2 and skipped.first()["skip_reason"] == "not_training_eligible"


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    none = spark.createDataFrame([], "record_id string, episode_id string")
    w.write("record_provenance", none)
    assert w.counts("record_provenance") == {"record_provenance": 0} and w.missing_columns("record_provenance") == []
    w.write("record_provenance", spark.createDataFrame([("a", "1"), ("b", "1")], "record_id string, episode_id string"))
    w.upsert("record_provenance", w.read("record_provenance").where("record_id = 'b'").withColumn("episode_id", F.lit("2")), "record_id")
    assert {(r["record_id"], r["episode_id"]) for r in w.read("record_provenance").collect()} == {("a", "1"), ("b", "2")}


def test_empty_inputs(spark):
    assert outcomes.outcome_labels(bars(spark, [])).count() == 0
    assert packing.shards(spark.range(0), 5, F.col("id"), "id").count() == 0
    assert reconcile.identity_delta(spark.range(0), spark.range(0), "id").count() == 0


def test_future_leaks(spark):
    from tidemark.operators.asof import future_leaks

    texts = spark.createDataFrame([(1, "REC-1 and REC-12"), (2, "nothing"), (3, None), (4, "漢REC-2漢REC-2")], "doc int, text string")
    ids = spark.createDataFrame([("REC-1", 1), ("REC-12", 2), ("REC-2", 3), ("REC-2", 4), (None, 5)], "id string, k int")
    want = {(1, 1), (1, 2), (4, 3), (4, 4)}
    for most in (0, 1 << 20):
        assert {(r["doc"], r["k"]) for r in future_leaks(texts, ids, "text", "id", most).collect()} == want
    blank = spark.createDataFrame([("", 1)], "id string, k int")
    assert {r["doc"] for r in future_leaks(texts, blank, "text", "id").collect()} == {1, 2, 4} == {r["doc"] for r in future_leaks(texts, blank, "text", "id", 0).collect()}
    assert future_leaks(texts, ids.limit(0), "text", "id").collect() == []


def test_cluster_rows(spark, monkeypatch):
    """Places of rows over many ranges, one cluster that holds most rows, null and repeated numbers, an empty table."""
    monkeypatch.setattr(packing, "RANGE_ROWS", 16)
    texts = ["Hot  text" if i % 3 else f"text {i % 7}" for i in range(200)] + [None, " "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "hot TEXT"), (5, "hot text")]
    df = spark.createDataFrame(rows, "n long, t string").repartition(7)
    got = news.cluster_rows(df, "n", "t").collect()
    groups = {}
    for n, t in rows:
        groups.setdefault(" ".join((t or "").lower().split()), []).append(n)
    order = sorted(groups, key=lambda k: min(n for n in groups[k] if n is not None))
    assert len(got) == len(rows)
    for index, k in enumerate(order, 1):
        own = sorted((r for r in got if r["cluster_index"] == index), key=lambda r: r["member_index"])
        assert [r["member_index"] for r in own] == list(range(1, len(groups[k]) + 1)) and {r["n_rows"] for r in own} == {len(groups[k])}
        assert [r["n"] for r in own] == sorted(groups[k], key=lambda n: (n is not None, n or 0)) and len({r["cluster_sha"] for r in own}) == 1
    assert news.cluster_rows(df.where("false"), "n", "t").count() == 0
