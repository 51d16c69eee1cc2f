"""Queries over bars, predictions, dated rows and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions.numbers import parse_number
from tidemark.operators import asof, claims, news, outcomes, packing, ranking, weights
from tidemark.plans.registry import Tables, query

BARS = """bars AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS trade_date, first(value ORDER BY ts, event_id) AS o, max(value) AS h,
         min(value) AS l, last(value ORDER BY ts, event_id) AS c, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL
)"""
LABELS = """labels AS (
  SELECT ticker, trade_date, o, h, l, c, gap_return, high_return, close_return, coalesce(high_return >= 29, false) AS touched_limit,
         coalesce(close_return >= 29, false) AS closed_limit, coalesce(high_return >= 29, false) AND NOT coalesce(close_return >= 29, false) AS released,
         coalesce(gap_return >= 29 AND high_return >= 29 AND low_return >= 29 AND close_return >= 29, false) AS one_price,
         coalesce(p, 0) = 0 AS unavailable
  FROM (SELECT *, CASE WHEN p <> 0 THEN (o / p - 1) * 100 END AS gap_return, CASE WHEN p <> 0 THEN (h / p - 1) * 100 END AS high_return,
               CASE WHEN p <> 0 THEN (l / p - 1) * 100 END AS low_return, CASE WHEN p <> 0 THEN (c / p - 1) * 100 END AS close_return
        FROM (SELECT *, lag(c) OVER (PARTITION BY ticker ORDER BY trade_date) AS p FROM bars))
)"""
FLAGS = """flags AS (
  SELECT ticker, trade_date, c, pc AS prev_c, CASE WHEN s > 0 THEN v / s * 100 END AS turnover,
         CASE WHEN pd IS NULL THEN 'PRICE_UNAVAILABLE|NEW_LISTING_OR_NO_PREVIOUS_CLOSE'
              WHEN pc IS NULL OR pc <= 0 THEN 'PRICE_UNAVAILABLE|REFERENCE_PRICE_UNCERTAIN'
              WHEN ps > 0 AND abs(s - ps) / ps * 100 >= 5 THEN 'PRICE_UNAVAILABLE|CORPORATE_ACTION_SUSPECTED' ELSE '' END AS flags
  FROM (SELECT *, lag(c) OVER w AS pc, lag(s) OVER w AS ps, lag(trade_date) OVER w AS pd FROM (SELECT *, 100 + floor(v / 4) AS s FROM bars)
        WINDOW w AS (PARTITION BY ticker ORDER BY trade_date))
)"""


def _bars(t: Tables) -> DataFrame:
    return outcomes.daily_bars(t.events, "event_type", "ts", "value", "event_id")


def _listed(t: Tables) -> DataFrame:
    return _bars(t).withColumn("s", 100 + F.floor(F.col("v") / 4).cast("double"))


@query(f"WITH {BARS}, {LABELS} SELECT * FROM labels")
def outcome_labels(t: Tables) -> DataFrame:
    return outcomes.outcome_labels(_bars(t))


@query(f"WITH {BARS}, {FLAGS} SELECT * FROM flags")
def outcome_reference_flags(t: Tables) -> DataFrame:
    return outcomes.reference_flags(_listed(t)).withColumn("flags", F.array_join("flags", "|"))


@query(f"WITH {BARS}, {LABELS}, {FLAGS} SELECT labels.*, turnover FROM labels JOIN flags USING (ticker, trade_date) WHERE flags NOT LIKE 'PRICE%' AND trade_date = DATE '2024-01-20'")
def outcome_universe(t: Tables) -> DataFrame:
    return outcomes.outcome_universe(_listed(t), "2024-01-20")


PREDICTED = """per AS (
  SELECT event_type AS prediction_id, user_id AS ticker, sum(CAST(round(value * 100) AS BIGINT)) AS total, max(value) / 16.0 AS high_return, min(value) - 20 AS gap_return,
         max(value) / 16.0 >= 29 AS touched, max(value) >= 485 AS closed FROM events GROUP BY ALL
), cand AS (
  SELECT prediction_id, rank, ticker, CASE ticker % 4 WHEN 0 THEN 'SINGLE_EVENT' WHEN 1 THEN 'THEME_BENEFICIARY' WHEN 2 THEN 'CONTINUATION' ELSE 'OTHER' END AS path_type
  FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY total DESC, ticker) * 10 AS rank FROM per) WHERE total >= 40000
), outc AS (SELECT * FROM per WHERE gap_return < 300), uni AS (SELECT * FROM per WHERE high_return >= 4)"""


def _predicted(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    high = F.max("value") / 16.0
    per = t.events.groupBy(F.col("event_type").alias("prediction_id"), F.col("user_id").alias("ticker")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), high.alias("high_return"), (F.min("value") - 20).alias("gap_return"), (high >= 29).alias("touched"), (F.max("value") >= 485).alias("closed")
    )
    ranked = ranking.placed(per, F.desc("total"), "ticker").withColumn("rank", F.col("position") * 10).where("total >= 40000")
    path = F.when(F.col("ticker") % 4 == 0, "SINGLE_EVENT").when(F.col("ticker") % 4 == 1, "THEME_BENEFICIARY").when(F.col("ticker") % 4 == 2, "CONTINUATION").otherwise("OTHER")
    return ranked.select("prediction_id", "rank", "ticker", path.alias("path_type")), per.where("gap_return < 300").drop("total"), per.where("high_return >= 4").drop("total")


_M = ", ".join(
    [f"count(*) FILTER (pos <= {k} AND hit) AS hits_at_{k}" for k in ranking.CUTS]
    + [f"count(*) FILTER (pos <= {k} AND hit) / CAST(least({k}, count(*)) AS DOUBLE) AS precision_at_{k}" for k in ranking.CUTS]
    + [f"round(avg(high_return) FILTER (pos <= {k}), 9) AS avg_high_at_{k}" for k in ranking.CUTS]
    + [f"count(*) FILTER (high_return >= {x}) / CAST(nullif(count(high_return), 0) AS DOUBLE) AS high_ge_{x}_rate" for x in ranking.LEVELS]
)
#: Recalls: name, the condition on a candidate's own outcome and that on the universe's.
_T = [("limit_recall", "hit", "u.touched"), ("closed_recall", "j.closed", "u.closed"), *((f"recall_ge_{x}", f"j.high_return >= {x}", f"u.high_return >= {x}") for x in ranking.LEVELS)]
_F = ", ".join(f"count(DISTINCT j.ticker) FILTER ({own} AND {all_}{cut}) AS {n}{at}" for n, own, all_ in _T for cut, at in [("", ""), *((f" AND pos <= {k}", f"_at_{k}") for k in ranking.CUTS)])
_U = ", ".join(f"count(*) FILTER ({all_}) AS all_{n}" for n, _, all_ in _T)
_R = ", ".join(f"{n}{at} / CAST(nullif(all_{n}, 0) AS DOUBLE) AS {n}{at}" for n, _, _ in _T for at in ["", *(f"_at_{k}" for k in ranking.CUTS)])


@query(f"""WITH {PREDICTED}, j AS (
  SELECT c.prediction_id, c.ticker, high_return, gap_return, closed, coalesce(touched, false) AS hit, row_number() OVER (PARTITION BY c.prediction_id ORDER BY rank) AS pos
  FROM cand c LEFT JOIN outc USING (prediction_id, ticker)
), m AS (
  SELECT prediction_id, count(*) AS n_candidates, {_M}, count(*) FILTER (gap_return > 0) / CAST(nullif(count(gap_return), 0) AS DOUBLE) AS gap_up_rate,
         count(*) FILTER (NOT hit) / CAST(count(*) AS DOUBLE) AS false_positive_rate FROM j GROUP BY 1
), f AS (SELECT j.prediction_id, {_F} FROM j LEFT JOIN uni u ON u.prediction_id = j.prediction_id AND u.ticker = j.ticker GROUP BY 1),
a AS (SELECT prediction_id, {_U} FROM uni u GROUP BY 1)
SELECT m.*, {_R} FROM m JOIN f USING (prediction_id) LEFT JOIN a USING (prediction_id)""")
def ranking_metrics_at_k(t: Tables) -> DataFrame:
    candidates, own, universe = _predicted(t)
    # A mean's last digits depend on the order of its rows.
    return ranking.metrics_at(candidates, own, universe).withColumns({c: F.round(c, 9) for c in (f"avg_high_at_{k}" for k in ranking.CUTS)})


PATHS = {"single_event_recall": ("SINGLE_EVENT",), "theme_recall": ("THEME_BENEFICIARY",), "beneficiary_recall": ("THEME_BENEFICIARY",), "continuation_recall": ("CONTINUATION",)}


@query(f"""WITH {PREDICTED}, lim AS (SELECT DISTINCT prediction_id, ticker FROM uni WHERE touched)
SELECT prediction_id, count(*) AS limit_tickers, {", ".join(f"count(c.ticker) FILTER (path_type = '{p[0]}') / CAST(count(*) AS DOUBLE) AS {n}" for n, p in PATHS.items())}
FROM lim LEFT JOIN (SELECT * FROM cand WHERE EXISTS (SELECT 1 FROM outc WHERE touched AND outc.prediction_id = cand.prediction_id AND outc.ticker = cand.ticker)) c USING (prediction_id, ticker) GROUP BY 1""")
def path_recall(t: Tables) -> DataFrame:
    candidates, own, universe = _predicted(t)
    return ranking.path_recall(candidates, universe, PATHS, own)


@query(f"WITH {PREDICTED} SELECT DISTINCT prediction_id, ticker FROM uni WHERE touched AND NOT EXISTS (SELECT 1 FROM cand WHERE cand.prediction_id = uni.prediction_id AND cand.ticker = uni.ticker)")
def misses(t: Tables) -> DataFrame:
    candidates, _, universe = _predicted(t)
    return ranking.misses(universe, candidates)


@query(f"WITH {PREDICTED} SELECT prediction_id, ticker, rank FROM cand WHERE NOT EXISTS (SELECT 1 FROM outc WHERE touched AND outc.prediction_id = cand.prediction_id AND outc.ticker = cand.ticker)")
def false_positives(t: Tables) -> DataFrame:
    candidates, own, _ = _predicted(t)
    return ranking.false_positives(candidates, own).select("prediction_id", "ticker", "rank")


@query(f"""WITH {PREDICTED}, fp AS (SELECT DISTINCT prediction_id FROM cand WHERE NOT EXISTS (SELECT 1 FROM outc WHERE touched AND outc.prediction_id = cand.prediction_id AND outc.ticker = cand.ticker)),
ms AS (SELECT DISTINCT prediction_id FROM uni WHERE touched AND NOT EXISTS (SELECT 1 FROM cand WHERE cand.prediction_id = uni.prediction_id AND cand.ticker = uni.ticker))
SELECT prediction_id, concat_ws('|', CASE WHEN prediction_id IN (SELECT * FROM fp) THEN 'UNKNOWN' END, CASE WHEN prediction_id IN (SELECT * FROM ms) THEN 'RANKING_MISS' END) AS failure_codes
FROM (SELECT DISTINCT prediction_id FROM cand)""")
def failure_codes(t: Tables) -> DataFrame:
    candidates, own, universe = _predicted(t)
    codes = ranking.failure_codes(ranking.false_positives(candidates, own), ranking.misses(universe, candidates), candidates)
    return codes.withColumn("failure_codes", F.array_join("failure_codes", "|"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS sealed, coalesce(o_totalprice > 100000, false) AS priced, o_orderpriority NOT LIKE '5%' AS urgent,
concat_ws('|', CASE WHEN NOT o_orderstatus = 'F' THEN 'sealed' END, CASE WHEN NOT o_totalprice > 100000 THEN 'priced' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'urgent' END) AS failed_rules FROM orders""")
def eligibility_matrix(t: Tables) -> DataFrame:
    rules = {"sealed": F.col("o_orderstatus") == "F", "priced": F.col("o_totalprice") > 100000, "urgent": ~F.col("o_orderpriority").startswith("5")}
    out = ranking.eligibility(t.orders, rules)
    return out.select("o_orderkey", *rules, F.array_join("failed_rules", "|").alias("failed_rules"))


def _day():
    return F.lit("2024-01-15").cast("date")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14 15:30:00' AND TIMESTAMP '2024-01-15 08:59:59'")
def news_window(t: Tables) -> DataFrame:
    return t.events.where(news.in_window(F.col("ts"), clock.window_start(_day()), clock.cutoff(_day()))).select("event_id", "ts")


DISPOSED = "d AS (SELECT *, CASE WHEN ts > TIMESTAMP '2024-01-15 08:59:59' THEN 'EXCLUDED_AFTER_CUTOFF' WHEN ts < TIMESTAMP '2024-01-14 15:30:00' THEN 'EXCLUDED_BEFORE_WINDOW' ELSE 'INCLUDED' END AS disposition FROM events)"


def _disposed(t: Tables) -> DataFrame:
    return news.disposition(t.events, "ts", clock.window_start(_day()), clock.cutoff(_day()))


@query(f"WITH {DISPOSED} SELECT event_id, disposition FROM d")
def row_disposition(t: Tables) -> DataFrame:
    return _disposed(t).select("event_id", "disposition")


@query(f"""WITH {DISPOSED} SELECT event_type, count(*) AS n_rows, count(*) FILTER (disposition = 'INCLUDED') AS n_included,
count(*) FILTER (disposition = 'EXCLUDED_AFTER_CUTOFF') AS n_excluded_after_cutoff, count(*) FILTER (disposition = 'EXCLUDED_BEFORE_WINDOW') AS n_excluded_before_window FROM d GROUP BY 1""")
def disposition_summary(t: Tables) -> DataFrame:
    return news.disposition_summary(_disposed(t), "event_type")


@query("SELECT CAST(max(ts) AS DATE) AS trade_date FROM events")
def trade_date_detection(t: Tables) -> DataFrame:
    return news.trade_date(t.events.withColumn("day", F.to_date("ts")), "day")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CASE dayofweek(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS next_day, CAST(CAST(o_orderdate AS DATE) - 1 AS DATE) AS previous_day FROM orders")
def next_trading_day(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", clock.next_trading_day(day).alias("next_day"), clock.previous_day(day).alias("previous_day"))


ASKS = "asks AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-03' + to_days(CAST(user_id % 25 AS INTEGER)) AS asked FROM events)"


@query(f"WITH {ASKS} SELECT a.user_id, a.asked, e.ts AS fact_at, e.value FROM asks a ASOF LEFT JOIN (SELECT user_id, ts, last(value ORDER BY event_id) AS value FROM events GROUP BY ALL) e ON a.user_id = e.user_id AND a.asked >= e.ts")
def asof_snapshot(t: Tables) -> DataFrame:
    asked = F.lit("2024-01-03").cast("timestamp_ntz") + F.make_dt_interval((F.col("user_id") % 25).cast("int"))
    asks = t.events.select("user_id").distinct().withColumn("asked", asked)
    return asof.latest_as_of(asks, t.events, "user_id", "asked", "ts", "event_id", "value")


@query("""WITH asked AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 1 AND l_orderkey % 10 = 0 THEN 100000000 ELSE 0 END AS o_orderkey FROM lineitem)
SELECT a.o_orderkey, coalesce(o_orderdate <= TIMESTAMP '1995-06-30', false) AS included FROM asked a LEFT JOIN orders USING (o_orderkey)""")
def asof_availability(t: Tables) -> DataFrame:
    gone = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 10 == 0), 100000000).otherwise(0)
    ids = t.lineitem.select((F.col("l_orderkey") + gone).alias("o_orderkey")).distinct()
    return asof.availability(ids, t.orders, "o_orderkey", "o_orderdate", F.lit("1995-06-30").cast("timestamp_ntz")).select("o_orderkey", "included")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def future_leak(t: Tables) -> DataFrame:
    passages = t.benchmark.select("item_id", F.col("text").alias("passage"))
    return asof.future_leaks(t.documents.select("doc_id", "text"), passages, "text", "passage").select("doc_id", "item_id")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'invalid_available_from' WHEN ts > TIMESTAMP '2024-01-20' THEN 'available_from_after_cutoff' END
WHEN event_id % 4 = 1 THEN CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'known_at_after_cutoff' END ELSE 'missing_temporal_scope' END AS reason FROM events""")
def temporal_scope_reason(t: Tables) -> DataFrame:
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    available = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 3 == 0, "soon").otherwise(time))
    known = F.when(F.col("event_id") % 4 == 1, time)
    return t.events.select("event_id", asof.scope_reason(available, known, F.lit("2024-01-20").cast("timestamp")).alias("reason"))


SHARE = "w AS (SELECT l_orderkey, CASE WHEN l_linenumber = 2 AND l_orderkey % 9 = 0 THEN 'none' ELSE CAST(1.0 / count(*) OVER (PARTITION BY l_orderkey) AS VARCHAR) END AS weight FROM lineitem)"


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber = 2 AND l_orderkey % 9 = 0) AS lost FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(CAST(n - lost AS DOUBLE) / n, 9) AS weight_sum FROM n WHERE lost > 0""")
def weight_sum_check(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.lineitem.join(n, "l_orderkey")
    text = F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 9 == 0), "none").otherwise((1 / F.col("n")).cast("string"))
    return weights.sum_check(rows.withColumn("w", text), F.col("w"), "l_orderkey").withColumn("weight_sum", F.bround("weight_sum", 9))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = n
THEN round_even(1 - (n - 1) * round_even(1.0::DOUBLE / n, 6), 6) ELSE round_even(1.0::DOUBLE / n, 6) END AS weight FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)""")
def fractional_weights(t: Tables) -> DataFrame:
    return weights.fractional(t.lineitem, ["l_linenumber", "l_partkey", "l_suppkey"], "l_orderkey").select("l_orderkey", "l_linenumber", "weight")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 5 = 0 THEN -1.0 ELSE 0.25 END::DOUBLE AS weight FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(weight, greatest(0.0, 1 - coalesce(sum(CASE WHEN weight >= 0 THEN weight END) OVER p, 0.0)) / nullif(count(*) FILTER (weight IS NULL) OVER p, 0)) AS weight
FROM w WINDOW p AS (PARTITION BY l_orderkey)""")
def weight_fill(t: Tables) -> DataFrame:
    weight = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).when(F.col("l_linenumber") % 5 == 0, -1.0).otherwise(0.25).cast("double")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", weight.alias("weight"))
    return weights.fill_missing(rows, "weight", "l_orderkey")


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) AS rn FROM lineitem)
WHERE rn > 1 AND l_linestatus <> 'F'""")
def repeated_issuer_days(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("policy", F.when(F.col("l_linestatus") == "F", "fractional_equal").otherwise("whole"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    return weights.repeated_keys(rows, F.col("policy"), order, "l_orderkey", "l_returnflag").select("l_orderkey", "l_linenumber")


SHARDED = "s AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS position FROM documents)"


def _sharded(t: Tables) -> DataFrame:
    return packing.shards(t.documents.select("doc_id", "text"), 20, F.floor(F.col("doc_id") / 1000), "doc_id")


@query(f"WITH {SHARDED} SELECT doc_id, position, CAST(floor((position - 1) / 20.0) + 1 AS BIGINT) AS shard FROM s")
def shards(t: Tables) -> DataFrame:
    return _sharded(t).select("doc_id", "position", "shard")


@query(f"WITH {SHARDED} SELECT CAST(floor((position - 1) / 20.0) + 1 AS BIGINT) AS shard, count(*) AS n_rows, sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY position)) AS shard_sha FROM s GROUP BY 1")
def shard_hash(t: Tables) -> DataFrame:
    return packing.shard_hashes(_sharded(t), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CAST(floor(value) AS BIGINT) AS cost FROM events),
r(user_id, k, used) AS (
  SELECT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT r.user_id, c.k, r.used + CASE WHEN r.used + c.cost <= 2000 THEN c.cost ELSE 0 END FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1
)
SELECT c.user_id, c.event_id, c.cost, b.used + c.cost <= 2000 AS packed FROM c JOIN r b ON b.user_id = c.user_id AND b.k = c.k - 1""")
def greedy_budget_pack(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.floor("value").cast("long").alias("cost"))
    return packing.pack_greedy(rows, 2000, "cost", "event_id", "user_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def ordered_distinct(t: Tables) -> DataFrame:
    return packing.ordered_distinct(t.events, "user_id", "event_id")


@query("""SELECT CAST(floor((position - 1) / 500.0) + 1 AS BIGINT) AS shard, count(*) AS n_rows, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value >= 400) AS high, count(*) FILTER (value < 50) AS low
FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS position FROM events) GROUP BY 1""")
def sweep_buckets(t: Tables) -> DataFrame:
    sharded = packing.shards(t.events, 500, F.floor(F.col("event_id") / 5000), "event_id")
    return packing.sweep(sharded, {"clicks": F.col("event_type") == "click", "high": F.col("value") >= 400, "low": F.col("value") < 50}, "shard")


@query("""WITH c AS (SELECT conv_id || '/' || turn AS conv_id, text, DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS day FROM conversations)
SELECT conv_id, CAST(pos - 1 AS INTEGER) AS position, word AS statement, CAST(day + CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS available_from,
'CLAIM-' || substr(sha256(conv_id || '|' || (pos - 1) || '|' || word), 1, 12) AS claim_id
FROM c, unnest(string_split(text, ' ')) WITH ORDINALITY AS u(word, pos)""")
def claims_explode(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int"))
    turns = t.conversations.withColumn("day", day).withColumn("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    return claims.claims_from_lessons(turns, "conv_id", F.col("day"), F.split("text", " ", -1))


@query("""WITH c AS (SELECT o_orderkey AS claim_id, o_orderdate AS f FROM orders), s AS (SELECT l_orderkey AS claim_id, l_suppkey * 3 AS episode_id FROM lineitem),
e AS (SELECT s_suppkey AS episode_id, TIMESTAMP '1992-01-01' + to_days(CAST(s_suppkey * 20 AS INTEGER)) AS f FROM supplier)
SELECT s.claim_id, s.episode_id, CASE WHEN e.f IS NULL THEN 'unknown_support' ELSE 'temporal_leak' END AS problem FROM s JOIN c USING (claim_id) LEFT JOIN e USING (episode_id) WHERE e.f IS NULL OR e.f > c.f""")
def claims_temporal_leak(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderdate").alias("available_from"))
    support = t.lineitem.select(F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") * 3).alias("episode_id"))
    known = F.lit("1992-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("s_suppkey") * 20).cast("int"))
    episodes = t.supplier.select(F.col("s_suppkey").alias("episode_id"), known.alias("available_from"))
    return asof.support_problems(own, support, episodes)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey AS DOUBLE) + 1000 END AS number FROM part""")
def price_number_parse(t: Tables) -> DataFrame:
    """The first alias that isn't blank decides; commas go; what is no number is null."""
    first = F.when(F.col("p_partkey") % 5 == 0, "n/a").when(F.col("p_partkey") % 2 == 0, " ").otherwise(F.format_number(F.col("p_partkey") + 1000, 0))
    return t.part.select("p_partkey", parse_number(first, F.format_number(F.col("p_partkey") + 1000, 2)).alias("number"))
