"""Queries over nested records and what is kept of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import direct_ingest as ingest
from tidemark.operators.incremental import Grouped, Mapped, update
from tidemark.session import shared_folder
from tidemark.sources.snapshots import Snapshots
from tidemark.plans.registry import Tables, query
from tidemark.plans.rules import _choice


def _event_records(t: Tables) -> DataFrame:
    """Events as nested records of 20 bundles: members outside and inside, some null, some absent."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", ingest.ISSUER).when(F.col("event_type") == "click", ingest.DIRECT).when(F.col("event_type") == "error", "ranking_error_case").when(F.col("event_type") == "signup", "negative_control_case").otherwise("blind_leader_preference_pair")
    outer = F.format_string(
        '{"record_type":"%s","brain_delta_id":"E%s","ticker":"U%s","trade_date":"%s","training_eligible":%s,"fact_id":"F%s"%s',
        kind, e.cast("string"), (F.col("user_id") % 50).cast("string"), F.col("ts").cast("date").cast("string"), F.when(F.col("value") > 5, "true").otherwise("false"), (e % 200).cast("string"), F.when(e % 7 == 0, ',"company_name":null').otherwise(""),
    )
    weight = F.when(e % 4 == 0, ',"sample_weight":0.25').when(e % 4 == 1, ',"sample_weight":0').otherwise("")
    inner = F.format_string(
        ',"payload":{"name":"N%s","props":%s,"deep":{"a":[{"b":null,"c":[%s]}]}%s%s%s}}',
        F.col("user_id").cast("string"), F.coalesce("props", F.lit("null")), e.cast("string"), weight, F.when(e % 2 == 0, ',"classification":null').otherwise(""), F.when(e % 3 == 0, F.concat(F.lit(',"source_ids":["X'), (F.col("user_id") % 3).cast("string"), F.lit('","",7]'))).otherwise(""),
    )
    return t.events.select((e % 20).alias("bundle_id"), e.alias("line"), F.concat(outer, inner).alias("payload"))


def _ledgers(t: Tables) -> tuple[DataFrame, DataFrame]:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    facts = t.customer.select((c % 20).alias("bundle_id"), c.alias("line"), F.concat(F.lit("F"), (c % 200).cast("string")).alias("fact_id"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("source_id"))
    sources = t.supplier.select((s % 20).alias("bundle_id"), s.alias("line"), F.when(s % 3 == 0, ingest.OUTCOME_SOURCE).otherwise(F.concat(F.lit("S"), s.cast("string"))).alias("source_id"), F.concat(F.lit("W"), s.cast("string")).alias("row_id"))
    return facts, sources


@query("""WITH e AS (SELECT event_id AS i, event_id % 20 AS b, 'E' || event_id AS rid, 'U' || user_id % 50 AS tk, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, value > 5 AS ok, 'F' || event_id % 200 AS f, user_id AS u, props,
CASE event_type WHEN 'view' THEN 'supervised_issuer_day_case' WHEN 'click' THEN 'supervised_direct_event_case' WHEN 'error' THEN 'ranking_error_case' WHEN 'signup' THEN 'negative_control_case' ELSE 'blind_leader_preference_pair' END AS t,
CASE event_id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.0 END AS w FROM events),
g AS (SELECT *, ok AND t LIKE 'supervised%' AS sh, greatest(0.0, 1 - sum(CASE WHEN ok THEN coalesce(w, 0) ELSE 0 END) OVER x) / nullif(count(*) FILTER (ok AND coalesce(w, 0) = 0) OVER x, 0) AS share FROM e WINDOW x AS (PARTITION BY b, t, d, tk)),
l AS (SELECT c_custkey % 20 AS b, 'F' || c_custkey % 200 AS f, 'S' || max_by(c_nationkey, c_custkey) AS s FROM customer GROUP BY 1, 2), q AS (SELECT s_suppkey % 20 AS b, bool_or(s_suppkey % 3 = 0) AS gold FROM supplier GROUP BY 1),
p AS (SELECT g.*, list_filter([CASE WHEN i % 3 = 0 THEN 'X' || u % 3 END, s], lambda x: x IS NOT NULL) AS src, coalesce(gold, false) AS gold FROM g LEFT JOIN l USING (b, f) LEFT JOIN q USING (b))
SELECT i AS event_id, CASE WHEN i % 7 > 0 THEN 'N' || u END AS company_name, '["' || f || '"]' AS fact_ids, CASE WHEN len(src) > 0 THEN '["' || array_to_string(src, '","') || '"]' WHEN gold THEN '["SRC-GOLD-REFERENCE"]' END AS provenance,
CASE WHEN t LIKE '%issuer%' THEN rid WHEN t LIKE '%direct%' THEN d || ':' || tk END AS issuer_day_case_id, CASE WHEN t LIKE '%direct%' THEN rid END AS case_id, CASE WHEN t LIKE 'supervised%' THEN d || ':' || tk END AS weight_group,
round(CAST(CASE WHEN sh AND coalesce(w, 0) = 0 THEN share ELSE w END AS DOUBLE), 9) AS sample_weight, CASE WHEN sh AND t LIKE '%issuer%' THEN 'fractional_issuer_day_group' END AS policy, CASE WHEN t LIKE 'ranking%' THEN rid END AS error_id,
t LIKE 'ranking%' AS has_error_type, CASE t WHEN 'blind_leader_preference_pair' THEN tk END AS winner, CASE t WHEN 'negative_control_case' THEN tk END AS candidate, CASE WHEN t LIKE '%issuer%' THEN 'issuer_day_price_response' WHEN t LIKE '%direct%' THEN 'direct_event_response' WHEN t LIKE 'ranking%' THEN 'candidate_ranking_correction'
WHEN t LIKE 'negative%' THEN 'negative_control_calibration' ELSE 'outcome_preferred_candidate' END AS training_target, 'POSTMORTEM' AS evidence_phase, '{"company_name":' || CASE WHEN i % 7 > 0 THEN '"N' || u || '"' ELSE 'null' END || ',"ticker":"' || tk || '"}' AS outcome,
'{"a":[{"b":null,"c":[' || i || ']}]}' AS deep, coalesce(replace(props, ' ', ''), 'null') AS props, 'supported' AS status FROM p""")
def direct_ingest(t: Tables) -> DataFrame:
    rows = ingest.normalised(_event_records(t), *_ledgers(t))
    member = {"company_name": "company_name", "fact_ids": "fact_ids", "provenance": "provenance_source_ids", "issuer_day_case_id": "issuer_day_case_id", "case_id": "case_id", "weight_group": "issuer_day_weight_group_id", "policy": "issuer_day_sample_weight_policy", "error_id": "error_id"}
    member |= {"winner": "outcome_winner_ticker", "candidate": "candidate_ticker", "training_target": "training_target", "evidence_phase": "evidence_phase", "outcome": "D_outcome", "deep": "deep", "status": "status"}
    rows = rows.select("line", F.parse_json("payload").alias("m"))
    get = lambda name, kind="string": F.try_variant_get("m", f"$.{name}", kind)
    return rows.select(
        F.col("line").alias("event_id"), *[get(n).alias(k) for k, n in member.items()], F.round(get("sample_weight", "double"), 9).alias("sample_weight"),
        get("error_type", "variant").isNotNull().alias("has_error_type"), F.to_json(get("props", "variant")).alias("props"),
    )


@query("""SELECT conv_id, turn, sha256('{"blind_fact_ids":["C' || conv_id || '"],"candidate_lane":"' || role || '","company_name":"' || role || '","D":"x","fact_ids":["C' || conv_id || '"]') AS head, strlen(text) AS size, role AS path_type, 'SRC-BLIND-SNAPSHOT' AS source, 'context_market_state_or_fact' AS training_target FROM conversations""")
def direct_ingest_turns(t: Tables) -> DataFrame:
    """Turns of conversations as records: whole texts inside, whatever they hold."""
    role, ids = F.col("role"), F.concat(F.lit("C"), F.col("conv_id").cast("string"))
    inner = F.to_json(F.struct(role.alias("name_on_D"), F.col("text"), F.lit("x").alias("D")))
    payload = F.format_string('{"record_type":"context_market_state_or_fact_case","source_fact_ids":["%s","%s"],"candidate_lane":"%s","payload":%s}', ids, ids, role, inner)
    records = t.conversations.select("conv_id", "turn", payload.alias("payload"))
    conversations = t.conversations.select("conv_id").distinct()
    sources = conversations.select("conv_id", F.lit(1).alias("line"), F.lit(ingest.BLIND_SOURCE).alias("source_id"), F.lit(None).cast("string").alias("row_id"))
    facts = sources.select("conv_id", "line", F.lit("other").alias("fact_id"), "source_id")
    held = F.col("m")
    rows = ingest.normalised(records, facts, sources, bundle="conv_id", line="turn").select("conv_id", "turn", F.from_json("payload", "map<string,variant>").alias("m"))
    string = lambda name: F.try_variant_get(held[name], "$", "string")
    head = F.concat(F.lit('{"blind_fact_ids":'), F.to_json(held["blind_fact_ids"]), F.lit(',"candidate_lane":"'), string("candidate_lane"), F.lit('","company_name":"'), string("company_name"), F.lit('","D":"'), string("D"), F.lit('","fact_ids":'), F.to_json(held["fact_ids"]))
    return rows.select("conv_id", "turn", F.sha2(head.cast("binary"), 256).alias("head"), F.octet_length(string("text")).cast("long").alias("size"), string("path_type").alias("path_type"), F.try_variant_get(held["provenance_source_ids"], "$[0]", "string").alias("source"), string("training_target").alias("training_target"))


@query("""WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 5),
c AS (SELECT l_partkey AS p, l_orderkey AS o, l_quantity + CASE WHEN l_orderkey % 10 = 4 THEN 1 ELSE 0 END AS q FROM lineitem JOIN s ON k = l_orderkey),
b AS (SELECT p, min(o) AS first_order, count(DISTINCT o) AS support, sum(q) AS quantity FROM c GROUP BY 1)
SELECT p_brand AS brand, count(*) AS n_parts, min(first_order) AS first_order, CAST(sum(support) AS BIGINT) AS support, round(sum(quantity), 2) AS quantity, 2 AS commits FROM b JOIN part ON p_partkey = p GROUP BY 1""")
def incremental_compile(t: Tables) -> DataFrame:
    """Orders as episodes, in two updates: some are new, some gone and some changed in the second. The tables come out as if made from the last listing."""
    o, more = F.col("o_orderkey"), F.when(F.col("key") % 10 == 4, F.col("bonus")).otherwise(0)
    lines = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q"))
    brands = t.part.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    steps = [
        Mapped("claims", "sources", "key", "part", lambda d: d.join(lines, "key").select("key", "part", (F.col("q") + more).alias("quantity"))),
        Grouped("parts", "claims", "part", lambda d: d.groupBy("part").agg(F.min("key").alias("first_order"), F.count_distinct("key").alias("support"), F.sum("quantity").alias("quantity"))),
        Mapped("by_brand", "parts", "part", "brand", lambda d: d.join(brands, "part").select("part", "brand", "first_order", "support", "quantity")),
        Grouped("brands", "by_brand", "brand", lambda d: d.groupBy("brand").agg(F.count(F.lit(1)).alias("n_parts"), F.min("first_order").alias("first_order"), F.sum("support").alias("support"), F.round(F.sum("quantity"), 2).alias("quantity"))),
    ]
    store = Snapshots(t.spark, f"{shared_folder(t.spark)}/tidemark-compile-{uuid.uuid4().hex[:12]}")
    listing = lambda keep, bonus: t.orders.where(keep).select(o.alias("key"), F.md5(F.concat_ws("|", o.cast("string"), F.when(o % 10 == 4, bonus).otherwise(0).cast("string"))).alias("sha"), F.lit(bonus).alias("bonus"))
    update(store, listing(o % 10 != 3, 0), steps, parts=8)
    update(store, listing(o % 10 != 5, 1), steps, parts=8)
    return store.read("brands").withColumn("commits", F.lit(store.head()[0]))
