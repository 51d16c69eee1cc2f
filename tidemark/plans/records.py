"""Queries over records: filters, coverage, reconciliation, exports and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import audits, claims, reconcile, training
from tidemark.operators import records as ops
from tidemark.plans.registry import Tables, query

RECORDS = """r AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderstatus AS record_type, CAST(o_orderdate AS DATE) AS trade_date, o_orderdate AS available_from,
         o_totalprice > 50000 AS training_eligible, o_orderpriority AS evidence_phase FROM orders
)"""


def _records(t: Tables) -> DataFrame:
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))).alias("ticker_list"))
    joined = t.orders.join(lists, "o_orderkey", "left")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderstatus").alias("record_type"), F.to_date("o_orderdate").alias("trade_date"), F.col("o_orderdate").alias("available_from"),
        (F.col("o_totalprice") > 50000).alias("training_eligible"), F.col("o_orderpriority").alias("evidence_phase"), F.coalesce("ticker_list", F.array().cast("array<string>")).alias("ticker_list"),
    )


@query(f"""WITH {RECORDS} SELECT record_id, record_type, trade_date FROM r
WHERE record_type IN ('F', 'O') AND training_eligible AND trade_date >= DATE '1993-01-01' AND trade_date <= DATE '1999-12-31' AND available_from <= TIMESTAMP '1999-06-30'
  AND record_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_suppkey = 7) ORDER BY trade_date, record_id LIMIT 20""")
def record_query(t: Tables) -> DataFrame:
    found = ops.query_records(_records(t), record_type=("F", "O", "F"), ticker="7", training_eligible=True, trade_date_from="1993-01-01", trade_date_to="1999-12-31", available_as_of="1999-06-30 00:00:00", limit=20)
    return found.select("record_id", "record_type", "trade_date")


@query("""SELECT event_id, concat_ws('|', user_id, event_type, 'nested', CASE WHEN k <> CAST(user_id AS VARCHAR) THEN k END) AS tickers, CAST(user_id AS VARCHAR) AS ticker
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def alias_extraction(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("string")
    payload = F.format_string('{"ticker": "%s", "peer_universe": ["%s", " %s ", true, ["nested", [null, {"a": 1}]]], "outcome": {"ticker": %s}}', user, F.col("event_type"), user, F.get_json_object("props", "$.k"))
    found = ops.with_aliases(t.events.withColumn("payload", payload), fields={"ticker": ops.PATHS["ticker"]})
    return found.select("event_id", F.array_join("ticker_list", "|").alias("tickers"), "ticker")


@query("""SELECT o_orderstatus, coalesce(nullif(CASE WHEN o_orderpriority LIKE '3%' THEN '' WHEN o_orderpriority NOT LIKE '4%' THEN o_orderpriority END, ''), 'UNKNOWN') AS target, count(*) AS n_records,
count(*) FILTER (o_totalprice > 50000) AS n_eligible, count(*) FILTER (NOT o_totalprice > 50000) AS n_ineligible, count(*) FILTER (o_orderpriority LIKE '5%') AS n_audit_only FROM orders GROUP BY ALL""")
def record_coverage(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    target = F.when(p.startswith("3"), "").when(~p.startswith("4"), p)
    return ops.coverage(t.orders.withColumn("target", target), F.col("o_totalprice") > 50000, p.startswith("5"), "o_orderstatus", target="target")


@query("""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'l_linenumber' END AS dimension,
CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag WHEN grouping(l_linestatus) = 0 THEN l_linestatus ELSE CAST(l_linenumber AS VARCHAR) END AS value,
count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))""")
def record_stats(t: Tables) -> DataFrame:
    return ops.stats(t.lineitem, "l_returnflag", "l_linestatus", "l_linenumber", distinct="l_orderkey")


@query("SELECT conv_id, turn, unnest(string_split(text, ' ')) AS source_id FROM conversations")
def record_provenance(t: Tables) -> DataFrame:
    return ops.provenance(t.conversations.withColumn("sources", F.split("text", " ", -1)), "sources", "conv_id", "turn")


@query("""SELECT 'customer' AS source_kind, 'CUST-' || c_custkey AS edge_id, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', 'SUPP-' || s_suppkey, s_nationkey, NULL FROM supplier""")
def edges_union(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("source_kind"), F.concat(F.lit("CUST-"), F.col("c_custkey")).alias("edge_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.lit("supplier").alias("source_kind"), F.concat(F.lit("SUPP-"), F.col("s_suppkey")).alias("edge_id"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS k FROM events")
def event_sources_distinct(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("k")).distinct()


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, upper(c_name), c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey + 10000000, c_name, 0.0 FROM customer WHERE c_custkey % 100 = 0""")
def upsert_by_key(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    changed = base.where("c_custkey % 10 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    fresh = base.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), "c_name", F.lit(0.0).alias("c_acctbal"))
    return reconcile.upsert(base, changed.unionByName(fresh), "c_custkey")


@query("""WITH a AS (SELECT p_partkey + 3 AS k FROM part), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
SELECT k, 'missing' AS status FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def identity_reconcile(t: Tables) -> DataFrame:
    return reconcile.identity_delta(t.part.select((F.col("p_partkey") + 3).alias("k")), t.lineitem.select(F.col("l_partkey").alias("k")), "k")


@query("SELECT sha256(coalesce(text, '')) AS sha, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_identities(t: Tables) -> DataFrame:
    return reconcile.duplicates(t.documents.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")), "sha")


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT k, coalesce(a.n, 0) AS n_expected, coalesce(b.n, 0) AS n_actual FROM a FULL JOIN b USING (k) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_delta(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("k"), "l_linenumber", "l_returnflag")
    return reconcile.multiset_delta(rows.where("l_linenumber <= 3"), rows.where("l_returnflag <> 'R'"), "k")


@query("SELECT DISTINCT l_suppkey * 2 AS s_suppkey FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)")
def provenance_closure(t: Tables) -> DataFrame:
    return reconcile.closure(t.lineitem.select((F.col("l_suppkey") * 2).alias("s_suppkey")), t.supplier, "s_suppkey")


@query("""SELECT l_suppkey * 2 AS s_suppkey, string_agg(DISTINCT lpad(CAST(l_partkey AS VARCHAR), 10, '0'), ',' ORDER BY lpad(CAST(l_partkey AS VARCHAR), 10, '0')) AS owners
FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def reference_closure(t: Tables) -> DataFrame:
    refs = t.lineitem.select((F.col("l_suppkey") * 2).alias("s_suppkey"), F.lpad(F.col("l_partkey").cast("string"), 10, "0").alias("owner"))
    return reconcile.closure_by_reference(refs, t.supplier, "owner", "s_suppkey").withColumn("owners", F.array_join("owners", ","))


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_name FROM lineitem l
LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 <> 0) o ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def provenance_enrich(t: Tables) -> DataFrame:
    first = reconcile.enrich(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), t.orders.where("o_orderkey % 5 <> 0"), "o_orderkey", "o_orderdate", "o_custkey")
    both = reconcile.enrich(first.withColumnRenamed("o_custkey", "c_custkey"), t.customer, "c_custkey", "c_acctbal", "c_name")
    return both.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.col("c_custkey").alias("o_custkey"), "c_name")


@query("SELECT user_id, last(value ORDER BY event_id) AS value, min(event_id) AS event_id FROM events GROUP BY 1")
def last_value_first_position(t: Tables) -> DataFrame:
    return reconcile.last_value_first_position(t.events, "user_id", "event_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL")
def id_conflicts(t: Tables) -> DataFrame:
    sha = F.sha2(F.col("text").cast("binary"), 256)
    a = t.documents.select("doc_id", sha.alias("sha"))
    b = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), sha)).otherwise(sha).alias("sha"))
    return reconcile.conflicts(a, b, "doc_id", "sha").select("doc_id")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'removed' ELSE 'changed' END AS status FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey + 1000000, 'added' FROM supplier WHERE s_suppkey % 13 = 0""")
def snapshot_diff(t: Tables) -> DataFrame:
    before = t.supplier.select("s_suppkey", "s_acctbal")
    after = before.where("s_suppkey % 11 <> 0").withColumn("s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0))
    after = after.unionByName(before.where("s_suppkey % 13 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    return reconcile.snapshot_diff(before, after, "s_suppkey", F.col("s_acctbal"))


@query("SELECT p_brand AS block, min(p_type) AS declared, min(p_type) || '!' AS found, count(DISTINCT p_type) AS n_declared, true AS mismatch, count(DISTINCT p_type) > 1 AS conflict FROM part GROUP BY 1")
def hash_expectations(t: Tables) -> DataFrame:
    declared = t.part.select(F.col("p_brand").alias("block"), F.col("p_type").alias("sha256"), F.col("p_type").alias("priority"))
    actual = declared.groupBy("block").agg(F.concat(F.min("sha256"), F.lit("!")).alias("sha256"))
    return reconcile.expectation_conflicts(declared, actual)


@query("""SELECT doc_id, category FROM (SELECT doc_id, CASE lang WHEN 'en' THEN ['english', 'all'] WHEN 'de' THEN ['german', 'germanic', 'all'] ELSE ['all'] END AS c FROM documents), unnest(c) AS u(category)""")
def category_routing(t: Tables) -> DataFrame:
    return ops.route(t.documents, {"en": ["english"], "de": ["german", "germanic"]}, "all", "lang").select("doc_id", "category")


LABELLED = "j AS (SELECT d.doc_id, d.source, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))"


def _labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id")


@query(f"WITH {LABELLED} SELECT a.source, a.doc_id AS chosen, b.doc_id AS rejected FROM j a JOIN j b ON a.source = b.source AND a.quality = 1 AND b.quality = 0")
def preference_pairs(t: Tables) -> DataFrame:
    return training.preference_pairs(_labelled(t), "source", "doc_id", F.col("quality") == 1, F.col("quality") == 0)


KINDS = {"sft": ["en", "de"], "preference": ["fr"]}
EXPORT = """x AS (SELECT d.doc_id, d.lang, CASE WHEN lang IN ('en', 'de') THEN 'sft' WHEN lang = 'fr' THEN 'preference' END AS kind, coalesce(quality = 1, false) AS ok, toxic = 0 AS sealed FROM labels l JOIN documents d USING (doc_id)),
y AS (SELECT *, CASE WHEN NOT ok THEN 'not_training_eligible' WHEN kind IS NULL THEN 'no_export_kind' WHEN kind = 'preference' AND NOT coalesce(sealed, false) THEN 'pair_not_sealed' END AS reason FROM x)"""


@query(f"WITH {EXPORT} SELECT doc_id, kind AS export_kind FROM y WHERE reason IS NULL")
def training_export(t: Tables) -> DataFrame:
    return training.export(_labelled(t), KINDS, "lang", F.col("quality") == 1, F.col("toxic") == 0)[0].select("doc_id", "export_kind")


@query(f"WITH {EXPORT} SELECT doc_id, reason AS skip_reason FROM y WHERE reason IS NOT NULL")
def training_skips(t: Tables) -> DataFrame:
    return training.export(_labelled(t), KINDS, "lang", F.col("quality") == 1, F.col("toxic") == 0)[1].select("doc_id", "skip_reason")


CATEGORIES = ["en", "fr", "ja", "de", "ko"]


@query("SELECT CAST(position AS INTEGER) AS position, lang, count(doc_id) AS n_rows FROM (VALUES (0, 'en'), (1, 'fr'), (2, 'ja'), (3, 'de'), (4, 'ko')) c(position, lang) LEFT JOIN documents USING (lang) GROUP BY ALL")
def category_zero_fill(t: Tables) -> DataFrame:
    return training.zero_filled(t.documents, "lang", CATEGORIES)


@query("""SELECT CAST(position AS INTEGER) AS position, category, coalesce(query, category || ' evidence') AS query FROM (VALUES (0, 'Brand#11'), (1, 'none'), (2, 'Brand#22')) c(position, category)
LEFT JOIN (SELECT DISTINCT p_brand AS category, trim(regexp_replace(p_type, '\\s+', ' ', 'g')) AS query FROM part) USING (category)""")
def plan_fallback(t: Tables) -> DataFrame:
    plan = t.part.select(F.col("p_brand").alias("category"), F.concat(F.lit("  "), F.regexp_replace("p_type", " ", "  ")).alias("query"))
    return training.with_fallback(plan, ["Brand#11", "none", "Brand#22"])


@query("""WITH a AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS k FROM supplier),
e AS (SELECT a.s_suppkey, a.k, c.c_custkey, 'exact' AS match FROM a JOIN customer c ON c.c_name = a.k),
r AS (SELECT a.s_suppkey, a.k, c.c_custkey, row_number() OVER (PARTITION BY a.k ORDER BY c.c_custkey) AS rn FROM a LEFT JOIN customer c ON contains(c.c_name, a.k) WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_name = a.k))
SELECT s_suppkey, k, c_custkey, match FROM e UNION ALL SELECT s_suppkey, k, c_custkey, CASE WHEN c_custkey IS NOT NULL THEN 'contained' END FROM r WHERE rn = 1""")
def substring_fallback_join(t: Tables) -> DataFrame:
    number = F.col("s_suppkey").cast("string")
    left = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(number, 9, "0"))).otherwise(number).alias("k"))
    right = t.customer.select("c_custkey", "c_name")
    return training.keyed_or_contained(left, right, "k", "c_name", "c_custkey", F.col("k"), F.col("c_name")).select("s_suppkey", "k", "c_custkey", "match")


@query("""SELECT o_custkey AS rank, concat_ws('|', 'base', CASE WHEN last(o_orderstatus ORDER BY o_orderkey) <> 'base' THEN last(o_orderstatus ORDER BY o_orderkey) END) AS flags FROM orders GROUP BY 1""")
def finding_merge(t: Tables) -> DataFrame:
    candidates = t.orders.select(F.col("o_custkey").alias("rank")).distinct().withColumn("flags", F.array(F.lit("base")))
    findings = t.orders.select(F.col("o_custkey").alias("rank"), "o_orderkey", F.array(F.lit("base"), F.col("o_orderstatus")).alias("flags"))
    return training.merge_findings(candidates, findings, "o_orderkey").select("rank", F.array_join("flags", "|").alias("flags"))


@query("""SELECT coalesce(a.k, b.k) AS k, least(a.known_at, b.known_at) AS known_at, concat_ws('|', a.tag, CASE WHEN b.tag IS DISTINCT FROM a.tag THEN b.tag END) AS tags
FROM (SELECT c_custkey AS k, DATE '2024-01-10' AS known_at, c_mktsegment AS tag FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT c_custkey AS k, DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS known_at, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'other' END AS tag FROM customer WHERE c_custkey % 4 <> 0) b ON a.k = b.k""")
def company_merge(t: Tables) -> DataFrame:
    key = F.col("c_custkey").alias("k")
    base = t.customer.where("c_custkey % 3 <> 0").select(key, F.lit("2024-01-10").cast("date").alias("known_at"), F.array("c_mktsegment").alias("tags"))
    tag = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("other")
    delta = t.customer.where("c_custkey % 4 <> 0").select(key, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 20).cast("int")).alias("known_at"), F.array(tag).alias("tags"))
    return claims.merge_company(base, delta, ["k"], ["tags"]).withColumn("tags", F.array_join("tags", "|"))


@query("""SELECT doc_id, category FROM (SELECT doc_id, list_filter([CASE WHEN contains(l, 'license') THEN 'legal' END, CASE WHEN contains(l, 'token') OR contains(l, 'password') THEN 'secret' END], lambda x: x IS NOT NULL) AS c
FROM (SELECT doc_id, lower(text) AS l FROM documents)), unnest(c) AS u(category)""")
def claims_by_keyword(t: Tables) -> DataFrame:
    return claims.by_keyword(t.documents, {"legal": ["license"], "secret": ["token", "password"]}, "text").select("doc_id", "category")


@query("""SELECT 'DUPLICATE' AS check_id, c_mktsegment || '|' || c_nationkey AS subject_id, CAST(count(*) AS VARCHAR) AS detail FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1
UNION ALL SELECT 'NEGATIVE', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT DISTINCT 'MISSING', CAST(o_orderkey AS VARCHAR), CAST(o_custkey * 2 AS VARCHAR) FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'RECOUNT', CAST(coalesce(a.k, b.k) AS VARCHAR), concat_ws('/', a.n, b.n) FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def audit_findings(t: Tables) -> DataFrame:
    refs = t.orders.select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey"))
    count = lambda d, k: d.groupBy(F.col(k).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return audits.union(
        audits.duplicate(t.customer, "DUPLICATE", "c_mktsegment", "c_nationkey"),
        audits.violated(t.customer, "NEGATIVE", "c_custkey", F.col("c_acctbal") < 0, F.col("c_nationkey")),
        audits.missing(refs, t.customer, "MISSING", "o_orderkey", "c_custkey"),
        audits.recount(count(t.customer, "c_nationkey"), count(t.supplier, "s_nationkey"), "RECOUNT", "k", "n"),
    )


@query("""WITH src AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 6 <> 5), ex AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 12 = 5), sk AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 30 = 29)
SELECT 'EXPORTED_OUTSIDE_SOURCE' AS check_id, k AS subject_id FROM ex WHERE k NOT IN (FROM src) UNION ALL SELECT 'EXPORTED_AND_SKIPPED', k FROM ex WHERE k IN (FROM sk)
UNION ALL SELECT 'NEITHER_EXPORTED_NOR_SKIPPED', k FROM src WHERE k NOT IN (FROM ex) AND k NOT IN (FROM sk) UNION ALL SELECT 'SKIPPED_OUTSIDE_SOURCE', k FROM sk WHERE k NOT IN (FROM src)""")
def audit_exports(t: Tables) -> DataFrame:
    k = t.orders.select(F.col("o_orderkey").alias("k"))
    found = audits.exported(k.where("k % 3 = 0 or k % 12 = 5"), k.where("k % 4 = 0 or k % 30 = 29"), k.where("k % 6 <> 5"), "k")
    return found.select("check_id", F.col("subject_id").cast("long").alias("subject_id"))
