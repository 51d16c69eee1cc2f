"""Queries over admission rules, defaults, rollups, segments, payload walks and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock, payload, segments
from tidemark.operators import audits, guards
from tidemark.plans.registry import Tables, query


def _choice(number: Column, *values) -> Column:
    """The value at place ``number``."""
    out = F.lit(None)
    for k, v in enumerate(values):
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(number == k, v) if k == 0 else out.when(number == k, v)
    return out


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing_published_at' WHEN event_type = 'click' THEN NULL WHEN ts > TIMESTAMP '2024-01-15' THEN 'published_after_cutoff' ELSE 'timestamp_verification_failed' END AS reason FROM events""")
def web_guard(t: Tables) -> DataFrame:
    published = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    return t.events.select("event_id", guards.web_reason(published, F.col("event_type") == "click", F.lit("2024-01-15").cast("timestamp_ntz")).alias("reason"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'non_object' WHEN 4 THEN 'missing_temporal_scope'
WHEN 2 THEN CASE WHEN o_orderdate > TIMESTAMP '1995-01-01' THEN 'available_from_after_cutoff' END ELSE CASE WHEN o_orderdate > TIMESTAMP '1995-01-01' THEN 'known_at_after_cutoff' END END AS reason FROM orders""")
def memory_admission(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    line = _choice(F.col("o_orderkey") % 5, "{no json", "[1]", F.format_string('{"available_from": "%s"}', day), F.format_string('{"known_at": "%s"}', day), "{}")
    return t.orders.select("o_orderkey", guards.memory_reason(line, F.lit("1995-01-01").cast("timestamp")).alias("reason"))


@query("""SELECT c_nationkey, CASE WHEN bool_or(c_custkey % 40 = 2) THEN 'accepted' WHEN bool_or(c_custkey % 7 = 1) THEN 'rejected' ELSE 'episode' END AS status FROM customer GROUP BY 1""")
def episode_precedence(t: Tables) -> DataFrame:
    status = F.when(F.col("c_custkey") % 40 == 2, "accepted").when(F.col("c_custkey") % 7 == 1, "rejected").otherwise("episode")
    return guards.by_precedence(t.customer.select("c_nationkey", status.alias("status")), "c_nationkey", "status")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def accepted_records(t: Tables) -> DataFrame:
    manifests = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", F.lit(False)).when(F.col("o_orderstatus") == "O", F.lit(True)).alias("accepted"))
    return guards.accepted_records(t.lineitem, manifests, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey, s_suppkey % 4 > 1 AS is_company FROM supplier")
def company_names(t: Tables) -> DataFrame:
    name = _choice(F.col("s_suppkey") % 4, " UNVERIFIED_ENTITY", "  ", F.col("s_name"), F.col("s_name"))
    return t.supplier.select("s_suppkey", guards.real_company(name).alias("is_company"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 > 1 AND c_acctbal > 0 THEN 'snapshot' ELSE 'unavailable' END AS status,
CASE WHEN c_custkey % 5 = 0 THEN 'ticker_not_resolved_for_candidate_discovery' WHEN c_custkey % 5 = 1 THEN 'ticker_not_verified' WHEN c_acctbal > 0 THEN NULL WHEN c_acctbal < -500 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END
ELSE 'd_minus_one_snapshot_not_collected_for_subject' END AS reason FROM customer""")
def snapshot_status(t: Tables) -> DataFrame:
    name = F.col("c_name")
    subjects = t.customer.select("c_custkey", _choice(F.col("c_custkey") % 5, "", " unknown ", name, name, name).alias("ticker"))
    snapshots = t.customer.where("c_acctbal > 0").select(F.lower(name).alias("ticker"))
    skipped = t.customer.where("c_acctbal < -500").select(name.alias("ticker"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("reason"))
    return guards.snapshot_status(subjects, snapshots, skipped).select("c_custkey", "status", "reason")


@query("""SELECT s_suppkey, d AS dimension, CASE WHEN s_nationkey % 3 = 0 THEN 'no_cutoff_safe_source' WHEN d = 'listed_security_and_exact_ticker' AND s_suppkey % 4 = 0 THEN 'needs_company_discovery' ELSE 'source_collected' END AS status
FROM supplier, unnest(['listed_security_and_exact_ticker', 'catalyst', 'liquidity']) AS u(d)""")
def verification_dimensions(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    subjects = t.supplier.select(k, (F.col("s_nationkey") % 3).alias("n_sources"), F.when(k % 2 == 0, "candidate_expansion").otherwise("candidate").alias("subject_type"), F.when(k % 4 != 0, F.col("s_name")).alias("ticker"))
    return guards.dimension_status(subjects, ("listed_security_and_exact_ticker", "catalyst", "liquidity")).select("s_suppkey", "dimension", "status")


@query("""WITH s AS (SELECT c_nationkey AS n, nullif(c_mktsegment, 'BUILDING') AS m, c_custkey, c_acctbal > 0 AS ok FROM customer), k AS (SELECT DISTINCT n, m FROM s)
SELECT k.n, k.m, count(c_custkey) FILTER (ok) AS n_accepted, count(c_custkey) FILTER (NOT ok) AS n_excluded FROM k LEFT JOIN (SELECT * FROM s WHERE n % 4 > 0) s ON s.n = k.n AND s.m IS NOT DISTINCT FROM k.m GROUP BY ALL""")
def verification_sources(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_nationkey").alias("n"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("m"), F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("accepted"))
    return guards.sources_of_subjects(rows.select("n", "m").distinct(), rows.where("n % 4 > 0"), ["n", "m"])


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, CASE WHEN n IS NULL THEN 'unreviewed' ELSE 'seen' END AS verdict, n IS NULL AS is_default FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def novelty_defaults(t: Tables) -> DataFrame:
    findings = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders")).withColumn("verdict", F.lit("seen"))
    return guards.with_defaults(t.customer.select("c_custkey"), findings, "c_custkey", {"n_orders": F.lit(0).cast("long"), "verdict": F.lit("unreviewed")})


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AS u FROM lineitem)
SELECT l_orderkey, l_linenumber FROM (SELECT *, bool_or(u) OVER w AS a, min(l_linenumber) OVER w AS f FROM i WINDOW w AS (PARTITION BY l_orderkey)) WHERE u OR NOT a AND l_linenumber = f""")
def used_or_first(t: Tables) -> DataFrame:
    used = t.part.where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return guards.used_or_first(t.lineitem, used, "l_orderkey", "l_partkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, bool_and(l_quantity > 5) AS all_true, count(*) AS n FROM lineitem GROUP BY 1")
def red_team_rollup(t: Tables) -> DataFrame:
    return guards.all_true(t.lineitem, F.col("l_quantity") > 5, "l_orderkey")


@query("""SELECT user_id, counter, n, latest FROM (SELECT user_id, max(ts) AS latest, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1) UNPIVOT (n FOR counter IN (n_events, clicks))""")
def manifest_rollup(t: Tables) -> DataFrame:
    counters = F.create_map(F.lit("n_events"), F.lit(1).cast("long"), F.lit("clicks"), (F.col("event_type") == "click").cast("long"))
    return guards.rollup_counters(t.events.withColumn("counters", counters), "counters", "ts", "user_id")


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority <> '1-URGENT') AS positive, count(*) FILTER (o_orderpriority = '1-URGENT') AS negative, count(*) FILTER (o_orderpriority = '1-URGENT') AS near_miss FROM orders GROUP BY 1""")
def evidence_counts(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "counterexample").otherwise(F.col("o_orderpriority"))
    rows = t.orders.select("o_orderstatus", *guards.evidence_counts(kind))
    return rows.groupBy("o_orderstatus").agg(F.sum("positive_case_count").alias("positive"), F.sum("negative_case_count").alias("negative"), F.sum("near_miss_count").alias("near_miss"))


@query("""SELECT DISTINCT id FROM (SELECT c_name AS id FROM customer UNION ALL SELECT CASE WHEN s_suppkey % 3 > 0 THEN s_name END FROM supplier UNION ALL SELECT ' ' FROM region) WHERE trim(id) <> ''""")
def ids_union(t: Tables) -> DataFrame:
    return guards.union_ids(t.customer.select(F.col("c_name").alias("id")), t.supplier.select(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name"))), t.region.select(F.lit(" ")))


@query("SELECT o_orderkey, c_nationkey IS NULL AS \"none\", c_nationkey AS place FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def claims_in_order(t: Tables) -> DataFrame:
    positions = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return guards.in_order_of(t.orders, positions, "o_custkey", "c_nationkey", "o_orderkey").select("o_orderkey", F.col("order_key.none").alias("none"), F.col("order_key.place").alias("place"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 3 THEN CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ELSE false END AS in_range, false AS bad_bound,
CASE event_id % 4 WHEN 0 THEN true WHEN 3 THEN CAST(ts AS DATE) <= DATE '2024-01-20' ELSE false END AS at_most FROM events""")
def date_rules(t: Tables) -> DataFrame:
    day = _choice(F.col("event_id") % 4, "2024-01-10", "2024-13-01", "soon", F.date_format("ts", "yyyy-MM-dd"))
    low, high = F.lit("2024-01-05"), F.lit("2024-01-20")
    return t.events.select("event_id", clock.date_in_range(day, low, high).alias("in_range"), clock.date_in_range(day, low, F.lit("x")).alias("bad_bound"), clock.time_at_most(day, high.cast("timestamp")).alias("at_most"))


@query(r"""WITH p AS (SELECT doc_id, unnest(r) AS raw, generate_subscripts(r, 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[^.?!。？！\r\n]*[.?!。？！\r\n]|[^.?!。？！\r\n]+$') AS r FROM documents)),
q AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, regexp_replace(raw, '^\s+', '') AS l FROM p),
s AS (SELECT doc_id, n, pos + length(raw) - length(l) AS a, regexp_replace(l, '\s+$', '') AS b FROM q)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS segment, CAST(a AS BIGINT) AS char_start, CAST(a + length(b) AS BIGINT) AS char_end, sha256(b) AS text_sha256, md5(substr(b, 1, 240)) AS excerpt_md5 FROM s WHERE b <> ''""")
def text_segments(t: Tables) -> DataFrame:
    return segments.segments(t.documents, "doc_id", "text").withColumn("excerpt_md5", F.md5(F.col("excerpt").cast("binary"))).drop("excerpt")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS present, CASE s_suppkey % 4 WHEN 2 THEN '# C' WHEN 3 THEN '# A|# B|# C' ELSE '' END AS missing,
CASE s_suppkey % 4 WHEN 2 THEN '# A' ELSE '' END AS empty, s_suppkey % 4 <> 1 AS ordered, s_suppkey % 4 = 0 AS passed FROM supplier""")
def report_headings(t: Tables) -> DataFrame:
    text = _choice(F.col("s_suppkey") % 4, "# A\nx\n# B\ny\n# C\nz", "# B\ny\n# A\nx\n# C\nz", "# A\n \n# B\ny", "")
    report = segments.heading_report(F.col("text"), ("# A", "# B", "# C"))
    joined = {k: F.array_join(c, "|") if k in ("missing", "empty") else c for k, c in report.items()}
    return t.supplier.select("s_suppkey", text.alias("text")).select("s_suppkey", *[c.alias(k) for k, c in joined.items()])


@query("""SELECT event_id, '{"a":"' || event_type || '"}' AS part, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END AS record_id, sha256('{"a":"' || event_type || '","case_id":' || CASE WHEN event_id % 2 = 0 THEN '"' || event_type || '"' ELSE '7' END || ',"own":null}') AS sealed,
CASE WHEN event_id % 2 = 0 THEN '[]' ELSE '{}' END AS emptied FROM events""")
def payload_rules(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    held = F.format_string('{"own": "x", "case_id": %s, "a": "%s"}', F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), kind, F.lit('"'))).otherwise("7"), kind)
    emptied = F.when(F.col("event_id") % 2 == 0, payload.json_or_empty(F.lit("{}"), "array")).otherwise(payload.json_or_empty(F.lit("[1")))
    return t.events.select("event_id", payload.subset(held, ["a", "z"]).alias("part"), payload.first_string(held, ["record_id", "case_id"], F.lit("none")).alias("record_id"), payload.seal(held, "own").alias("sealed"), emptied.alias("emptied"))


@query("""SELECT event_id, 'event:EVT-' || event_id || '|fact:FACT-' || user_id || '|inference:INF-' || user_id AS found FROM events""")
def payload_references(t: Tables) -> DataFrame:
    text = F.format_string('{"event_id": "EVT-%s", "x": [{"support_fact_ids": ["FACT-%s", ""], "fact_id": 3}], "a_fact_or_inference_id": ["INF-%s", "zzz"], "preevent_id": "no"}', F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("user_id").cast("string"))
    found = F.transform(payload.references(text), lambda r: F.concat_ws(":", r["kind"], r["id"]))
    return t.events.select("event_id", F.array_join(found, "|").alias("found"))


@query("""WITH l AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE CAST(o_custkey * 2 AS VARCHAR) END AS k FROM orders), x AS (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer)
SELECT 'LISTED_BLANK' AS check_id, k AS subject_id FROM l WHERE trim(k) = '' UNION ALL SELECT 'LISTED_TWICE', k FROM l WHERE trim(k) <> '' GROUP BY k HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'LISTED_UNEXPECTED', k FROM l WHERE trim(k) <> '' AND k NOT IN (FROM x) UNION ALL SELECT 'NOT_LISTED', k FROM x WHERE k NOT IN (FROM l)""")
def audit_id_list(t: Tables) -> DataFrame:
    listed = t.orders.select(F.when(F.col("o_orderkey") % 10 == 0, " ").otherwise((F.col("o_custkey") * 2).cast("string")).alias("k"))
    return audits.id_list(listed, t.customer.select(F.col("c_custkey").cast("string").alias("k")), "k").select("check_id", "subject_id")


@query("""WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS k, l_linenumber = 1 AS other, l_quantity < 5 AS no_winner, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag = 'R' END AS ok, CASE WHEN l_discount > 0.05 THEN 'positive_preference' WHEN l_tax > 0.04 THEN 'odd' ELSE 'correction' END AS mode FROM lineitem)
SELECT 'NOT_A_LEADER_PAIR' AS check_id, k AS subject_id FROM r WHERE other UNION ALL SELECT 'WINNER_MISSING', k FROM r WHERE NOT other AND no_winner UNION ALL SELECT 'CORRECT_INVALID', k FROM r WHERE NOT other AND ok IS NULL
UNION ALL SELECT 'MODE_INVALID', k FROM r WHERE NOT other AND mode = 'odd' UNION ALL SELECT 'MODE_CONTRADICTS', k FROM r WHERE NOT other AND mode <> 'odd' AND ok IS NOT NULL AND mode <> CASE WHEN ok THEN 'positive_preference' ELSE 'correction' END""")
def audit_preferences(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), F.when(F.col("l_linenumber") != 1, audits.PREFERENCE).alias("record_type"), F.lit("a").alias("preferred"), F.lit("b").alias("rejected"),
        F.when(F.col("l_quantity") < 5, " ").otherwise("a").alias("winner"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag") == "R").alias("correct"), F.when(F.col("l_discount") > 0.05, "positive_preference").when(F.col("l_tax") > 0.04, "odd").otherwise("correction").alias("mode"),
    )
    return audits.preferences(rows).select("check_id", "subject_id")


@query("""SELECT CASE WHEN o_orderkey % 4 < 2 THEN 'KNOWN_AT_INVALID' ELSE 'KNOWN_AT_BACKDATED' END AS check_id, CAST(o_orderkey AS VARCHAR) AS subject_id FROM orders WHERE o_orderkey % 4 < 2 OR o_orderkey % 4 = 2 AND o_orderdate < TIMESTAMP '1995-06-01 15:00:00'""")
def audit_known_times(t: Tables) -> DataFrame:
    """Times with Seoul's offset against a limit of 1995-06-02 there."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    local = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    known = _choice(F.col("o_orderkey") % 4, "later", day, F.concat(local, F.lit("+09:00")), "")
    rows = t.orders.select(F.col("o_orderkey").alias("record_id"), known.alias("known_at"), F.lit("1995-06-01T15:00:00Z").cast("timestamp").alias("available_from"))
    return audits.known_times(rows).select("check_id", "subject_id")


@query("""WITH m AS (SELECT c_custkey AS k, coalesce(list(o_orderkey) FILTER (o_orderstatus = 'F'), []) AS s, coalesce(list(o_orderkey) FILTER (o_orderstatus = 'O'), []) AS f, c_acctbal > 0 AS src FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal)
SELECT 'MECHANISM_WITHOUT_CASES' AS check_id, CAST(k AS VARCHAR) AS subject_id FROM m WHERE len(s) = 0 AND len(f) = 0 UNION ALL SELECT 'MECHANISM_WITHOUT_PROVENANCE', CAST(k AS VARCHAR) FROM m WHERE NOT src
UNION ALL SELECT 'MECHANISM_CASE_UNKNOWN', CAST(k AS VARCHAR) FROM m, unnest(s) AS u(e) WHERE e % 3 = 0""")
def audit_mechanisms(t: Tables) -> DataFrame:
    lists = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("successes"), F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("failures"))
    rows = t.customer.join(lists, "c_custkey", "left").select(F.col("c_custkey").alias("mechanism_id"), "successes", "failures", F.when(F.col("c_acctbal") > 0, F.array("c_name")).alias("sources"))
    return audits.mechanisms(rows, t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("episode_id"))).select("check_id", "subject_id")


@query("""WITH r AS (SELECT o_orderkey // 2 AS n, o_custkey AS e FROM orders)
SELECT 'ROW_NUMBER_TWICE' AS check_id, CAST(n AS VARCHAR) AS subject_id, CAST(count(*) AS VARCHAR) AS detail FROM r GROUP BY n HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'LEDGER_ROW_UNKNOWN', CAST(l_suppkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT n FROM r)
UNION ALL SELECT DISTINCT 'LEDGER_EVENT_UNKNOWN', CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey NOT IN (SELECT e FROM r)
UNION ALL SELECT DISTINCT 'PREDICTED_EVENT_UNKNOWN', CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT e FROM r)""")
def audit_bundle_rows(t: Tables) -> DataFrame:
    rows = t.orders.select(F.floor(F.col("o_orderkey") / 2).cast("long").alias("row_number"), F.col("o_custkey").alias("event_id"))
    ledger = t.lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("row_number"))
    events = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.col("s_suppkey").alias("event_id"))
    predicted = t.customer.select(F.col("c_nationkey").alias("prediction_id"), F.col("c_custkey").alias("event_id"))
    return audits.bundle_rows(rows, ledger, events, predicted)


@query("""SELECT CASE WHEN turn = 3 THEN 'RAW_LINE_NO_OBJECT' WHEN n > 40 THEN 'RAW_LINE_MISSING' ELSE 'RAW_HASH_MISMATCH' END AS check_id, conv_id || '/' || turn AS subject_id
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE turn = 3 OR turn = 1""")
def audit_raw_lines(t: Tables) -> DataFrame:
    line = F.when(F.col("turn") == 3, "[3]").otherwise(F.format_string('{"role":"%s","n":%d}', F.col("role"), F.col("turn").cast("int")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    blocks = t.conversations.groupBy(F.col("conv_id").alias("block")).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\\n \\n".replace("\\n", "\n")).alias("text"))
    hashed = F.sha2(F.format_string('{"n": %d, "role": "%s"}', F.col("turn").cast("int"), F.when(F.col("turn") == 1, "other").otherwise(F.col("role"))).cast("binary"), 256)
    place = F.array_position(F.col("turns"), F.col("turn")).cast("int")
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    rows = t.conversations.join(turns, "conv_id").select(F.concat_ws("/", "conv_id", "turn").alias("record_id"), F.col("conv_id").alias("block"), place.alias("source_line"), hashed.alias("raw_sha256"))
    return audits.raw_lines(rows, blocks).select("check_id", "subject_id")


@query("""SELECT 'AUDIT_ONLY_UNEXPECTED' AS check_id, CAST(k AS VARCHAR) AS subject_id FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'AUDIT_ONLY_MISSING', CAST(k AS VARCHAR) FROM (SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)""")
def audit_only_delta(t: Tables) -> DataFrame:
    key = lambda d, c: d.select(F.col(c).alias("k"))
    return audits.multiset(key(t.customer, "c_nationkey"), key(t.supplier, "s_nationkey"), "AUDIT_ONLY", "k").select("check_id", "subject_id")


@query("""WITH r AS (SELECT o_orderkey AS k, o_totalprice > 50000 AS e, o_orderstatus = 'F' AS unknown, CASE o_orderkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'odd' END AS q, o_orderkey % 3 = 0 AS bare, o_custkey AS src, o_orderkey % 7 = 0 AS bad FROM orders)
SELECT 'UNKNOWN_TYPED_PAYLOAD_ELIGIBLE' AS check_id, CAST(k AS VARCHAR) AS subject_id FROM r WHERE e AND unknown UNION ALL SELECT 'PAYLOAD_HASH_MISMATCH', CAST(k AS VARCHAR) FROM r WHERE bad
UNION ALL SELECT 'ELIGIBLE_WITHOUT_PROVENANCE', CAST(k AS VARCHAR) FROM r WHERE e AND bare UNION ALL SELECT 'INVALID_LABEL_QUALITY', CAST(k AS VARCHAR) FROM r WHERE q = 'odd'
UNION ALL SELECT 'PROVENANCE_SOURCE_MISSING', CAST(k AS VARCHAR) FROM r WHERE NOT bare AND src NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def audit_record_store(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    held = _choice(k % 4, '{"label_quality":"verified"}', '{"label_quality":"odd"}', "{}", "{}")
    rows = t.orders.select(
        k.cast("string").alias("record_id"), F.when(F.col("o_orderstatus") == "F", "UNKNOWN_TYPED_PAYLOAD").otherwise("TYPED").alias("typed_payload_status"), (F.col("o_totalprice") > 50000).alias("training_eligible"), held.alias("payload"),
        F.when(k % 7 != 0, F.sha2(held.cast("binary"), 256)).alias("normalized_payload_sha256"), F.when(k % 3 != 0, F.array(F.col("o_custkey").cast("string"))).alias("provenance_source_ids"),
    )
    return audits.record_store(rows, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("source_id"))).select("check_id", "subject_id")


@query("""WITH r AS (SELECT o_orderkey AS k, o_totalprice > 50000 AS e, o_orderpriority LIKE '1%' AS bad FROM orders)
SELECT 'FORBIDDEN_EDGE' AS check_id, CAST(k AS VARCHAR) AS subject_id FROM r WHERE e AND (bad OR k % 5 = 0) UNION ALL SELECT 'EDGE_WITHOUT_VALID_SOURCE', CAST(k AS VARCHAR) FROM r WHERE e AND k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O')""")
def audit_edges(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderpriority").startswith("1"), "x_outcome_only").otherwise("news").alias("origin"), (F.col("o_totalprice") > 50000).alias("training_eligible"), (F.col("o_orderkey") % 5 != 0).alias("time_verified"), F.lit(True).alias("available_before_cutoff"))
    provenance = t.lineitem.select(F.col("l_orderkey").alias("record_id"), (F.col("l_returnflag") == "N").alias("verified"), (F.col("l_linestatus") == "O").alias("before_cutoff"))
    return audits.edges(rows, provenance).select("check_id", "subject_id")


@query("""SELECT 'PHASE' AS check_id, CAST(event_id AS VARCHAR) AS subject_id FROM events WHERE CASE event_id % 3 WHEN 0 THEN event_type <> 'click' WHEN 1 THEN event_type = 'click' ELSE true END
UNION ALL SELECT 'BASIS_NOT_SATISFIED', CAST(event_id AS VARCHAR) FROM events WHERE NOT value > 100""")
def audit_phases(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("record_id"), _choice(F.col("event_id") % 3, "BLIND", "POSTMORTEM", "OTHER").alias("phase"), (F.col("event_type") == "click").alias("hindsight_safe"), (F.col("value") > 100).alias("basis_satisfied"))
    return audits.phases(rows).select("check_id", "subject_id")


@query("""SELECT 'PRICE_ALLOWED_TOO_LATE' AS check_id, CAST(event_id AS VARCHAR) AS subject_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20' UNION ALL SELECT 'PRICE_SNAPSHOT_AFTER_CUTOFF', CAST(event_id AS VARCHAR) FROM events WHERE ts > TIMESTAMP '2024-01-25'""")
def audit_price_scope(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.to_date("ts").alias("allowed_through"), F.lit("2024-01-20").cast("date").alias("trade_date"), F.col("ts").alias("as_of"), F.lit("2024-01-25").cast("timestamp_ntz").alias("cutoff_at"))
    return audits.price_scope(rows, "event_id").select("check_id", "subject_id")
