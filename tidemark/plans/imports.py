"""Queries over the import of bundles and over what goes into prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.operators import admission, imports, prompts
from tidemark.plans.registry import Tables, query
from tidemark.plans.rules import _choice


@query("""WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'memory_claim' WHEN 1 THEN 'blind_leader_preference_pair' WHEN 2 THEN 'other' ELSE 'beneficiary_discovery_case' END AS t,
CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'C-' || o_orderkey END AS c, o_orderpriority LIKE '1%' AS ok FROM orders),
e AS (SELECT *, CASE WHEN t = 'other' THEN 'unknown record_type preserved as raw payload' WHEN t = 'memory_claim' AND NOT ok THEN 'known record_type payload failed typed validation; preserved as raw payload'
WHEN t = 'blind_leader_preference_pair' THEN 'sealed_preference_pair_missing' END AS why FROM r),
h AS (SELECT *, sha256('{"case_id":"' || c || CASE WHEN why IS NULL THEN '","record_type":"' || t || '","training_eligible":true}' ELSE '","eligibility_reason":"' || why || '","record_type":"' || t || '","training_eligible":false}' END) AS n FROM e)
SELECT k AS o_orderkey, CASE WHEN c = '' THEN 'BRAIN-' || substr(sha256('E' || k % 7 || '|' || t || '|' || n), 1, 12) ELSE c END AS record_id, t AS record_type,
CASE t WHEN 'memory_claim' THEN 'AUDIT' WHEN 'beneficiary_discovery_case' THEN 'BLIND' ELSE 'POSTMORTEM' END AS evidence_phase, why IS NULL AS training_eligible, why AS eligibility_reason,
CASE WHEN t = 'other' OR (t = 'memory_claim' AND NOT ok) THEN 'UNKNOWN_TYPED_PAYLOAD' ELSE 'KNOWN_TYPED_PAYLOAD' END AS typed_payload_status, 'tentative' AS status, 'low' AS confidence_label,
sha256('{"case_id": "' || c || '", "record_type": "' || t || '", "training_eligible": true}') AS raw_payload_sha256, n AS normalized_payload_sha256 FROM h""")
def import_envelopes(t: Tables) -> DataFrame:
    kind = _choice(F.col("o_orderkey") % 4, "memory_claim", "blind_leader_preference_pair", "other", "beneficiary_discovery_case")
    case = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("C-"), F.col("o_orderkey").cast("string")))
    text = F.concat(F.lit('{"training_eligible": true, "record_type": "'), kind, F.lit('", "case_id": "'), case, F.lit('"}'))
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.concat(F.lit("E"), (F.col("o_orderkey") % 7).cast("string")).alias("episode_id"), text.alias("payload"))
    known = {"memory_claim": F.col("o_orderpriority").startswith("1"), "blind_leader_preference_pair": F.lit(True), "beneficiary_discovery_case": F.lit(True)}
    return imports.envelopes(rows, known).drop("payload", "o_orderpriority", "episode_id")


@query("""WITH r AS (SELECT s_suppkey, '{"eligibility_reason":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'old; ' ELSE '' END || 'unsupported bundle version preserved as forward-compatible raw-only record","record_id":"R' || s_suppkey || '","source_phase":"outcome","training_eligible":false}' AS n FROM supplier)
SELECT s_suppkey, 'R' || s_suppkey AS record_id, 'unknown' AS record_type, false AS training_eligible, 'raw_only' AS status, sha256(n) AS normalized_payload_sha256, 'POSTMORTEM' AS phase FROM r""")
def import_raw_only(t: Tables) -> DataFrame:
    said = F.when(F.col("s_suppkey") % 2 == 0, "old").otherwise("")
    text = F.concat(F.lit('{"record_id": "R'), F.col("s_suppkey").cast("string"), F.lit('", "source_phase": "outcome", "training_eligible": true'), F.when(said != "", F.concat(F.lit(', "eligibility_reason": "'), said, F.lit('"'))).otherwise(""), F.lit("}"))
    rows = t.supplier.select("s_suppkey", F.lit("E").alias("episode_id"), text.alias("payload"))
    phase = imports.evidence_phase(F.col("payload"), F.col("record_type"), source_phase=True).alias("phase")
    return imports.envelopes(rows, {}, raw_only=True).select("s_suppkey", "record_id", "record_type", "training_eligible", "status", "normalized_payload_sha256", phase)


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'v23-direct-ingest' WHEN 2 THEN 'v11' WHEN 3 THEN 'v10' WHEN 4 THEN 'legacy-v1' WHEN 6 THEN 'legacy-v1' ELSE CASE WHEN p_size > 25 THEN 'forward-compatible-raw-only' ELSE 'quarantine' END END AS adapter FROM part""")
def import_adapter(t: Tables) -> DataFrame:
    which, none = F.col("p_partkey") % 8, F.lit(None).cast("string")
    front = _choice(which, "a.research_bundle.v11", "a.research_bundle.v11", "a.research_bundle.v11", none, none, "a.research_bundle.v12", "", none)
    manifest = _choice(which, "a.bundle_manifest.v23", "a.bundle_manifest.v23", "a.bundle_manifest.v11", "a.bundle_manifest.v10", none, "a.bundle_manifest.v11", "a.bundle_manifest.v1", none)
    episode = F.when(which == 4, "a.research_episode.v1")
    return t.part.select("p_partkey", imports.adapter(front, manifest, episode, which == 0, F.col("p_size") > 25, "a").alias("adapter"))


@query("""WITH r AS (SELECT o_custkey AS b, o_orderkey AS line, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey || '-' || o_orderkey END AS id, o_orderstatus AS t, o_totalprice > 50000 AS e, o_orderpriority AS s, o_orderkey AS p, o_orderkey AS q FROM orders),
n AS (SELECT b, line, CASE WHEN p % 40 = 3 THEN id || 'x' ELSE id END AS id, CASE WHEN p % 20 = 1 THEN 'X' ELSE t END AS t, e AND p % 60 <> 5 AS e, CASE WHEN p % 30 = 2 THEN '-' ELSE s END AS s FROM r WHERE q % 70 <> 9),
u AS (SELECT b, line, id, t, e, s, 1 AS r FROM r UNION ALL SELECT b, line, id, t, e, s, 0 FROM n),
i AS (SELECT b, count(*) FILTER (lo = 1) AS missing, count(*) FILTER (hi = 0) AS extra FROM (SELECT b, id, min(r) AS lo, max(r) AS hi FROM u WHERE id IS NOT NULL GROUP BY ALL) GROUP BY 1),
k AS (SELECT b, max(abs(d)) = 0 AS tm FROM (SELECT b, t, sum(CASE WHEN r = 1 THEN 1 ELSE -1 END) AS d FROM u GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT r.b, count(*) FILTER (n.s <> r.s) = 0 AND count(*) = count(n.b) AS hm FROM r LEFT JOIN n USING (b, line) GROUP BY 1),
c AS (SELECT b, count(*) FILTER (r = 1) AS raw_records, count(*) FILTER (r = 0) AS normalised_records, count(*) FILTER (r = 1 AND id IS NULL) AS raw_without_id, count(*) FILTER (r = 1 AND e) = count(*) FILTER (r = 0 AND e) AS em FROM u GROUP BY 1)
SELECT c.b AS bundle_id, raw_records, normalised_records, raw_without_id, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, CASE WHEN raw_without_id = 0 THEN missing = 0 AND extra = 0 END AS record_ids_match, tm AS type_counts_match, em AS eligible_count_matches, hm AS hashes_match,
coalesce(raw_without_id = 0 AND missing = 0 AND extra = 0 AND tm AND em AND hm, false) AS passed FROM c JOIN k USING (b) JOIN h USING (b) LEFT JOIN i USING (b)""")
def import_loss(t: Tables) -> DataFrame:
    key = F.col("line")
    name = F.when(F.col("o_orderkey") % 50 != 0, F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")))
    raw = t.orders.select(F.col("o_custkey").alias("bundle_id"), F.col("o_orderkey").alias("line"), name.alias("record_id"), F.col("o_orderstatus").alias("record_type"), (F.col("o_totalprice") > 50000).alias("eligible"), F.col("o_orderpriority").alias("sha"))
    changed = {"record_id": F.when(key % 40 == 3, F.concat("record_id", F.lit("x"))).otherwise(F.col("record_id")), "record_type": F.when(key % 20 == 1, "X").otherwise(F.col("record_type"))}
    changed |= {"eligible": F.col("eligible") & (key % 60 != 5), "sha": F.when(key % 30 == 2, "-").otherwise(F.col("sha"))}
    return imports.import_loss(raw, raw.where("line % 70 <> 9").withColumns(changed))


@query("""SELECT o_orderkey AS bundle_id, coalesce(a, 0) AS block_hash, coalesce(b, 0) AS import_loss, coalesce(d, 0) AS unknown_checks, coalesce(a + b + c + d, 0) = 0 AS passed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_linenumber % 4 = 3) AS d, count(*) FILTER (l_linenumber % 4 = 0) AS a, count(*) FILTER (l_linenumber % 4 = 1) AS b, count(*) FILTER (l_linenumber % 4 = 2) AS c
FROM lineitem WHERE l_quantity < 5 GROUP BY 1) ON l_orderkey = o_orderkey""")
def bundle_verdicts(t: Tables) -> DataFrame:
    found = t.lineitem.where("l_quantity < 5").select(F.col("l_orderkey").alias("bundle_id"), _choice(F.col("l_linenumber") % 4, "block_hash", "import_loss", "sample_weights", "not_a_check").alias("check_id"))
    return imports.verdicts(t.orders.select(F.col("o_orderkey").alias("bundle_id")), found).select("bundle_id", "block_hash", "import_loss", "unknown_checks", "passed")


@query("""WITH r AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 5 = 0 AND (o_totalprice > 150000 OR o_orderkey % 35 = 0) AS bad, o_totalprice > 50000 AS e FROM orders),
p AS (SELECT c, count(*) AS n, count(*) FILTER (e) AS ne, min(k) FILTER (bad) AS first FROM r GROUP BY 1),
b AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 6 = 0 THEN 'EPISODE_HASH_CONFLICT' WHEN first IS NOT NULL THEN 'RECORD_ID_CONFLICT' END AS reason, first, n, ne FROM customer LEFT JOIN p ON p.c = c_custkey)
SELECT c AS episode_id, CASE WHEN reason IS NULL THEN 'stored' ELSE 'quarantined' END AS outcome, reason, CASE WHEN reason = 'RECORD_ID_CONFLICT' THEN first END AS record_id, CASE WHEN reason IS NOT NULL THEN c || '-' || substr(sha256(CAST(c AS VARCHAR)), 1, 12) END AS quarantine,
coalesce(n, 0) AS n_records, coalesce(ne, 0) AS n_eligible FROM b""")
def store_conflicts(t: Tables) -> DataFrame:
    sha = F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256)
    bundles = t.customer.select(F.col("c_custkey").alias("episode_id"), sha.alias("sha"))
    held = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("episode_id"), F.when(F.col("c_custkey") % 2 == 0, "other").otherwise(sha).alias("sha"))
    records = t.orders.select(F.col("o_custkey").alias("episode_id"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("record_id"), F.lit("h").alias("sha"), (F.col("o_totalprice") > 50000).alias("eligible"))
    stored = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 35 == 0, -1).otherwise(F.col("o_custkey")).alias("episode_id"), F.when(F.col("o_totalprice") > 150000, "g").otherwise("h").alias("sha"))
    return imports.admit(bundles, records, held, stored).drop("bundle_id")


@query("""WITH RECURSIVE b AS (SELECT CAST(o_orderkey AS VARCHAR) AS bundle, o_custkey AS c, o_custkey || '/' || o_orderkey % 5 AS episode, o_orderpriority AS sha, o_orderkey AS k FROM orders),
l AS (SELECT l_orderkey AS k, l_linenumber * 100000000 + l_partkey AS p, l_partkey % 30 AS id, l_returnflag || l_linestatus AS h, l_quantity < 25 AS e, row_number() OVER (PARTITION BY l_orderkey, l_linenumber * 100000000 + l_partkey) AS n FROM lineitem),
w AS (SELECT bundle, 'E' || episode AS key, sha AS sets, sha AS checks, 0 AS p FROM b UNION ALL
 SELECT bundle, 'R' || c || '-' || id, episode || '=' || max_by(h, p), CASE WHEN min(h) = max(h) THEN episode || '=' || min(h) END, min(p) FROM b JOIN l USING (k) GROUP BY bundle, c, id, episode),
t AS (SELECT c, bundle, row_number() OVER (PARTITION BY c ORDER BY k) AS i, list({'k': key, 's': sets, 'c': checks} ORDER BY p) AS claims FROM b JOIN w USING (bundle) GROUP BY c, bundle, k),
s AS (SELECT c, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS bundle, CAST(NULL AS VARCHAR) AS clash, MAP {CAST('' AS VARCHAR): CAST('' AS VARCHAR)} AS held FROM (SELECT DISTINCT c FROM t) UNION ALL
 SELECT c, i, bundle, clash, CASE WHEN clash IS NULL THEN map_concat(held, map_from_entries(list_transform(list_filter(claims, lambda x: held[x.k] IS NULL), lambda x: struct_pack(k := x.k, v := x.s)))) ELSE held END FROM (
 SELECT t.c, t.i, t.bundle, t.claims, s.held, list_filter(t.claims, lambda x: s.held[x.k] IS NOT NULL AND s.held[x.k] IS DISTINCT FROM x.c)[1].k AS clash FROM s JOIN t ON t.c = s.c AND t.i = s.i + 1)),
n AS (SELECT k, count(*) AS n, count(*) FILTER (e) AS ne FROM l GROUP BY 1)
SELECT k AS bundle_id, episode AS episode_id, CASE WHEN clash IS NULL THEN 'stored' ELSE 'quarantined' END AS outcome, CASE WHEN clash LIKE 'E%' THEN 'EPISODE_HASH_CONFLICT' WHEN clash IS NOT NULL THEN 'RECORD_ID_CONFLICT' END AS reason,
CASE WHEN clash LIKE 'R%' THEN substr(clash, 2) END AS record_id, CASE WHEN clash IS NOT NULL THEN episode || '-' || substr(sha, 1, 12) END AS quarantine, coalesce(n, 0) AS n_records, coalesce(ne, 0) AS n_eligible FROM s JOIN b USING (bundle) LEFT JOIN n USING (k)""")
def store_batch(t: Tables) -> DataFrame:
    """Orders as bundles of one batch: a customer's orders share episodes and record ids."""
    own = F.concat_ws("/", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 5).cast("string"))
    bundles = t.orders.select(F.col("o_orderkey").alias("bundle_id"), F.col("o_orderkey").alias("arrival"), own.alias("episode_id"), F.col("o_orderpriority").alias("sha"))
    owner, n = t.orders.select(F.col("o_orderkey").alias("bundle_id"), "o_custkey"), t.orders.count()
    lines = t.lineitem.select(F.col("l_orderkey").alias("bundle_id"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("position"), "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("sha"), (F.col("l_quantity") < 25).alias("eligible"))
    records = admission.dealt(lines, n).join(admission.dealt(owner, n), "bundle_id").withColumn("record_id", F.concat_ws("-", F.col("o_custkey").cast("string"), (F.col("l_partkey") % 30).cast("string")))
    return imports.admit(bundles, records, bundles.select("episode_id", "sha").limit(0), records.select("record_id", F.lit("").alias("episode_id"), "sha").limit(0))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'positive_analogs' WHEN 1 THEN 'near_misses' WHEN 2 THEN 'counterexamples' WHEN 3 THEN 'candidate_generation_errors' WHEN 4 THEN 'leader_selection_pairs' END AS category,
CASE WHEN o_orderstatus = 'F' THEN 'counterexample' WHEN o_orderstatus = 'O' THEN 'ranking_error_case' ELSE 'blind_leader_preference_pair' END AS t, o_totalprice > 100000 AS e FROM orders)
SELECT o_orderkey, category, CASE category WHEN 'positive_analogs' THEN e WHEN 'near_misses' THEN NOT e WHEN 'counterexamples' THEN t = 'counterexample' WHEN 'candidate_generation_errors' THEN t = 'ranking_error_case' WHEN 'leader_selection_pairs' THEN t = 'blind_leader_preference_pair' ELSE true END AS belongs FROM r""")
def semantic_categories(t: Tables) -> DataFrame:
    named = prompts.category(_choice(F.col("o_orderkey") % 6, " Positive", "near-miss", "Counterexamples ", "Candidate Generation Failure", "leader_selection-case", "others"))
    kind = F.when(F.col("o_orderstatus") == "F", "counterexample").when(F.col("o_orderstatus") == "O", "ranking_error_case").otherwise("blind_leader_preference_pair")
    rows = t.orders.select("o_orderkey", named.alias("category"), kind.alias("kind"), (F.col("o_totalprice") > 100000).alias("eligible"))
    return rows.select("o_orderkey", "category", prompts.in_category(F.col("category"), F.col("kind"), F.col("eligible"), ("ranking_error_case", "row_disposition_error_case")).alias("belongs"))


@query("""WITH i AS (SELECT c_nationkey AS g, c_custkey AS o, CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE '' END AS title FROM customer), f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY g ORDER BY o) <= 10),
a AS (SELECT g, count(*) FILTER (title <> '') AS n FROM f GROUP BY 1)
SELECT g AS nation, CAST(CASE WHEN n = 0 THEN 1 ELSE 3 * n END + 11 AS BIGINT) AS n_queries, CASE WHEN n = 0 THEN 'open-world market catalyst company discovery' ELSE 'verify listing ticker novelty direct relation ' || (SELECT min_by(title, o) FROM f WHERE f.g = a.g AND title <> '') END AS first_query FROM a""")
def web_query_builder(t: Tables) -> DataFrame:
    title = F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).otherwise("")
    made = prompts.web_queries(t.customer.select(F.col("c_nationkey").alias("nation"), "c_custkey", title.alias("title")), "title", "c_custkey", "nation")
    return made.groupBy("nation").agg(F.count(F.lit(1)).alias("n_queries"), F.min_by("query", "position").alias("first_query"))


@query("""SELECT 'R' || event_id AS record_id, 'E' || user_id AS episode_id, event_type AS record_type, 'x' AS training_target, 'BLIND' AS evidence_phase, value > 100 AS training_eligible, ts AS available_from, NULL AS response_class, CAST(user_id AS VARCHAR) AS ticker, NULL AS theme_id,
event_type AS path_type, 'low' AS confidence_label FROM events""")
def record_summaries(t: Tables) -> DataFrame:
    text = F.format_string('{"ticker": %s, "path_type": "%s", "other": 1}', F.col("user_id").cast("string"), F.col("event_type"))
    rows = t.events.select(F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("record_id"), F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("episode_id"), F.col("event_type").alias("record_type"), F.lit("x").alias("training_target"), F.lit("BLIND").alias("evidence_phase"), (F.col("value") > 100).alias("training_eligible"), F.col("ts").alias("available_from"), F.lit("low").alias("confidence_label"), text.alias("payload"))
    return prompts.summaries(rows)


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a":"' || event_type || '"}' ELSE '{"b":[{"c":{"d":["[nested list with 2 items]"]}}],"long":"' || repeat('x', 800) || '...[truncated]"}' END AS compact FROM events""")
def compact_payload(t: Tables) -> DataFrame:
    short = F.format_string('{"z": 1, "a": " %s ", "e": [], "s": "  "}', F.col("event_type"))
    deep = F.lit('{"b": [{"c": {"d": [[1, 2]]}}, {}, null], "hidden": 3, "long": "' + "x" * 900 + '"}')
    text = F.when(F.col("event_id") % 2 == 0, short).otherwise(deep)
    return t.events.select("event_id", prompts.compact(text, ("a", "e", "s"), ("hidden",)).alias("compact"))


@query("""SELECT c_nationkey, p AS path_type, coalesce(n, 0) AS n, best_rank FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES ('SINGLE_EVENT'), ('THEME_BENEFICIARY'), ('CONTINUATION'), ('HYBRID')) v(p)
LEFT JOIN (SELECT c_nationkey AS g, CASE WHEN c_custkey % 3 = 0 THEN 'HYBRID' WHEN c_custkey % 3 = 1 THEN 'SINGLE_EVENT' ELSE 'CONTINUATION' END AS q, count(*) AS n, min(c_custkey) AS best_rank FROM customer GROUP BY 1, 2) ON g = c_nationkey AND q = p""")
def candidates_by_path(t: Tables) -> DataFrame:
    path = _choice(F.col("c_custkey") % 3, "HYBRID", "SINGLE_EVENT", "CONTINUATION")
    return prompts.by_path(t.customer.select("c_nationkey", path.alias("path_type"), F.col("c_custkey").alias("rank")), "c_nationkey")


@query("""SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, sha256(string_agg('{"a":' || l_linenumber || ',"b":"' || l_returnflag || '"}' || chr(10), '' ORDER BY l_linenumber, l_returnflag)) AS sha256 FROM lineitem GROUP BY 1""")
def canonical_lines(t: Tables) -> DataFrame:
    text = F.format_string('{"b": "%s", "a": %s}', F.col("l_returnflag"), F.col("l_linenumber").cast("string"))
    return prompts.lines_hash(t.lineitem.select("l_orderkey", "l_linenumber", payload.canonical_json(text).alias("line")), F.col("line"), "l_linenumber", "l_orderkey")


@query("""WITH b AS (SELECT s_name, 1000 + CAST('0x' || substr(sha256(s_name), 1, 2) AS INTEGER) AS b, CAST('0x' || substr(sha256(s_name || '|2024-03-08'), 1, 2) AS INTEGER) AS o FROM supplier)
SELECT s_name, CAST(DATE '2024-03-08' - CAST(k - 1 AS INTEGER) AS DATE) AS trade_date, CAST(b + k AS DOUBLE) AS open, CAST(b + k + 10 AS DOUBLE) AS high, CAST(b + k - 5 AS DOUBLE) AS low, CAST(b + k + 3 AS DOUBLE) AS close, CAST(b * k AS DOUBLE) AS volume, CAST(b * k * 100 AS DOUBLE) AS amount,
CAST(b * 1000 AS DOUBLE) AS market_cap, CAST(b * 10 AS DOUBLE) AS listed_shares, CAST(o % 30 AS DOUBLE) AS high_return, o % 30 >= 29 AND o % 2 = 1 AS released FROM b, range(1, 6) r(k)""")
def sample_prices(t: Tables) -> DataFrame:
    bars = prompts.sample_bars(t.supplier, "s_name", F.lit("2024-03-08").cast("date"))
    made = prompts.sample_outcome(F.col("s_name"), F.lit("2024-03-08"))
    return bars.select("*", made["intraday_high_return_pct"].alias("high_return"), made["upper_limit_released"].alias("released"))
