"""Queries that hold what is claimed against what is recomputed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import web_time
from tidemark.operators import diffs, json_tree, receipts, rulebook, scopes
from tidemark.operators.rulebook import Counted, Refers, Row, Total, Unique
from tidemark.plans.registry import Tables, query
from tidemark.session import shared_folder

LISTS = {"available_ids": "available", "unavailable_ids": "unavailable", "training_ids": "eligible"}


def _packs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as packs with a cutoff each, that list orders; every nation's lists lack some and have some too many."""
    records = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").cast("timestamp").alias("available_from"), (F.col("o_orderstatus") == "F").alias("eligible"))
    packs = t.nation.select(F.col("n_nationkey").alias("pack_id"), F.date_add(F.lit("1992-06-01").cast("date"), (F.col("n_nationkey") * 97).cast("int")).cast("timestamp").alias("cutoff"))
    then = F.col("available_from") <= F.col("cutoff")
    mix = F.pmod(F.col("record_id") * 7 + F.col("pack_id") * 13, F.lit(500))
    lists = F.array(F.when(then != (mix == 1), F.lit("available_ids")), F.when(~then, F.lit("unavailable_ids")), F.when(then & F.col("eligible") & (mix != 2), F.lit("training_ids")), F.when(then & F.col("eligible") & (mix == 3), F.lit("training_ids")))
    both = records.join(F.broadcast(packs), F.lit(True)).select("pack_id", F.col("record_id") + F.when(mix == 4, F.lit(1 << 40)).otherwise(0), F.explode(lists).alias("list")).toDF("pack_id", "record_id", "list").where("list is not null")
    return records, packs, both


#: The same lists, and the sets they are held against, pair by pair.
_PAIRS = """r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS a, o_orderstatus = 'F' AS e FROM orders), p AS (SELECT n_nationkey AS pack_id, CAST(DATE '1992-06-01' + CAST(n_nationkey * 97 AS INTEGER) AS TIMESTAMP) AS c FROM nation),
x AS (SELECT pack_id, id, a <= c AS av, e, (id * 7 + pack_id * 13) % 500 AS m FROM r, p), y AS (SELECT *, id + CASE WHEN m = 4 THEN 1099511627776 ELSE 0 END AS shown FROM x),
l AS (SELECT pack_id, shown AS id, 'available_ids' AS list FROM y WHERE av <> (m = 1) UNION ALL SELECT pack_id, shown, 'unavailable_ids' FROM y WHERE NOT av UNION ALL SELECT pack_id, shown, 'training_ids' FROM y WHERE av AND e AND m <> 2 UNION ALL SELECT pack_id, shown, 'training_ids' FROM y WHERE av AND e AND m = 3),
w AS (SELECT pack_id, id, 'available_ids' AS list FROM x WHERE av UNION ALL SELECT pack_id, id, 'unavailable_ids' FROM x WHERE NOT av UNION ALL SELECT pack_id, id, 'training_ids' FROM x WHERE av AND e),
o AS (SELECT pack_id, list, id, count(*) AS n FROM l GROUP BY ALL),
d AS (SELECT coalesce(o.pack_id, w.pack_id) AS pack_id, coalesce(o.list, w.list) AS list, coalesce(o.id, w.id) AS id, o.n, w.id IS NOT NULL AS wanted FROM o FULL JOIN w ON o.pack_id = w.pack_id AND o.list = w.list AND o.id = w.id)"""


@query(f"""WITH {_PAIRS} SELECT p.pack_id, v.list, count(*) FILTER (coalesce(wanted, false)) AS expected, count(n) AS listed, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, coalesce(bool_and(wanted AND n IS NOT NULL) FILTER (wanted IS NOT NULL), true) AS ids_match, coalesce(bool_and(wanted AND n IS NOT NULL AND n = 1) FILTER (wanted IS NOT NULL), true) AS passed
FROM p CROSS JOIN (VALUES ('available_ids'), ('unavailable_ids'), ('training_ids')) v(list) LEFT JOIN (SELECT pack_id AS k, list AS l, n, wanted FROM d WHERE id IS NOT NULL) ON k = p.pack_id AND l = v.list GROUP BY 1, 2""")
def pack_scopes(t: Tables) -> DataFrame:
    return scopes.scope_report(*_packs(t), LISTS).drop("count_matches")


@query(f"""WITH {_PAIRS} SELECT pack_id, list, id AS record_id, CASE WHEN n IS NULL THEN 'missing' WHEN id >= 1099511627776 THEN 'unknown' ELSE 'unexpected' END AS problem FROM d WHERE n IS NULL OR NOT wanted
UNION ALL SELECT pack_id, list, id, 'duplicate' FROM o WHERE n > 1""")
def pack_differences(t: Tables) -> DataFrame:
    return scopes.scope_differences(*_packs(t), LISTS, buckets=16)


#: The tables of the rulebook, made of those of the shop and the warehouse, as SQL that both engines read.
SUBJECTS = {
    "predictions": ("prediction_id", """SELECT o_orderkey AS prediction_id, CASE WHEN o_orderkey % 17 > 0 THEN o_custkey + CASE WHEN o_orderkey % 23 = 0 THEN 100000000 ELSE 0 END END AS manifest_id, CASE WHEN o_orderkey % 11 > 1 THEN md5(CAST(o_orderkey AS VARCHAR(20))) WHEN o_orderkey % 11 = 1 THEN '' END AS blind_sha256,
o_orderkey % 13 > 0 AS has_provenance, o_orderdate AS cutoff_at, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS sealed_at, CASE WHEN o_orderkey % 4 = 0 THEN 'blind' ELSE 'sampled' END AS mode, o_orderkey % 8 AS n_candidates FROM orders"""),
    "candidates": ("concat(prediction_id, '/', rank)", """SELECT l_orderkey + CASE WHEN l_partkey % 97 = 0 THEN 100000000 ELSE 0 END AS prediction_id, l_linenumber AS rank, CASE WHEN l_partkey % 31 > 0 THEN concat('T', l_partkey % 12) ELSE '' END AS ticker, l_returnflag <> 'R' AS has_provenance,
l_linenumber % 2 AS n_events, l_suppkey % 2 AS n_records, l_partkey % 3 AS n_urls, l_discount * 11 AS confidence FROM lineitem"""),
    "manifests": ("manifest_id", """SELECT client_id AS manifest_id, CASE WHEN client_id % 3 = 0 THEN 'exhaustive' WHEN client_id % 3 = 1 THEN 'blind' ELSE segment END AS mode, CASE WHEN client_id % 9 > 0 THEN updated_at END AS trade_date, CASE WHEN client_id % 10 > 0 THEN updated_at END AS cutoff_at, updated_at AS as_of,
client_id % 5 AS accepted, client_id % 4 AS swept, updated_at AS price_through, CASE WHEN client_id % 6 > 0 THEN updated_at END AS price_as_of, client_id % 7 AS n_hashes, client_id % 2 AS web_calls, CASE WHEN client_id % 8 > 0 THEN 0 END AS price_calls, client_id % 12 AS n_sources FROM clients"""),
    "sources": ("source_id", """SELECT sale_id AS source_id, client_id AS manifest_id, CASE WHEN sale_id % 19 = 0 THEN '' WHEN sale_id % 19 = 1 THEN 'ftp://x' ELSE 'https://x' END AS url, sold_at AS published_at, arrived_at AS cutoff_at, arrived_at AS observed_at, status = 'done' AS before_cutoff,
CASE WHEN priority = 1 THEN 'datetime' WHEN priority = 2 THEN 'date_only_end_of_day' ELSE 'about' END AS time_precision, CASE WHEN sale_id % 5 > 0 THEN repeat('a', 64) ELSE status END AS sha256 FROM sales"""),
    "records": ("record_id", """SELECT event_id AS record_id, CASE WHEN event_id % 50 > 0 THEN ts END AS available_from, CASE WHEN event_id % 20 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS episode_from, value > 50 AS eligible, event_id % 3 > 0 AS typed,
CASE event_type WHEN 'view' THEN 'verified' WHEN 'click' THEN 'quarantined' WHEN 'error' THEN 'guessed' END AS quality, CASE event_type WHEN 'view' THEN 'BLIND' WHEN 'click' THEN 'POSTMORTEM' WHEN 'error' THEN 'AUDIT' END AS phase FROM events"""),
    "exports": ("example_id", """SELECT click_id AS example_id, click_id * 3 % 13001 AS record_id, client_id AS group_id, CASE WHEN click_id % 41 > 0 THEN 'h' ELSE '' END AS source_hash, CASE kind WHEN 'view' THEN 'BLIND' WHEN 'click' THEN 'POSTMORTEM' WHEN 'error' THEN 'AUDIT' END AS phase,
CASE WHEN click_id % 10 < 8 THEN 'train' WHEN click_id % 10 = 8 THEN 'test' END AS split, click_id % 2 = 0 AS hindsight, CASE WHEN value > 40 THEN 'outcome' ELSE 'rank' END AS task, CASE WHEN value > 20 THEN 0.25 END AS weight FROM clicks"""),
    "support": ("concat(record_id, '/', claim)", """SELECT l_orderkey AS record_id, l_linenumber AS claim, TIMESTAMP '2024-01-03 00:00:00' AS known_at FROM lineitem"""),
}


def _violations(r) -> str:
    """The rule by itself, as a statement over its own tables."""
    rows = lambda name: f"({SUBJECTS[name][1]})"
    text = lambda x: f"CAST({x} AS VARCHAR)"
    subject = text(SUBJECTS[r.table][0])
    if isinstance(r, Row):
        return f"SELECT '{r.check}' AS check_id, {subject} AS subject_id, CAST(NULL AS VARCHAR) AS detail FROM {rows(r.table)} WHERE {r.when}"
    if isinstance(r, Unique):
        return f"SELECT '{r.check}', {text('k')}, {text('count(*)')} FROM (SELECT {r.key} AS k FROM {rows(r.table)}) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1"
    if isinstance(r, Total):
        return f"SELECT '{r.check}', {text('k')}, {text('n')} FROM (SELECT {r.key} AS k, count(*) AS n, sum({r.value}) AS total, min({r.value}) AS least, max({r.value}) AS most FROM {rows(r.table)} WHERE {r.where} GROUP BY 1) WHERE k IS NOT NULL AND ({r.when})"
    if isinstance(r, Counted):
        return f"SELECT '{r.check}', s, {text('coalesce(m, 0)')} FROM (SELECT {subject} AS s, {r.key} AS k, {r.claims} AS c FROM {rows(r.table)}) LEFT JOIN (SELECT {r.of[1]} AS k, count(*) AS m FROM {rows(r.of[0])} GROUP BY 1) USING (k) WHERE k IS NOT NULL AND c IS DISTINCT FROM coalesce(m, 0)"
    own = f"(SELECT {subject} AS s, {r.key} AS k, {r.mine or 'NULL'} AS v FROM {rows(r.table)})"
    if not r.mine:
        return f"SELECT '{r.check}', s, {text('k')} FROM {own} WHERE k IS NOT NULL AND k NOT IN (SELECT {r.of[1]} FROM {rows(r.of[0])} WHERE {r.of[1]} IS NOT NULL)"
    return f"SELECT '{r.check}', s, {text('k')} FROM {own} JOIN (SELECT {r.of[1]} AS k, max({r.theirs}) AS w FROM {rows(r.of[0])} GROUP BY 1) USING (k) WHERE {'v IS DISTINCT FROM w' if r.how == 'same' else 'v < w'}"


@query(" UNION ALL ".join(_violations(r) for r in rulebook.RULES))
def audit_rulebook(t: Tables) -> DataFrame:
    """All rules of the book over six tables at once."""
    for name in ("orders", "lineitem", "clients", "sales", "events", "clicks"):
        getattr(t, name).createOrReplaceTempView(name)
    return rulebook.findings(rulebook.RULES, {name: (t.spark.sql(sql), subject) for name, (subject, sql) in SUBJECTS.items()})


@query("""WITH RECURSIVE n AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT o, n, 1 AS k, sha256('{"before":null,"body":{"k":1,"o":' || o || '},"inputs":{}}') AS h FROM n UNION ALL SELECT o, n, k + 1, sha256('{"before":"' || h || '","body":{"k":' || (k + 1) || ',"o":' || o || '},"inputs":{}}') FROM c WHERE k < n),
p AS (SELECT *, (o + k) % 29 = 0 AS gone, (o + k) % 31 = 0 AS bad FROM c), s AS (SELECT *, coalesce(max(k) FILTER (gone) OVER (PARTITION BY o ORDER BY k), 0) AS since FROM p),
q AS (SELECT *, CASE WHEN bad THEN 'changed' WHEN k > 1 AND k = since + 1 THEN 'gap' END AS problem FROM s WHERE NOT gone),
f AS (SELECT *, min(k) FILTER (problem IS NOT NULL) OVER (PARTITION BY o, since ORDER BY k) AS fk FROM q)
SELECT f.o AS run_id, f.h AS receipt_sha256, f.k - f.since AS depth, f.problem, g.h AS first_broken, g.problem AS first_problem, f.fk IS NULL AS valid FROM f LEFT JOIN q g ON g.o = f.o AND g.k = f.fk""")
def receipt_chains(t: Tables) -> DataFrame:
    """A chain for each order, a receipt a line; some receipts are lost, some were changed after they were sealed."""
    text = lambda k, before: F.concat(F.lit('{"before":'), F.coalesce(F.concat(F.lit('"'), before, F.lit('"')), F.lit("null")), F.lit(',"body":{"k":'), k.cast("string"), F.lit(',"o":'), F.col("o").cast("string"), F.lit('},"inputs":{}}'))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    start = F.struct(F.lit(None).cast("string").alias("h"), F.array().cast("array<string>").alias("texts"))
    chain = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), start, lambda a, k: F.struct(hashed(text(k, a["h"])).alias("h"), F.array_append(a["texts"], text(k, a["h"])).alias("texts")))["texts"]
    rows = lines.select("o", F.posexplode(chain).alias("at", "receipt")).withColumn("mix", F.col("o") + F.col("at") + 1).where("mix % 29 <> 0")
    rows = rows.select(F.col("o").alias("run_id"), F.when(F.col("mix") % 31 == 0, F.concat("receipt", F.lit(" "))).otherwise(F.col("receipt")).alias("receipt"), hashed(F.col("receipt")).alias("receipt_sha256"))
    return receipts.chain_report(rows)


@query("""SELECT click_id, fullkey AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, CASE WHEN type NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(json, fullkey) END AS text
FROM (SELECT c.click_id, c.props AS json, t.fullkey, t.type FROM clicks c, json_tree(c.props) t WHERE json_valid(c.props))""")
def json_rows(t: Tables) -> DataFrame:
    return json_tree.tree(t.clicks, "click_id", "props").select("click_id", "path", "kind", "text")


@query("""SELECT event_id, 'event' AS kind, 'EVT-' || event_id AS id FROM events UNION ALL SELECT event_id, 'fact', 'FACT-' || user_id FROM events UNION ALL SELECT event_id, 'inference', 'INF-' || user_id FROM events UNION ALL SELECT event_id, 'event', 'EVT-k' || json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def payload_reference_rows(t: Tables) -> DataFrame:
    """References anywhere in nested payloads, as rows of the tree."""
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    text = F.format_string('{"event_id": "EVT-%s", "x": [{"support_fact_ids": ["FACT-%s", ""], "fact_id": 3, "deep": [[{"y": {"event_ids": [%s, [], null]}}]]}], "a_fact_or_inference_id": ["INF-%s", "zzz"], "preevent_id": "no", "props": %s}', F.col("event_id").cast("string"), user, F.coalesce(F.concat(F.lit('"EVT-k'), k, F.lit('"')), F.lit("null")), user, F.coalesce("props", F.lit("null")))
    return json_tree.references(json_tree.tree(t.events.select("event_id", text.alias("payload")), "event_id", "payload"), "event_id")


@query("""WITH q AS (SELECT c_custkey AS query_id, 'U' || c_custkey % 60 AS ticker, CASE c_nationkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' END AS path FROM customer)
SELECT query_id, event_id FROM q JOIN events ON (ticker = 'U' || user_id OR ticker = 'U' || json_extract_string(props, '$.k')) AND (path IS NULL OR path = event_type)""")
def index_filters(t: Tables) -> DataFrame:
    """Customers ask an inverted index of events for a ticker, two of three for a path as well."""
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    text = F.format_string('{"ticker": " U%s ", "issuer_day_outcome": {"code": [["U%s"], null]}, "missed_path_type": "%s", "other": "U1"}', user, k, F.col("event_type"))
    rows = t.events.select("event_id", text.alias("payload"))
    index = json_tree.InvertedIndex(t.spark, f"{shared_folder(t.spark)}/tidemark-index-{uuid.uuid4().hex[:12]}", "event_id", 8)
    index.write(json_tree.postings(json_tree.tree(rows, "event_id", "payload"), "event_id"))
    path = F.when(F.col("c_nationkey") % 3 == 0, "view").when(F.col("c_nationkey") % 3 == 1, "click")
    asks = F.array_compact(F.array(F.struct(F.lit("ticker").alias("field"), F.concat(F.lit("U"), (F.col("c_custkey") % 60).cast("string")).alias("value")), F.when(path.isNotNull(), F.struct(F.lit("path_type").alias("field"), path.alias("value")))))
    queries = t.customer.select(F.col("c_custkey").alias("query_id"), F.explode(asks).alias("a")).select("query_id", "a.field", "a.value")
    return index.answers(queries, rows)


@query("""SELECT event_id, CASE event_id % 6 WHEN 3 THEN date_trunc('second', ts) - INTERVAL 9 HOUR WHEN 4 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 3599 SECOND WHEN 5 THEN NULL ELSE date_trunc('second', ts) END AS published_at FROM events""")
def web_times(t: Tables) -> DataFrame:
    """Times of events as web results give them: GMT, an offset, ISO, without a zone, a date alone, an age."""
    ts, seoul = F.col("ts").cast("timestamp"), F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul")
    texts = [F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.concat(F.date_format(seoul, "d MMM yyyy H:mm:ss"), F.lit(" +0900")), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy/MM/dd"), F.lit("3 hours ago")]
    said = F.get(F.array(*texts), (F.col("event_id") % 6).cast("int"))
    return t.events.select("event_id", web_time(said, "Asia/Seoul").cast("timestamp_ntz").alias("published_at"))


@query(r"""WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS a FROM documents WHERE text <> ''), b AS (SELECT doc_id, a, list_concat(list_filter(a, lambda x: length(x) % 5 <> 0), ['the end']) AS b FROM d)
SELECT doc_id, sha256(array_to_string(b, chr(10))) AS applied_sha256, len(b) - len(a) AS balance, 'changed' AS status FROM b""")
def line_diff(t: Tables) -> DataFrame:
    """Documents against themselves without some lines and with one more: their changes, applied to the first text, give the second."""
    kept = F.filter(diffs.lines_of(F.col("text")), lambda x: F.char_length(x) % 5 != 0)
    pairs = t.documents.where("text <> ''").select("doc_id", "text", F.array_join(F.concat(kept, F.array(F.lit("the end"))), "\n").alias("later"))
    found = diffs.line_diffs(pairs, "text", "later")
    lines = diffs.applied(F.col("text"), F.col("later"), F.col("changes"))
    applied = F.array_join(lines, "\n")
    return found.select("doc_id", F.sha2(applied.cast("binary"), 256).alias("applied_sha256"), (F.col("added") - F.col("removed")).cast("long").alias("balance"), "status")
