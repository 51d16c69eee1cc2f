"""Queries over texts: clusters, terms, embeddings, retrieval, bundles and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ids, payload, text, vectors
from tidemark.operators import audits, news, retrieval
from tidemark.plans.registry import Tables, query
from tidemark.session import shared_folder
from tidemark.sources import bundles
from tidemark.streaming import admission

CLUSTERS = r"""c AS (SELECT sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS cluster_sha, min(doc_id) AS first_row, max(doc_id) AS last_row, count(*) AS n_rows FROM documents GROUP BY 1)"""


@query(f"WITH {CLUSTERS} SELECT *, 'CLUSTER-' || substr(sha256(cluster_sha), 1, 12) AS cluster_id FROM c")
def exact_duplicate_clusters(t: Tables) -> DataFrame:
    return news.event_clusters(t.documents, "doc_id", None, "text")


@query(f"WITH {CLUSTERS} SELECT count(*) AS n_clusters, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) FILTER (n_rows > 1) AS n_repeated_clusters, CAST(sum(n_rows - 1) AS BIGINT) AS n_exact_repeats, max(n_rows) AS largest FROM c")
def cluster_summary(t: Tables) -> DataFrame:
    return news.cluster_summary(news.event_clusters(t.documents, "doc_id", None, "text"))


@query(r"""WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS cluster_sha FROM documents),
c AS (SELECT cluster_sha, count(*) AS n_rows, row_number() OVER (ORDER BY min(doc_id)) AS cluster_index FROM k GROUP BY 1)
SELECT doc_id, cluster_sha, cluster_index, row_number() OVER (PARTITION BY cluster_sha ORDER BY doc_id) AS member_index, n_rows FROM k JOIN c USING (cluster_sha)""")
def cluster_rows(t: Tables) -> DataFrame:
    return news.cluster_rows(t.documents, "doc_id", "text")


@query(r"""WITH l AS (SELECT doc_id, CAST(text AS VARCHAR) AS text, list_transform(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x, E' \t\n\x0b\x0c\r') <> '' AND NOT starts_with(x, '# ')
  AND NOT starts_with(x, 'Brain version:') AND NOT starts_with(x, 'Build mode:') AND NOT starts_with(x, 'Provider:') AND NOT starts_with(x, 'Model:') AND NOT starts_with(x, 'Category:')
  AND NOT starts_with(x, 'Source record count:') AND NOT starts_with(x, 'Accepted episodes covered:')), lambda x: trim(x, E' \t\n\x0b\x0c\r')) AS x FROM documents),
h AS (SELECT doc_id, 'IDENTICAL_FILES' AS check_id, sha256(text) AS h FROM l UNION ALL SELECT doc_id, 'IDENTICAL_BODIES', sha256(array_to_string(x, chr(10))) FROM l),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY check_id, h) AS first_id, count(*) OVER (PARTITION BY check_id, h) AS n FROM h WHERE h IS NOT NULL)
SELECT check_id, CAST(doc_id AS VARCHAR) AS subject_id, CAST(first_id AS VARCHAR) AS detail FROM g WHERE n > 1""")
def near_identical_bodies(t: Tables) -> DataFrame:
    return audits.twins(t.documents, "doc_id", "text").select("check_id", F.col("subject_id").cast("string").alias("subject_id"), F.col("detail").cast("string").alias("detail"))


@query(r"""SELECT doc_id, len(x) AS n_terms, md5(array_to_string(list_sort(x), ' ')) AS terms_md5
FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', ' ', 'g')), ' +'), lambda w: length(w) > 1)) AS x FROM documents)""")
def text_terms(t: Tables) -> DataFrame:
    x = text.text_terms(F.col("text"))
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort(x), " ").cast("binary")).alias("terms_md5"))


@query(r"""SELECT doc_id, len(x) AS n_bigrams, md5(array_to_string(list_sort(x), ' ')) AS bigrams_md5
FROM (SELECT doc_id, list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) AS x FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS c FROM documents))""")
def text_bigrams(t: Tables) -> DataFrame:
    x = text.text_bigrams(F.col("text"))
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n_bigrams"), F.md5(F.array_join(F.array_sort(x), " ").cast("binary")).alias("bigrams_md5"))


FEATURES = r"""t AS (SELECT doc_id AS item_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', ' ', 'g')), ' +'), lambda w: length(w) > 1)) AS terms,
  regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS c FROM documents),
f AS (SELECT item_id, sha256(unnest(list_concat(terms, list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2)))))) AS h FROM t),
b AS (SELECT item_id, CAST(('0x' || substr(h, 1, 8)) AS UBIGINT) % 32 AS bucket, sum(CASE WHEN CAST(('0x' || substr(h, 9, 2)) AS UBIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM f GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(s * s)) AS norm FROM b GROUP BY 1)"""


@query(f"WITH {FEATURES} SELECT b.item_id, CAST(bucket AS INTEGER) AS bucket, round(s / norm, 9) AS value FROM b JOIN n USING (item_id) WHERE s <> 0")
def hash_embedding(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("item_id"), F.posexplode(vectors.hash_embedding(F.col("text"))).alias("bucket", "value"))
    return rows.where("value <> 0").select("item_id", "bucket", F.round("value", 9).alias("value"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(t: Tables) -> DataFrame:
    top = retrieval.vector_top(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return top.withColumn("score", F.round("score", 6))


@query(r"""WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(text, '[^\p{L}\p{N}]', ' ', 'g')), ' +'), lambda w: length(w) > 1)) AS x FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', ' ', 'g')), ' +'), lambda w: length(w) > 1)) AS y FROM documents),
s AS (SELECT item_id, doc_id, len(list_intersect(x, y)) AS score FROM q, d)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def lexical_topk(t: Tables) -> DataFrame:
    none = F.array().cast("array<double>")
    queries = t.benchmark.select("item_id", text.text_terms(F.col("text")).alias("terms"), none.alias("vector"))
    store = t.documents.select("doc_id", text.text_terms(F.col("text")).alias("terms"), none.alias("vector"))
    return retrieval.hybrid(queries, store, "item_id", "doc_id", 5).select("item_id", "doc_id", F.col("score").cast("long").alias("score"), "rank")


@query()
def hybrid_retrieval(t: Tables) -> DataFrame:
    queries = retrieval.indexed(t.benchmark, "text")
    return retrieval.hybrid(queries, retrieval.indexed(t.documents, "text"), "item_id", "doc_id", 5).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
SELECT user_id, event_id, rank FROM k WHERE rank <= 5 AND ts <= TIMESTAMP '2024-01-20'""")
def topk_then_asof(t: Tables) -> DataFrame:
    """Rows of the future take places in the top five before they are taken out."""
    top = retrieval.top_k(t.events, 5, "user_id", "event_id", "value")
    return top.where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")).select("user_id", "event_id", "rank")


@query("""WITH s AS (SELECT event_type, event_id, CASE WHEN event_type < 'n' THEN floor(value) - 400 ELSE -floor(value) END AS score FROM events)
SELECT event_type, event_id, CAST(score AS BIGINT) AS score FROM (SELECT *, max(score) OVER (PARTITION BY event_type) AS best FROM s) WHERE best <= 0 OR score > 0""")
def positive_or_all(t: Tables) -> DataFrame:
    score = F.when(F.col("event_type") < "n", F.floor("value") - 400).otherwise(-F.floor("value"))
    return retrieval.positive_or_all(t.events.select("event_type", "event_id", score.cast("long").alias("score")), "event_type")


@query("SELECT c_custkey, 'CUST-' || substr(sha256(c_name || '|' || coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'None')), 1, 12) AS stable_id, c_name || '|' || coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, '') AS identity FROM customer")
def stable_ids(t: Tables) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", ids.stable_id("CUST", F.col("c_name"), segment).alias("stable_id"), ids.identity(F.col("c_name"), segment).alias("identity"))


@query(r"SELECT page_id, md5(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS clean_md5 FROM pages")
def clean_control_chars(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.drop_controls(F.col("html")).cast("binary")).alias("clean_md5"))


@query("SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS n_tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("n_tokens"))


@query(r"SELECT doc_id, md5(CASE WHEN length(c) > 1200 THEN rtrim(substr(c, 1, 1197)) || '...' ELSE c END) AS excerpt_md5 FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents)")
def excerpts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.excerpt(F.col("text")).cast("binary")).alias("excerpt_md5"))


@query("SELECT p_partkey, upper(translate(trim(p_type), '- ', '__')) AS token, coalesce(nullif(left(trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9가-힣_-]+', '-', 'g'), '-+', '-', 'g'), '-'), 80), ''), 'item') AS slug FROM part")
def normalised_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.edge_token(F.col("p_type")).alias("token"), text.slug(F.col("p_name")).alias("slug"))


@query("""SELECT event_id, sha256('{"a":' || json_extract(props, '$.k') || ',"b":"' || event_type || '"}') AS payload_sha FROM events""")
def canonical_payload_hash(t: Tables) -> DataFrame:
    raw = F.format_string('{ "b" : "%s",  "a": %s }', F.col("event_type"), F.get_json_object("props", "$.k"))
    return t.events.select("event_id", payload.payload_hash(raw).alias("payload_sha"))


@query()
def bundle_blocks(t: Tables) -> DataFrame:
    """Each conversation as a bundle with a front matter and a JSONL block of its turns, parsed again."""
    line = F.to_json(F.struct("turn", "role"))
    bundle = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("j")))), lambda x: x["j"]), "\n").alias("body"))
    made = F.concat(F.lit("---\nepisode_id: 'EP-"), F.col("conv_id"), F.lit("'\n---\n<!-- BUNDLE:BEGIN turns.jsonl -->\n```json\n"), F.col("body"), F.lit("\n```\n<!-- BUNDLE:END turns.jsonl -->\n"))
    parsed = bundles.json_lines(bundles.blocks(bundle.select(F.col("conv_id").cast("string").alias("path"), made.alias("text"))))
    return parsed.select("path", "line", F.get_json_object("payload", "$.role").alias("role"), "valid")


@query("""SELECT CAST(ts + INTERVAL 8 HOUR + INTERVAL 30 MINUTE AS DATE) AS trade_date, count(DISTINCT event_id) AS n_events FROM events GROUP BY 1
HAVING CAST(ts + INTERVAL 8 HOUR + INTERVAL 30 MINUTE AS DATE) + INTERVAL 15 HOUR + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""".replace("HAVING CAST(ts + INTERVAL 8 HOUR + INTERVAL 30 MINUTE AS DATE)", "HAVING trade_date"))
def stream_admission(t: Tables) -> DataFrame:
    """Events per admission window, from a stream; windows that the watermark has not passed are withheld."""
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*")
    windows = admission.daily_windows(stream, "ts", "event_id")
    return admission.run_available(windows, f"{shared_folder(t.spark)}/admission-{uuid.uuid4().hex[:8]}")


@query("SELECT user_id, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS cluster_index FROM events")
def first_appearance_index(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", "ts", F.row_number().over(w).alias("cluster_index"))
