"""Query op5: pages against dated lists, as of the day of their fetch.

Pages have no fetch time and there is no list table, so both follow from the pages by rule: page N is fetched on day N mod 365 of
2024; a quarter of all hosts are listed, on and off, on days that the hash of their name gives; two parent domains and some
URLs are listed as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.url_filter import active_entries, host_of

NAME = "op5_url_filter"
HEX = "0123456789abcdef"


def _day(n: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))


def entries(pages: DataFrame) -> DataFrame:
    """The list: (kind, pattern, at, action)."""
    named = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("m", F.md5(F.col("host").cast("binary")))
    digit = lambda i: F.instr(F.lit(HEX), F.substring("m", i, 1)) - 1
    listed = named.where(digit(1) < 4).withColumn("n", 16 * digit(2) + digit(3)).withColumn("more", digit(4) < 8)
    dated = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("action"), F.lit(o).alias("only")) for k, a, o in ((0, "add", False), (10, "add", False), (60, "remove", False), (200, "add", True))])
    hosts = listed.withColumn("d", F.explode(dated)).where(~F.col("d.only") | F.col("more"))
    hosts = hosts.select(F.lit("domain").alias("kind"), F.col("host").alias("pattern"), _day(F.col("n") + F.col("d.k")).alias("at"), F.col("d.action").alias("action"))
    urls = pages.select(F.lower(F.trim("url")).alias("pattern")).distinct().where(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 2) == "00")
    urls = urls.select(F.lit("url").alias("kind"), "pattern", _day(F.lit(100)).alias("at"), F.lit("add").alias("action"))
    fixed = pages.sparkSession.createDataFrame([("domain", "example.org", 300, "add"), ("domain", "example.net", 300, "add"), ("domain", "example.net", 330, "remove")], "kind string, pattern string, n int, action string")
    return hosts.unionByName(urls).unionByName(fixed.select("kind", "pattern", _day(F.col("n")).alias("at"), "action"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = pages.withColumn("fetched_on", _day(F.pmod("page_id", F.lit(365))))
    found = active_entries(fetched, entries(pages), "page_id", "url", "fetched_on")
    return found.select("page_id", "fetched_on", "host", "blocked", "n_active", F.array_join("active", "|").alias("active"))


SQL = r"""
WITH p AS (
  SELECT page_id, url, lower(trim(url)) AS low, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_on,
         coalesce(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host
  FROM pages
), h AS (SELECT DISTINCT host, md5(host) AS m FROM p WHERE host <> ''),
l AS (
  SELECT host, 16 * (strpos('0123456789abcdef', substr(m, 2, 1)) - 1) + strpos('0123456789abcdef', substr(m, 3, 1)) - 1 AS n,
         strpos('0123456789abcdef', substr(m, 4, 1)) - 1 < 8 AS more
  FROM h WHERE strpos('0123456789abcdef', substr(m, 1, 1)) - 1 < 4
), e AS (
  SELECT 'domain' AS kind, host AS pattern, n + k AS n, action
  FROM l, (VALUES (0, 'add', false), (10, 'add', false), (60, 'remove', false), (200, 'add', true)) d(k, action, only_more)
  WHERE NOT only_more OR more
  UNION ALL SELECT DISTINCT 'url', low, 100, 'add' FROM p WHERE substr(md5(low), 1, 2) = '00'
  UNION ALL VALUES ('domain', 'example.org', 300, 'add'), ('domain', 'example.net', 300, 'add'), ('domain', 'example.net', 330, 'remove')
), s AS (
  SELECT kind, pattern, DATE '2024-01-01' + CAST(n AS INTEGER) AS since, bool_or(action = 'add') AS is_on FROM e GROUP BY ALL
), t AS (
  SELECT *, coalesce(lag(is_on) OVER w, false) AS was FROM s WINDOW w AS (PARTITION BY kind, pattern ORDER BY since)
), v AS (
  SELECT kind, pattern, since AS valid_from, lead(since) OVER (PARTITION BY kind, pattern ORDER BY since) AS valid_to, is_on
  FROM t WHERE is_on <> was
), hits AS (
  SELECT p.page_id, p.url, v.pattern FROM p JOIN v ON v.is_on AND v.valid_from <= p.fetched_on AND (v.valid_to IS NULL OR p.fetched_on < v.valid_to)
   AND ((v.kind = 'domain' AND p.host <> '' AND (p.host = v.pattern OR ends_with(p.host, '.' || v.pattern))) OR (v.kind = 'url' AND p.low = v.pattern))
), a AS (SELECT page_id, url, string_agg(DISTINCT pattern, '|' ORDER BY pattern) AS active, count(DISTINCT pattern) AS n FROM hits GROUP BY ALL)
SELECT p.page_id, p.fetched_on, p.host, a.n IS NOT NULL AS blocked, coalesce(a.n, 0) AS n_active, coalesce(a.active, '') AS active
FROM p LEFT JOIN a ON p.page_id = a.page_id AND p.url IS NOT DISTINCT FROM a.url
"""
