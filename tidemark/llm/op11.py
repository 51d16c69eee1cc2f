"""Query op11: users of the shop in trailing windows, by kind of click."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.rolling_users import Measure, rolling_users

NAME = "op11_rolling_users"
MEASURES = [Measure("users_short", 15), Measure("users_middle", 180), Measure("users_long", 1440), Measure("hot_users", 1440, 2)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_users(spark.read.parquet(f"{sf_dir}/clicks.parquet"), MEASURES)


def _spans(measure: Measure) -> str:
    """Spans [lo, hi) in which a user has at least ``least`` clicks (1 or 2): from the last of so many clicks to where the first leaves the window."""
    lo, hi = "minute", f"lag(minute, {measure.least - 1}) OVER w + {measure.minutes}"
    return f"""SELECT kind, lo AS minute, 1 AS step, '{measure.name}' AS name FROM (
    SELECT kind, client_id, lo, lag(hi) OVER v AS before FROM (SELECT kind, client_id, {lo} AS lo, {hi} AS hi, n FROM clicked WINDOW w AS (PARTITION BY kind, client_id ORDER BY minute, n)) WHERE hi > lo
    WINDOW v AS (PARTITION BY kind, client_id ORDER BY lo, n)) WHERE coalesce(before <= lo, true)
  UNION ALL
  SELECT kind, hi, -1, '{measure.name}' FROM (
    SELECT kind, client_id, hi, lead(lo) OVER v AS later FROM (SELECT kind, client_id, {lo} AS lo, {hi} AS hi, n FROM clicked WINDOW w AS (PARTITION BY kind, client_id ORDER BY minute, n)) WHERE hi > lo
    WINDOW v AS (PARTITION BY kind, client_id ORDER BY lo, n)) WHERE coalesce(later >= hi, true)"""


SQL = f"""
WITH one AS (
  SELECT kind, client_id, epoch_us(ts) // 60000000 - (epoch_us(ts) % 60000000 < 0)::BIGINT AS minute
  FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ts, kind, client_id NULLS FIRST) AS k FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL)
  WHERE k = 1 OR click_id IS NULL
),
clicked AS (SELECT kind, client_id, minute, row_number() OVER (PARTITION BY kind, client_id, minute) AS n FROM one WHERE client_id IS NOT NULL),
steps AS (
  {" UNION ALL ".join(_spans(m) for m in MEASURES)}
  UNION ALL SELECT DISTINCT kind, minute, 0, 'pair' FROM one
),
summed AS (
  SELECT kind, minute, bool_or(name = 'pair') AS present, {", ".join(f"coalesce(sum(step) FILTER (name = '{m.name}'), 0) AS {m.name}" for m in MEASURES)}
  FROM steps GROUP BY kind, minute
)
SELECT kind, minute, {", ".join(f"{m.name}::BIGINT AS {m.name}" for m in MEASURES)} FROM (
  SELECT kind, minute, present, {", ".join(f"sum({m.name}) OVER w AS {m.name}" for m in MEASURES)} FROM summed WINDOW w AS (PARTITION BY kind ORDER BY minute)
) WHERE present
"""
