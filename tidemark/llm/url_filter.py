"""URL filters by a temporal list join: which list entries were active for a capture when it was fetched.

Dated list entries become validity intervals of their pattern. Distinct hosts, not captures, meet the patterns of their domains; captures
then meet the intervals of their host by an as-of condition, so that a hot host is rows of a join that adaptive execution
can split, and at most one interval of a pattern passes. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

DOMAIN, URL = "domain", "url"
#: Bytes that one interval of a host takes in a broadcast.
ENTRY_BYTES = 256


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port or final dot; '' if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, valid_from, valid_to) from entries (kind, pattern, at, action); valid_to is null while open.

    Of several entries of a pattern at one time an ``add`` counts before a ``remove``. Entries that change nothing are no
    bound; entries with a null or another action are ignored.
    """
    clean = entries.where("kind is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    state = clean.groupBy("kind", F.lower("pattern").alias("pattern"), "at").agg(F.max(F.col("action") == "add").alias("on"))
    by = Window.partitionBy("kind", "pattern").orderBy("at")
    turns = state.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(False))).where(F.col("on") != F.col("was"))
    return turns.withColumn("valid_to", F.lead("at").over(by)).where("on").select("kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def active_entries(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, at_col: str, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per capture: id, url, at, host, blocked, n_active, active (its patterns in order).

    A ``domain`` entry holds for its host and all below it, a ``url`` entry for that URL alone, letter case aside. It is active from its time
    on, until the time of its removal. A null URL or time meets nothing, a malformed URL only entries of its own.
    Rows that repeat an id are looked at each by itself; other columns are ignored, whatever their names.
    """
    scratch = Scratch(captures.sparkSession, "urls")
    seen = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("at"))
    seen = seen.withColumn("host", host_of(F.col("url")))
    valid = scratch.save(intervals(entries), "intervals")

    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = seen.select("host").where("host <> ''").distinct().select(F.col("host").alias("key"), F.explode(suffixes).alias("pattern"))
    ranges = valid.where(F.col("kind") == DOMAIN).join(hosts, "pattern").select(F.lit(DOMAIN).alias("kind"), "key", "pattern", "valid_from", "valid_to")
    exact = valid.where(F.col("kind") == URL).select("kind", F.col("pattern").alias("key"), "pattern", "valid_from", "valid_to")
    ranges = scratch.save(ranges.unionByName(exact), "ranges")
    small = ranges.count() * ENTRY_BYTES <= broadcast_bytes
    ranges = F.broadcast(ranges) if small else ranges

    during = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))

    def found(kind: str, key: Column) -> DataFrame:
        return seen.withColumn("key", key).join(ranges.where(F.col("kind") == kind), "key").where(during).select("id", "url", "at", "pattern")

    hits = found(DOMAIN, F.col("host")).unionByName(found(URL, F.lower(F.trim(F.col("url")))))
    hits = hits.groupBy("id", "url", "at").agg(F.sort_array(F.collect_set("pattern")).alias("active"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("id", "url", "at")]
    out = seen.alias("s").join(hits.alias("h"), same[0] & same[1] & same[2], "left")
    active = F.coalesce("active", F.array().cast("array<string>"))
    return out.select(F.col("s.id").alias(id_col), F.col("s.url").alias(url_col), F.col("s.at").alias(at_col), "host", (F.size(active) > 0).alias("blocked"), F.size(active).cast("long").alias("n_active"), active.alias("active"))
