"""Admission with reasons, defaults for what is missing, and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import scope_reason

#: Names that stand for no company, tickers that stand for none, the dimensions of a candidate's verification that need a ticker, record types of negative evidence.
GENERIC_NAMES = ("BENEFICIARY_DISCOVERY_REQUIRED", "D_MINUS_ONE_LEADER_REVIEW", "UNVERIFIED_ENTITY")
NO_TICKER = ("UNKNOWN", "UNVERIFIED")
TICKER_DIMENSION, EXPANSION = "listed_security_and_exact_ticker", "candidate_expansion"
NEGATIVE_TYPES = ("candidate_generation_error_case", "candidate_ranking_error_case", "row_disposition_error_case", "entity_resolution_error_case", "counterexample")


def web_reason(published_at: Column, verified: Column, cut: Column) -> Column:
    """Why a search result is left out; null if it stays. A verified time decides, whatever it is."""
    late = F.when(published_at > cut, "published_after_cutoff").otherwise("timestamp_verification_failed")
    return F.when(published_at.isNull(), "missing_published_at").when(~F.coalesce(verified, F.lit(False)), late)


def openable(asked: DataFrame, accepted: DataFrame, url: str) -> DataFrame:
    """``asked`` with whether its url is one that a search accepted."""
    known = accepted.select(url).distinct().withColumn("may_open", F.lit(True))
    return asked.join(known, url, "left").withColumn("may_open", F.coalesce("may_open", F.lit(False)))


def memory_reason(line: Column, cut: Column) -> Column:
    """Why a line of market memory is left out: it doesn't parse, is no object, or its times say so; null if it stays."""
    kind = F.schema_of_variant(F.try_parse_json(line))
    scope = scope_reason(F.get_json_object(line, "$.available_from"), F.get_json_object(line, "$.known_at"), cut)
    return F.when(kind.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "non_object").otherwise(scope)


def by_precedence(rows: DataFrame, key: str, status: str, order: tuple[str, ...] = ("accepted", "rejected", "episode")) -> DataFrame:
    """One row of each key: that of the first status in ``order``; a status outside it comes last."""
    place = F.coalesce(*[F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    w = Window.partitionBy(key).orderBy(place, status)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def accepted_records(records: DataFrame, manifests: DataFrame, episode: str = "episode_id", accepted: str = "accepted") -> DataFrame:
    """Records of episodes whose manifest does not say false; an episode without a manifest counts as accepted."""
    return records.join(manifests.where(F.col(accepted) == F.lit(False)).select(episode).distinct(), episode, "left_anti")


def real_company(name: Column) -> Column:
    """Whether a candidate's company name is one."""
    clean = F.coalesce(F.trim(name), F.lit(""))
    return (clean != "") & ~clean.isin(*GENERIC_NAMES)


def snapshot_status(subjects: DataFrame, snapshots: DataFrame, skipped: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Each subject with (status, reason) of its last snapshot: no ticker, no real one, found, skipped, not collected, in that order."""
    clean = F.upper(F.trim(F.coalesce(F.col(ticker), F.lit(""))))
    norm = lambda d: F.upper(F.trim(F.coalesce(d[ticker], F.lit(""))))
    found = snapshots.select(norm(snapshots).alias("_t")).distinct().withColumn("_found", F.lit(True))
    why = skipped.select(norm(skipped).alias("_t"), "reason").groupBy("_t").agg(F.min("reason").alias("_why"), F.lit(True).alias("_skipped"))
    rows = subjects.withColumn("_t", clean).join(found, "_t", "left").join(why, "_t", "left")
    reason = (
        F.when(F.col("_t") == "", "ticker_not_resolved_for_candidate_discovery").when(F.col("_t").isin(*NO_TICKER), "ticker_not_verified").when(F.col("_found"), F.lit(None))
        .when(F.col("_skipped"), F.coalesce(F.nullif("_why", F.lit("")), F.lit("unknown"))).otherwise("d_minus_one_snapshot_not_collected_for_subject")
    )
    status = F.when(reason.isNull(), "snapshot").otherwise("unavailable")
    return rows.withColumns({"status": status, "reason": reason}).drop("_t", "_found", "_why", "_skipped")


def dimension_status(subjects: DataFrame, dimensions: tuple[str, ...], n_sources: str = "n_sources", kind: str = "subject_type", ticker: str = "ticker") -> DataFrame:
    """A row for each subject and dimension with its status. The dimensions are a fixed, short list."""
    rows = subjects.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
    lost = (F.col("dimension") == TICKER_DIMENSION) & (F.col(kind) == EXPANSION) & (F.coalesce(F.col(ticker), F.lit("")) == "")
    return rows.withColumn("status", F.when(F.coalesce(F.col(n_sources), F.lit(0)) == 0, "no_cutoff_safe_source").when(lost, "needs_company_discovery").otherwise("source_collected"))


def sources_of_subjects(subjects: DataFrame, sources: DataFrame, keys: list[str], source: str = "source_id", accepted: str = "accepted") -> DataFrame:
    """Each subject with the number of its accepted and of its excluded sources; keys may be null on both sides. Repeated source ids count once."""
    counts = sources.groupBy(*keys).agg(*[F.count_distinct(F.when(F.col(accepted) == F.lit(flag), F.col(source))).alias(name) for flag, name in ((True, "n_accepted"), (False, "n_excluded"))])
    other = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "n_accepted", "n_excluded")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return subjects.join(other, same, "left").drop(*[f"_{k}" for k in keys]).fillna(0, ["n_accepted", "n_excluded"])


def with_defaults(rows: DataFrame, findings: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Each row with its finding, or the defaults where there is none; ``is_default`` tells which."""
    found = findings.select(key, *defaults, F.lit(True).alias("_own"))
    own = F.coalesce("_own", F.lit(False))
    out = rows.join(found, key, "left")
    return out.select(*rows.columns, *[F.when(own, F.col(c)).otherwise(d).alias(c) for c, d in defaults.items()], (~own).alias("is_default"))


def used_or_first(items: DataFrame, used: DataFrame, group: str, key: str, position: str) -> DataFrame:
    """Of each group the items that are used, by position; of a group without any, its first item."""
    marked = items.join(used.select(key).distinct().withColumn("_used", F.lit(True)), key, "left").withColumn("_used", F.coalesce("_used", F.lit(False)))
    w = Window.partitionBy(group)
    return marked.withColumns({"_any": F.max("_used").over(w), "_first": F.min(position).over(w)}).where("_used or (not _any and " + position + " = _first)").drop("_used", "_any", "_first")


def all_true(rows: DataFrame, flag: Column, *keys: str) -> DataFrame:
    """Whether the flag holds in every row of a group; null does not hold."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(flag, F.lit(False))).alias("all_true"), F.count(F.lit(1)).alias("n"))


def rollup_counters(rows: DataFrame, counters: str, latest: str, *keys: str) -> DataFrame:
    """Counters (a map) summed name by name within each group, with the latest time of the group's rows."""
    last = rows.groupBy(*keys).agg(F.max(latest).alias("latest"))
    sums = rows.select(*keys, F.explode(counters).alias("counter", "n")).groupBy(*keys, "counter").agg(F.sum("n").alias("n"))
    return sums.join(last, list(keys))


def evidence_counts(record_type: Column) -> list[Column]:
    """Positive, negative and near-miss cases of a record: 0 or 1 each."""
    bad = F.coalesce(record_type.isin(*NEGATIVE_TYPES), F.lit(False)).cast("int")
    return [(1 - bad).alias("positive_case_count"), bad.alias("negative_case_count"), bad.alias("near_miss_count")]


def union_ids(*frames: DataFrame) -> DataFrame:
    """The distinct values of single-column frames, nulls and blanks left out."""
    name = frames[0].columns[0]
    out = reduce(DataFrame.union, [f.select(F.col(f.columns[0]).alias(name)) for f in frames])
    return out.where(F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) != "").distinct()


def in_order_of(rows: DataFrame, positions: DataFrame, key: str, position: str, *ties: str) -> DataFrame:
    """Rows with the place of their key in another table, those without one last; ``order_key`` sorts them."""
    out = rows.join(positions.select(key, F.col(position).alias("_p")), key, "left")
    return out.withColumn("order_key", F.struct(F.col("_p").isNull().alias("none"), F.col("_p").alias("place"), *ties)).drop("_p")
