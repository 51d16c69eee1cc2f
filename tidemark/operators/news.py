"""Admission of dated rows to a window, and clusters of exact repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import sha256_text, stable_id
from tidemark.functions.text import cluster_text
from tidemark.operators.packing import before
from tidemark.stages import Stages

INCLUDED, LATE, EARLY = "INCLUDED", "EXCLUDED_AFTER_CUTOFF", "EXCLUDED_BEFORE_WINDOW"


def in_window(ts: Column, start: Column, cut: Column) -> Column:
    """Inclusive at both ends."""
    return ts.between(start, cut)


def disposition(rows: DataFrame, ts: str, start: Column, cut: Column) -> DataFrame:
    """Every row with what becomes of it; none is dropped."""
    kind = F.when(F.col(ts) > cut, LATE).when(F.col(ts) < start, EARLY).otherwise(INCLUDED)
    return rows.withColumn("disposition", kind)


def disposition_summary(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("disposition") == x).alias(f"n_{x.lower()}") for x in (INCLUDED, LATE, EARLY)])


def trade_date(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.max(column).alias("trade_date"))


def event_clusters(rows: DataFrame, number: str, ts: Column | None, *texts: str, cut: Column | None = None) -> DataFrame:
    """Rows whose normalised texts are equal, numbered by first appearance. Members are counted and bounded by min and max, not listed."""
    keyed = rows.withColumn("cluster_sha", sha256_text(cluster_text(*[F.col(t) for t in texts])))
    aggs = [F.min(number).alias("first_row"), F.max(number).alias("last_row"), F.count(F.lit(1)).alias("n_rows")]
    if ts is not None:
        aggs += [F.min(ts).alias("first_at"), F.max(ts).alias("last_at")]
        if cut is not None:
            aggs.append(F.max(F.when(ts <= cut, ts)).alias("last_before_cutoff"))
    return keyed.groupBy("cluster_sha").agg(*aggs).withColumn("cluster_id", stable_id("CLUSTER", F.col("cluster_sha")))


def cluster_members(rows: DataFrame, number: str, *texts: str) -> DataFrame:
    """The members of each cluster in row order, for batches small enough to list them."""
    keyed = rows.withColumn("cluster_sha", sha256_text(cluster_text(*[F.col(t) for t in texts])))
    members = keyed.groupBy("cluster_sha").agg(F.sort_array(F.collect_list(number)).alias("members"))
    numbered = before(members, [F.col("members")[0], F.col("cluster_sha")], {"cluster_index": F.lit(1)}, Stages(rows.sparkSession, "clusters"), "numbered")
    return numbered.withColumn("cluster_index", (F.col("cluster_index") + 1).cast("int"))


def cluster_rows(rows: DataFrame, number: str, *texts: str) -> DataFrame:
    """(number, cluster_sha, cluster_index, member_index, n_rows): each row with its cluster's place by first appearance and its own place in the cluster, from 1.

    No cluster is listed or meets in one task, however many rows repeat it. Clusters of one first number go by their hashes. Rows whose number is null come first in their cluster, rows that
    repeat a number in any order; a cluster without numbers comes before all others. Null texts are empty; an empty table gives no rows.
    """
    stages = Stages(rows.sparkSession, "clusters")
    keyed = stages.save(rows.select(F.col(number), sha256_text(cluster_text(*[F.col(t) for t in texts])).alias("cluster_sha")), "keyed")
    clusters = keyed.groupBy("cluster_sha").agg(F.min(number).alias("first_row"), F.count(F.lit(1)).alias("n_rows"))
    clusters = before(clusters, [F.col("first_row"), F.col("cluster_sha")], {"cluster_index": F.lit(1), "rows_before": F.col("n_rows")}, stages, "clusters")
    members = before(keyed.join(clusters.drop("first_row"), "cluster_sha"), [F.col("cluster_index"), F.col(number)], {"place": F.lit(1)}, stages, "members")
    return members.select(number, "cluster_sha", (F.col("cluster_index") + 1).alias("cluster_index"), (F.col("place") - F.col("rows_before") + 1).alias("member_index"), "n_rows")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    more = F.col("n_rows") > 1
    return clusters.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count_if(more).alias("n_repeated_clusters"), F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n_exact_repeats"), F.coalesce(F.max("n_rows"), F.lit(0)).alias("largest"))
