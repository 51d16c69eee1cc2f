"""Positions, shards and budgets over ordered rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.stages import Stages

#: Rows of a range of ``before``.
RANGE_ROWS = 1 << 20


def with_position(rows: DataFrame, bucket: Column, *order, name: str = "position") -> DataFrame:
    """Rows numbered from 1 in the order (bucket, order). ``bucket`` must not fall along the order; it deals the rows to tasks.

    Only one row per bucket meets in the window that adds up what stands before.
    """
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_bucket", before.alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return own.join(starts, "_bucket").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_bucket", "_own", "_before", "_n")


def before(rows: DataFrame, order: list[Column], sums: dict[str, Column], stages: Stages, name: str) -> DataFrame:
    """``rows`` with a column for each of ``sums``: what the rows before it, in one order of the whole table, add up to; 0 for the first.

    Rows are dealt by ranges of the order, of RANGE_ROWS as counted, and written; one row for each range meets in the window over ranges. Rows that are equal in the order
    go to one range, one after the other in any order: give it enough columns that only few are. Nulls of a sum count as 0; an empty table stays empty.
    """
    spark = rows.sparkSession
    rows = stages.save(rows, f"{name}_rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    ranged = stages.save(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)
    stages.drop(f"{name}_rows")
    zero = {c: F.coalesce(x, F.lit(0)) for c, x in sums.items()}
    whole = ranged.groupBy("_range").agg(*[F.sum(x).alias(f"{c}_whole") for c, x in zero.items()])
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_range", *[F.coalesce(F.sum(f"{c}_whole").over(lower), F.lit(0)).alias(f"{c}_start") for c in sums])
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(x).over(inner), F.lit(0)).alias(f"{c}_own") for c, x in zero.items()])
    return own.join(starts, "_range").select(*rows.columns, *[(F.col(f"{c}_start") + F.col(f"{c}_own")).alias(c) for c in sums])


def shards(rows: DataFrame, size: int, bucket: Column, *order) -> DataFrame:
    """Shards of ``size`` rows, numbered from 1."""
    return with_position(rows, bucket, *order).withColumn("shard", (F.floor((F.col("position") - 1) / size) + 1).cast("long"))


def shard_hashes(sharded: DataFrame, content: Column) -> DataFrame:
    """One hash per shard over its rows in order; a shard is of fixed size."""
    lines = F.array_sort(F.collect_list(F.struct("position", content.alias("x"))))
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), lines.alias("_l")).select("shard", "n_rows", F.sha2(F.array_join(F.transform("_l", lambda r: r["x"]), "\n").cast("binary"), 256).alias("shard_sha"))


def pack_greedy(rows: DataFrame, budget: int, cost: str, order: str, *by: str) -> DataFrame:
    """Rows of each group with ``packed``: in order, each is taken if it still fits; a row that doesn't is skipped and the scan goes on.

    No running sum can tell this. Rows dearer than the budget never fit and leave first; of a group only (order, cost)
    meets in one row, so a group is one pack's candidates, not a corpus.
    """
    step = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("took"))

    def fold(state, row):
        fits = state["used"] + row["cost"] <= budget
        return F.when(fits, F.struct((state["used"] + row["cost"]).alias("used"), F.concat(state["took"], F.array(row["at"])).alias("took"))).otherwise(state)

    fitting = rows.where(F.col(cost) <= budget)
    groups = fitting.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col(cost).cast("long").alias("cost")))).alias("_r"))
    took = groups.select(*by, F.explode(F.aggregate("_r", step, fold)["took"]).alias(order)).withColumn("packed", F.lit(True))
    return rows.join(took, [*by, order], "left").withColumn("packed", F.coalesce("packed", F.lit(False)))


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, where it first stands."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def sweep(rows: DataFrame, flags: dict[str, Column], *by: str) -> DataFrame:
    """Counts of each named bucket by shard."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def reuse(planned: DataFrame, cached: DataFrame, *fields: str) -> tuple[DataFrame, DataFrame]:
    """Planned shards that the cache has with every field equal, and those to compute."""
    held = cached.select(*fields).distinct()
    return planned.join(held, list(fields), "left_semi"), planned.join(held, list(fields), "left_anti")
