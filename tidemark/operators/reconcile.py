"""Set, multiset and key reconciliation between two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity_delta(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """(keys, status): identities missing from ``actual`` or extra in it."""
    want, have = (d.select(*keys).distinct() for d in (expected, actual))
    missing = want.join(have, list(keys), "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(have.join(want, list(keys), "left_anti").withColumn("status", F.lit("extra")))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def multiset_delta(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_expected, n_actual) where the two counts differ: EXCEPT ALL both ways, in one shuffle."""
    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("a")))
    return both.groupBy(*keys).agg(F.sum("e").alias("n_expected"), F.sum("a").alias("n_actual")).where("n_expected <> n_actual")


def multisets_equal(a: DataFrame, b: DataFrame, *keys: str) -> bool:
    return multiset_delta(a, b, *keys).isEmpty()


def closure(references: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """References that the known ids lack."""
    return references.join(known.select(*keys).distinct(), list(keys), "left_anti").distinct()


def closure_by_reference(references: DataFrame, known: DataFrame, owner: str, *keys: str) -> DataFrame:
    """Each missing reference with its owners in order."""
    gone = references.join(known.select(*keys).distinct(), list(keys), "left_anti")
    return gone.groupBy(*keys).agg(F.sort_array(F.collect_set(owner)).alias("owners"))


def conflicts(a: DataFrame, b: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys that both tables have with different values."""
    left = a.select(key, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(key, *[F.col(v).alias(f"{v}_b") for v in values])
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b"))
    return left.join(right, key).where(differ)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, status) of keys that were added, removed or changed."""
    b, a = (d.select(key, content.alias(n)) for d, n in ((before, "old"), (after, "new")))
    b, a = b.withColumn("in_old", F.lit(True)), a.withColumn("in_new", F.lit(True))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return b.join(a, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def upsert(base: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``base`` whose key does not come in, and all that comes in."""
    return base.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def enrich(rows: DataFrame, lookup: DataFrame, key: str, position: str, *columns: str) -> DataFrame:
    """``rows`` with columns of the last lookup row of their key; nulls where there is none."""
    last = lookup.groupBy(key).agg(*[F.max_by(c, position).alias(c) for c in columns])
    return rows.join(last, key, "left")


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_value_first_position(rows: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """(key, position, value): where a key first stands, with the value that it has last."""
    return rows.groupBy(key).agg(F.min(position).alias(position), F.max_by(value, position).alias(value))


def expectation_conflicts(declared: DataFrame, actual: DataFrame, key: str = "block") -> DataFrame:
    """Blocks whose hash is not the declared one of the highest priority, or that are declared differently."""
    top = declared.groupBy(key).agg(F.min_by("sha256", "priority").alias("declared"), F.count_distinct("sha256").alias("n_declared"))
    joined = top.join(actual.select(key, F.col("sha256").alias("found")), key)
    return joined.withColumn("mismatch", ~F.col("declared").eqNullSafe(F.col("found"))).withColumn("conflict", F.col("n_declared") > 1).where("mismatch or conflict")
