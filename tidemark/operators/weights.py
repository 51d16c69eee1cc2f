"""Sample weights: checks that groups sum to one, and fractional weights that do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def sum_check(rows: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """Groups whose weights miss 1, with the sum to 12 digits. A weight that is no number counts as 0."""
    value = F.coalesce(weight.try_cast("double"), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sum(value).alias("w")).where(F.abs(F.col("w") - 1) > TOLERANCE).select(*keys, F.bround("w", 12).alias("weight_sum"))


def map_check(rows: DataFrame, weights: str) -> DataFrame:
    """Rows whose map of weights holds a null or misses 1."""
    values = F.map_values(weights)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return rows.where(F.coalesce(total.isNull() | (F.abs(total - 1) > TOLERANCE), F.lit(True)))


def repeated_keys(rows: DataFrame, policy: Column, order: str | Column, *keys: str) -> DataFrame:
    """Rows whose key was seen before them in input order, unless their own policy is fractional."""
    seen = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1
    return rows.withColumn("seen_before", seen).where(F.col("seen_before") & ~F.coalesce(policy.startswith("fractional"), F.lit(False))).drop("seen_before")


def fill_missing(rows: DataFrame, weight: str, *keys: str) -> DataFrame:
    """Missing weights share what explicit ones leave of 1. Negative weights stay, neither filled nor counted."""
    w = Window.partitionBy(*keys)
    explicit = F.coalesce(F.sum(F.when(F.col(weight) >= 0, F.col(weight))).over(w), F.lit(0.0))
    gaps = F.count_if(F.col(weight).isNull()).over(w)
    return rows.withColumn(weight, F.coalesce(F.col(weight), F.greatest(F.lit(0.0), 1 - explicit) / gaps))


def fractional(rows: DataFrame, order: list, *keys: str, digits: int = 6, name: str = "weight") -> DataFrame:
    """Equal weights of each group, rounded half to even; the last row takes what is left."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == n
    base = F.bround(1 / n, digits)
    return rows.withColumn(name, F.when(last, F.bround(1 - (n - 1) * base, digits)).otherwise(base))
