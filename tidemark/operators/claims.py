"""Claims from lessons, and what contradicts or lacks support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import next_trading_day
from tidemark.functions.ids import stable_id


def claims_from_lessons(lessons: DataFrame, episode: str, day: Column, items: Column) -> DataFrame:
    """A claim for each lesson, available from the start of the next trading day."""
    return lessons.select(episode, F.posexplode(items).alias("position", "statement"), next_trading_day(day).alias("available_from")).withColumn("claim_id", stable_id("CLAIM", F.col(episode), F.col("position"), F.col("statement")))


def by_keyword(claims: DataFrame, categories: dict[str, list[str]], *texts: str) -> DataFrame:
    """A row for each category of which a claim has a word."""
    text = F.lower(F.concat_ws(" ", *texts))
    hit = lambda words: F.array(*[F.when(text.contains(w), F.lit(True)) for w in words])
    names = F.array_compact(F.array(*[F.when(F.size(F.array_compact(hit(w))) > 0, F.lit(c)) for c, w in categories.items()]))
    return claims.withColumn("category", F.explode(names))


def keep_first(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def merge_company(base: DataFrame, delta: DataFrame, key: list[str], lists: list[str]) -> DataFrame:
    """known_at is the earliest; lists are joined, each value once, base first."""
    empty = F.array().cast("array<string>")
    b = base.select(*key, F.col("known_at").alias("_kb"), *[F.col(x).alias(f"_b_{x}") for x in lists])
    d = delta.select(*key, F.col("known_at").alias("_kd"), *[F.col(x).alias(f"_d_{x}") for x in lists])
    joined = b.join(d, key, "full_outer")
    return joined.select(*key, F.least("_kb", "_kd").alias("known_at"), *[F.array_distinct(F.filter(F.concat(F.coalesce(f"_b_{x}", empty), F.coalesce(f"_d_{x}", empty)), lambda v: v != "")).alias(x) for x in lists])


def apply_deltas(deltas: DataFrame, cut: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deltas to apply, those of the future (skipped) and those without a valid time (errors)."""
    known = F.try_to_timestamp("known_at")
    marked = deltas.withColumn("_known", known)
    return marked.where(F.col("_known") <= cut).drop("_known"), marked.where(F.col("_known") > cut).drop("_known"), marked.where("_known is null").drop("_known")
