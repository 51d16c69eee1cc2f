"""Query op12: conversations damaged by a stated rule, and their cheapest repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.conversation_repair import reports

NAME = "op12_conversation_repair"


def damaged(turns: DataFrame) -> DataFrame:
    """Null roles and texts are one space. Of 20 turns, by crc32 of ``conv_id:turn``: one is dropped (``here`` is false), one emptied, one loses its
    sentence ends, one stands twice, one is the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("here"), twice.alias("_copy")).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), here=F.col("here"))


#: A search over edit sequences is not a relational query; tests hold it against brute force.
SQL = None
