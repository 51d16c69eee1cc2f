"""Query op1: the language of every document, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold
from tidemark.llm.language_id import detect, fit

NAME = "op1_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    profiles = fit(docs.where(~F.col("held_out")))
    return detect(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


#: Ranking n-grams per text is not a relational query; tests hold it against a brute-force version and held-out accuracy.
SQL = None
