"""Query op7: near duplicates of documents by five-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shingle_join import shingle_classes

NAME = "op7_shingle_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of a self-join are too slow on whole tables; tests hold it against them on small ones.
SQL = None
