"""Query op4: near duplicates of embeddings within a label, cosine 0.98 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.vector_dedup import near_vectors

NAME = "op4_vector_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Projection passes and components are not a SQL query; tests hold it against all pairs.
SQL = None
