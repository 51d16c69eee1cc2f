"""Query op2: all documents mixed to source weights 1, 2, 3, repeating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.cube_mix import cube_mix

NAME = "op2_cube_mix"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = cube_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: A random draw; tests hold it against the totals that the method keeps.
SQL = None
