"""Query op10: documents without the lines that others repeat, fuzzily, before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.line_dedup import dedup_lines

NAME = "op10_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: MinHash bands and components are not a SQL query; tests hold it against exact Jaccard of all pairs.
SQL = None
