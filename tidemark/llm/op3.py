"""Query op3: every document scored by a language model of four fifths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold
from tidemark.llm.lm_score import score_texts

NAME = "op3_lm_score"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, fold(F.col("doc_id"), 5) != 1)


#: The weights come from EM; tests hold counts and scores against a brute-force version.
SQL = None
