"""Query op8: every document encoded by byte-level BPE, and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import encode
from tidemark.llm.vocabularies import content

NAME = "op8_byte_bpe"
RANKS = "byte_bpe_50k.tiktoken"


def digests(docs: DataFrame) -> DataFrame:
    both = encode(docs.select("doc_id", "text"), content(RANKS), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Ranked merges are not a SQL query; tests hold ids against the library and texts against their round trip.
SQL = None
