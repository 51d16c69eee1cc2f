"""Query op9: token-id files of all documents, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Scratch
from tidemark.llm.token_files import crc32, read_token_files, write_token_files
from tidemark.llm.vocabularies import content

NAME = "op9_token_files"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    path = f"{scratch.base}/files"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), content("byte_bpe_50k.json"), path, scratch)
    scratch.release()
    return read_token_files(spark, path, crc32, "ids_crc32 long")


#: A file format is not a SQL query; tests hold it against the library and an exact round trip.
SQL = None
