"""Episodes and records kept as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.guards import accepted_records


def read_documents(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """A row for each JSON file that the pattern names; fields that a file lacks are null. A file that doesn't parse is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(pattern)


def episodes(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The episodes below a folder by trade date, then by id."""
    return read_documents(spark, f"{folder}/*.json", schema).orderBy("trade_date", "episode_id")


def record_lines(spark: SparkSession, pattern: str, schema: T.StructType | str, manifests: DataFrame | None = None) -> DataFrame:
    """The records of JSONL files by trade date, then by id; with ``manifests`` (episode_id, accepted) only those of episodes that aren't refused."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(pattern)
    return (rows if manifests is None else accepted_records(rows, manifests)).orderBy("trade_date", "record_id")


def by_ids(records: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """The records of a table of ids; an id that no record has gives none."""
    return records.join(ids.select(key).distinct(), key, "left_semi")


def line_counts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, n_lines): lines of each file that aren't blank."""
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.groupBy("path").agg(F.count_if(F.trim("value") != "").alias("n_lines"))
