"""Research bundles: Markdown files with front matter and named blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word before :BEGIN and :END in the comments around a block; callers pass the one of their files.
MARKER = "BUNDLE"
FENCE = r"(?s)^\s*```[a-zA-Z]*\n(.*?)\n?```\s*$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def front_matter(texts: DataFrame) -> DataFrame:
    """(path, key, value) of the fenced header; quotes are dropped."""
    head = F.regexp_extract("text", r"(?s)\A\s*---\n(.*?)\n---", 1)
    line = texts.select("path", F.explode(F.split(head, "\n")).alias("line")).where(F.col("line").contains(":"))
    value = F.btrim(F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)), F.lit("\"'"))
    return line.select("path", F.trim(F.substring_index("line", ":", 1)).alias("key"), value.alias("value"))


def _block(marker: str) -> str:
    return rf"(?s)<!--\s*{marker}:BEGIN\s+(\S+)\s*-->(.*?)<!--\s*{marker}:END\s+\1\s*-->"


def blocks(texts: DataFrame, marker: str = MARKER) -> DataFrame:
    """(path, position, block, payload, sha256) of the blocks in order; a code fence around a payload is dropped."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(_block(marker)), 1).alias("block"), F.regexp_extract_all("text", F.lit(_block(marker)), 2).alias("payload"))
    rows = texts.select("path", F.posexplode(pairs).alias("position", "b")).select("path", "position", F.col("b.block").alias("block"), F.trim(F.col("b.payload")).alias("raw"))
    payload = F.when(F.col("raw").rlike(FENCE), F.regexp_extract("raw", FENCE, 1)).otherwise(F.btrim("raw", F.lit("\n")))
    return rows.withColumn("payload", payload).withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256)).drop("raw")


def block_errors(texts: DataFrame, marker: str = MARKER) -> DataFrame:
    """(path, block, error): blocks that begin twice or never end."""
    begun = texts.select("path", "text", F.explode(F.regexp_extract_all("text", F.lit(rf"{marker}:BEGIN\s+(\S+)"), 1)).alias("block"))
    counts = begun.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    ended = F.array_contains(F.regexp_extract_all("text", F.lit(rf"{marker}:END\s+(\S+)"), 1), F.col("block"))
    error = F.when(F.col("n") > 1, "duplicate_begin").when(~ended, "missing_end")
    return counts.select("path", "block", error.alias("error")).where("error is not null")


def json_lines(blocks_: DataFrame) -> DataFrame:
    """(path, block, line, payload, valid) of the non-empty lines of JSONL blocks, numbered from 1; a row must be an object."""
    lines = F.filter(F.split("payload", "\n"), lambda x: F.trim(x) != "")
    rows = blocks_.where(F.col("block").endswith(".jsonl")).select("path", "block", F.posexplode(lines).alias("at", "payload"))
    return rows.select("path", "block", (F.col("at") + 1).alias("line"), "payload", F.json_object_keys("payload").isNotNull().alias("valid"))
