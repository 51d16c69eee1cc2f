"""Query op13: the quality of every document, learned from labelled ones among three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold
from tidemark.llm.subword_classifier import classify, fit

NAME = "op13_quality_classifier"
#: A document of so high a score counts as good.
LEAST = 0.7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: it is not held out, and has no label to learn from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = lambda: F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs, labels.where(~held_out()), "quality")
    scored = classify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, 1).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= LEAST).cast("int"))


#: Training is not a relational query; tests hold the score against a plain version of the features and held-out accuracy.
SQL = None
