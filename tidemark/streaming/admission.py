"""Streaming forms of admission: event-time windows, late rows kept apart, repeats dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A trade date's window opens at 15:30 of the day before, wall clock read as UTC.
OPENS = "15 hours 30 minutes"


def daily_windows(events: DataFrame, ts: str, key: str, delay: str = "1 hour", opens: str = OPENS) -> DataFrame:
    """Events per window and key, each event id once; a window is emitted when the watermark has passed it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    once = timed.dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(ts, "1 day", "1 day", opens).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(F.to_date("w.end").alias("trade_date"), "n_events")


def admit(batch: DataFrame, ts: str, start: Column, cut: Column, admitted: Callable[[DataFrame], None], others: Callable[[DataFrame], None]) -> None:
    """A micro-batch's rows with their disposition: those inside to one sink, all others to another."""
    from tidemark.operators.news import INCLUDED, disposition

    rows = disposition(batch, ts, start, cut).persist()
    try:
        admitted(rows.where(F.col("disposition") == INCLUDED))
        others(rows.where(F.col("disposition") != INCLUDED))
    finally:
        rows.unpersist()


def upsert_sink(warehouse, name: str, *keys: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keyed upsert, so that a batch that is replayed changes nothing."""
    return lambda batch, _: warehouse.upsert(name, batch, *keys)


def run_available(result: DataFrame, folder: str) -> DataFrame:
    """Runs a streaming result over all that is there, into a Parquet table below ``folder``, which all executors share."""
    query = result.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/table")
