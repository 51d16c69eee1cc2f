"""News CSV files: encoding fallback, header and row checks, collection times."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import at_time
from tidemark.functions.ids import stable_id
from tidemark.functions.text import clean_cell

#: Encodings in the order of trial, required columns, and where a file may hold the time of collection.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")
REQUIRED = ("date", "time", "title")
#: The market's zone and its offset, which is the same all year.
ZONE, OFFSET = "Asia/Seoul", "+09:00"
COLLECTED = ("collected_at", "collected_datetime", "retrieved_at", "crawl_at", "crawled_at", "scraped_at")
COLLECTED_DATE, COLLECTED_TIME = ("collected_date", "retrieved_date", "crawl_date"), ("collected_time", "retrieved_time", "crawl_time")


def detect_encoding(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            content.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError("file is in none of: " + ", ".join(ENCODINGS))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """One file as row_number, published_at, collected_at, title, body, event_id; rows are numbered from 1 in file order.

    A file is a day's news, parsed by one task since quoted cells may hold line breaks. Missing columns and blank required cells
    are errors that name them. A missing body is ''.
    """
    named = F.pandas_udf(lambda contents: contents.map(detect_encoding), "string")
    encoding = spark.read.format("binaryFile").load(path).select(named("content")).first()[0]
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path, encoding="UTF-8" if encoding.startswith("utf-8") else {"cp949": "MS949"}.get(encoding, encoding))
    for name in raw.columns:
        raw = raw.withColumnRenamed(name, name.lstrip("﻿").strip().lower())
    gone = sorted(c for c in REQUIRED if c not in raw.columns)
    if gone:
        raise ValueError("news file lacks columns: " + ", ".join(gone))
    rows = raw.coalesce(1).withColumn("row_number", (F.monotonically_increasing_id() + 1).cast("long"))
    cells = {c: F.coalesce(clean_cell(F.col(c)), F.lit("")) for c in raw.columns}
    blank = F.coalesce(*[F.when(cells[c] == "", F.lit(c)) for c in REQUIRED])
    bad = rows.select("row_number", blank.alias("column")).where("column is not null").orderBy("row_number").first()
    if bad:
        raise ValueError(f"row {bad['row_number']} missing required {bad['column']}")
    day = F.when(cells["date"].rlike(r"^\d{4}-\d{2}-\d{2}$"), cells["date"].try_cast("date"))
    published = at_time(day, cells["time"])
    wrong = F.when(day.isNull(), F.concat(F.lit("date: "), cells["date"])).when(published.isNull(), F.concat(F.lit("time: "), cells["time"]))
    bad = rows.select("row_number", wrong.alias("wrong")).where("wrong is not null").orderBy("row_number").first()
    if bad:
        raise ValueError(f"row {bad['row_number']} has an invalid {bad['wrong']}")
    body = cells.get("body", F.lit(""))
    out = rows.select("row_number", published.alias("published_at"), collected_at(cells).alias("collected_at"), cells["title"].alias("title"), body.alias("body"))
    stamp = F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(OFFSET))
    return out.withColumn("event_id", stable_id("EVT", F.col("title"), F.col("body"), stamp))


def collected_at(cells: dict[str, Column]) -> Column:
    """The first time that a column gives; else the first date with the first time of day, midnight without one."""
    first = lambda names: F.coalesce(*[F.nullif(cells[c], F.lit("")) for c in names if c in cells], F.lit(None).cast("string"))
    text = first(COLLECTED)
    # A time with an offset is turned into the market's wall clock.
    shifted = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz"))
    whole = F.when(text.rlike(r"([+-]\d{2}:?\d{2}|Z)$"), shifted).otherwise(text.try_cast("timestamp_ntz"))
    return F.coalesce(whole, at_time(first(COLLECTED_DATE).try_cast("date"), F.coalesce(first(COLLECTED_TIME), F.lit("00:00:00"))))


def import_name(content: bytes, trade_date: str, name: str) -> str:
    """Where a raw file is kept: the same content has the same name."""
    return f"{trade_date}_{hashlib.sha256(content).hexdigest()[:8]}_{name}"
