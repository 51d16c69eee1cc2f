"""Sentences and headings of a text, with their positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that end a segment, and those of them that are line ends.
ENDS = ".?!。？！"
SPACE = r"(?U)\s"


def segments(rows: DataFrame, key: str, text: str, most: int = 240) -> DataFrame:
    """(key, segment, char_start, char_end, text_sha256, excerpt): sentences and lines without white space around them, numbered from 1.

    Positions count characters from 0, the end excluded. Null and blank texts have none. Rows that repeat a key are texts of their own, each numbered from 1.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)[^{ENDS}\r\n]*[{ENDS}\r\n]|[^{ENDS}\r\n]+$"), F.lit(0))
    each = rows.select(key, F.monotonically_increasing_id().alias("_row"), F.col(text)).select(key, "_row", F.posexplode(pieces).alias("_n", "_raw"))
    before = F.coalesce(F.sum(F.char_length("_raw")).over(Window.partitionBy("_row").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("_at", before).withColumn("_left", F.regexp_replace("_raw", f"^{SPACE}+", "")).withColumn("_body", F.regexp_replace("_left", f"{SPACE}+$", "")).where("_body <> ''")
    start = (F.col("_at") + F.char_length("_raw") - F.char_length("_left")).cast("long")
    number = F.row_number().over(Window.partitionBy("_row").orderBy("_n"))
    return each.select(key, number.alias("segment"), start.alias("char_start"), (start + F.char_length("_body")).alias("char_end"), F.sha2(F.col("_body").cast("binary"), 256).alias("text_sha256"), F.substring("_body", 1, most).alias("excerpt"))


def heading_report(text: Column, headings: tuple[str, ...]) -> dict[str, Column]:
    """Of the headings asked for: how many are there, which are missing, which have no body, whether they come in order, and whether all is well."""
    at = [F.locate(h, text) for h in headings]
    found = F.filter(F.array(*at), lambda p: p > 0)
    names = lambda flags: F.array_compact(F.array(*[F.when(f, F.lit(h)) for h, f in zip(headings, flags, strict=True)]))

    def body(h: str, p: Column) -> Column:
        after = F.array_min(F.filter(found, lambda q: q > p))
        start = p + len(h)
        return F.trim(F.regexp_replace(F.substring(text, start, F.coalesce(after, F.char_length(text) + 1) - start), r"\s+", " "))

    missing = names([p == 0 for p in at])
    empty = names([(p > 0) & (body(h, p) == "") for h, p in zip(headings, at, strict=True)])
    ordered = found == F.array_sort(found)
    return {"present": F.size(found), "missing": missing, "empty": empty, "ordered": ordered, "passed": (F.size(missing) == 0) & (F.size(empty) == 0) & ordered}
