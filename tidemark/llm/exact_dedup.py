"""Exact deduplication: 128-bit content hash, byte comparison inside groups, one row stays.

DataFrame operations only. Hashes travel without texts; the text of a row is shuffled only if another row has the same
hash. The table of repeated hashes is broadcast while its counted size is below ``broadcast_bytes`` and joined by
sort-merge, where adaptive execution splits hot hashes, beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, ascii_lower

#: Bytes that one repeated hash takes in a broadcast: hash, id and overhead.
ENTRY_BYTES = 96


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal when their bytes are, after lower-casing A-Z where ``fold_case``. Of equal
    texts the row with the smallest id stays (``keep="max"``: the largest); a null id never stays beside another. Rows
    that repeat an id and a text are all counted, and all of them have the kept id. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    best = F.min if keep == "min" else F.max
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.select(F.col(id_col).alias("id"), (ascii_lower(text) if fold_case else text).alias("body"))
    norm = norm.withColumn("h", F.unhex(F.md5(F.col("body").cast("binary"))))
    thin = scratch.save(norm.select("id", "h", F.sha2(F.col("body").cast("binary"), 256).alias("sha")), "hashes")
    groups = thin.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("id").alias("first_id")).where("n > 1").select("h", "first_id")
    groups = scratch.save(groups, "repeated")
    small = groups.count() * ENTRY_BYTES <= broadcast_bytes

    # Bytes are compared with those of the row that stays; rows that differ form classes of their own by whole text.
    bodies = scratch.save(norm.join(F.broadcast(groups) if small else groups, "h"), "bodies")
    firsts = bodies.where(F.col("id").eqNullSafe(F.col("first_id"))).select("h", F.col("body").alias("first_body")).dropDuplicates(["h"])
    firsts = scratch.save(firsts, "firsts")
    differs = F.when(F.col("body") == F.col("first_body"), F.lit("")).otherwise(F.concat(F.lit("x"), F.col("body")))
    classed = bodies.join(firsts, "h").select("id", "h", differs.alias("class"), F.sha2(F.col("body").cast("binary"), 256).alias("sha"))
    classed = scratch.save(classed, "classed")
    scratch.drop("bodies", "firsts")
    totals = classed.groupBy("h", "class").agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id"))
    totals = scratch.save(totals, "totals")

    repeated = classed.join(totals, ["h", "class"]).select("id", "keep_id", "group_size", "sha")
    single = thin.join(groups, "h", "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return single.unionByName(repeated).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
