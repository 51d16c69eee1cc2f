"""Training exports, preference pairs and category counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import truthy


def _listed(rows: DataFrame, group: str, key: str, name: str, size: int) -> DataFrame:
    """Lists of about ``size`` keys of each group."""
    rows = rows.where(F.col(group).isNotNull()).select(group, F.struct(F.col(key).alias("k")).alias("_x"))
    parts = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    dealt = rows.join(parts, group).withColumn("_part", F.pmod(F.xxhash64("_x"), F.col("_parts")))
    return dealt.groupBy(group, "_part").agg(F.collect_list("_x").alias(name)).withColumnRenamed("_part", f"{name}_part")


def preference_pairs(rows: DataFrame, group: str, key: str, good: Column, bad: Column, size: int = 256) -> DataFrame:
    """Every good row of a group with every bad one. All pairs are the feature: the groups are episodes.

    Lists of ``size`` keys meet, not rows, and the pairs of lists are dealt out before they are written as pairs of rows, so that a large group is many tasks' work.
    """
    better, worse = _listed(rows.where(good), group, key, "_good", size), _listed(rows.where(bad), group, key, "_bad", size)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = better.join(worse, group).repartition(parts, F.xxhash64(group, "_good_part", "_bad_part"))
    return met.select(group, F.explode("_good").alias("_g"), "_bad").select(group, F.col("_g.k").alias("chosen"), F.explode("_bad").alias("_b")).select(group, "chosen", F.col("_b.k").alias("rejected"))


def sealed_pair(winner: Sequence[Column], loser: Sequence[Column]) -> Column:
    """Both sides name someone."""
    return truthy(*winner).isNotNull() & truthy(*loser).isNotNull()


def export(records: DataFrame, kinds: dict[str, Sequence[str]], type_col: str, eligible: Column, sealed: Column, needs_seal: Sequence[str] = ("preference",)) -> tuple[DataFrame, DataFrame]:
    """Rows of each export kind, and what was skipped with the first reason."""
    table = F.create_map(*[x for k, types in kinds.items() for t in types for x in (F.lit(t), F.lit(k))])
    marked = records.withColumn("export_kind", table[F.col(type_col)])
    reason = F.when(~F.coalesce(eligible, F.lit(False)), "not_training_eligible").when(F.col("export_kind").isNull(), "no_export_kind").when(F.col("export_kind").isin(*needs_seal) & ~F.coalesce(sealed, F.lit(False)), "pair_not_sealed")
    marked = marked.withColumn("skip_reason", reason)
    return marked.where("skip_reason is null").drop("skip_reason"), marked.where("skip_reason is not null")


def zero_filled(rows: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Counts of each required category, 0 where there is none."""
    required = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(categories)], f"position int, {column} string")
    counts = rows.where(F.col(column).isin(*categories)).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return required.join(counts, column, "left").select("position", column, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def with_fallback(plan: DataFrame, required: Sequence[str], fallback: str = "{} evidence") -> DataFrame:
    """Query plan rows (category, query), distinct and with white space collapsed, plus a query for each category that lacks one."""
    clean = plan.select("category", F.trim(F.regexp_replace("query", r"\s+", " ")).alias("query")).where("query <> ''").distinct()
    order = plan.sparkSession.createDataFrame([(i, c, fallback.format(c)) for i, c in enumerate(required)], "position int, category string, fallback string")
    return order.join(clean, "category", "left").select("position", "category", F.coalesce("query", "fallback").alias("query")).orderBy("position", "query")


def keyed_or_contained(left: DataFrame, right: DataFrame, key: str, right_key: str, order: str, needle: Column, haystack: Column) -> DataFrame:
    """The right row whose key is equal, else the first, in order, whose text contains the left's. Only rows without an equal key are searched, of a repeated key one.

    Texts are cut into their pieces of the lengths that are searched for, so that containing is an equality: no row is held against all others. Rows grow with characters times different lengths.
    """
    exact = left.join(right, left[key] == right[right_key], "left_semi").join(right, F.col(key) == F.col(right_key))
    rest = left.join(right.select(F.col(right_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").dropDuplicates([key]).withColumn("_piece", needle)
    asked = rest.where("_piece is not null").select("_piece").distinct()
    lengths = asked.select(F.char_length("_piece").alias("_length")).distinct()
    long = F.char_length("_text")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(long - F.col("_length") + 1, F.lit(1))), lambda at: F.substring(F.col("_text"), at, F.col("_length")))
    parts = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file makes many pieces
    texts = right.repartition(parts).select(F.struct(F.col(order).alias("_order"), F.struct(*right.columns).alias("_row")).alias("_held"), haystack.alias("_text"))
    pieces = texts.join(F.broadcast(lengths), long >= F.col("_length")).select("_held", F.explode(F.array_distinct(cut)).alias("_piece"))
    best = pieces.join(asked, "_piece", "left_semi").groupBy("_piece").agg(F.min("_held")["_row"].alias("_row"))
    first = rest.join(best, "_piece", "left").select(*left.columns, "_row.*")
    return exact.withColumn("match", F.lit("exact")).unionByName(first.withColumn("match", F.when(F.col(right_key).isNotNull(), F.lit("contained"))))


def merge_findings(candidates: DataFrame, findings: DataFrame, position: str) -> DataFrame:
    """Candidates with the last finding of their rank; its flags are appended, each once."""
    last = findings.groupBy("rank").agg(F.max_by("flags", position).alias("_more"))
    empty = F.array().cast("array<string>")
    merged = F.array_distinct(F.concat(F.coalesce("flags", empty), F.coalesce("_more", empty)))
    return candidates.join(last, "rank", "left").withColumn("flags", merged).drop("_more")
