"""A corpus from raw documents to token ids: language, lines, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import encode
from tidemark.llm.common import ROW, Scratch, fresh
from tidemark.llm.cube_mix import cube_mix
from tidemark.llm.language_id import accepted, detect, fit
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.shingle_join import shingle_classes
from tidemark.llm.vocabularies import content

#: Score under which a text is in none of the languages learned; natural text scores 0.38 and more on the test tables.
LEAST_SCORE = 0.25
RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of a table of ids that is broadcast at most, and of one id in it.
BROADCAST, ENTRY = 32 << 20, 64


#: Rows and bytes that Spark hands to a Python worker at once: what an executor holds outside its heap grows with both. Rows that it reads from Parquet
#: at once: rows of scratch tables have up to some 100 KB each.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "256"}


def _may_broadcast(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() * ENTRY <= BROADCAST else ids


def _small_batches(spark: SparkSession) -> None:
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Null and empty texts, texts without a letter and texts far from every profile go.

    Texts are read whole, however long. Rows that repeat a doc_id, or have none, are judged each by its own text; a null lang teaches nothing. An
    empty table, or one without any lang, gives none. Other columns stay, whatever their names.
    """
    _small_batches(spark)
    names = fresh(docs, "lang", "score")
    found = detect(docs, fit(docs), names=tuple(names))
    return found.where(accepted(F.col(names[0]), F.col(names[1]), LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines one stays; n_chars follows. Documents of which no line stays go.

    Null, empty and blank texts have no line and stay as they are. Rows that repeat a doc_id, or have none, are documents of their own; of
    rows that repeat doc_id and text one keeps its lines. An empty table gives none. Other columns stay, whatever their names.
    """
    _small_batches(spark)
    had, kept = fresh(docs, "lines", "kept")
    left = dedup_lines(docs, counts=(had, kept)).where((F.col(kept) > 0) | (F.col(had) == 0))
    return left.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike the one with the smallest doc_id stays, one without a doc_id only if none has one; of rows that repeat a doc_id and its text, one.

    Rows that share a doc_id are compared each by its own text. Null, empty and blank texts are alike to nothing: of those that repeat a
    doc_id and its text one stays, and all without a doc_id. Texts are read whole; an empty table gives none; other columns stay, but for ROW's name any may be there.
    """
    _small_batches(spark)
    scratch = Scratch(spark, "near")
    rows = scratch.numbered(docs)
    classes = scratch.save(shingle_classes(rows, ROW), "classes")
    named = scratch.save(rows.select(ROW, "doc_id").join(classes, ROW), "named")
    first = F.min(F.struct(F.isnull("doc_id").alias("bare"), "doc_id", ROW))
    stays = named.where("n_shingles > 0").groupBy("component_id").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stays = scratch.save(stays.select("component_id", F.col(f"first.{ROW}").alias("stays")), "stays")
    gone = named.where("n_shingles > 0").join(_may_broadcast(stays), "component_id").where(F.col(ROW) != F.col("stays")).select(ROW)
    # Texts without a word have no set.
    bare = rows.select(ROW, "text").join(named.where("n_shingles = 0 and doc_id is not null").select(ROW, "doc_id"), ROW)
    bare = bare.withColumn("stays", F.min(ROW).over(Window.partitionBy("doc_id", "text"))).where(F.col(ROW) != F.col("stays"))
    gone = scratch.save(gone.unionByName(bare.select(ROW)), "gone")
    return rows.join(_may_broadcast(gone), ROW, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its sources takes it: not at all, or up to three times as equal rows.

    Rows that repeat a doc_id, or have none, are documents of their own. Null and wordless texts have size 0 and are not taken; a null source is a
    source. An empty table gives none. Other columns stay, but for ROW's name any may be there.
    """
    _small_batches(spark)
    scratch = Scratch(spark, "mixed")
    rows = scratch.numbered(docs)
    key, copies, copy = fresh(rows, "key", "copies", "copy")
    mixed = cube_mix(rows, key_col=ROW).where("copies > 0")
    mixed = scratch.save(mixed.select(F.col(ROW).alias(key), F.col("copies").alias(copies)), "copies")
    taken = rows.join(_may_broadcast(mixed), F.col(ROW) == F.col(key))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the bytes that they decode to; a row for each row.

    Null and empty texts have no ids. Texts are read whole; an empty table gives none; other columns go.
    """
    _small_batches(spark)
    both = encode(docs.select("doc_id", "source", "lang", "text"), content(RANKS), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", languages), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Profiles, MinHash, components, sampling and merges are no SQL query; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
