"""Lexical and vector retrieval."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import text_bigrams, text_terms
from tidemark.functions.vectors import hash_embedding


def indexed(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("terms", text_terms(F.col(text))).withColumn("vector", hash_embedding(F.col(text)))


def top_k(scored: DataFrame, k: int, query: str, key: str, score: str = "score") -> DataFrame:
    """The k best of each query, by falling score, then by id."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries that are held by a task at once; more are asked in further blocks.
BLOCK = 4096


def _best(rows: DataFrame, queries: DataFrame, query: str, key: str, k: int, own: bool, terms: bool) -> DataFrame:
    """(query, key, score): of each Arrow batch and query the k best rows, by falling score, then by key. own: a row may answer a query of its own id."""
    kind, asked = rows.schema[key].dataType, queries.schema[query].dataType
    schema = T.StructType([T.StructField(query, asked), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    names = [query, "terms", "vector"] if terms else [query, "vector"]
    listed, out = queries.select(*names).orderBy(query).toLocalIterator(prefetchPartitions=False), None
    while block := list(itertools.islice(listed, BLOCK)):
        part = rows.select(key, *names[1:]).mapInArrow(_scorer([tuple(r) for r in block], k, own, terms, query, key), schema)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _scorer(block: list[tuple], k: int, own: bool, terms: bool, query: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [b[0] for b in block], [b[-1] or [] for b in block]
        width = max(map(len, vectors), default=0)
        asked = np.array([v if len(v) == width else [0.0] * width for v in vectors], np.float64).reshape(len(block), width)
        wanted: dict[str, list[int]] = {}
        for q, words in enumerate(b[1] for b in block if terms):
            for w in words or ():
                wanted.setdefault(w, []).append(q)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                batch = batch.take(pc.sort_indices(batch.column(0)))
                score = np.zeros((len(batch), len(block)))
                if width:
                    own_vectors = [v if v is not None and len(v) == width else [0.0] * width for v in batch.column(batch.num_columns - 1).to_pylist()]
                    score += np.array(own_vectors, np.float64) @ asked.T
                if terms:
                    for row, words in enumerate(batch.column(1).to_pylist()):
                        for hits in filter(None, map(wanted.get, words or ())):
                            score[row, hits] += 1
                if not own:
                    places = {x: i for i, x in enumerate(batch.column(0).to_pylist())}
                    for q, x in enumerate(ids):
                        if x in places:
                            score[places[x], q] = -np.inf
                best = np.argsort(-score, axis=0, kind="stable")[:k].T
                value = np.take_along_axis(score.T, best, axis=1)
                held = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, n in zip(ids, held.sum(axis=1).tolist(), strict=True) for _ in range(n)]), batch.column(0).take(pa.array(best[held])), pa.array(value[held])], names=[query, key, "score"])

    return run


def hybrid(queries: DataFrame, store: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k best by shared terms plus dot product; no score is too low.

    queries: query, terms, vector; store: key, terms, vector (vectors of another length than the queries' count as zero). The queries are a stated set, held by each task BLOCK at a time:
    a task looks its rows' terms up among theirs, multiplies vectors as matrices, and sends the k best of 1,024 rows to the shuffle.
    """
    return top_k(_best(store, queries, query, key, k, True, True), k, query, key)


def legacy_score(terms: str, q_terms: str):
    """Shared terms, plus the share of the query's bigrams that the document has; bigrams over the sorted, joined terms."""
    joined = lambda c: text_bigrams(F.array_join(F.array_sort(c), " "))
    q = joined(F.col(q_terms))
    return F.size(F.array_intersect(terms, q_terms)) + F.size(F.array_intersect(joined(F.col(terms)), q)) / F.greatest(F.lit(1), F.size(q))


def positive_or_all(scored: DataFrame, query: str, score: str = "score") -> DataFrame:
    """Rows of positive score; of a query that has none, all rows."""
    best = F.max(score).over(Window.partitionBy(query))
    return scored.withColumn("_best", best).where((F.col("_best") <= 0) | (F.col(score) > 0)).drop("_best")


def vector_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k best of all vectors for each stated query by dot product, the query itself left out."""
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("vector"))
    return top_k(_best(rows, q, "query_id", key, k, False, False), k, "query_id", key)


def index_status(manifest: dict | None, schema_version: str, index_hash: str, source_hash: str) -> str:
    """missing, invalid, stale or current."""
    if manifest is None:
        return "missing"
    if manifest.get("schema_version") != schema_version or manifest.get("index_hash") != index_hash:
        return "invalid"
    return "current" if manifest.get("source_hash") == source_hash else "stale"
