"""What was known when: availability, as-of lookups and leaks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clock import is_available


def split_available(rows: DataFrame, available_from: str, cut: Column) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("available", is_available(F.col(available_from), cut))
    return marked.where("available").drop("available"), marked.where("not available").drop("available")


def availability(ids: DataFrame, store: DataFrame, key: str, available_from: str, cut: Column) -> DataFrame:
    """Each id asked for with whether it may be seen; one that the store lacks may not."""
    return ids.join(store.select(key, available_from), key, "left").withColumn("included", is_available(F.col(available_from), cut))


def latest_as_of(asks: DataFrame, facts: DataFrame, key: str, asked: str, at: str, tie: str, *columns: str, inclusive: bool = True) -> DataFrame:
    """Each (key, asked) row with the columns of the last fact of its key at or before that time; nulls if there is none.

    Asks and facts of a key are merged in one ordered window: no fact is paired with every ask. Distinct (key, asked) expected.
    """
    kind = {c: facts.schema[c].dataType for c in (at, tie, *columns)}
    told = facts.select(key, F.col(at).alias("_t"), F.lit(0 if inclusive else 1).alias("_side"), F.struct(F.col(at).alias("fact_at"), *columns).alias("_f"), F.col(tie).cast("string").alias("_tie"), F.col(tie).alias("_tie_value"))
    ask = asks.select(key, F.col(asked).alias("_t"), F.lit(1 if inclusive else 0).alias("_side"), F.lit(None).cast(told.schema["_f"].dataType).alias("_f"), F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(kind[tie]).alias("_tie_value"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_tie_value").rowsBetween(Window.unboundedPreceding, 0)
    merged = told.unionByName(ask).withColumn("_last", F.last("_f", ignorenulls=True).over(w))
    return merged.where("_f is null and _tie is null").select(key, F.col("_t").alias(asked), "_last.fact_at", *[F.col(f"_last.{c}").alias(c) for c in columns])


#: Bytes of ids that every task searches for at once.
HELD_BYTES = 32 << 20


def future_leaks(texts: DataFrame, ids: DataFrame, text: str, needle: str, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Texts that contain an id that is not yet available, a row for each text and row of ``ids`` that it contains.

    Up to ``held_bytes`` of different ids, as counted, are one automaton, with which a task reads each text once; more are met by a nested loop. A null id or text matches nothing, an
    empty id every text. The columns of both tables have different names.
    """
    wanted = ids.select(F.col(needle).cast("string").alias("n")).where("n is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("n") + 64).alias("b")).first()["b"] or 0
    if size > held_bytes:
        return texts.join(ids, F.col(text).contains(F.col(needle)))
    listed, at = sorted(r["n"] for r in wanted.collect()), texts.columns.index(text)
    everywhere = [k for k, n in enumerate(listed) if n == ""]
    place = "_place"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        search = ahocorasick.Automaton()
        for k, n in enumerate(listed):
            if n:
                search.add_word(n, k)
        search.make_automaton()
        for batch in batches:
            rows, places = [], []
            for row, body in enumerate(batch.column(at).to_pylist()):
                if body is not None:
                    hits = sorted({k for _, k in search.iter(body)} if len(search) else ()) + everywhere
                    rows += [row] * len(hits)
                    places += hits
            found = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(places, pa.int32())], names=[*batch.schema.names, place])

    schema = T.StructType([*texts.schema.fields, T.StructField(place, T.IntegerType())])
    named = texts.sparkSession.createDataFrame(list(enumerate(listed)), f"{place} int, _needle string")
    hits = texts.mapInArrow(run, schema).join(F.broadcast(named), place)
    return hits.join(ids, F.col("_needle") == F.col(needle).cast("string")).drop(place, "_needle")


def scope_reason(available_from: Column, known_at: Column, cut: Column) -> Column:
    """Why a memory row is left out: the first of the two fields that is a string decides; null if the row stays."""
    def judge(field: Column, name: str) -> Column:
        time = F.try_to_timestamp(field)
        return F.when(time.isNull(), f"invalid_{name}").when(time > cut, f"{name}_after_cutoff")

    return F.when(available_from.isNotNull(), judge(available_from, "available_from")).when(known_at.isNotNull(), judge(known_at, "known_at")).otherwise("missing_temporal_scope")


def support_problems(claims: DataFrame, support: DataFrame, episodes: DataFrame) -> DataFrame:
    """(claim_id, episode_id, problem): support that is unknown, or later than its claim."""
    joined = support.join(claims.select("claim_id", F.col("available_from").alias("claim_from")), "claim_id").join(episodes.select("episode_id", F.col("available_from").alias("support_from")), "episode_id", "left")
    problem = F.when(F.col("support_from").isNull(), "unknown_support").when(F.col("support_from") > F.col("claim_from"), "temporal_leak")
    return joined.select("claim_id", "episode_id", problem.alias("problem")).where("problem is not null")


class BlindPrices:
    """Access to prices on a blind day: only rows before it can be read, and asking for later ones is an error."""

    def __init__(self, prices: DataFrame, trade_date: str):
        self._prices, self.trade_date = prices, trade_date

    def before(self, day: str | None = None) -> DataFrame:
        if day is not None and day > self.trade_date:
            raise PermissionError(f"prices from {self.trade_date} on are closed")
        return self._prices.where(F.col("trade_date") < F.lit(day or self.trade_date).cast("date"))

    def outcomes(self, *_: object) -> DataFrame:
        raise PermissionError("outcomes are closed while blind")
