"""Admission of many bundles at once, with the outcome that they would have one after the other by arrival.

A bundle claims its episode, with its file's hash, and the ids of its records, each with the episode and the record's hash. It is admitted if no stored bundle and no
earlier *admitted* one holds one of its keys with another value; a refused bundle holds nothing. Keys that all claim alike can't refuse anyone and are left out. The rest is
decided in rounds, in which claims meet by key, then by bundle. Claims are numbers only: the bundle's place in the order, 96 bits of the key's hash, 64 bits of what it is held with.
A key of many claims does not gather them: of such a key two rows tell who comes first with which value and who comes first with another one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import packing
from tidemark.stages import Stages

#: Why a bundle is put aside.
EPISODE, RECORD = "EPISODE_HASH_CONFLICT", "RECORD_ID_CONFLICT"
#: So many contended claims are one task's work.
SMALL = 1 << 17
#: Claims from which a key is hot, parts of keys that are counted first, and claims that a task sorts, about.
HOT, PARTS, ROWS = 1 << 16, 1 << 20, 1 << 22
#: Bundles that a task takes with their records, claims of a slice of keys, about, and the most slices.
BUNDLES, SLICE, SLICES = 1 << 18, 1 << 23, 8
KEY = ["k1", "k2"]


def dealt(rows: DataFrame, bundles: int, always: bool = False) -> DataFrame:
    """Rows by ``bundle_id``, in parts of about BUNDLES of so many bundles, where Spark's own number of parts is less; always: by bundle_id in any case. Rows that lie so stay where they are."""
    parts = math.ceil(bundles / BUNDLES)
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartition(parts, "bundle_id")
    return rows.repartition("bundle_id") if always else rows


class _Work:
    """Tables of the steps. What was shuffled for one goes before the next."""

    def __init__(self, spark: SparkSession):
        self.stages, self.names = Stages(spark, "admit"), []
        self.drop = self.stages.drop

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = self.stages.save(df, name)
        del df
        self.stages.release()
        self.names.append(name.split("/")[0])
        return out

    def by_slice(self, rows: DataFrame, n: int, step: Callable[[DataFrame, int], DataFrame], name: str) -> DataFrame:
        """``step`` of a slice of the keys at a time, so that the disk holds the shuffle of one slice only. n: how many rows."""
        m = min(SLICES, max(1, n // SLICE))
        parts = [rows if m == 1 else rows.where(F.pmod("k1", F.lit(m)) == i) for i in range(m)]
        return reduce(DataFrame.unionByName, [self.keep(step(part, n // m), f"{name}/{i}") for i, part in enumerate(parts)])


def _hash(*values: Column) -> Column:
    """A null is a value of its own."""
    return F.xxhash64(*[x for v in values for x in (v, v.isNull())])


def _key(kind: str, of: Column) -> list[Column]:
    return [_hash(F.lit(kind), of).alias("k1"), F.shiftright(_hash(F.lit("second"), F.lit(kind), of), 32).cast("int").alias("k2")]


def _claims(bundles: DataFrame, records: DataFrame, episode: Column, sha: Column, record: Column) -> DataFrame:
    """(turn, k1, k2, sets, torn, place): what a key is held with if the bundle is admitted.

    A bundle that gives one record id two contents (torn) sets the last by position, the largest of one position, and fits to none. place: the key's place in the bundle, of the episode 0.
    """
    own = bundles.where(episode.isNotNull()).select("turn", *_key("episode", episode), _hash(F.lit(""), sha).alias("sets"), F.lit(False).alias("torn"), F.lit(0).alias("place"))
    n = bundles.count()
    held = dealt(bundles.select("bundle_id", "turn", episode.alias("of")), n).join(records.where("record_id is not null").select("bundle_id", "position", record.alias("id"), sha.alias("sha")), "bundle_id")
    # By bundle_id once, where the join has not done so; it stays among the keys, so that no step deals the rows out again.
    held = dealt(held, n, True).groupBy("bundle_id", "turn", "of", "id").agg(F.max(F.struct("position", "sha"))["sha"].alias("last"), (F.min(F.struct("sha")) != F.max(F.struct("sha"))).alias("torn"), F.min(F.struct("position")).alias("at"))
    place = F.row_number().over(Window.partitionBy("bundle_id", "turn").orderBy("at", "id"))
    return own.unionByName(held.select("turn", *_key("record", F.col("id")), _hash(F.col("of"), F.col("last")).alias("sets"), "torn", place.alias("place")))


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bundles' outcomes, one after the other."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: r["turn"])
    held, left = {}, []
    for r in rows:
        if r["holds"]:
            held.setdefault((r["k1"], r["k2"]), r["sets"])
        else:
            left.append(r)
    out, at = [], 0
    while at < len(left):
        end = at
        while end < len(left) and left[end]["turn"] == left[at]["turn"]:
            end += 1
        own = left[at:end]
        fits = all(not r["torn"] and r["sets"] == held[k] for r in own if (k := (r["k1"], r["k2"])) in held)
        if fits:
            for r in own:
                held.setdefault((r["k1"], r["k2"]), r["sets"])
        out.append((own[0]["turn"], fits))
        at = end
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())], names=["turn", "admitted"])


class _Keys:
    """Rows by key: those of hot keys, which are few keys, stay where they are and meet what is told of their key."""

    def __init__(self, rows: DataFrame, hot: int):
        spark = rows.sparkSession
        part = F.pmod("k1", F.lit(PARTS))
        # Whole parts are counted first, as there are few; keys only of those that may have a hot one.
        found = rows.groupBy(part.alias("_part")).count().where(F.col("count") > hot).select("_part")
        found = rows.select(*KEY, part.alias("_part")).join(F.broadcast(found), "_part", "left_semi").groupBy(*KEY).count().where(F.col("count") > hot)
        self.keys = found.select(*KEY).collect()
        self.hot = F.broadcast(spark.createDataFrame(self.keys, rows.select(*KEY).schema)) if self.keys else None
        self.least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cold(self, rows: DataFrame, n: int) -> DataFrame:
        """The rows of other keys, a key in one part; n: of how many."""
        rows = rows if self.hot is None else rows.join(self.hot, KEY, "left_anti")
        parts = math.ceil(n / ROWS)
        return rows.repartition(parts, *KEY) if parts > self.least else rows

    def met(self, rows: DataFrame, told) -> DataFrame | None:
        """Rows of hot keys beside ``told`` of them, a row for each key."""
        if self.hot is None:
            return None
        rows = rows.join(self.hot, KEY, "left_semi")
        return rows.join(F.broadcast(told(rows)), KEY, "left")


def _both(one: DataFrame, other: DataFrame | None) -> DataFrame:
    return one if other is None else one.unionByName(other)


def _contended(claims: DataFrame, keys: _Keys, n: int) -> DataFrame:
    """The rows of keys that are held with something else than a claim wants, or wanted in two ways."""
    lo, hi, torn = F.min("sets"), F.max("sets"), F.max("torn")
    over = lambda c: c.over(Window.partitionBy(*KEY))
    cold = keys.cold(claims, n).withColumns({"lo": over(lo), "hi": over(hi), "any": over(torn)})
    hot = keys.met(claims, lambda rows: rows.groupBy(*KEY).agg(lo.alias("lo"), hi.alias("hi"), torn.alias("any")))
    return _both(cold, hot).where("lo <> hi or any").drop("lo", "hi", "any")


def _flags(left: DataFrame, keys: _Keys, n: int) -> DataFrame:
    """(turn, refused, waits) for each bundle: by a key that is held with something else; for others that come first with a key."""
    # One with two contents is apart from others that set the same: who comes after it waits, as a key that is held by then would refuse it.
    order = Window.partitionBy(*KEY).orderBy(F.desc("holds"), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = (F.col("sets") == F.col("leads")) & (F.col("torn") == F.col("apart"))
    cold = keys.cold(left, n).withColumns({"held": F.first("holds").over(order), "leads": F.first("sets").over(order), "apart": F.first("torn").over(order), "first": F.first("turn").over(order)})
    cold = cold.withColumn("alike", F.min(same).over(order))

    def told(rows: DataFrame) -> DataFrame:
        heads = rows.groupBy(*KEY, "holds", "sets", "torn").agg(F.min("turn").alias("turn"))
        heads = heads.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("holds"), "turn"))).where("k <= 2")
        one = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
        return heads.groupBy(*KEY).agg(one("holds").alias("held"), one("sets").alias("leads"), one("torn").alias("apart"), one("turn").alias("first"), F.max(F.when(F.col("k") == 2, F.col("turn"))).alias("other"))

    hot = keys.met(left, told)
    if hot is not None:
        hot = hot.withColumn("alike", F.col("other").isNull() | (F.col("turn") < F.col("other"))).drop("other")
    refused = F.col("held") & (F.col("torn") | (F.col("sets") != F.col("leads")))
    waits = ~F.col("held") & (F.col("turn") != F.col("first")) & ~(F.col("alike") & ~F.col("torn"))
    return _both(cold, hot).where("not holds").groupBy("turn").agg(F.max(refused).alias("refused"), F.max(waits).alias("waits"))


def _pruned(left: DataFrame) -> DataFrame:
    """Without what is held and nobody wants any more; a key is held once."""
    wants, holds = left.where("not holds"), left.where("holds")
    holds = holds.join(wants.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.min_by("sets", "turn").alias("sets"), F.min("turn").alias("turn"))
    holds = holds.select("turn", *KEY, "sets", F.lit(False).alias("torn"), F.lit(True).alias("holds"))
    return wants.select(*holds.columns).unionByName(holds)


def _open(left: DataFrame, votes: DataFrame) -> DataFrame:
    """What waits, and what is held from now on."""
    columns = ["turn", *KEY, "sets", "torn", "holds"]
    own = left.where("not holds").join(votes, "turn").where("admitted is null or admitted").withColumn("holds", F.col("admitted").isNotNull())
    return own.select(*columns).unionByName(left.where("holds").select(*columns))


def _decided(fought: DataFrame, keys: _Keys, work: _Work, small: int) -> DataFrame:
    """(turn, admitted) for each bundle of ``fought``, whose rows with ``holds`` tell what is held before."""
    found: DataFrame | None = None
    left, name = fought, None

    def instead(of: DataFrame, n: int, step: Callable[[DataFrame, int], DataFrame], new: str) -> DataFrame:
        nonlocal name
        out = work.by_slice(of, n, step, new)
        if name:
            work.drop(name)
        name = new
        return out

    for round_ in range(1 << 30):
        n, n_held = left.where("not holds").count(), left.where("holds").count()
        if n <= small:
            return _both(work.keep(_pruned(left).coalesce(1).mapInArrow(_in_turn, "turn long, admitted boolean"), "rest"), found)
        if n_held > n:
            left = instead(left, n + n_held, lambda rows, _: _pruned(rows), f"pruned{round_}")
            n_held = left.where("holds").count()
        flags = work.by_slice(left, n + n_held, lambda rows, k: _flags(rows, keys, k), "flags")
        # An admitted bundle agrees with others of its round wherever they meet, but for one that comes first with two contents.
        votes = flags.groupBy("turn").agg(F.when(F.max("refused"), False).when(~F.max("waits"), True).alias("admitted"))
        votes = work.keep(votes, f"votes{round_}")
        work.drop("flags")
        found = _both(votes.where("admitted is not null"), found)
        left = instead(left, n + n_held, lambda rows, _, votes=votes: _open(rows, votes), f"left{round_}")
    raise RuntimeError("admission did not settle")


def _clashes(fought: DataFrame, settled: DataFrame, keys: _Keys, n: int) -> DataFrame:
    """(turn, place, k1, k2) for each refused bundle: the first of its keys that was held with something else when it came, by what was stored or else by the first that was admitted."""
    known = fought.where("not holds").join(settled, "turn").unionByName(fought.where("holds").withColumn("admitted", F.lit(True)))
    earlier = Window.partitionBy(*KEY).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    cold = keys.cold(known, n).withColumn("before", F.first(F.when(F.col("admitted"), F.col("sets")), ignorenulls=True).over(earlier))
    hot = keys.met(known, lambda rows: rows.where("admitted").groupBy(*KEY).agg(F.min("turn").alias("since"), F.min_by("sets", "turn").alias("holder")))
    if hot is not None:
        hot = hot.withColumn("before", F.when(F.col("since") < F.col("turn"), F.col("holder"))).drop("since", "holder")
    return _first(_both(cold, hot).where("not admitted and before is not null and (torn or sets <> before)"))


def _first(clash: DataFrame) -> DataFrame:
    return clash.groupBy("turn").agg(F.min("place").alias("place"), F.min_by("k1", "place").alias("k1"), F.min_by("k2", "place").alias("k2"))


def admit(bundles: DataFrame, records: DataFrame, stored_bundles: DataFrame, stored_records: DataFrame, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """A row for each incoming bundle: stored, or quarantined with its reason.

    bundles: (bundle_id, arrival, episode_id, sha); records: (bundle_id, position, record_id, sha, eligible). Where bundles have no bundle_id, they are named by their episode,
    as are their records, and come in its order. stored_bundles: (episode_id, sha), one row an episode; stored_records: (record_id, episode_id, sha), ids unique.
    Bundles come by arrival, then by id. An episode that is held with another hash is EPISODE_HASH_CONFLICT; else a record id that is held for another episode or with another hash is
    RECORD_ID_CONFLICT, of which the first by position is named. Records without an id claim nothing, nor do records of a bundle that isn't there. Extra columns are ignored.
    A bundle that comes again just as it was is stored again. Ids are compared as text; they come back as they are.

    Tables of a step go as soon as the next one is written, and so do its shuffle files.
    """
    if "bundle_id" not in bundles.columns:
        bundles, records = bundles.withColumn("bundle_id", F.col("episode_id")), records.withColumn("bundle_id", F.col("episode_id"))
    if "arrival" not in bundles.columns:
        bundles = bundles.withColumn("arrival", F.lit(0))
    work = _Work(bundles.sparkSession)
    text = lambda name: F.col(name).cast("string")
    bundles = bundles.select("bundle_id", "arrival", "episode_id", "sha")
    rows = records.select("bundle_id", "position", "record_id", "sha", "eligible")
    # Bundles and their records meet by the id as it is, so that rows that lie by it stay there; as text if that is the only way to tell.
    plain = bundles.schema["bundle_id"].dataType == rows.schema["bundle_id"].dataType and isinstance(rows.schema["bundle_id"].dataType, T.StringType | T.IntegralType)
    named = bundles.withColumnRenamed("bundle_id", "_id").withColumn("bundle_id", F.col("_id") if plain else text("_id"))
    rows = rows if plain else rows.withColumn("bundle_id", text("bundle_id"))
    order = [F.col("arrival"), text("_id"), text("episode_id"), text("sha")]
    numbered = work.keep(packing.before(named, order, {"turn": F.lit(1)}, work.stages, "turns").drop("arrival"), "numbered")
    work.drop("turns")
    claims = work.keep(_claims(numbered, rows, text("episode_id"), text("sha"), text("record_id")).withColumn("holds", F.lit(False)), "claims")
    stored = stored_bundles.where("episode_id is not null").select(*_key("episode", text("episode_id")), _hash(F.lit(""), text("sha")).alias("sets"))
    stored = stored.unionByName(stored_records.where("record_id is not null").select(*_key("record", text("record_id")), _hash(text("episode_id"), text("sha")).alias("sets")))
    # What is stored comes before all.
    stored = stored.select(F.lit(-1).cast("long").alias("turn"), *KEY, "sets", F.lit(False).alias("torn"), F.lit(-1).alias("place"), F.lit(True).alias("holds"))
    wanted = claims.unionByName(stored)
    keys = _Keys(wanted, hot)
    fought = work.by_slice(wanted, wanted.count(), lambda part, n: _contended(part, keys, n), "fought")
    work.drop("claims")
    settled = _decided(fought, keys, work, small)
    clash = work.by_slice(fought, fought.count(), lambda part, n: _clashes(part, settled, keys, n), "clashes")
    clash = work.keep(_first(clash), "clash")
    work.drop(*[n for n in work.names if n not in ("numbered", "clash")])
    # Records once more, beside the clash of their bundle: the id of the key that clashes is among them.
    told = dealt(numbered.join(clash, "turn", "left"), numbered.count())
    mine = ["bundle_id", "turn", "_id", "episode_id", "sha", "place"]
    met = told.join(rows.select("bundle_id", F.col("record_id").alias("id"), "eligible", F.lit(True).alias("here")), "bundle_id", "left")
    k1, k2 = _key("record", text("id"))
    named = F.when((F.col("place") > 0) & (k1 == F.col("k1")) & (k2 == F.col("k2")), F.col("id"))
    met = met.groupBy(*mine, named.alias("record_id")).agg(F.count("here").alias("n_records"), F.count_if("eligible").alias("n_eligible"))
    out = met.groupBy(*mine).agg(F.min("record_id").alias("record_id"), F.sum("n_records").alias("n_records"), F.sum("n_eligible").alias("n_eligible"))
    return out.select(
        F.col("_id").alias("bundle_id"),
        "episode_id",
        F.when(F.col("place").isNull(), "stored").otherwise("quarantined").alias("outcome"),
        F.when(F.col("place") == 0, EPISODE).when(F.col("place") > 0, RECORD).alias("reason"),
        "record_id",
        F.when(F.col("place").isNotNull(), F.concat_ws("-", text("episode_id"), F.substring(text("sha"), 1, 12))).alias("quarantine"),
        "n_records",
        "n_eligible",
    )
