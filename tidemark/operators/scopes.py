"""Lists of records that packs carry, against the sets recomputed as of each pack's own cutoff.

Records are dealt into buckets by a hash of their id. In a bucket, records and cutoffs are merged in order of time, and a running count and sum of id hashes give for every cutoff the
size and the fingerprint of the set that was available then: no pack is paired with all records. A list whose sizes and fingerprints agree is right. Only where a bucket of a
list disagrees are its records looked at one by one. Lists travel as counts of a record in 15 packs, 4 bits each, in one number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.stages import Stages

#: The sets a list may be held against: all records, those available at the cutoff, those that are not, those available and eligible.
SETS = ("all", "available", "unavailable", "eligible")
#: Records of a bucket, in the mean.
BUCKET = 1 << 18
WIDE = "decimal(38,0)"
#: Packs of a word, and bits for the count of each.
SLOTS, BITS = 15, 4


def bucket_count(records: DataFrame, rows: int = BUCKET) -> int:
    return max(1, -(-records.count() // rows))


def _bucket(record: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), record), F.lit(buckets)).cast("int")


def _print(record: Column) -> Column:
    return F.xxhash64(record).cast(WIDE)


def expected_sets(records: DataFrame, packs: DataFrame, buckets: int) -> DataFrame:
    """(pack_id, bucket, set, n, print) for each pack, bucket and set of SETS. records: (record_id, available_from, eligible), ids unique; packs: (pack_id, cutoff).

    What is available exactly at the cutoff counts; a record without a time is never available, nor is any to a pack without a cutoff.
    """
    known = records.where("record_id is not null").select(_bucket(F.col("record_id"), buckets).alias("bucket"), F.col("available_from").cast("timestamp").alias("t"), F.coalesce("eligible", F.lit(False)).alias("e"), _print(F.col("record_id")).alias("h"))
    # Records of one time in a bucket are one row; those without a time come last, after every cutoff.
    told = known.groupBy("bucket", "t").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("h").cast(WIDE).alias("h"), F.count_if("e").alias("ne"), F.sum(F.when(F.col("e"), F.col("h")).otherwise(F.lit(0).cast(WIDE))).cast(WIDE).alias("he"))
    told = told.select("bucket", F.lit(None).cast(packs.schema["pack_id"].dataType).alias("pack_id"), "t", F.lit(0).alias("side"), "n", "h", "ne", "he")
    zero = F.lit(0).cast("long")
    asks = packs.where("cutoff is not null").select("pack_id", F.col("cutoff").cast("timestamp").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    asks = asks.select("bucket", "pack_id", "t", F.lit(1).alias("side"), zero.alias("n"), F.lit(0).cast(WIDE).alias("h"), zero.alias("ne"), F.lit(0).cast(WIDE).alias("he"))
    upto = Window.partitionBy("bucket").orderBy(F.col("t").asc_nulls_last(), "side").rowsBetween(Window.unboundedPreceding, 0)
    run = told.unionByName(asks).select("bucket", "pack_id", "side", *[F.sum(c).over(upto).alias(c) for c in ("n", "ne")], *[F.sum(c).over(upto).cast(WIDE).alias(c) for c in ("h", "he")])
    whole = told.groupBy("bucket").agg(F.sum("n").alias("all_n"), F.sum("h").cast(WIDE).alias("all_h"))
    none = lambda c: F.coalesce(c, F.lit(0).cast(WIDE))
    at = packs.select("pack_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).join(run.where("side = 1").drop("side"), ["pack_id", "bucket"], "left").join(whole, "bucket", "left")
    at = at.withColumns({"n": F.coalesce("n", zero), "ne": F.coalesce("ne", zero), "all_n": F.coalesce("all_n", zero), "h": none(F.col("h")), "he": none(F.col("he")), "all_h": none(F.col("all_h"))})
    each = {"all": ("all_n", "all_h"), "available": ("n", "h"), "unavailable": (F.col("all_n") - F.col("n"), F.col("all_h") - F.col("h")), "eligible": ("ne", "he")}
    pair = lambda n, h: (F.col(n) if isinstance(n, str) else n, F.col(h) if isinstance(h, str) else h)
    rows = F.array(*[F.struct(F.lit(s).alias("set"), pair(*v)[0].alias("n"), pair(*v)[1].cast(WIDE).alias("print")) for s, v in each.items()])
    return at.select("pack_id", "bucket", F.explode(rows).alias("r")).select("pack_id", "bucket", "r.set", "r.n", "r.print")


def _numbered(packs: DataFrame) -> DataFrame:
    """(pack_id, cutoff, word, slot): packs dealt SLOTS to a word."""
    parts = max(1, -(-packs.count() // 4096))
    rows = packs.where("pack_id is not null").select("pack_id", F.col("cutoff").cast("timestamp").alias("cutoff"), F.pmod(F.xxhash64("pack_id"), F.lit(parts)).alias("_part"))
    rows = rows.withColumn("_at", (F.row_number().over(Window.partitionBy("_part").orderBy("pack_id")) - 1).cast("long"))
    return rows.select("pack_id", "cutoff", (F.col("_part") * (1 << 20) + F.expr(f"_at div {SLOTS}")).alias("word"), (F.col("_at") % SLOTS).cast("int").alias("slot"))


def _placed(listed: DataFrame, places: DataFrame, lists: dict[str, str]) -> DataFrame:
    return listed.where(F.col("record_id").isNotNull() & F.col("list").isin(*lists)).select("pack_id", "list", "record_id").join(places.drop("cutoff"), "pack_id")


def _counted(listed: DataFrame, places: DataFrame, lists: dict[str, str]) -> DataFrame:
    """(record_id, word, c0, n0, c1, ...): by list how often the packs of a word list a record, BITS for each pack in one number, and how often they do together.

    Packs that list a record are added up before the shuffle, so that a row is sent for a word and not for a pack.
    """
    one = F.expr(f"shiftleft(1L, slot * {BITS})")
    mine = [F.when(F.col("list") == name, one) for name in lists]
    return _placed(listed, places, lists).groupBy("record_id", "word").agg(*[x for i, m in enumerate(mine) for x in (F.try_sum(m).alias(f"c{i}"), F.count(m).alias(f"n{i}"))])


def _by_pack(counted: DataFrame, listed: DataFrame, places: DataFrame, lists: dict[str, str]) -> DataFrame:
    """A row for each record and pack of its words, with the counts k0, k1, ... by list; other columns stay. ``counted`` is a written table."""
    ks, kept = range(len(lists)), [c for c in counted.columns if c[0] not in "cn" or not c[1:].isdigit()]
    digit = lambda i, at: F.expr(f"shiftright(coalesce(c{i}, 0L), {at}) & {(1 << BITS) - 1}")
    # A pack that lists a record too often for its bits carries into its neighbour's: the digits then don't add up to all.
    crowded = F.lit(False)
    for i in ks:
        crowded = crowded | (F.coalesce(f"n{i}", F.lit(0)) != sum((digit(i, s * BITS) for s in range(1, SLOTS)), digit(i, 0)))
    words = places.groupBy("word").agg(F.collect_list(F.struct("pack_id", "cutoff", "slot")).alias("_packs"))
    spread = lambda rows: rows.join(words, "word").select(*counted.columns, F.explode("_packs").alias("_p")).select(*counted.columns, "_p.*")
    out = spread(counted.where(~crowded)).select(*kept, "pack_id", "cutoff", *[digit(i, f"slot * {BITS}").alias(f"k{i}") for i in ks])
    many = counted.where(crowded)
    if many.limit(1).count():
        exact = _placed(listed, places, lists).join(many.select("record_id", "word"), ["record_id", "word"], "left_semi")
        exact = exact.groupBy("record_id", "pack_id").agg(*[F.count_if(F.col("list") == name).alias(f"k{i}") for i, name in enumerate(lists)])
        out = out.unionByName(spread(many).join(exact, ["record_id", "pack_id"], "left").select(*kept, "pack_id", "cutoff", *[F.coalesce(f"k{i}", F.lit(0)).alias(f"k{i}") for i in ks]))
    return out


def _compared(records: DataFrame, packs: DataFrame, listed: DataFrame, lists: dict[str, str], buckets: int, places: DataFrame, counted: DataFrame) -> DataFrame:
    """(pack_id, list, set, bucket, expected, listed, duplicates, same)."""
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("list"), F.lit(kind).alias("set")) for name, kind in lists.items()])).alias("l")
    want = expected_sets(records, packs, buckets)
    asked = packs.select("pack_id", named).select("pack_id", "l.list", "l.set").join(want, ["pack_id", "set"])
    rows = counted.withColumns({"bucket": _bucket(F.col("record_id"), buckets), "h": F.xxhash64("record_id")})
    # Sums of 64-bit hashes by halves, as whole numbers.
    low, high, sums = F.expr("h & 4294967295L"), F.shiftright("h", 32), []
    for i in range(len(lists)):
        k = F.col(f"k{i}")
        there = k > 0
        sums.append([F.count_if(there), F.sum(F.when(there, low)), F.sum(F.when(there, high)), F.sum(F.when(there, k - 1))])
    flat = _by_pack(rows, listed, places, lists).groupBy("pack_id", "bucket").agg(*[x.alias(f"{name}{i}") for i, each in enumerate(sums) for name, x in zip("mlha", each, strict=True)])
    wide = lambda c: F.col(c).cast(WIDE)
    each = [F.struct(F.lit(name).alias("list"), F.col(f"m{i}").alias("m"), (F.col(f"h{i}").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(f"l{i}").cast("decimal(19,0)")).cast(WIDE).alias("g"), F.col(f"a{i}").alias("again")) for i, name in enumerate(lists)]
    have = flat.select("pack_id", "bucket", F.explode(F.array(*each)).alias("x")).select("pack_id", "bucket", "x.*")
    joined = asked.join(have, ["pack_id", "list", "bucket"], "left")
    same = (F.coalesce("m", F.lit(0)) == F.col("n")) & (F.coalesce("g", F.lit(0).cast(WIDE)) == wide("print"))
    return joined.select("pack_id", "list", "set", "bucket", F.col("n").alias("expected"), F.coalesce("m", F.lit(0)).alias("listed"), F.coalesce("again", F.lit(0)).alias("duplicates"), same.alias("same"))


def scope_report(records: DataFrame, packs: DataFrame, listed: DataFrame, lists: dict[str, str], counts: dict[str, str] | None = None, buckets: int | None = None) -> DataFrame:
    """A row for each pack and list: expected and listed (different ids), duplicates, whether the ids match, and passed.

    listed: (pack_id, list, record_id). lists: the set of SETS that each list is held against; a pack that has no row of a list lists nothing. counts: for lists the column of ``packs`` with the
    size it claims, which must be there and right as well. Order doesn't matter; an id listed twice fails the list.
    """
    stages = Stages(records.sparkSession, "scopes")
    places = stages.save(_numbered(packs), "places")
    counted = stages.save(_counted(listed, places, lists), "counted")
    found = _compared(records, packs, listed, lists, buckets or bucket_count(records), places, counted)
    found = found.groupBy("pack_id", "list").agg(F.sum("expected").alias("expected"), F.sum("listed").alias("listed"), F.sum("duplicates").alias("duplicates"), F.bool_and("same").alias("ids_match"))
    claimed = F.lit(True)
    if counts:
        found = found.join(packs.select("pack_id", *dict.fromkeys(counts.values())), "pack_id")
        for name, column in counts.items():
            claimed = F.when(F.col("list") == name, F.coalesce(F.col(column) == F.col("expected"), F.lit(False))).otherwise(claimed)
    found = found.withColumn("count_matches", claimed)
    return found.select("pack_id", "list", "expected", "listed", "duplicates", "ids_match", "count_matches", (F.col("ids_match") & F.col("count_matches") & (F.col("duplicates") == 0)).alias("passed"))


def scope_differences(records: DataFrame, packs: DataFrame, listed: DataFrame, lists: dict[str, str], buckets: int | None = None) -> DataFrame:
    """(pack_id, list, record_id, problem): unknown (no record has it), unexpected, missing, duplicate. Only buckets that disagree are compared by id."""
    buckets = buckets or bucket_count(records)
    stages, ks = Stages(records.sparkSession, "scopes"), range(len(lists))
    places = stages.save(_numbered(packs), "places")
    counted = stages.save(_counted(listed, places, lists), "counted")
    wrong = _compared(records, packs, listed, lists, buckets, places, counted).where("not same").select("pack_id", "bucket")
    wrong = stages.save(wrong.join(places, "pack_id").select("bucket", "word").distinct(), "wrong")
    known = records.where("record_id is not null").select("record_id", F.col("available_from").cast("timestamp").alias("t"), F.coalesce("eligible", F.lit(False)).alias("e"), _bucket(F.col("record_id"), buckets).alias("bucket"))
    known = known.join(wrong, "bucket").select("record_id", "word", "t", "e", F.lit(True).alias("known"))
    # One row for a record and a word: what is listed, and the record where the word is to be compared.
    numbers = [f"{x}{i}" for i in ks for x in "cn"]
    met = counted.unionByName(known, allowMissingColumns=True).groupBy("record_id", "word").agg(*[F.max(c).alias(c) for c in (*numbers, "t", "e", "known")])
    met = met.withColumn("bucket", _bucket(F.col("record_id"), buckets)).join(wrong.withColumn("asked", F.lit(True)), ["bucket", "word"], "left").drop("bucket")
    then = F.coalesce(F.col("t") <= F.col("cutoff"), F.lit(False))
    member = {"all": F.lit(True), "available": then, "unavailable": ~then, "eligible": then & F.col("e")}
    found = []
    for i, (name, kind) in enumerate(lists.items()):
        there, asked, known_ = F.col(f"k{i}") > 0, F.col("asked").isNotNull(), F.col("known").isNotNull()
        is_so = lambda when, problem, name=name: F.when(when, F.struct(F.lit(name).alias("list"), F.lit(problem).alias("problem")))
        found.append(F.coalesce(is_so(asked & there & ~known_, "unknown"), is_so(asked & there & ~member[kind], "unexpected"), is_so(asked & ~there & known_ & member[kind], "missing")))
        found.append(is_so(F.col(f"k{i}") > 1, "duplicate"))
    rows = _by_pack(stages.save(met, "met"), listed, places, lists).where(F.coalesce(*found).isNotNull())
    return rows.select("pack_id", "record_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("pack_id", "f.list", "record_id", "f.problem")
