"""JSON payloads as rows: a row for each value of each payload, made level by level in the JVM.

What looks for something anywhere in a payload (references, objects of a shape, values behind aliases) is a filter over these rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import variants as V
from tidemark.functions.payload import REFERENCES
from tidemark.stages import Stages

#: Ids of a block of answers, and rows that a task makes of blocks.
BLOCK, ANSWERS = 1024, 1 << 23
#: Payloads that a task unfolds, about.
PAYLOADS = 25_000


def _kind(value: Column) -> Column:
    """An object is told by a cast that looks at no member; a type is spelled out for the others only."""
    k = V.kind(value)
    names = {"ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.when(value.isNull(), "null").when(F.try_variant_get(value, "$", "struct<>").isNotNull(), "object")
    for prefix, name in names.items():
        out = out.when(k.startswith(prefix), name)
    return out.otherwise("number")


def _step(name: Column) -> Column:
    """A member's name in a path, quoted unless it is a plain word."""
    quoted = F.concat(F.lit('."'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(name.rlike(r"^\w+$"), F.concat(F.lit("."), name)).otherwise(quoted)


def _children(nodes: DataFrame, key: str) -> DataFrame:
    """The values in containers, one level down."""
    rows = nodes.where(F.col("kind").isin("object", "array")).select(key, F.col("path").alias("parent"), "depth", "_value", F.col("member_path").alias("_mp"), F.col("member").alias("_m"), F.col("lists").alias("_l"), F.col("kind").alias("inside"))
    entries = nodes.sparkSession.tvf.variant_explode(F.col("_value").outer()).toDF("_at", "_name", "_entry")
    rows = rows.lateralJoin(entries).drop("_value")
    own, name = F.col("inside") == "object", F.col("_name")
    path = F.concat("parent", F.when(own, _step(name)).otherwise(F.concat(F.lit("["), F.col("_at").cast("string"), F.lit("]"))))
    return rows.select(key, path.alias("path"), "parent", (F.col("depth") + 1).alias("depth"), "inside", F.when(own, name).otherwise(F.col("_m")).alias("member"), F.when(own, path).otherwise(F.col("_mp")).alias("member_path"), F.when(own, 0).otherwise(F.col("_l") + 1).alias("lists"), F.col("_entry").alias("_value")).transform(_described)


def _described(rows: DataFrame) -> DataFrame:
    """Values with their kind and text; only containers are kept."""
    v = F.col("_value")
    rows = rows.withColumn("kind", _kind(v))
    scalar = F.when(F.col("kind") == "string", F.try_variant_get(v, "$", "string")).when(F.col("kind").isin("number", "boolean"), F.to_json(v))
    return rows.withColumn("text", scalar).withColumn("_value", F.when(F.col("kind").isin("object", "array"), v))


def tree(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, parent, depth, inside, member, member_path, lists, kind, text, names) for each value, the payload itself with path ``$`` included.

    inside: object or array. member: the name of the nearest member that the value is or is listed in; lists: through how many lists. member_path: that member's path.
    kind: object, array, string, number, boolean or null. text: a scalar's text, numbers as they are spelled in JSON. names: an object's member names.
    A payload that is null or no JSON gives no rows, nor does one that names a member of an object twice. Levels are written tables, each made of the one above, so that every value is
    unfolded once; there are as many as the deepest payload has. Payloads are dealt out before they are parsed, as a small file is one task's; levels stay where their payloads are.
    """
    stages = Stages(rows.sparkSession, "tree")
    none, n = F.lit(None).cast("string"), F.lit(0)
    parts = max(1, math.ceil(rows.count() / PAYLOADS))
    # Parsed once: what filters and describes the values reads them from the table.
    held = stages.save(rows.select(key, payload).repartition(parts).select(key, F.try_parse_json(payload).alias("_value")), "parsed").where("_value is not null")
    last = held.select(key, F.lit("$").alias("path"), none.alias("parent"), n.alias("depth"), none.alias("inside"), none.alias("member"), F.lit("$").alias("member_path"), n.alias("lists"), "_value").transform(_described)
    out = None
    for depth in range(1 << 20):
        last = stages.save(last, f"level{depth}")
        out = last if out is None else out.unionByName(last)
        if last.where("kind in ('object', 'array')").limit(1).count() == 0:
            # Read only by who asks for names.
            return out.withColumn("names", F.when(F.col("kind") == "object", F.map_keys(F.try_variant_get("_value", "$", V.MEMBERS)))).drop("_value")
        last = _children(last, key)
    raise RuntimeError("payloads are too deep")


def references(nodes: DataFrame, key: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """(key, kind, id), once each: strings that are, or are directly listed in, a member named ``<kind>_id`` or ``<kind>_ids``, alone or after another word; and those of members
    whose name has ``fact_or_inference_id``, of the kind that their prefix tells."""
    kinds = kinds or REFERENCES
    low = F.lower("member")
    either = low.contains("fact_or_inference_id")
    found = []
    for kind, prefix in kinds.items():
        one, many = F.concat(F.lit("_"), low).endswith(f"_{kind}_id"), F.concat(F.lit("_"), low).endswith(f"_{kind}_ids")
        found.append(F.when((either & F.col("text").startswith(prefix)) | (~either & ((one & (F.col("lists") == 0)) | (many & (F.col("lists") == 1)))), F.lit(kind)))
    hits = nodes.where((F.col("kind") == "string") & (F.col("text") != "") & (F.col("lists") <= 1) & F.col("member").isNotNull())
    return hits.select(key, F.explode(F.array_compact(F.array(*found))).alias("kind"), F.col("text").alias("id")).distinct()


#: Members that make an object look like a web source.
WEB = ("published_at", "source_url", "url", "query", "time_verified")


def objects_with(nodes: DataFrame, key: str, names: tuple[str, ...] = WEB, values: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, a column for each of ``values``): objects anywhere in a payload that have a member of one of the names; values: the texts of scalar members, null otherwise."""
    found = nodes.where((F.col("kind") == "object") & F.arrays_overlap("names", F.array(*map(F.lit, names)))).select(key, "path")
    if not values:
        return found
    inner = nodes.where((F.col("inside") == "object") & F.col("member").isin(*values)).groupBy(key, F.col("parent").alias("path")).agg(*[F.max(F.when(F.col("member") == v, F.col("text"))).alias(v) for v in values])
    return found.join(inner, [key, "path"], "left")


#: The members that an index finds a value of a field by; ``a.b`` is a member of a member.
OUTCOMES = ("D_outcome", "outcome", "issuer_day_outcome")
FIELDS = {
    "ticker": ("ticker", "candidate_ticker", "outcome_ticker", "chosen_leader_ticker", "rejected_candidate_tickers", "peer_universe", "blind_preferred_ticker", "blind_rejected_ticker", "outcome_winner_ticker", "missed_ticker", "corrected_ticker", "issuer_ticker", *[f"{o}.{m}" for o in OUTCOMES for m in ("ticker", "code")]),
    "company_name": (
        "company_name", "candidate_company_name", "outcome_company_name", "chosen_leader_company_name", "blind_preferred_company_name", "blind_rejected_company_name", "outcome_winner_company_name", "missed_company_name", "corrected_company_name", "company_name_on_D", "issuer_company_name",
        *[f"{o}.{m}" for o in OUTCOMES for m in ("company_name", "company_name_on_D", "name")],
    ),
    "theme_id": ("theme_id", "theme_ids", "candidate_theme_id", "missed_theme_ids", "missed_theme_id", "corrected_theme_ids", "corrected_theme_id"),
    "path_type": ("path_type", "candidate_path_type", "missed_path_type", "corrected_path_type"),
    "response_class": ("response_class", "candidate_response_class", "blind_response_class", "outcome_response_class", *[f"{o}.response_class" for o in OUTCOMES]),
}


def postings(nodes: DataFrame, key: str, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(field, value, key), once each: the strings, trimmed and not blank, and numbers behind a field's members, lists of any depth included."""
    fields = fields or FIELDS
    of = lambda field: F.when(F.col("member_path").isin(*[f"$.{n}" for n in fields[field]]), F.lit(field))
    value = F.when(F.col("kind") == "string", F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))).when(F.col("kind") == "number", F.col("text"))
    leaves = nodes.where(F.col("kind").isin("string", "number") & F.col("member").isNotNull())
    return leaves.select(F.explode(F.array_compact(F.array(*map(of, fields)))).alias("field"), value.alias("value"), key).where("value <> ''").distinct()


class InvertedIndex:
    """Postings in folders by field and by bucket of the value: a search reads the folders of its values only."""

    def __init__(self, spark: SparkSession, path: str, key: str = "record_id", buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def write(self, entries: DataFrame) -> None:
        rows = entries.select("field", "value", self.key).withColumn("bucket", self._bucket(F.col("value")))
        rows.hint("rebalance", "field", "bucket").sortWithinPartitions("field", "bucket", "value").write.mode("overwrite").partitionBy("field", "bucket").parquet(self.path)

    def read(self, key_type: T.DataType) -> DataFrame:
        fields = [("value", T.StringType()), (self.key, key_type), ("field", T.StringType()), ("bucket", T.IntegerType())]
        return self.spark.read.schema(T.StructType([T.StructField(*f) for f in fields])).parquet(self.path)

    def narrowed(self, records: DataFrame, filters: dict[str, str]) -> DataFrame:
        """The records that have all the values: a semi-join with the postings of each."""
        held = self.read(records.schema[self.key].dataType)
        for field, value in filters.items():
            bucket = self.spark.range(1).select(self._bucket(F.lit(value))).first()[0]
            hits = held.where((F.col("field") == field) & (F.col("bucket") == bucket) & (F.col("value") == value)).select(self.key)
            records = records.join(hits, self.key, "left_semi")
        return records

    def answers(self, queries: DataFrame, records: DataFrame, query: str = "query_id") -> DataFrame:
        """(query, key) for many conjunctions at once; queries: (query, field, value). A record answers if it has each different value that its query names.

        Queries that name the same values are answered once. Of a conjunction the rarest value names the records, which are then looked up under its other values; answers and queries
        meet in blocks last, dealt out by the number of rows they make.
        """
        stages = Stages(self.spark, "answers")
        wanted = queries.select(query, F.struct("field", "value").alias("a")).groupBy(query).agg(F.array_sort(F.collect_set("a")).alias("_set"))
        wanted = stages.save(wanted.withColumn("_of", F.sha2(F.to_json("_set", {"ignoreNullFields": "false"}).cast("binary"), 256)), "wanted")
        asked = wanted.groupBy("_of").agg(F.first("_set").alias("_set")).select("_of", F.size("_set").alias("_need"), F.explode("_set").alias("a")).select("_of", "_need", "a.field", "a.value")
        asked = stages.save(asked.withColumn("bucket", self._bucket(F.col("value"))), "asked")
        place = ["field", "bucket", "value"]
        held = self.read(records.schema[self.key].dataType).join(asked.select(*place).distinct(), place, "left_semi")
        asked = asked.join(held.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")), place, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        asked = stages.save(asked.withColumn("_k", F.row_number().over(Window.partitionBy("_of").orderBy("_n", *place))), "ranked")
        led = stages.save(asked.where("_k = 1").join(held, place).select("_of", "_need", self.key), "led")
        more = led.join(asked.where("_k > 1").select("_of", *place), "_of").join(held, [*place, self.key], "left_semi")
        more = more.groupBy("_of", "_need", self.key).agg(F.count(F.lit(1)).alias("_more")).where("_more = _need - 1").select("_of", self.key)
        full = led.where("_need = 1").select("_of", self.key).unionByName(more)
        full = stages.save(full.join(records.select(self.key), self.key, "left_semi"), "full")
        ids = self._blocks(full, self.key, "_keys").join(self._blocks(wanted.select("_of", query), query, "_queries"), "_of")
        ids = stages.save(ids, "blocks")
        made = ids.agg(F.sum(F.size("_keys").cast("long") * F.size("_queries"))).first()[0] or 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(made / ANSWERS))
        asking = ids.repartition(parts).select(F.explode("_queries").alias(query), "_keys")
        # coalesce moves no rows here, but parts the two steps: as one step of generated code they would hold all rows of two blocks, a million, before the first goes on.
        return asking.coalesce(parts).select(query, F.explode("_keys").alias(self.key))

    @staticmethod
    def _blocks(rows: DataFrame, name: str, listed: str) -> DataFrame:
        """Lists of some BLOCK ids of each conjunction."""
        sizes = rows.groupBy("_of").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
        dealt = rows.join(sizes, "_of").withColumn("_block", F.pmod(F.xxhash64(name), F.col("_parts")))
        return dealt.groupBy("_of", "_block").agg(F.collect_list(name).alias(listed)).select("_of", listed)
