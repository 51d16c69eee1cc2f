"""JSON objects as maps of variants: all in the JVM, a member that is null told apart from one that is absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBERS = "map<string,variant>"


def members(text: Column) -> Column:
    """The members of a JSON object; null if the text is no object, or names a member twice."""
    return named_once(F.from_json(text, MEMBERS))


def named_once(held: Column) -> Column:
    """``held``, null if it has a member twice."""
    return F.when(F.size(F.array_distinct(F.map_keys(held))) == F.size(held), held)


def nested(value: Column) -> Column:
    """A variant's members, none if it is no object."""
    return F.coalesce(F.try_variant_get(value, "$", MEMBERS), no_members())


def no_members() -> Column:
    return F.from_json(F.lit("{}"), MEMBERS)


def to_text(held: Column) -> Column:
    """The object as JSON, members by name."""
    return F.when(F.size(held) == 0, F.lit("{}")).otherwise(F.to_json(F.to_variant_object(held)))


def null() -> Column:
    """A member that is there and null."""
    return F.parse_json(F.lit("null"))


def text(value: Column) -> Column:
    return value.cast("variant")


def kind(value: Column) -> Column:
    """The type's name: OBJECT<...>, ARRAY<...>, STRING, BOOLEAN, BIGINT, DECIMAL(...), DOUBLE, VOID; null where there is no member."""
    return F.schema_of_variant(value)


def string(value: Column) -> Column:
    """A variant's string, null if it is none or empty."""
    return F.when(kind(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def when_string(value: Column) -> Column:
    """A list of a variant's string; an empty one if it is none or empty."""
    return F.when(string(value).isNotNull(), F.array(string(value))).otherwise(no_strings())


def strings(value: Column) -> Column:
    """The strings of a variant that is a list, empty ones too; no strings of any other."""
    items = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    found = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(F.coalesce(kind(value).startswith("ARRAY"), F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def is_true(value: Column) -> Column:
    return F.coalesce((kind(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False))


def number(value: Column) -> Column:
    """A variant's number, 0 of anything else."""
    numeric = F.coalesce(kind(value).rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False))
    return F.when(numeric, F.try_variant_get(value, "$", "double")).otherwise(0.0)


def filled(value: Column) -> Column:
    """A variant that is neither absent, null, false, 0, nor an empty string, list or object."""
    empty = F.coalesce((F.to_json(value)).isin("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}"), F.lit(True))
    return F.when(~empty, value)


def references(held: Column, *names: str) -> Column:
    """The non-empty strings of members that are a string or a list, by member."""
    each = []
    for name in names:
        value = held[name]
        each.append(F.when(string(value).isNotNull(), F.array(string(value))).otherwise(F.filter(strings(value), lambda x: x != "")))
    return F.concat(*each)


def listed(members: Sequence[tuple[str, Column]]) -> Column:
    """The members whose values are not SQL null, as entries."""
    none = F.array().cast("array<struct<key:string,value:variant>>")
    return F.concat(*[F.when(value.isNotNull(), F.array(F.struct(F.lit(name).alias("key"), value.alias("value")))).otherwise(none) for name, value in members])


def changed(df: DataFrame, held: str, over: dict[str, str], lacking: Sequence[tuple[str, Column]]) -> DataFrame:
    """``df`` whose map ``held`` has the members ``over`` (by column) replaced or added, and those of ``lacking`` that it does not have, be they null; a value that is SQL null sets nothing."""
    m, left, more = F.col(held), "_left", "_more"
    entries = [*[(name, F.col(c)) for name, c in over.items()], *[(name, F.when(~F.map_contains_key(m, name), value)) for name, value in lacking]]
    gone = lambda k: F.coalesce(*[F.when((k == name) & F.col(c).isNotNull(), F.lit(True)) for name, c in over.items()], F.lit(False))
    # Both in one step: a step with a lambda is compiled in small pieces, one of plain expressions as a single method, which at this length stays interpreted.
    rows = df.withColumns({left: F.map_filter(m, lambda k, _: ~gone(k)), more: listed(entries)})
    return rows.withColumn(held, F.when(F.size(more) > 0, F.map_concat(left, F.map_from_entries(more))).otherwise(m)).drop(left, more)
