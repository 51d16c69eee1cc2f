"""Schema-on-read payloads: JSON text with aliases for the same logical field."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _spelled(separators: tuple[str, str]):
    def run(payload: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=separators)
            except ValueError:
                return None

        return payload.map(one)

    return F.pandas_udf(run, "string")


def canonical_json(payload: Column) -> Column:
    """Sorted keys, no spaces, numbers as Python spells them; null if it doesn't parse. Spark's own writer respells numbers."""
    return _spelled((",", ":"))(payload)


def spaced_json(payload: Column) -> Column:
    return _spelled((", ", ": "))(payload)


def payload_hash(payload: Column) -> Column:
    return F.sha2(canonical_json(payload).cast("binary"), 256)


def scalars(value: object) -> list[str]:
    """The non-blank strings and numbers of a value as text, lists of any depth flattened. Booleans, objects and nulls give nothing."""
    if isinstance(value, list):
        return [x for item in value for x in scalars(item)]
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return []
    text = str(value).strip()
    return [text] if text else []


def alias_values(payload: Column, paths: Sequence[str]) -> Column:
    """Ordered distinct scalars of all alias paths (``$.a.b``), from one parse of each payload; see scalars()."""
    steps = [p.removeprefix("$.").split(".") for p in paths]

    def run(payload: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                root = None if text is None else json.loads(text)
            except ValueError:
                root = None
            found: dict[str, None] = {}
            for names in steps:
                value = root
                for name in names:
                    value = value.get(name) if isinstance(value, dict) else None
                found.update(dict.fromkeys(scalars(value)))
            return list(found)

        return payload.map(one)

    return F.pandas_udf(run, "array<string>")(payload)


def has_key(payload: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def outer_wins(payload: Column, key: str, nested: str = "payload") -> Column:
    """A key present outside decides, even as null; otherwise the nested one."""
    return F.when(has_key(payload, key), F.get_json_object(payload, f"$.{key}")).otherwise(F.get_json_object(payload, f"$.{nested}.{key}"))


def truthy(*values: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def merge_lists(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)), lambda x: x.isNotNull() & (x != "")))


def json_or_empty(payload: Column, kind: str = "object") -> Column:
    """The payload if it is a JSON object (``kind`` "array": an array), else an empty one."""
    found = F.schema_of_variant(F.try_parse_json(payload))
    return F.when(found.startswith(kind.upper()), payload).otherwise(F.lit("{}" if kind == "object" else "[]"))


def first_string(payload: Column, keys: Sequence[str], otherwise: Column) -> Column:
    """The first of the keys that holds a string that isn't empty, else another value."""
    parsed = F.try_parse_json(payload)
    strings = [F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) == "STRING", F.nullif(F.try_variant_get(parsed, f"$.{k}", "string"), F.lit(""))) for k in keys]
    return F.coalesce(*strings, otherwise)


def subset(payload: Column, keys: Sequence[str]) -> Column:
    """An object's members of the keys that it has, in canonical JSON."""

    def run(payload: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                held = None if text is None else json.loads(text)
            except ValueError:
                held = None
            if not isinstance(held, dict):
                return None
            return json.dumps({k: held[k] for k in keys if k in held}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

        return payload.map(one)

    return F.pandas_udf(run, "string")(payload)


def replaced(payload: Column, members: Column) -> Column:
    """An object in which the members of another one stand for its own, in canonical JSON; as it is where the other is null."""

    def run(payload: pd.Series, members: pd.Series) -> pd.Series:
        def one(text: str | None, more: str | None) -> str | None:
            try:
                held = None if text is None else json.loads(text)
            except ValueError:
                held = None
            if not isinstance(held, dict):
                return None
            return json.dumps(held | json.loads(more or "{}"), sort_keys=True, ensure_ascii=False, separators=(",", ":"))

        return pd.Series([one(a, b) for a, b in zip(payload, members, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(payload, members)


def seal(payload: Column, own: str) -> Column:
    """The hash of the canonical JSON of an object in which its own hash field is null."""

    def run(payload: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                held = None if text is None else json.loads(text)
            except ValueError:
                held = None
            if not isinstance(held, dict):
                return None
            return json.dumps(held | {own: None}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

        return payload.map(one)

    return F.sha2(F.pandas_udf(run, "string")(payload).cast("binary"), 256)


#: Kinds of references and the prefixes of their ids.
REFERENCES = {"event": "EVT-", "fact": "FACT-", "inference": "INF-"}


def references(payload: Column, kinds: dict[str, str] | None = None) -> Column:
    """(kind, id) of all references anywhere in a payload, sorted: members named ``<kind>_id`` or ``<kind>_ids``, alone or after another word, and members whose
    name has ``fact_or_inference_id``, whose values tell their kind by prefix."""
    kinds = kinds or REFERENCES

    def run(payload: pd.Series) -> pd.Series:
        def texts(value: object) -> list[str]:
            return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str) and x]

        def one(text: str | None) -> list[dict]:
            try:
                todo = [json.loads(text)] if text is not None else []
            except ValueError:
                todo = []
            found: set[tuple[str, str]] = set()
            while todo:
                value = todo.pop()
                if isinstance(value, list):
                    todo.extend(value)
                elif isinstance(value, dict):
                    for name, member in value.items():
                        low = name.lower()
                        if "fact_or_inference_id" in low:
                            found.update((kind, x) for x in texts(member) for kind, prefix in kinds.items() if x.startswith(prefix))
                        else:
                            for kind in kinds:
                                many = f"_{low}".endswith(f"_{kind}_ids")
                                if many and isinstance(member, list) or f"_{low}".endswith(f"_{kind}_id") and isinstance(member, str):
                                    found.update((kind, x) for x in texts(member))
                        todo.append(member)
            return [{"kind": k, "id": x} for k, x in sorted(found)]

        return payload.map(one)

    return F.pandas_udf(run, "array<struct<kind: string, id: string>>")(payload)
