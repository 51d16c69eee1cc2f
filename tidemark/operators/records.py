"""Record queries over envelopes with schema-on-read payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import alias_values

#: The payload fields that may hold each logical field, in order, then the nested ones.
ALIASES = {
    "ticker": ("ticker", "candidate_ticker", "outcome_ticker", "chosen_leader_ticker", "rejected_candidate_tickers", "peer_universe", "blind_preferred_ticker", "blind_rejected_ticker", "outcome_winner_ticker", "missed_ticker", "corrected_ticker", "issuer_ticker"),
    "company_name": ("company_name", "entity_name", "name", "name_on_D", "candidate_company_name", "outcome_company_name", "chosen_leader_company_name", "blind_preferred_company_name", "blind_rejected_company_name", "outcome_winner_company_name", "missed_company_name", "corrected_company_name", "company_name_on_D", "issuer_company_name"),
    "theme_id": ("theme_id", "theme_ids", "candidate_theme_id", "missed_theme_ids", "missed_theme_id", "corrected_theme_ids", "corrected_theme_id"),
    "path_type": ("path_type", "candidate_lane", "candidate_path_type", "missed_path_type", "corrected_path_type"),
    "response_class": ("response_class", "candidate_response_class", "blind_response_class", "outcome_response_class"),
}
NESTED = {
    "ticker": (("D_outcome", "outcome", "issuer_day_outcome"), ("ticker", "code")),
    "company_name": (("D_outcome", "outcome", "issuer_day_outcome"), ("company_name", "company_name_on_D", "name")),
    "response_class": (("D_outcome", "outcome", "issuer_day_outcome"), ("response_class",)),
}
PATHS = {
    field: [f"$.{n}" for n in names] + [f"$.{o}.{i}" for outer, inner in [NESTED.get(field, ((), ()))] for o in outer for i in inner]
    for field, names in ALIASES.items()
}


def with_aliases(records: DataFrame, payload: str = "payload", fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Each logical field as an ordered distinct list, and its first value as a scalar."""
    fields = fields or PATHS
    lists = {f"{name}_list": alias_values(F.col(payload), paths) for name, paths in fields.items()}
    return records.withColumns(lists).withColumns({name: F.try_element_at(F.col(f"{name}_list"), F.lit(1)) for name in fields})


def one_of(column: Column, wanted: str | Sequence[str] | None) -> Column:
    """Equality or IN; nothing wanted, or an empty list, is no filter."""
    if wanted is None or not isinstance(wanted, str) and not list(wanted):
        return F.lit(True)
    return column == wanted if isinstance(wanted, str) else column.isin(*sorted(set(wanted)))


def query_records(records: DataFrame, *, record_type=None, ticker=None, company_name=None, theme_id=None, path_type=None, response_class=None, trade_date_from=None, trade_date_to=None, available_as_of=None, training_eligible: bool | None = None, limit: int = 20, **equal) -> DataFrame:
    """Filters that are given, all of them; then the order (trade_date, record_id); then the limit, which is never pushed below a filter."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    keep = one_of(F.col("record_type"), record_type)
    for name, value in equal.items():
        keep &= one_of(F.col(name), value)
    if training_eligible is not None:
        keep &= F.col("training_eligible") == training_eligible
    for bound, test in ((trade_date_from, F.col("trade_date").__ge__), (trade_date_to, F.col("trade_date").__le__)):
        if bound is not None:
            keep &= test(F.lit(bound))
    if available_as_of is not None:
        keep &= F.col("available_from") <= F.lit(available_as_of).cast(records.schema["available_from"].dataType)
    for name, value in (("ticker", ticker), ("company_name", company_name), ("theme_id", theme_id), ("path_type", path_type), ("response_class", response_class)):
        if value is not None:
            keep &= F.array_contains(f"{name}_list", value)
    return records.where(keep).orderBy("trade_date", "record_id").limit(limit)


def coverage(records: DataFrame, eligible: Column, audit_only: Column, *by: str, target: str) -> DataFrame:
    """Counts by group; a null or empty target is UNKNOWN."""
    named = F.coalesce(F.nullif(F.col(target), F.lit("")), F.lit("UNKNOWN")).alias(target)
    return records.groupBy(*by, named).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(eligible).alias("n_eligible"), F.count_if(~F.coalesce(eligible, F.lit(False))).alias("n_ineligible"), F.count_if(audit_only).alias("n_audit_only"))


def stats(records: DataFrame, *dimensions: str, distinct: str | None = None) -> DataFrame:
    """Counts by each dimension alone, in one pass: (dimension, value, n_rows)."""
    sets = [[F.col(d)] for d in dimensions]
    out = records.groupingSets(sets, *dimensions).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n_rows"), *([F.count_distinct(distinct).alias("n_distinct")] if distinct else []))
    top = len(dimensions)
    name = F.coalesce(*[F.when(F.col("_set") == (1 << top) - 1 - (1 << (top - 1 - i)), F.lit(d)) for i, d in enumerate(dimensions)])
    value = F.coalesce(*[F.when(F.col("_set") == (1 << top) - 1 - (1 << (top - 1 - i)), F.col(d).cast("string")) for i, d in enumerate(dimensions)])
    return out.select(name.alias("dimension"), value.alias("value"), "n_rows", *(["n_distinct"] if distinct else []))


def provenance(records: DataFrame, sources: str, *keys: str, name: str = "source_id") -> DataFrame:
    """A row for each source of each record."""
    return records.select(*keys, F.explode(sources).alias(name))


def accepted(records: DataFrame, manifests: DataFrame, key: str = "episode_id") -> DataFrame:
    """Records of episodes that no manifest rejects; without a manifest an episode is accepted."""
    return records.join(manifests.where("accepted = false").select(key).distinct(), key, "left_anti")


def route(records: DataFrame, routes: dict[str, Sequence[str]], default: str, column: str = "record_type") -> DataFrame:
    """A row for each category that takes the record's type; ``default`` takes every record."""
    table = F.create_map(*[x for k, v in routes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(table[F.col(column)], F.array().cast("array<string>"))
    return records.withColumn("category", F.explode(F.array_distinct(F.concat(own, F.array(F.lit(default))))))
