"""Normalisation of records that come nested: flattening, aliases by record type, provenance from the bundle's ledgers, shared sample weights.

A record is a JSON object in which a member may stand for another one that is missing. What stands for what is a table (ALIASES), applied in one expression
over maps of variants; a member that is there counts even as null. No Python runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import variants as V
from tidemark.stages import Stages

#: Records of one task, which parses them.
ROWS = 200_000
#: Record types with shared weights, and members that an outcome is read from.
ISSUER, DIRECT = "supervised_issuer_day_case", "supervised_direct_event_case"
OUTCOME = {"ticker": "ticker", "company_name": "company_name", "outcome_high_return_pct": "high_return_pct", "outcome_close_return_pct": "close_return_pct", "outcome_high_return_rank": "high_return_rank", "upper_limit_touched": "upper_limit_touched"}
COMPANY = ("company_name", "entity_name", "name", "name_on_D")
#: Members of a record made before its outcome was known, and the sources that stand for those and for outcomes.
BLIND = ("blind_score", "blind_rank", "candidate_lane", "matched_screening_ids", "screening_id")
BLIND_SOURCE, OUTCOME_SOURCE = "SRC-BLIND-SNAPSHOT", "SRC-GOLD-REFERENCE"
#: What a type is a target of.
TARGETS = {
    ISSUER: "issuer_day_price_response", DIRECT: "direct_event_response", "theme_formation_case": "theme_formation_response", "blind_leader_preference_pair": "outcome_preferred_candidate",
    "candidate_generation_error_case": "candidate_generation_correction", "ranking_error_case": "candidate_ranking_correction", "negative_control_case": "negative_control_calibration",
    "newsless_or_unexplained_case": "newsless_outcome_calibration", "context_market_state_or_fact_case": "context_market_state_or_fact",
}
#: By type, the members that are missing and what stands for them (see _stand_ins).
ERROR = {"error_id": "audit", "error_type": "classification", "correction_mode": "classification"}
ALIASES = {
    ISSUER: {"issuer_day_weight_group_id": "group_known", "issuer_day_case_id": "record_or_group"},
    DIRECT: {"issuer_day_weight_group_id": "group_known", "issuer_day_case_id": "group", "case_id": "record"},
    "theme_formation_case": {"chosen_leader_ticker": "ticker", "chosen_leader_company_name": "company"},
    "blind_leader_preference_pair": {"blind_pair_id": "record", "blind_preferred_ticker": "ticker", "blind_preferred_company_name": "company", "outcome_winner_ticker": "ticker", "outcome_winner_company_name": "company", "blind_preference_correct": "verified"},
    "candidate_generation_error_case": ERROR | {"missed_ticker": "ticker", "missed_company_name": "company"},
    "ranking_error_case": ERROR | {"corrected_ticker": "ticker", "corrected_company_name": "company"},
    "negative_control_case": {"candidate_ticker": "ticker", "candidate_company_name": "company"},
}
AUDIT_TYPES, BLIND_TYPE = ("memory_claim", "mechanism_memory", "counterexample", "research_question"), "beneficiary_discovery_case"


def _or_null(value: Column) -> Column:
    """A variant that is null where there is no value."""
    return F.coalesce(value, V.null())


def _stand_ins(held: Column) -> dict[str, Column]:
    """The values that ALIASES names, of the columns that ``_read`` gives; one that is SQL null sets nothing."""
    ticker, day, record, company = F.col("_ticker"), F.col("_day"), F.col("_record"), F.col("_company")
    group, known = F.concat_ws(":", day, ticker), ticker.isNotNull() & day.isNotNull()
    as_member = lambda c: _or_null(V.text(c))
    return {
        "ticker": as_member(ticker),
        "company": as_member(company),
        "record": as_member(record),
        "group": as_member(F.when(known, group)),
        "group_known": V.text(F.when(known, group)),
        "record_or_group": as_member(F.coalesce(record, F.when(known, group))),
        "classification": _or_null(held["classification"]),
        "audit": F.coalesce(V.filled(held["audit_id"]), as_member(record)),
        "verified": F.when(F.map_contains_key(held, "pair_direction_verified"), V.is_true(held["pair_direction_verified"]).cast("variant")),
    }


def _phase(held: Column, kind: Column) -> Column:
    said = F.upper(V.string(held["source_phase"]))
    by_type = F.when(kind.isin(*AUDIT_TYPES), "AUDIT").when(kind == BLIND_TYPE, "BLIND").otherwise("POSTMORTEM")
    return F.when(said.contains("POSTSEAL") | said.contains("OUTCOME"), "POSTMORTEM").when(said.contains("BLIND"), "BLIND").when(said.contains("AUDIT"), "AUDIT").otherwise(by_type)


def _read(records: DataFrame, payload: str, held: str) -> DataFrame:
    """``records`` with the map ``held``: members of the nested payload stand beside those of the record, which go before; and what the rules read of it, each value read once."""
    own, inner, m = F.col("_own"), F.col("_inner"), F.col(held)
    rows = records.withColumn("_own", F.from_json(F.col(payload), V.MEMBERS)).withColumn("_own", V.named_once(own)).withColumn("_inner", V.nested(own["payload"]))
    rows = rows.withColumn(held, F.map_concat(own, F.map_filter(inner, lambda k, _: ~F.map_contains_key(own, k))))
    named = F.map_contains_key(m, "company_name")
    company = F.coalesce(*[V.string(inner[c]) for c in COMPANY])
    rows = rows.withColumns({"_company": F.when(named, V.string(m["company_name"])).otherwise(company), "_fact_ids": V.strings(m["fact_ids"]), "_fact_id": V.string(m["fact_id"]), "_source_fact_ids": V.strings(m["source_fact_ids"])})
    listed, more = F.col("_fact_ids"), F.array_distinct(F.concat(F.when(F.col("_fact_id").isNotNull(), F.array("_fact_id")).otherwise(V.no_strings()), "_source_fact_ids"))
    rows = rows.withColumn("_facts", F.concat(listed, F.array_except(more, listed)))
    has = lambda names: F.coalesce(*[F.nullif(F.map_contains_key(m, n), F.lit(False)) for n in names], F.lit(False))
    rows = rows.withColumns(
        {
            "_kind": V.string(m["record_type"]),
            "_ticker": V.string(m["ticker"]),
            "_day": V.string(m["trade_date"]),
            "_record": F.coalesce(V.string(m["brain_delta_id"]), V.string(m["record_id"])),
            "_lane": V.string(m["candidate_lane"]),
            "_named": V.references(m, "source_id", "source_ids"),
            "_listed": V.strings(m["provenance_source_ids"]),
            "_was_blind": has(BLIND),
            "_has_outcome": has(OUTCOME) | F.col("_company").isNotNull(),
            "_eligible": V.is_true(m["training_eligible"]),
            "_weight": V.number(m["sample_weight"]),
        }
    )
    asked = F.concat(V.references(m, "fact_id"), F.when(F.size("_facts") > 0, F.filter("_facts", lambda x: x != "")).otherwise(V.references(m, "fact_ids")), F.filter("_source_fact_ids", lambda x: x != ""), V.when_string(m["source_fact_ids"]))
    both = lambda kind, refs: F.transform(refs, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))
    rows = rows.withColumn("_asked", F.concat(both("fact", asked), both("row", V.references(m, "row_id", "matched_row_ids"))))
    shared = F.col("_kind").isin(ISSUER, DIRECT) & F.col("_eligible") & F.col("_ticker").isNotNull() & F.col("_day").isNotNull()
    return rows.withColumn("_shared", F.coalesce(shared, F.lit(False))).drop("_own", "_inner", "_fact_ids", "_fact_id", "_source_fact_ids")


def _aliases(held: Column) -> list[tuple[str, Column]]:
    """The members of ALIASES by the record's type. A stand-in that isn't there either makes the member null."""
    kind, values, out = F.col("_kind"), _stand_ins(held), []
    for name in dict.fromkeys(n for per in ALIASES.values() for n in per):
        value = F.lit(None).cast("variant")
        for stand_in in dict.fromkeys(per[name] for per in ALIASES.values() if name in per):
            types = [t for t, per in ALIASES.items() if per.get(name) == stand_in]
            value = F.when(kind.isin(*types), values[stand_in]).otherwise(value)
        out.append((name, value))
    return out


def flattened(records: DataFrame, payload: str, held: str) -> DataFrame:
    """``records`` with the map ``held`` of all members and, beside it, what joins and groups need: names and lists that several members may give are filled in, then ALIASES.

    Values are columns before the map is made of them, and the map is made once: a member that an expression over maps reads is read anew wherever it is named.
    """
    rows, m = _read(records, payload, held), F.col(held)
    named = F.when(F.map_contains_key(m, "company_name"), m["company_name"]).otherwise(V.text(F.col("_company")))
    outcome = V.listed([(to, named if name == "company_name" else m[name]) for name, to in OUTCOME.items()])
    rows = rows.withColumns({"_outcome": outcome, "_fact_list": F.when(F.size("_facts") > 0, F.to_variant_object("_facts"))})
    facts, outcome = F.col("_fact_list"), F.when(F.size("_outcome") > 0, F.to_variant_object(F.map_from_entries("_outcome")))
    lacking = [("company_name", V.text(F.col("_company"))), ("path_type", V.text(F.col("_lane"))), ("blind_fact_ids", facts), ("D_outcome", outcome), *_aliases(m)]
    rows = V.changed(rows, held, {"fact_ids": "_fact_list"}, lacking)
    return rows.drop("_company", "_lane", "_facts", "_outcome", "_fact_list")


def with_provenance(rows: DataFrame, facts: DataFrame, sources: DataFrame, bundle: str, line: str) -> DataFrame:
    """``_sources`` of a record: its own list, those that it names, those of its facts and of its rows by the bundle's ledgers; lacking any, the bundle's standing ones.

    A ledger that names a fact or a row twice gives the last by line. References travel without the record.
    """
    refs = rows.select(bundle, line, F.posexplode("_asked").alias("_at", "_r")).select(bundle, line, "_at", "_r.kind", "_r.ref")
    solid = lambda df, *names: df.where(" and ".join(f"{n} is not null and {n} <> ''" for n in names))
    known = solid(facts, "fact_id", "source_id").groupBy(bundle, F.lit("fact").alias("kind"), F.col("fact_id").alias("ref")).agg(F.max_by("source_id", "line").alias("source"))
    known = known.unionByName(solid(sources, "row_id", "source_id").groupBy(bundle, F.lit("row").alias("kind"), F.col("row_id").alias("ref")).agg(F.max_by("source_id", "line").alias("source")))
    found = refs.join(known, [bundle, "kind", "ref"]).groupBy(bundle, line).agg(F.array_sort(F.collect_list(F.struct("_at", "source"))).alias("_found"))
    standing = sources.groupBy(bundle).agg(F.max(F.col("source_id") == BLIND_SOURCE).alias("_blind"), F.max(F.col("source_id") == OUTCOME_SOURCE).alias("_gold"))
    rows = rows.join(found, [bundle, line], "left").join(standing, bundle, "left")
    named = F.array_distinct(F.concat("_named", F.coalesce(F.transform("_found", lambda x: x["source"]), F.array().cast("array<string>"))))
    rows = rows.withColumn("_own", F.concat("_listed", F.array_except(named, "_listed")))
    spare = F.when(F.col("_blind") & F.col("_was_blind"), F.array(F.lit(BLIND_SOURCE))).when(F.col("_gold") & F.col("_has_outcome"), F.array(F.lit(OUTCOME_SOURCE)))
    return rows.withColumn("_sources", F.when(F.size("_own") > 0, F.col("_own")).otherwise(spare)).drop("_own", "_found", "_blind", "_gold")


def with_weights(rows: DataFrame, bundle: str) -> DataFrame:
    """``_share``: eligible cases of a company and day share a weight of 1: those without one of their own share alike what the others leave."""
    keys = [bundle, "_kind", "_day", "_ticker", "_shared"]
    groups = rows.where("_shared").groupBy(*keys).agg(F.sum(F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(0.0)).alias("_given"), F.count_if(F.col("_weight") == 0).alias("_missing"))
    share = F.greatest(F.lit(0.0), 1.0 - F.col("_given")) / F.nullif(F.col("_missing"), F.lit(0))
    return rows.join(groups, keys, "left").withColumn("_share", F.when(F.col("_weight") == 0, share)).drop("_given", "_missing")


def normalised(records: DataFrame, facts: DataFrame, sources: DataFrame, payload: str = "payload", bundle: str = "bundle_id", line: str = "line") -> DataFrame:
    """``records`` with their payloads normalised, as JSON with members by name; all rows and other columns stay.

    records: (bundle, line, payload), a line a record. facts: (bundle, line, fact_id, source_id), sources: (bundle, line, source_id, row_id): the bundle's ledgers.
    A member that is there is never replaced, not even a null one, but for lists that are added to and weights of 0 that are shared out. A payload that is no object, or
    names a member twice, gives null. Payloads are parsed once: the flattened records are a written table, of which the joins with the ledgers and the groups read thin columns.
    """
    held, spark = "_held", records.sparkSession
    # A record takes far longer than its bytes let Spark expect: rows are dealt out before they are parsed.
    dealt = records.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(records.count() / ROWS)))
    rows = Stages(spark, "ingest").save(flattened(dealt, payload, held), "flat")
    rows = with_weights(with_provenance(rows, facts, sources, bundle, line), bundle)
    m, kind, own = F.col(held), F.col("_kind"), F.col("_shared")
    rows = rows.withColumn("_phase", _phase(m, F.coalesce(kind, F.lit("unknown"))))
    target = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])[kind]
    group, issuer = F.concat_ws(":", "_day", "_ticker"), own & (kind == ISSUER)
    case = F.when(kind == ISSUER, F.coalesce("_record", group)).otherwise(group)
    rows = rows.withColumns({"_listed_sources": F.to_variant_object("_sources"), "_shared_weight": F.when(own, F.col("_share").cast("variant")), "_policy": F.when(issuer, V.text(F.lit("fractional_issuer_day_group")))})
    over = {"provenance_source_ids": "_listed_sources", "sample_weight": "_shared_weight", "issuer_day_sample_weight_policy": "_policy"}
    lacking = [("training_target", _or_null(V.text(target))), ("evidence_phase", V.text(F.col("_phase"))), ("status", V.text(F.lit("supported"))), ("issuer_day_weight_group_id", F.when(own, V.text(group))), ("issuer_day_case_id", F.when(own, V.text(case)))]
    rows = V.changed(rows, held, over, lacking)
    return rows.withColumn(payload, V.to_text(m)).select(*records.columns)
