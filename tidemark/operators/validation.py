"""The conditions that a bundle of records must meet, each computed from the bundle's own tables; ``imports.verdicts`` counts what is found here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import variants as V
from tidemark.functions.payload import references
from tidemark.operators.audits import FORBIDDEN_ORIGINS, QUALITIES
from tidemark.operators.direct_ingest import ALIASES, DIRECT, ISSUER, TARGETS
from tidemark.stages import Stages

#: Record types whose payloads have a model, beside those that ALIASES and TARGETS name.
TYPES = (
    *dict.fromkeys([*ALIASES, *TARGETS]), "supervised_theme_formation_case", "beneficiary_discovery_case", "candidate_ranking_error_case", "row_disposition_error_case", "entity_resolution_error_case",
    "memory_claim", "mechanism_memory", "counterexample", "event_ticker_edge", "company_memory_delta", "research_question",
)
#: What members hold by their names; other members may hold anything. Only what is no list, object or map may be null.
TEXTS = ("ticker", "company_name", "theme_id", "path_type", "event_id", "case_id", "issuer_day_case_id", "issuer_day_weight_group_id", "response_class", "label_quality", "attribution_status", "lesson", "name", "candidate_lane", "error_id", "error_type", "correction_mode", "chosen_leader_ticker", "blind_preferred_ticker", "blind_rejected_ticker", "outcome_winner_ticker")
LISTS = ("event_ids", "observation_ids", "fact_ids", "inference_ids", "source_fact_ids", "blind_fact_ids", "blind_inference_ids", "blind_candidate_ids", "peer_universe", "rejected_candidate_tickers", "matched_screening_ids", "correction_record_ids", "source_candidate_ids")
NUMBERS, FLAGS, OBJECTS, WEIGHTS = ("sample_weight", "outcome_high_return_pct"), ("fact_entailment_verified", "cross_event_leak_verified", "blind_preference_correct", "upper_limit_touched", "no_catalyst_asserted"), ("D_outcome", "outcome"), "event_level_weights"
#: Types with rules of their own.
EDGE, DELTA, FRACTIONAL = "event_ticker_edge", "company_memory_delta", "fractional_issuer_day_group"
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(F.regexp_extract(V.kind(value), r"^[A-Z]+", 0).isin(*kinds), F.lit(False))


def fits_model(m: Column) -> Column:
    """Whether the members of a record whose type has a model are of the kinds that their names call for. Numbers and flags may come as text, as the import reads them."""
    null = lambda c: c.isNull() | _is(c, "VOID")
    text = lambda c: F.lower(F.try_variant_get(c, "$", "string"))
    number = lambda c: _is(c, "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN") | (_is(c, "STRING") & text(c).try_cast("double").isNotNull())
    flag = lambda c: _is(c, "BOOLEAN") | F.coalesce(text(c).isin("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n"), F.lit(False))
    listed = lambda c: _is(c, "ARRAY") & F.coalesce(F.size(V.strings(c)) == F.size(F.try_variant_get(c, "$", "array<variant>")), F.lit(False))
    rules = [null(m[n]) | _is(m[n], "STRING") for n in TEXTS] + [null(m[n]) | number(m[n]) for n in NUMBERS] + [null(m[n]) | flag(m[n]) for n in FLAGS]
    rules += [m[n].isNull() | listed(m[n]) for n in LISTS] + [m[n].isNull() | _is(m[n], "OBJECT") for n in OBJECTS]
    weights = m[WEIGHTS]
    rules.append(weights.isNull() | (_is(weights, "OBJECT") & F.forall(F.map_values(V.nested(weights)), number)))
    return F.forall(F.array(*rules), lambda x: x)


def _time(value: Column) -> Column:
    """A member's time; null if it isn't a string with one."""
    said = V.string(value)
    return F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(said))


def _facts(records: DataFrame, bundle: str) -> DataFrame:
    """Of each record what the conditions look at."""
    m = F.col("_m")
    rows = records.select(bundle, "line", "payload", V.members(F.col("payload")).alias("_m")).where("_m is not null")
    kind, eligible = V.string(m["record_type"]), V.is_true(m["training_eligible"])
    subject = F.coalesce(V.string(m["record_id"]), V.string(m["brain_delta_id"]), F.concat(F.lit("line:"), F.col("line").cast("string")))
    rows = rows.withColumns({"kind": kind, "eligible": eligible, "subject": subject, "known_at": V.string(m["known_at"])})
    token = lambda name: F.coalesce(F.upper(F.translate(F.trim(V.string(m[name])), "- ", "__")), F.lit(""))
    hindsight = lambda name: token(name).isin(*FORBIDDEN_ORIGINS) | token(name).contains("OUTCOME_ONLY")
    verified = (V.is_true(m["source_time_verified"]) | V.is_true(m["time_verified"])) & V.is_true(m["available_before_cutoff"])
    outcome = V.nested(m["D_outcome"])
    quality = lambda held: F.map_contains_key(held, "label_quality") & ~F.coalesce(V.string(held["label_quality"]).isin(*QUALITIES), F.lit(False))
    zoned = F.col("known_at").rlike(ZONED) & _time(m["known_at"]).isNotNull()
    from_zoned = F.coalesce(V.string(m["available_from"]).rlike(ZONED), F.lit(False))
    given = F.map_contains_key(m, "known_at") & ~_is(m["known_at"], "VOID") & ~F.coalesce(F.to_json(m["known_at"]) == '""', F.lit(False))
    weights = V.nested(m[WEIGHTS])
    numeric = F.forall(F.map_values(weights), lambda v: _is(v, "BIGINT", "DECIMAL", "DOUBLE"))
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, v: a + V.number(v))
    is_ = lambda name: F.coalesce(F.col("kind") == name, F.lit(False))
    wrong = {
        "available_from": F.map_contains_key(m, "available_from") & _time(m["available_from"]).isNull(),
        "outcome_label_quality": quality(m) | quality(outcome),
        "typed_payload": F.col("kind").isin(*TYPES) & ~fits_model(m),
        "edge_cutoff_provenance": is_(EDGE) & F.col("eligible") & (hindsight("edge_origin") | hindsight("source_kind") | ~verified),
        "company_known_at": is_(DELTA) & given & ~F.coalesce(zoned, F.lit(False)),
        "company_known_at_backdated": is_(DELTA) & F.coalesce(zoned, F.lit(False)) & from_zoned & (_time(m["known_at"]) < _time(m["available_from"])),
        "issuer_day_weights": is_(ISSUER) & F.col("eligible") & F.map_contains_key(m, WEIGHTS) & ~((F.size(weights) > 0) & numeric & (F.abs(total - 1.0) <= 0.000001)),
    }
    checks = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in wrong.items()]))
    day, ticker = F.coalesce(V.string(m["trade_date"]), F.lit("")), F.coalesce(V.string(m["ticker"]), F.lit(""))
    group = F.when(is_(ISSUER), F.concat_ws("|", day, ticker)).when(is_(DIRECT), F.coalesce(V.string(m["issuer_day_weight_group_id"]), V.string(m["issuer_day_case_id"]), F.concat_ws(":", day, ticker)))
    plain = ~F.coalesce(V.string(m["issuer_day_sample_weight_policy"]) == FRACTIONAL, F.lit(False))
    return rows.select(bundle, "line", "payload", "subject", "kind", "eligible", checks.alias("checks"), V.strings(m["provenance_source_ids"]).alias("sources"), F.when(F.col("eligible"), group).alias("group"), plain.alias("plain"), V.number(m["sample_weight"]).alias("weight"))


def bundle_findings(bundles: DataFrame, records: DataFrame, sources: DataFrame, definitions: DataFrame, blocks: DataFrame, expectations: DataFrame, declared: DataFrame | None = None, loss: DataFrame | None = None, bundle: str = "bundle_id") -> DataFrame:
    """(bundle_id, check_id, subject_id) of all conditions that ``imports.CHECKS`` names.

    bundles: (bundle_id, record_count, eligible_count), null where nothing is claimed. records: (bundle_id, line, payload). sources: the ledger (bundle_id, line, source_id, time_verified,
    available_before_cutoff), of which the last by line counts. definitions: (bundle_id, kind, id) of what payloads may refer to. blocks: (bundle_id, block, content). expectations: (bundle_id, block, position, sha256, embedded):
    an embedded hash goes before the others, of those the first by position. declared: (bundle_id, field, value) times of the bundle itself. loss: the result of ``imports.import_loss``. Payloads that
    are no object count as records and as nothing else.
    """
    held = Stages(records.sparkSession, "validate").save(_facts(records, bundle), "facts")
    found = lambda df, check, subject: df.select(bundle, (F.lit(check) if isinstance(check, str) else check).alias("check_id"), subject.cast("string").alias("subject_id"))
    out = found(held.select(bundle, "subject", F.explode("checks").alias("check")), F.col("check"), F.col("subject"))
    counts = records.groupBy(bundle).agg(F.count(F.lit(1)).alias("n")).join(held.groupBy(bundle).agg(F.count_if("eligible").alias("ne")), bundle, "left")
    claimed = bundles.select(bundle, "record_count", "eligible_count").join(counts, bundle, "left")
    for check, claim, n in (("record_count", "record_count", "n"), ("training_eligible_count", "eligible_count", "ne")):
        out = out.unionByName(found(claimed.where(F.col(claim).isNotNull() & (F.col(claim) != F.coalesce(n, F.lit(0)))), check, F.coalesce(n, F.lit(0))))
    named = held.select(bundle, "line", "subject", "kind", "eligible", F.explode_outer("sources").alias("source_id"))
    ledger = sources.where("source_id is not null and source_id <> ''").groupBy(bundle, "source_id").agg(F.max_by(F.coalesce("time_verified", F.lit(False)) & F.coalesce("available_before_cutoff", F.lit(False)), "line").alias("valid"))
    met = named.join(ledger, [bundle, "source_id"], "left")
    out = out.unionByName(found(met.where("source_id is not null and valid is null").select(bundle, "source_id").distinct(), "source_reference", F.col("source_id")))
    edges = met.where(F.col("eligible") & (F.col("kind") == EDGE)).groupBy(bundle, "line", "subject").agg(F.max(F.coalesce("valid", F.lit(False))).alias("valid"))
    out = out.unionByName(found(edges.where("not valid"), "edge_source_ledger_cutoff", F.col("subject")))
    refs = held.select(bundle, F.explode(references(F.col("payload"))).alias("r")).select(bundle, "r.kind", "r.id").distinct()
    out = out.unionByName(found(refs.join(definitions.select(bundle, "kind", "id").distinct(), [bundle, "kind", "id"], "left_anti"), "payload_reference", F.col("id")))
    groups = held.where("group is not null").groupBy(bundle, "kind", "group").agg(F.sum("weight").alias("total"), F.count_if("plain").alias("plain"), F.count(F.lit(1)).alias("n"), F.min_by("plain", "line").alias("first"))
    # Of cases of one company and day the first may be plain, later ones must share.
    twice = (F.col("kind") == ISSUER) & (F.col("plain") - F.col("first").cast("int") > 0)
    out = out.unionByName(found(groups.where(twice | (F.abs(F.col("total") - 1.0) > 0.000001)), "sample_weights", F.col("group")))
    wanted = expectations.where("sha256 is not null and sha256 <> ''").groupBy(bundle, "block").agg(F.max_by("sha256", F.when(F.col("embedded"), F.col("position"))).alias("own"), F.min_by("sha256", "position").alias("first"), F.max("embedded").alias("any"), F.min("sha256").alias("lo"), F.max("sha256").alias("hi"))
    out = out.unionByName(found(wanted.where("lo <> hi"), "hash_expectation", F.col("block")))
    hashed = blocks.select(bundle, "block", F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    want = F.when(F.col("any"), F.col("own")).otherwise(F.col("first"))
    out = out.unionByName(found(wanted.join(hashed, [bundle, "block"]).where(want != F.col("now")), "block_hash", F.col("block")))
    if declared is not None:
        bad = ~F.coalesce(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp("value").isNotNull(), F.lit(False))
        out = out.unionByName(found(declared.where(bad), "available_from", F.col("field")))
    if loss is not None:
        out = out.unionByName(found(loss.where(~F.coalesce("passed", F.lit(False))), "import_loss", F.lit("records")))
    return out
