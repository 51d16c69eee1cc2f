"""Import of bundles of records, many bundles at once: adapter, envelopes, loss audit, verdict, conflicts with what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import stable_id
from tidemark.functions.payload import first_string, payload_hash, replaced, spaced_json
from tidemark.operators.admission import admit  # noqa: F401  it belongs to the import

#: Members that name a record, first to last.
RECORD_IDS = ("record_id", "brain_delta_id", "issuer_day_case_id", "case_id", "blind_pair_id", "claim_id", "mechanism_id", "counterexample_id", "edge_id", "question_id", "error_id")
#: Record types by the phase that they have by default.
AUDIT_TYPES, BLIND_TYPES = ("memory_claim", "mechanism_memory", "counterexample", "research_question"), ("beneficiary_discovery_case",)
#: Reasons added to a record that isn't eligible.
INVALID, UNKNOWN = "known record_type payload failed typed validation; preserved as raw payload", "unknown record_type preserved as raw payload"
NO_PAIR, RAW_ONLY = "sealed_preference_pair_missing", "unsupported bundle version preserved as forward-compatible raw-only record"
PAIR_TYPE = "blind_leader_preference_pair"


def _string(payload: Column, *keys: str) -> Column:
    return first_string(payload, keys, F.lit(None).cast("string"))


def _is_true(payload: Column, key: str) -> Column:
    held = F.try_parse_json(payload)
    kind = F.schema_of_variant(F.try_variant_get(held, f"$.{key}", "variant"))
    return F.coalesce((kind == "BOOLEAN") & F.try_variant_get(held, f"$.{key}", "boolean"), F.lit(False))


def evidence_phase(payload: Column, record_type: Column, source_phase: bool = False) -> Column:
    """A record's phase: what it says, else by its type. With source_phase, what its member of that name contains goes first."""
    by_type = F.when(record_type.isin(*AUDIT_TYPES), "AUDIT").when(record_type.isin(*BLIND_TYPES), "BLIND").otherwise("POSTMORTEM")
    own = F.coalesce(_string(payload, "evidence_phase"), by_type)
    if not source_phase:
        return own
    said = F.upper(_string(payload, "source_phase"))
    return F.when(said.contains("POSTSEAL") | said.contains("OUTCOME"), "POSTMORTEM").when(said.contains("BLIND"), "BLIND").when(said.contains("AUDIT"), "AUDIT").otherwise(own)


def envelopes(records: DataFrame, kinds: dict[str, Column], payload: str = "payload", episode: str = "episode_id", raw_only: bool = False) -> DataFrame:
    """``records`` with the fields of their envelopes; all rows and columns stay, but for the payload, which is the normalised one.

    kinds: the known record types, each with the condition on the row under which its payload is valid. A record of another type, an invalid one, and an
    eligible preference pair without both sides are not eligible; the reason is appended to its own one and enters the normalised payload. With
    raw_only no record is eligible and no type is known. A payload that is no JSON object gives null hashes, and no id: nothing tells two of them apart.
    """
    text = F.col(payload)
    record_type = F.coalesce(F.nullif(F.get_json_object(text, "$.record_type"), F.lit("")), F.lit("unknown"))
    valid = F.lit(False)
    for name, rule in kinds.items():
        valid = F.when(record_type == name, F.coalesce(rule, F.lit(False))).otherwise(valid)
    gate = F.when(~record_type.isin(*kinds), UNKNOWN).when(~valid, INVALID) if kinds else F.lit(UNKNOWN)
    gate = F.lit(RAW_ONLY) if raw_only else gate
    sides = _string(text, "blind_preferred_ticker", "blind_preferred_candidate_id").isNotNull() & _string(text, "blind_rejected_ticker", "blind_rejected_candidate_id").isNotNull()
    pair = F.when(gate.isNull() & (record_type == PAIR_TYPE) & _is_true(text, "training_eligible") & ~sides, NO_PAIR)
    first = records.select("*", record_type.alias("record_type"), gate.alias("_gate"), pair.alias("_pair"), _string(text, "eligibility_reason").alias("_said"), F.sha2(spaced_json(text).cast("binary"), 256).alias("raw_payload_sha256"))
    changed = F.col("_gate").isNotNull() | F.col("_pair").isNotNull()
    parts = F.concat_ws("; ", "_said", "_gate", "_pair")
    more = F.when(changed, F.to_json(F.struct(F.lit(False).alias("training_eligible"), parts.alias("eligibility_reason"))))
    known = F.when(F.col("_gate").isNull(), "KNOWN_TYPED_PAYLOAD").otherwise("UNKNOWN_TYPED_PAYLOAD")
    second = first.select(
        *[c for c in first.columns if c not in (payload, "_gate", "_pair", "_said")],
        text.alias("_raw"),
        replaced(text, more).alias(payload),
        (_is_true(text, "training_eligible") & ~changed).alias("training_eligible"),
        F.when(changed, parts).otherwise(F.col("_said")).alias("eligibility_reason"),
        known.alias("typed_payload_status"),
    ).withColumn("normalized_payload_sha256", payload_hash(F.col(payload)))
    raw = F.col("_raw")
    return second.select(
        "*",
        first_string(raw, RECORD_IDS, F.when(F.col("normalized_payload_sha256").isNotNull(), stable_id("BRAIN", F.col(episode), F.col("record_type"), F.col("normalized_payload_sha256")))).alias("record_id"),
        evidence_phase(raw, F.col("record_type")).alias("evidence_phase"),
        F.coalesce(_string(raw, "status"), F.lit("raw_only" if raw_only else "tentative")).alias("status"),
        F.coalesce(_string(raw, "confidence_label"), F.lit("low")).alias("confidence_label"),
    ).drop("_raw")


def adapter(front: Column, manifest: Column, episode: Column, contract: Column, importable: Column, space: str) -> Column:
    """Which adapter takes a bundle, by the versions in its front matter, manifest and episode, all of the name space ``space``.

    contract: it has an ingest contract. importable: it has an episode, a date and records. The first that fits: v23-direct-ingest, v11, v10,
    legacy-v1, forward-compatible-raw-only if importable, quarantine.
    """
    front, manifest, episode = (F.nullif(c, F.lit("")) for c in (front, manifest, episode))
    version = F.coalesce(front, manifest, episode, F.lit("UNKNOWN_BUNDLE_VERSION"))
    last = lambda c: F.element_at(F.split(F.coalesce(c, F.lit("")), r"\."), -1)
    declared = version.startswith(f"{space}.research_bundle.")
    major = F.regexp_extract(last(manifest), r"^v(\d+)$", 1).try_cast("int")
    newer = lambda n: F.coalesce(manifest.startswith(f"{space}.bundle_manifest.") & (major > n), F.lit(False))

    def of(n: int) -> Column:
        return ~(declared & ~version.endswith(f".v{n}")) & ~newer(n) & F.array_contains(F.array(last(version), last(manifest), last(episode)), f"v{n}")

    is_ = lambda c, name: F.coalesce(c == f"{space}.{name}", F.lit(False))
    legacy = is_(version, "bundle_manifest.v1") | is_(version, "research_bundle.v1") | is_(manifest, "bundle_manifest.v1") | is_(episode, "research_episode.v1")
    direct = is_(version, "research_bundle.v11") & is_(manifest, "bundle_manifest.v23") & F.coalesce(contract, F.lit(False))
    chosen = F.when(direct, "v23-direct-ingest").when(of(11), "v11").when(of(10), "v10").when(legacy, "legacy-v1")
    return chosen.when(F.coalesce(importable, F.lit(False)), "forward-compatible-raw-only").otherwise("quarantine")


def import_loss(raw: DataFrame, normalised: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """A row for each bundle: whether its normalised records are its raw ones.

    Both: (bundle, line, record_id, record_type, eligible, sha). A raw record without an id makes the id sets incomparable: record_ids_match is null
    and the bundle doesn't pass. Hashes match if both have as many rows and no line has two hashes.
    """
    fields = [bundle, "line", "record_id", "record_type", "eligible", "sha"]
    rows = raw.select(*fields, F.lit(1).alias("r")).unionByName(normalised.select(*fields, F.lit(0).alias("r")))
    old, new = F.col("r") == 1, F.col("r") == 0
    count = lambda c: F.count_if(c)
    ids = rows.where("record_id is not null").groupBy(bundle, "record_id").agg(F.max("r").alias("hi"), F.min("r").alias("lo"))
    ids = ids.groupBy(bundle).agg(count(F.col("lo") == 1).alias("missing"), count(F.col("hi") == 0).alias("extra"))
    types = rows.groupBy(bundle, "record_type").agg(F.sum(F.when(old, 1).otherwise(-1)).alias("d")).groupBy(bundle).agg(F.max(F.abs("d")).alias("types"))
    lines = rows.groupBy(bundle, "line").agg(F.max(F.when(old, F.col("sha"))).alias("a"), F.max(F.when(new, F.col("sha"))).alias("b"))
    lines = lines.groupBy(bundle).agg(count(F.col("a") != F.col("b")).alias("hashes"))
    total = rows.groupBy(bundle).agg(
        count(old).alias("raw_records"), count(new).alias("normalised_records"), count(old & F.col("record_id").isNull()).alias("raw_without_id"), F.sum(F.when(F.col("eligible"), F.when(old, 1).otherwise(-1)).otherwise(0)).alias("eligible")
    )
    joined = total.join(types, bundle).join(lines, bundle).join(ids, bundle, "left")
    missing, extra = F.coalesce("missing", F.lit(0)), F.coalesce("extra", F.lit(0))
    out = joined.select(
        bundle, "raw_records", "normalised_records", "raw_without_id", missing.alias("missing"), extra.alias("extra"),
        F.when(F.col("raw_without_id") == 0, (missing == 0) & (extra == 0)).alias("record_ids_match"),
        (F.col("types") == 0).alias("type_counts_match"), (F.col("eligible") == 0).alias("eligible_count_matches"),
        ((F.col("hashes") == 0) & (F.col("raw_records") == F.col("normalised_records"))).alias("hashes_match"),
    )
    every = F.col("record_ids_match") & F.col("type_counts_match") & F.col("eligible_count_matches") & F.col("hashes_match")
    return out.withColumn("passed", F.coalesce(every, F.lit(False)))


#: What a bundle must pass, all of it.
CHECKS = (
    "record_count", "training_eligible_count", "block_hash", "hash_expectation", "source_reference", "payload_reference", "available_from", "outcome_label_quality",
    "typed_payload", "edge_cutoff_provenance", "edge_source_ledger_cutoff", "company_known_at", "company_known_at_backdated", "issuer_day_weights", "sample_weights", "import_loss",
)


def verdicts(bundles: DataFrame, findings: DataFrame, bundle: str = "bundle_id", checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """A row for each bundle: how many findings (bundle, check_id) each check has, ``unknown_checks`` of any other or no check, and passed if none has any."""
    each = [F.count_if(F.col("check_id") == c).alias(c) for c in checks]
    other = F.count_if(~F.coalesce(F.col("check_id").isin(*checks), F.lit(False))).alias("unknown_checks")
    found = bundles.select(bundle).distinct().join(findings.groupBy(bundle).agg(*each, other), bundle, "left").na.fill(0, [*checks, "unknown_checks"])
    return found.withColumn("passed", sum((F.col(c) for c in (*checks, "unknown_checks")), F.lit(0)) == 0)
