"""Audits as queries: each check returns the rows that violate it, as (check_id, subject_id, detail); passed means no rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import has_key, payload_hash
from tidemark.stages import Stages

#: Label qualities and edge origins that the rules name.
QUALITIES = ("verified", "quarantined", "no_tradable_row")
FORBIDDEN_ORIGINS = ("AFTER_CUTOFF_SOURCE", "OUTCOME_ONLY_ASSOCIATION")


#: Rows of one task where rows are told apart by key.
ROWS = 1_000_000


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by a hash of their keys in as many parts as their number asks for, so that what a task holds does not grow with the table."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS))
    return rows.repartition(parts, *keys)


def finding(rows: DataFrame, check: str, subject: str | Column, detail: Column | None = None) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(F.lit(check).alias("check_id"), subject.cast("string").alias("subject_id"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def union(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def violated(rows: DataFrame, check: str, subject: str, rule: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which the rule is true; null is no violation."""
    return finding(rows.where(F.coalesce(rule, F.lit(False))), check, subject, detail)


def duplicate(rows: DataFrame, check: str, *keys: str) -> DataFrame:
    found = _dealt(rows.select(*keys), *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return finding(found, check, F.concat_ws("|", *keys), F.col("n"))


def missing(references: DataFrame, known: DataFrame, check: str, subject: str, key: str) -> DataFrame:
    asked = _dealt(references.select(subject, key), subject, key).distinct()
    return finding(asked.join(_dealt(known.select(key), key).distinct(), key, "left_anti"), check, subject, F.col(key))


def recount(stored: DataFrame, actual: DataFrame, check: str, key: str, value: str) -> DataFrame:
    """Stored counts that differ from counted ones, either side lacking a key included."""
    joined = stored.select(key, F.col(value).alias("_s")).join(actual.select(key, F.col(value).alias("_a")), key, "full_outer")
    return finding(joined.where(~F.col("_s").eqNullSafe(F.col("_a"))), check, key, F.concat_ws("/", F.col("_s").cast("string"), F.col("_a").cast("string")))


def weights(rows: DataFrame, check: str, weight: Column, *keys: str) -> DataFrame:
    from tidemark.operators.weights import sum_check

    return finding(sum_check(rows, weight, *keys), check, F.concat_ws("|", *keys), F.col("weight_sum"))


def record_store(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Checks of the record store. records: record_id, typed_payload_status, training_eligible, payload, normalized_payload_sha256, provenance_source_ids; ledger: source_id."""
    eligible = F.coalesce("training_eligible", F.lit(False))
    exploded = records.select("record_id", F.explode("provenance_source_ids").alias("source_id"))
    quality = F.get_json_object("payload", "$.label_quality")
    return union(
        duplicate(records, "DUPLICATE_RECORD_ID", "record_id"),
        violated(records, "UNKNOWN_TYPED_PAYLOAD_ELIGIBLE", "record_id", eligible & (F.col("typed_payload_status") == "UNKNOWN_TYPED_PAYLOAD")),
        violated(records, "PAYLOAD_HASH_MISMATCH", "record_id", ~payload_hash(F.col("payload")).eqNullSafe(F.col("normalized_payload_sha256"))),
        violated(records, "ELIGIBLE_WITHOUT_PROVENANCE", "record_id", eligible & (F.size(F.coalesce("provenance_source_ids", F.array().cast("array<string>"))) == 0)),
        violated(records, "INVALID_LABEL_QUALITY", "record_id", has_key(F.col("payload"), "label_quality") & ~F.coalesce(quality.isin(*QUALITIES), F.lit(False)), quality),
        missing(exploded, ledger, "PROVENANCE_SOURCE_MISSING", "record_id", "source_id"),
    )


def edges(rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """Eligible edges of a forbidden origin, or without any source both verified and from before the cutoff."""
    origin = F.upper(F.col("origin"))
    bad = origin.isin(*FORBIDDEN_ORIGINS) | origin.contains("OUTCOME_ONLY") | ~F.coalesce("time_verified", F.lit(False)) | ~F.coalesce("available_before_cutoff", F.lit(False))
    good = provenance.where("verified and before_cutoff").select("record_id").distinct()
    return union(violated(rows, "FORBIDDEN_EDGE", "record_id", F.col("training_eligible") & bad), finding(rows.where("training_eligible").join(good, "record_id", "left_anti"), "EDGE_WITHOUT_VALID_SOURCE", "record_id"))


def exported(rows: DataFrame, skipped: DataFrame, source: DataFrame, key: str = "record_id") -> DataFrame:
    """Exported ids: repeated, outside the source, skipped as well; sources neither exported nor skipped; skipped ids outside the source."""
    return union(
        duplicate(rows, "EXPORTED_TWICE", key),
        finding(rows.join(source, key, "left_anti"), "EXPORTED_OUTSIDE_SOURCE", key),
        finding(rows.join(skipped, key, "left_semi"), "EXPORTED_AND_SKIPPED", key),
        finding(source.join(rows, key, "left_anti").join(skipped, key, "left_anti"), "NEITHER_EXPORTED_NOR_SKIPPED", key),
        finding(skipped.join(source, key, "left_anti"), "SKIPPED_OUTSIDE_SOURCE", key),
    )


def phases(rows: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows of an unknown phase, blind rows with hindsight, and postmortem rows that claim none."""
    safe = F.coalesce("hindsight_safe", F.lit(False))
    bad = F.when(F.col("phase") == "BLIND", ~safe).when(F.col("phase") == "POSTMORTEM", safe).otherwise(True)
    return union(violated(rows, "PHASE", key, bad, F.col("phase")), violated(rows, "BASIS_NOT_SATISFIED", key, ~F.coalesce("basis_satisfied", F.lit(False))))


def price_scope(rows: DataFrame, key: str) -> DataFrame:
    """Price reads allowed through the trade date or later, or snapshots from after the cutoff."""
    return union(violated(rows, "PRICE_ALLOWED_TOO_LATE", key, F.col("allowed_through") >= F.col("trade_date")), violated(rows, "PRICE_SNAPSHOT_AFTER_CUTOFF", key, F.col("as_of") > F.col("cutoff_at")))


#: Beginnings of lines that say how a file was made, not what is in it.
MADE_BY = ("# ", "Brain version:", "Build mode:", "Provider:", "Model:", "Category:", "Source record count:", "Accepted episodes covered:")


def twins(files: DataFrame, path: str, content: str, ignored: tuple[str, ...] = MADE_BY) -> DataFrame:
    """Files that are equal, or equal but for blank lines, margins and lines that begin with one of ``ignored``: a row for each such file.

    detail: the first path of its group. Groups of any size stay rows, none becomes a list.
    """
    lines = F.split(F.col(content), r"\r\n|\r|\n")
    kept = F.filter(lines, lambda x: (F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "") & ~F.coalesce(*[F.when(x.startswith(i), F.lit(True)) for i in ignored], F.lit(False)))
    body = F.array_join(F.transform(kept, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))), "\n")
    # Texts are read and hashed once; what meets then is a table of hashes.
    hashes = files.select(F.col(path).alias("path"), *[F.sha2(x.cast("binary"), 256).alias(c) for c, x in (("whole", F.col(content)), ("body", body))])
    hashes, out = Stages(files.sparkSession, "twins").save(hashes, "hashes"), []
    for check, text in (("IDENTICAL_FILES", "whole"), ("IDENTICAL_BODIES", "body")):
        hashed = hashes.select("path", F.col(text).alias("h"))
        groups = hashed.groupBy("h").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(finding(hashed.join(groups, "h"), check, F.col("path"), F.col("first")))
    return union(*out)


def id_list(listed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Ids that a manifest lists twice, lists though they are not expected, or lacks; blank and null ones are no ids."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    real, wanted = listed.where(~blank), expected.select(key).distinct()
    return union(
        finding(listed.where(blank), "LISTED_BLANK", key),
        duplicate(real, "LISTED_TWICE", key),
        finding(real.select(key).distinct().join(wanted, key, "left_anti"), "LISTED_UNEXPECTED", key),
        finding(wanted.join(real, key, "left_anti"), "NOT_LISTED", key),
    )


#: The one kind of preference row, and its modes by whether the blind preference was right.
PREFERENCE, MODES = "blind_leader_preference_pair", {True: "positive_preference", False: "correction"}


def preferences(rows: DataFrame, key: str = "record_id") -> DataFrame:
    """Preference rows: another kind; else tickers or winner blank, a flag that is null, an unknown mode, a mode that contradicts the flag.

    rows: key, record_type, preferred, rejected, winner, correct, mode.
    """
    pair = rows.where(F.col("record_type").eqNullSafe(F.lit(PREFERENCE)))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    known = F.coalesce(F.col("mode").isin(*MODES.values()), F.lit(False))
    fits = F.col("mode") == F.when(F.col("correct"), MODES[True]).otherwise(MODES[False])
    return union(
        finding(rows.where(~F.col("record_type").eqNullSafe(F.lit(PREFERENCE))), "NOT_A_LEADER_PAIR", key),
        *[violated(pair, f"{c.upper()}_MISSING", key, blank(c)) for c in ("preferred", "rejected", "winner")],
        violated(pair, "CORRECT_INVALID", key, F.col("correct").isNull()),
        violated(pair, "MODE_INVALID", key, ~known),
        violated(pair, "MODE_CONTRADICTS", key, known & F.col("correct").isNotNull() & ~fits),
    )


def multiset(stored: DataFrame, derived: DataFrame, check: str, key: str) -> DataFrame:
    """Rows that one side has more often than the other."""
    return union(finding(stored.exceptAll(derived), f"{check}_UNEXPECTED", key), finding(derived.exceptAll(stored), f"{check}_MISSING", key))


def known_times(rows: DataFrame, key: str = "record_id", known: str = "known_at", available: str = "available_from") -> DataFrame:
    """Times, as text, at which something was known: unreadable or without an offset; or before it was available."""
    given = rows.where(F.coalesce(F.col(known), F.lit("")) != "")
    time = F.when(F.col(known).rlike(r"([+-]\d{2}:?\d{2}|Z)$"), F.try_to_timestamp(F.col(known)))
    return union(violated(given, "KNOWN_AT_INVALID", key, time.isNull(), F.col(known)), violated(given, "KNOWN_AT_BACKDATED", key, time < F.col(available)))


def mechanisms(rows: DataFrame, accepted: DataFrame, key: str = "mechanism_id") -> DataFrame:
    """Mechanisms without any case, without provenance, or with a success case that is no accepted episode. rows: key, successes, failures, sources; accepted: episode_id."""
    none = lambda c: F.size(F.coalesce(F.col(c), F.array())) == 0
    cases = rows.select(key, F.explode("successes").alias("episode_id"))
    return union(
        violated(rows, "MECHANISM_WITHOUT_CASES", key, none("successes") & none("failures")),
        violated(rows, "MECHANISM_WITHOUT_PROVENANCE", key, none("sources")),
        missing(cases, accepted, "MECHANISM_CASE_UNKNOWN", key, "episode_id"),
    )


def bundle_rows(rows: DataFrame, ledger_rows: DataFrame, ledger_events: DataFrame, predicted: DataFrame) -> DataFrame:
    """A bundle's row dispositions (row_number, event_id) against what refers to them: (source_id, row_number), (source_id, event_id), (prediction_id, event_id)."""
    return union(
        duplicate(rows, "ROW_NUMBER_TWICE", "row_number"),
        missing(ledger_rows, rows, "LEDGER_ROW_UNKNOWN", "source_id", "row_number"),
        missing(ledger_events, rows, "LEDGER_EVENT_UNKNOWN", "source_id", "event_id"),
        missing(predicted, rows, "PREDICTED_EVENT_UNKNOWN", "prediction_id", "event_id"),
    )


def raw_lines(records: DataFrame, blocks: DataFrame, key: str = "record_id") -> DataFrame:
    """Records (key, block, source_line, raw_sha256) whose line of a block (block, text) is missing, no object, or has another hash. Lines that are blank aren't counted."""
    from tidemark.functions.payload import spaced_json

    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    each = blocks.select("block", F.posexplode(lines).alias("_n", "_line")).select("block", (F.col("_n") + 1).alias("source_line"), "_line")
    joined = records.join(each, ["block", "source_line"], "left")
    kind = F.schema_of_variant(F.try_parse_json(F.col("_line")))
    object_ = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return union(
        violated(joined, "RAW_LINE_MISSING", key, F.col("_line").isNull()),
        violated(joined, "RAW_LINE_NO_OBJECT", key, F.col("_line").isNotNull() & ~object_),
        violated(joined, "RAW_HASH_MISMATCH", key, object_ & ~F.sha2(spaced_json(F.col("_line")).cast("binary"), 256).eqNullSafe(F.col("raw_sha256"))),
    )


def gate(findings: DataFrame, most: int = 20) -> None:
    """Raises with the first findings if there are any."""
    rows = findings.orderBy("check_id", "subject_id").limit(most).collect()
    if rows:
        raise ValueError("; ".join(f"{r['check_id']}:{r['subject_id']}" for r in rows))
