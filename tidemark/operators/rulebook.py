"""Checks as data: a list of declared rules, run over their tables together.

Every table is read once: a row gives the findings of the rules on rows by themselves, and thin facts for the others: the keys that it has, those that it refers to, and
what it adds to a group. The facts are a written table; keys meet their references in one join, groups in one aggregation, however many rules there are.
Conditions and keys are SQL expressions over a table's columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.stages import Stages


@dataclass(frozen=True)
class Row:
    """A row is wrong ``when``."""

    check: str
    table: str
    when: str


@dataclass(frozen=True)
class Unique:
    """Rows of one key are wrong, if not null."""

    check: str
    table: str
    key: str


@dataclass(frozen=True)
class Refers:
    """A key that isn't null must be one of ``of`` = (table, key). With ``mine`` and ``theirs`` it is right only if both values agree: "same", or "not before" (mine, a time, is no
    earlier than theirs); a row without a partner is then no finding, nor is a null value, but for "same", where nulls agree with nulls only."""

    check: str
    table: str
    key: str
    of: tuple[str, str]
    mine: str | None = None
    theirs: str | None = None
    how: str = "same"


@dataclass(frozen=True)
class Total:
    """Rows of a key together are wrong ``when``, of n, total, least and most of ``value`` over the rows ``where``."""

    check: str
    table: str
    key: str
    value: str
    when: str
    where: str = "true"


@dataclass(frozen=True)
class Counted:
    """The number that a row claims must be that of the rows of ``of`` = (table, key) with its key; a null claim is wrong."""

    check: str
    table: str
    key: str
    claims: str
    of: tuple[str, str]


FACT = "struct<role:string, name:string, key:string, subject:string, text:string, number:double>"


def _fact(role: str, name: str, key: Column | None = None, subject: Column | None = None, text: Column | None = None, number: Column | None = None) -> Column:
    string = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.struct(F.lit(role).alias("role"), F.lit(name).alias("name"), string(key).alias("key"), string(subject).alias("subject"), string(text).alias("text"), (F.lit(None) if number is None else number).cast("double").alias("number"))


def _true(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def facts(rules: list, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(role, name, key, subject, text, number) of all rules: findings, keys, references, parts of groups, claims. One scan of each table that a rule names."""
    each: dict[str, list[Column]] = {t: [] for t in tables}
    spaces: dict[tuple[str, str], set[str]] = {}
    for r in rules:
        if isinstance(r, Unique):
            spaces.setdefault((r.table, r.key), set())
        elif isinstance(r, Refers):
            spaces.setdefault(r.of, set()).update([r.theirs] if r.theirs else [])
    for r in rules:
        subject = F.expr(tables[r.table][1])
        add = each[r.table].append
        if isinstance(r, Row):
            add(F.when(_true(r.when), _fact("found", r.check, None, subject)))
        elif isinstance(r, Refers):
            key, value = F.expr(r.key).cast("string"), None if r.mine is None else F.expr(r.mine)
            add(F.when(key.isNotNull(), _fact("asks", r.check, key, subject, value)))
        elif isinstance(r, Total):
            key = F.expr(r.key).cast("string")
            add(F.when(key.isNotNull() & _true(r.where), _fact("part", r.check, key, None, None, F.expr(r.value))))
        elif isinstance(r, Counted):
            add(F.when(F.expr(r.key).isNotNull(), _fact("claim", r.check, F.expr(r.key), subject, None, F.expr(r.claims))))
            key = F.expr(r.of[1])
            each[r.of[0]].append(F.when(key.isNotNull(), _fact("member", r.check, key)))
    for (table, key), values in spaces.items():
        # What others compare with stands beside the key as a JSON object.
        text = F.to_json(F.create_map(*[x for v in sorted(values) for x in (F.lit(v), F.expr(v).cast("string"))]), {"ignoreNullFields": "false"}) if values else None
        each[table].append(F.when(F.expr(key).isNotNull(), _fact("has", f"{table}.{key}", F.expr(key), None, text)))
    out = None
    for table, made in each.items():
        if made:
            rows = tables[table][0].select(F.explode(F.array_compact(F.array(*made))).alias("f")).select("f.*")
            out = rows if out is None else out.unionByName(rows)
    return out


def findings(rules: list, tables: dict[str, tuple[DataFrame, str]], stages: Stages | None = None) -> DataFrame:
    """(check_id, subject_id, detail): a row for each violation; no rows mean that all is well.

    tables: by name the rows and the expression that names one. subject_id is the row's name, or the key of rules on keys and groups. detail is the key that is missing or
    differs, null of rules on rows, and for totals and counts what was found. An expression that is null violates nothing.
    """
    if len({r.check for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    spark = next(iter(tables.values()))[0].sparkSession
    held = (stages or Stages(spark, "rules")).save(facts(rules, tables), "facts")
    row = lambda df, check, subject, detail: df.select(check.alias("check_id"), subject.cast("string").alias("subject_id"), detail.cast("string").alias("detail"))
    none = F.lit(None).cast("string")
    out = row(held.where("role = 'found'"), F.col("name"), F.col("subject"), none)
    mapping = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p]) if d else F.lit(None).cast("map<string,string>")
    refers = [r for r in rules if isinstance(r, Refers)]
    has = held.where("role = 'has'")
    # Counts alone are hashed; a string's maximum would have Spark sort the keys of all rows.
    unique = {f"{r.table}.{r.key}": r.check for r in rules if isinstance(r, Unique)}
    twice = has.where(F.col("name").isin(*unique)).groupBy("name", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(row(twice, mapping(unique)[F.col("name")], F.col("key"), F.col("n")))
    # Of keys that others refer to one row each, whoever has it; the largest text if it is there twice.
    referred = sorted({".".join(r.of) for r in refers})
    keys = has.where(F.col("name").isin(*referred)).groupBy("name", "key").agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("theirs"))
    if refers:
        space = mapping({r.check: ".".join(r.of) for r in refers})
        asks = held.where("role = 'asks'").select(F.col("name").alias("check_id"), space[F.col("name")].alias("name"), "key", "subject", "text")
        met = asks.join(keys, ["name", "key"], "left")
        theirs = F.from_json("theirs", "map<string,string>")[mapping({r.check: r.theirs for r in refers if r.theirs})[F.col("check_id")]]
        plain, same, late = ([r.check for r in refers if f(r)] for f in (lambda r: not r.mine, lambda r: r.mine and r.how == "same", lambda r: r.mine and r.how == "not before"))
        found, check = F.col("n").isNotNull(), F.col("check_id")
        wrong = (check.isin(*plain) & ~found) | (check.isin(*same) & found & ~F.col("text").eqNullSafe(theirs)) | (check.isin(*late) & found & F.coalesce(F.try_to_timestamp("text") < F.try_to_timestamp(theirs), F.lit(False)))
        out = out.unionByName(row(met.where(wrong), check, F.col("subject"), F.col("key")))
    totals, counted = [r for r in rules if isinstance(r, Total)], [r for r in rules if isinstance(r, Counted)]
    if totals:
        sums = held.where("role = 'part'").groupBy("name", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("total"), F.min("number").alias("least"), F.max("number").alias("most"))
        wrong = F.lit(False)
        for r in totals:
            wrong = F.when(F.col("name") == r.check, _true(r.when)).otherwise(wrong)
        out = out.unionByName(row(sums.where(wrong), F.col("name"), F.col("key"), F.col("n")))
    if counted:
        members = held.where("role = 'member'").groupBy("name", "key").agg(F.count(F.lit(1)).alias("m"))
        claims = held.where("role = 'claim'").join(members, ["name", "key"], "left")
        m = F.coalesce("m", F.lit(0))
        out = out.unionByName(row(claims.where(~F.coalesce(F.col("number") == m, F.lit(False))), F.col("name"), F.col("subject"), m))
    return out


def _named(table: str, rules: dict[str, str]) -> list[Row]:
    return [Row(check, table, when) for check, when in rules.items()]


#: What a forecast's files must hold: predictions, their candidates, the manifests and sources behind them, the records, and what is exported of those.
RULES = [
    *_named("predictions", {"PREDICTION_BLIND_HASH_MISSING": "coalesce(blind_sha256, '') = ''", "PREDICTION_WITHOUT_MANIFEST": "manifest_id IS NULL", "PREDICTION_ANALYSIS_PROVENANCE_MISSING": "NOT coalesce(has_provenance, false)", "PREDICTION_SEALED_AFTER_CUTOFF": "sealed_at > cutoff_at", "PREDICTION_SEALED_WITHOUT_HASH": "sealed_at IS NOT NULL AND blind_sha256 IS NULL"}),
    Unique("PREDICTION_ID_REPEATED", "predictions", "prediction_id"),
    Refers("PREDICTION_MANIFEST_MISSING", "predictions", "manifest_id", ("manifests", "manifest_id")),
    Refers("PREDICTION_MODE_DIFFERS", "predictions", "manifest_id", ("manifests", "manifest_id"), "mode", "mode"),
    Counted("PREDICTION_CANDIDATE_COUNT", "predictions", "prediction_id", "n_candidates", ("candidates", "prediction_id")),
    *_named("candidates", {"CANDIDATE_PROVENANCE_MISSING": "NOT coalesce(has_provenance, false)", "CANDIDATE_WITHOUT_ANCHOR": "n_events + n_records + n_urls = 0", "CANDIDATE_RANK_INVALID": "coalesce(rank, 0) < 1", "CANDIDATE_TICKER_INVALID": "coalesce(ticker, '') = ''", "CANDIDATE_CONFIDENCE_INVALID": "coalesce(confidence, -1) NOT BETWEEN 0 AND 1"}),
    Refers("CANDIDATE_PREDICTION_MISSING", "candidates", "prediction_id", ("predictions", "prediction_id")),
    Unique("CANDIDATE_RANK_REPEATED", "candidates", "concat(prediction_id, '/', rank)"),
    Unique("CANDIDATE_TICKER_REPEATED", "candidates", "concat(prediction_id, '/', ticker)"),
    Total("CANDIDATE_RANKS_WITH_GAPS", "candidates", "prediction_id", "rank", "least <> 1 OR most <> n"),
    *_named("manifests", {
        "MANIFEST_TRADE_DATE_MISSING": "trade_date IS NULL", "MANIFEST_CUTOFF_MISSING": "cutoff_at IS NULL", "MANIFEST_AS_OF_AFTER_CUTOFF": "as_of > cutoff_at", "MANIFEST_EXHAUSTIVE_COVERAGE": "mode = 'exhaustive' AND coalesce(accepted, -1) <> coalesce(swept, -2)", "MANIFEST_PRICE_ALLOWED_TOO_LATE": "price_through >= trade_date",
        "MANIFEST_PRICE_SNAPSHOT_LATE": "price_as_of > cutoff_at", "MANIFEST_PRICE_SNAPSHOT_MISSING": "price_as_of IS NULL", "MANIFEST_FILE_HASHES_MISSING": "coalesce(n_hashes, 0) = 0", "MANIFEST_BLIND_WEB_SEARCH": "mode = 'blind' AND coalesce(web_calls, -1) <> 0", "MANIFEST_BLIND_PRICE_ACCESS": "mode = 'blind' AND coalesce(price_calls, -1) <> 0",
        "MANIFEST_SWEPT_MORE_THAN_ACCEPTED": "swept > accepted", "MANIFEST_MODE_UNKNOWN": "coalesce(mode, '') NOT IN ('exhaustive', 'blind', 'sampled')",
    }),
    Unique("MANIFEST_ID_REPEATED", "manifests", "manifest_id"),
    Counted("MANIFEST_SOURCE_COUNT", "manifests", "manifest_id", "n_sources", ("sources", "manifest_id")),
    *_named("sources", {"SOURCE_URL_MISSING": "coalesce(url, '') = ''", "SOURCE_URL_INVALID": "url NOT LIKE 'http://%' AND url NOT LIKE 'https://%'", "SOURCE_AFTER_CUTOFF": "published_at > cutoff_at", "SOURCE_UNDATED_YET_BEFORE_CUTOFF": "before_cutoff AND published_at IS NULL", "SOURCE_PRECISION_UNKNOWN": "coalesce(time_precision, '') NOT IN ('datetime', 'date_only_end_of_day')", "SOURCE_HASH_INVALID": "coalesce(length(sha256), 0) <> 64", "SOURCE_SEEN_BEFORE_PUBLISHED": "observed_at < published_at"}),
    Unique("SOURCE_ID_REPEATED", "sources", "source_id"),
    Refers("SOURCE_MANIFEST_MISSING", "sources", "manifest_id", ("manifests", "manifest_id")),
    *_named("records", {"RECORD_TIME_MISSING": "available_from IS NULL", "RECORD_BEFORE_ITS_EPISODE": "available_from < episode_from", "RECORD_ELIGIBLE_UNTYPED": "eligible AND NOT coalesce(typed, false)", "RECORD_LABEL_QUALITY_INVALID": "quality NOT IN ('verified', 'quarantined', 'no_tradable_row')", "RECORD_PHASE_INVALID": "coalesce(phase, '') NOT IN ('BLIND', 'POSTMORTEM', 'AUDIT')"}),
    Unique("RECORD_ID_REPEATED", "records", "record_id"),
    *_named("exports", {"EXPORT_PROVENANCE_MISSING": "coalesce(source_hash, '') = ''", "EXPORT_PHASE_INVALID": "coalesce(phase, '') NOT IN ('BLIND', 'POSTMORTEM', 'AUDIT')", "EXPORT_SPLIT_INVALID": "coalesce(split, '') NOT IN ('train', 'validation', 'test')", "EXPORT_HINDSIGHT_FLAG": "phase = 'BLIND' AND coalesce(hindsight, true) OR phase = 'POSTMORTEM' AND NOT coalesce(hindsight, false)", "EXPORT_BLIND_MIXES_TASKS": "phase = 'BLIND' AND task = 'outcome'"}),
    Unique("EXPORT_EXAMPLE_REPEATED", "exports", "example_id"),
    Refers("EXPORT_RECORD_MISSING", "exports", "record_id", ("records", "record_id")),
    Refers("EXPORT_PHASE_DIFFERS", "exports", "record_id", ("records", "record_id"), "phase", "phase"),
    Total("EXPORT_GROUP_WEIGHTS", "exports", "group_id", "weight", "abs(total - 1) > 0.000001", "weight IS NOT NULL"),
    Refers("SUPPORT_RECORD_MISSING", "support", "record_id", ("records", "record_id")),
    Refers("SUPPORT_LATER_THAN_CLAIM", "support", "record_id", ("records", "record_id"), "known_at", "available_from", "not before"),
]
