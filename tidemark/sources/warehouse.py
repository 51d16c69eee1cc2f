"""Parquet warehouse: explicit schemas, overwrite, keyed upsert, counts and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.reconcile import upsert

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(text: str) -> T.StructType:
    kinds = {"string": S, "long": L, "double": D, "boolean": B, "array<string>": T.ArrayType(S), "timestamp": T.TimestampType(), "date": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(" ") for x in text.split(", "))])


#: The columns of the warehouse's tables.
CASE = "record_id string, episode_id string, trade_date date, available_from timestamp, record_type string, training_target string, training_eligible boolean, payload_json string"
SCHEMAS = {
    name: _schema(text)
    for name, text in {
        "events": "event_id string, episode_id string, trade_date date, published_at timestamp, row_number long, title string, body string, source_id string, provenance_json string",
        "event_sources": "source_id string, event_id string, episode_id string, source_type string, uri string, content_sha256 string, excerpt string, observed_at timestamp",
        "research_episodes": "episode_id string, trade_date date, cutoff_at timestamp, available_from timestamp, execution_protocol_version string, outcome_coverage_status string, research_version string, lesson_count long, counterexample_count long, candidate_count long, eligibility_matrix_json string, provenance_json string",
        "event_ticker_edges": "source_kind string, record_id string, edge_id string, episode_id string, event_id string, ticker string, company_name string, relation_class string, confidence_label string, directly_mentioned boolean, provenance_json string",
        "market_memory": "claim_id string, episode_id string, trade_date date, available_from timestamp, status string, confidence_label string, statement string, mechanism string, support_episode_ids_json string, contradiction_episode_ids_json string",
        "predictions": "prediction_id string, trade_date date, cutoff_at timestamp, sealed_at timestamp, blind_artifact_sha256 string, candidate_count long, dominant_sector_count long",
        "record_provenance": "record_id string, episode_id string, record_type string, source_id string",
        "record_coverage": "episode_id string, record_type string, evidence_phase string, training_target string, record_count long, eligible_count long, ineligible_count long, audit_only_count long",
        "issuer_day_cases": f"{CASE}, issuer_day_case_id string, issuer_day_weight_group_id string, ticker string, company_name string, response_class string, attribution_status string, sample_weight double",
        "direct_event_cases": f"{CASE}, case_id string, issuer_day_case_id string, issuer_day_weight_group_id string, ticker string, company_name string, event_id string, observation_id string, candidate_decision string, response_class string, sample_weight double",
        "memory_claims": f"{CASE}, claim_id string, mechanism_id string, counterexample_id string, statement string",
        "research_questions": f"{CASE}, question_id string, question string, priority string",
        "error_cases": f"{CASE}, error_id string, error_type string, correction_mode string",
    }.items()
}


class Warehouse:
    """Tables below one folder. A table is a folder of numbered versions, of which the last that is complete counts: a writer that dies changes nothing. An empty table
    keeps its schema."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> tuple[object, list[str]]:
        """The file system, and the complete versions of a table, oldest first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = sorted(str(x.getPath()) for x in fs.listStatus(folder)) if fs.exists(folder) else []
        return fs, [x for x in paths if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]

    def path(self, name: str) -> str:
        """The version of a table that readers get."""
        versions = self._versions(name)[1]
        if not versions:
            raise FileNotFoundError(f"{self.root}/{name}")
        return versions[-1]

    def _commit(self, name: str, rows: DataFrame) -> None:
        """Writes the next version; the one before stays for those who read it, older ones go."""
        fs, versions = self._versions(name)
        number = int(versions[-1].rsplit("/", 1)[-1]) + 1 if versions else 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{number:010d}")
        for old in versions[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces a table in its declared columns; a missing column is null, an undeclared one an error."""
        schema = SCHEMAS.get(name, rows.schema)
        if extra := set(rows.columns) - set(schema.names):
            raise ValueError(f"{name} has no columns {sorted(extra)}")
        self._commit(name, rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(self.path(name))

    def upsert(self, name: str, incoming: DataFrame, *keys: str) -> None:
        """Replaces rows by key."""
        self._commit(name, upsert(self.read(name), incoming, *keys))

    def counts(self, *names: str) -> dict[str, int]:
        return {n: self.read(n).count() for n in names}

    def missing_columns(self, name: str) -> list[str]:
        held = set(self.spark.read.parquet(self.path(name)).columns)
        return [c for c in SCHEMAS[name].names if c not in held]
