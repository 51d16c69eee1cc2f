"""All queries of the engine and their oracle SQL."""

from tidemark.plans import checks, imports, ingest, market, records, rules, texts  # noqa: F401  they register their queries
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
